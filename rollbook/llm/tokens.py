"""Token ids of whole texts with the ``tokenizers`` library.

Words repeat far more often than texts do, so a text is cut where the tokenizer is sure to
cut, and each distinct part is encoded once for a worker process. The ids are exactly those
of the whole text; a text with white space that makes a cut doubtful is encoded as one.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re

import numpy as np

#: Distinct parts a worker remembers; parts beyond are encoded whenever they occur.
REMEMBERED = 450_000

#: Letters of Latin-1 followed by ASCII punctuation without the apostrophe.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

_encoders: dict[tuple[str, bool], Encoder] = {}


class Doubtful(Exception):
    """A part does not begin and end with visible characters."""


def _byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in visible else chr(spare))
        spare += b not in visible
    return out


_LETTERS = _byte_letters()


class _Parts(dict):
    """Part of a text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, words: bool) -> None:
        self.tokenizer, self.model, self.words = tokenizer, tokenizer.model, words
        self.bare: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self._split(part)
        if len(self) < REMEMBERED:
            self[part] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        """Ids of letters, or of signs, that the tokenizer never cuts before merging."""
        written = "".join([_LETTERS[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(written)], dtype="<u4").tobytes()

    def _bare(self, word: str) -> bytes:
        """The same without a space in front: signs after a word, words after a line feed."""
        ids = self.bare.get(word)
        if ids is None:
            ids = self._merged(word)
            if len(self.bare) < REMEMBERED // 8:
                self.bare[word] = ids
        return ids

    def _split(self, part: str) -> bytes:
        if self.words:
            plain = _PLAIN.fullmatch(part)
            if plain is None:
                return self._whole(part) if part else b""
            core, tail = plain[1].lower(), plain[2]
            if core == part:
                return self._merged(core)
            return self[core] + (self[tail] if tail else b"")
        begin = part[1:2] if part[:1] == "\n" else part[:1]
        if not begin or not _visible(begin) or not _visible(part[-1]):
            raise Doubtful
        if part[0] == "\n":
            plain = _PLAIN.fullmatch(part, 1)
            if plain is None:
                return self._whole(part)
            head = self._bare("\n") + self._bare(plain[1])
        else:
            plain = _PLAIN.fullmatch(part)
            if plain is None:
                return self._whole(" " + part)
            head = self[plain[1]] if plain[2] else self._merged(" " + part)
        return head + (self._bare(plain[2]) if plain[2] else b"")


def _visible(c: str) -> bool:
    return c.isprintable() and not c.isspace()


class Encoder:
    """Encodes whole texts.

    ``words`` is for vocabularies that drop white space (parts are cut at spaces and line
    feeds); otherwise for byte-level vocabularies in which a space begins the next word.
    Strings of special tokens in a text are ordinary text. Null counts as empty.
    """

    def __init__(self, path: str, words: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = words
        self.parts = _Parts(self.tokenizer, words)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get = self.parts.__getitem__
        if self.words:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        try:
            # A line feed in front gives the first word the same form as one after a line
            # feed; it is one id, which is cut off again.
            return b"".join(map(get, ("\n" + text.replace("\n", " \n")).split(" ")))[4:]
        except Doubtful:
            return self.parts._whole(text)


def encoder(path: str, words: bool) -> Encoder:
    """The encoder of this worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, words)
    return _encoders[key]


def forget() -> None:
    """Drop this worker process's encoders, which it would keep while it serves other steps."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory of this worker process to the system where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass
