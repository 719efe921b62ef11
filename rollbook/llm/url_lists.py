"""URL filters whose lists change over time.

Dated list entries become intervals in which a key is listed. A capture is tested against
the intervals that hold at its fetch day: an equi-join on key and time bucket, then the
range of days. Buckets split a host that holds a large share of all captures; the entries of
a key are first reduced to one for each day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook import session
from rollbook.llm.prefix import beside, unfold

#: Days in a time bucket.
BUCKET_DAYS = 16

_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_SEGMENT = "^[^:/?#]+://[^/?#]+/([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit("")))


def folder(url: Column) -> Column:
    """Host and first path segment; empty if there is no segment."""
    segment = F.coalesce(F.regexp_extract(url, _SEGMENT, 1), F.lit(""))
    return F.when((segment == "") | (host(url) == ""), F.lit("")).otherwise(F.concat(host(url), F.lit("/"), segment))


def depths(entries: DataFrame) -> list[int]:
    """Numbers of labels that the hosts of listed keys have, each once, for :func:`keys`.

    Few as a rule, and never more than the root of twice the characters of all keys.
    """
    labels = F.size(F.split(F.substring_index("key", "/", 1), "\\."))
    return sorted(r[0] for r in entries.filter("key is not null").select(labels).distinct().collect())


def keys(url: Column, labels: Sequence[int]) -> Column:
    """Keys that a listed key can equal: the last so many ``labels`` of the host, and the
    folder. A host is cut once for each number of labels, whatever its length.
    """
    name = host(url)
    names = [F.substring_index(name, ".", -n) for n in labels]
    return F.array_distinct(F.filter(F.array(*names, folder(url)), lambda k: k != ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, begins, ends) from dated entries (list, key, day, listed).

    An entry holds from its day until the next entry of the same list and key; ``ends`` is
    the first day it no longer holds, null if it still does. Of entries of one day, one that
    lists the key wins. Entries with a null in list, key, day or listed are ignored.
    """
    daily = entries.dropna(subset=["list", "key", "day", "listed"]).groupBy("list", "key", "day").agg(F.max("listed").alias("listed"))
    follows = Window.partitionBy("list", "key").orderBy("day")
    dated = daily.withColumn("ends", F.lead("day").over(follows))
    return dated.filter("listed").select("list", "key", F.col("day").alias("begins"), "ends")


def active(captures: DataFrame, url: Column, day: Column, entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Add ``lists``, the sorted names of lists with an entry that matches the URL and holds
    on ``day``, ``n_active``, the number of such entries, and ``blocked``.

    A listed host matches itself and all hosts below it, of any length. A null URL, one
    without a host, or a null day matches nothing. Repeated captures are tested each for itself. An empty list blocks nothing; an empty table gives no rows.
    """
    rows = beside(captures, url=url.cast("string"), day=day.cast("int")).withColumn("at", F.monotonically_increasing_id())
    rows = session.materialize(rows, "url-captures")
    span = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    # Only days on which something was fetched matter, which bounds the buckets of an interval.
    first, last = (span["first"], span["last"]) if span["first"] is not None else (0, -1)
    held = intervals(entries).withColumns({
        "low": F.greatest("begins", F.lit(first)), "high": F.least(F.coalesce("ends", F.lit(last + 1)), F.lit(last + 1)),
    }).filter("low < high")
    width = F.lit(bucket_days)
    cut = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    held = held.withColumn("bucket", F.explode(cut)).select("list", "key", "bucket", "low", "high")
    asked = rows.select("at", "day", F.explode(keys(F.col("url"), depths(entries))).alias("key")).filter("day is not null")
    asked = asked.withColumn("bucket", F.floor(F.col("day") / width))
    met = asked.join(held, ["key", "bucket"]).filter("low <= day and day < high")
    found = met.groupBy("at").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = rows.join(found, "at", "left").withColumns({"n_active": F.coalesce("n_active", F.lit(0)), "lists": F.coalesce("lists", F.lit(""))})
    return unfold(out.withColumn("blocked", F.col("n_active") > 0), "n_active", "lists", "blocked")
