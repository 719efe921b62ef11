"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times the mix should take it. Among all rates
that give each source its target number of tokens, those nearest to 1 in relative entropy
are exponential in the document's size, ``exp(lambda * size)`` up to a cap, with one
multiplier for each source. The multipliers solve the convex dual problem; Newton steps
for all sources at once are one aggregation over the table of (source, size, number of
documents), which is all that rates depend on. Rates are then rounded into copies.

All sums that decide anything are over integers, so reruns agree whatever the order in
which partial sums meet.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import session
from rollbook.llm.prefix import beside, in_order, prefix_sums, unfold

#: Rates are held in millionths.
UNIT = 1_000_000

#: Tables of up to so many sources are broadcast, so that a source with a large share of
#: all documents is not one join key; beyond, joins are shuffled and
#: adaptive execution splits the large source.
FEW_SOURCES = 50_000

_KEY = ["src_null", "src"]


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Token targets of sources, given one row (src_null, src, tokens, docs) for each.

    Sources sorted by code point, null last, get ``weights`` in turn; together they share
    all tokens. A target stops at ``cap`` times its source's tokens and the excess goes to
    the others by weight, until none is above.
    """
    ranked = prefix_sums(in_order(sources, [F.col(c) for c in _KEY], "mix-sources"), place=F.lit(1))
    each = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(each, (F.col("place_before") % len(weights) + 1).cast("int")))
    ranked = session.materialize(ranked.select(*_KEY, "tokens", "docs", "least", "weight"), "mix-weights")
    full = F.col("tokens") * F.lit(float(cap))
    level = 0.0
    while True:  # the level of the free sources only rises, so each turn fills at least one
        capped = F.col("weight") * F.lit(level) >= full
        r = ranked.agg(
            F.sum("tokens").alias("all"), F.sum(F.when(capped, full)).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("free"),
        ).first()
        if r["all"] is None or not r["free"]:
            level = math.inf
            break
        new = (r["all"] - (r["held"] or 0.0)) / r["free"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    # Rounded: a sum of doubles may come out differently in its last bits.
    return ranked.withColumn("target", F.round(F.least(full, F.col("weight") * F.lit(level)), 3) if math.isfinite(level) else full)


def rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    """Tilted rate in millionths, at most the cap."""
    raw = F.exp(F.least(multiplier * size / mean, F.lit(50.0)))
    return F.round(F.least(raw, F.lit(float(cap))) * UNIT).cast("long")


def multipliers(cells: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-5, most: int = 60) -> DataFrame:
    """Solve the dual: one multiplier for each source.

    ``cells`` has (src_null, src, size, n), sizes above 0. Newton steps are taken on the
    logarithm of the tokens; a step that leaves the bracket known so far is replaced by
    its middle, which makes convergence certain also where the cap bends the dual. A source
    that is not within ``tolerance`` after ``most`` steps is told in a warning.
    """
    mean = F.col("tokens") / F.col("docs")
    # With all rates capped a source gives cap times its tokens; with these others, less than its target.
    z = F.col("least") / mean
    low = (F.least(F.log(F.col("target") / F.col("tokens")), F.lit(0.0)) - 1) / z
    state = goals.filter("tokens > 0").select(
        *_KEY, "target", mean.alias("mean"), low.alias("lo"), (F.lit(math.log(cap) + 1e-9) / z).alias("hi"),
        F.when(F.col("target") >= F.col("tokens") * cap * (1 - 1e-9), F.lit(math.log(cap) + 1e-9) / z).otherwise(F.lit(0.0)).alias("m"),
    )
    state = session.materialize(state, "mix-state")
    for _ in range(most):
        r = rate(F.col("m"), F.col("size"), F.col("mean"), cap)
        weight = (F.col("n") * F.col("size")).cast("decimal(38,0)")
        slope = F.when(r < int(cap * UNIT), F.round(F.col("size") / F.col("mean") * r).cast("long")).otherwise(F.lit(0))
        sums = cells.join(state.select(*_KEY, "m", "mean"), _KEY).groupBy(*_KEY).agg(
            (F.sum(weight * r) / UNIT).cast("double").alias("got"), (F.sum(weight * slope) / UNIT).cast("double").alias("slope"),
        )
        new = state.join(sums, _KEY)
        off = F.abs(F.col("got") - F.col("target")) / F.col("target")
        lo = F.when(F.col("got") < F.col("target"), F.col("m")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") >= F.col("target"), F.col("m")).otherwise(F.col("hi"))
        step = F.col("m") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("got") > 0) & (step > lo) & (step < hi)
        m = F.when(off <= tolerance, F.col("m")).when(inside, step).otherwise((lo + hi) / 2)
        new = new.select(*_KEY, "target", "mean", lo.alias("lo"), hi.alias("hi"), m.alias("m"), off.alias("off"))
        state = session.materialize(new, "mix-state")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        warnings.warn(f"after {most} Newton steps a source is still {worst:.1e} of its target away", stacklevel=2)
    return state.select(*_KEY, "m", "mean")


def mix(df: DataFrame, source: Column, size: Column, weights: Sequence[float] = (1, 2, 3), cap: int = 3, repairs: int = 4) -> DataFrame:
    """Decide how often the mix takes each row; adds size, source_size, target, rate,
    copies and taken (``size * copies``).

    Copies are the rates rounded systematically along the sizes of a source, which misses
    a source's target by at most one document; ``repairs`` rounds then change the copies
    of the one document of a source that brings it nearest. No document is taken more
    than ``cap`` times. Rows of size 0 get rate 1. A null source is a source of its own,
    a null size is 0; repeated rows are separate documents. An empty table gives no rows.
    """
    rows = beside(
        df, src_null=source.isNull(), src=F.coalesce(source.cast("string"), F.lit("")), size=F.coalesce(size.cast("long"), F.lit(0)),
    )
    spread = F.xxhash64("row")
    ordered = in_order(rows.withColumn("spread", spread), [F.col(c) for c in (*_KEY, "size", "spread")], "mix-order")
    cells = ordered.groupBy(*_KEY, "size").agg(F.count("*").alias("n"))
    cells = session.materialize(cells, "mix-cells")
    sources = cells.groupBy(*_KEY).agg(
        F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    goals = session.materialize(targets(sources, weights, cap), "mix-goals")
    solved = multipliers(cells.filter("size > 0"), goals, cap)
    few = goals.count() <= FEW_SOURCES

    def to_all(by_source: DataFrame) -> DataFrame:
        return F.broadcast(by_source) if few else by_source

    rates = goals.join(solved, _KEY, "left")
    tilted = F.when(F.col("m").isNull() | (F.col("size") == 0), F.lit(UNIT)).otherwise(rate(F.col("m"), F.col("size"), F.col("mean"), cap))
    slim = ordered.select("at", *_KEY, "size").join(to_all(rates.select(*_KEY, "m", "mean", "tokens", "target")), _KEY)
    summed = prefix_sums(slim, tilt=tilted)
    starts = summed.groupBy(*_KEY).agg(F.min("tilt_before").alias("start"))
    upto = F.col("tilt_before") - F.col("start") + UNIT // 2
    copies = F.floor((upto + F.col("tilt")) / UNIT) - F.floor(upto / UNIT)
    counted = summed.join(to_all(starts), _KEY).select("at", *_KEY, "size", "tokens", "target", "tilt", copies.cast("int").alias("copies"))
    counted = session.materialize(counted, "mix-copies")
    changes = None
    for _ in range(repairs):
        changes = _repair(counted, changes, cap, to_all)
    counted = _changed(counted, changes)
    out = ordered.select("at", "row").join(counted, "at").select(
        "row", "size", F.col("tokens").alias("source_size"), "target", (F.col("tilt") / UNIT).alias("rate"),
        "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )
    return unfold(out, "size", "source_size", "target", "rate", "copies", "taken")


def _changed(counted: DataFrame, changes: DataFrame | None) -> DataFrame:
    if changes is None:
        return counted
    by_row = changes.groupBy("at").agg(F.sum("change").alias("change"))
    return counted.join(by_row, "at", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)).cast("int")).drop("change")


def _repair(counted: DataFrame, changes: DataFrame | None, cap: int, to_all: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One more change for each source that a single copy more or less brings nearer."""
    now = _changed(counted, changes)
    gaps = now.groupBy(*_KEY).agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    able = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    left = F.round(F.abs(F.abs(F.col("gap")) - F.col("size")), 3)
    better = (F.col("size") > 0) & able & (left < F.abs(F.col("gap")))
    best = now.join(to_all(gaps), _KEY).filter(better).groupBy(*_KEY).agg(F.min(F.struct(left.alias("left"), "at", F.signum("gap").cast("int").alias("change"))).alias("best"))
    new = best.select("best.at", "best.change")
    return session.materialize(new if changes is None else changes.unionByName(new), "mix-changes")
