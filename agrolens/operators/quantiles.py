"""Exact medians per group, for several columns at once, at any group size.

Spark's exact ``median``/``percentile`` keeps every distinct value of a group
in one aggregation buffer, so a group holding a third of a 100 TB table would
land in a single task.  This operator finds the order statistics by histogram
refinement instead, with one algorithm whatever the size:

1. one partially aggregated pass gives ``n, min, max`` per group and column;
   wanted are the values at the 0-based ranks ``(n-1) div 2`` and ``n div 2``;
2. each pass counts the values between a column's current bounds in ``B``
   buckets (partially aggregated; at most B small rows per group and column).
   If the two ranks fall into different buckets, the lower bucket's largest
   and the upper one's smallest value are the answer; if their bucket holds
   one distinct value, that is; else the bucket's least and largest values are
   the next bounds.

Both bounds are values that occur, so every pass parts at least those two and
the search ends.  Buckets are equal steps of ``sign(x) * log1p(|x|)``, which
cannot overflow and spreads any range of doubles (infinities lie at the ends);
where the bounds differ by less than a millionth they are equal steps of x
itself.  The rows stay wide and never move: the small table of bounds is
joined to them, broadcast while it is small.  The median is
``(x[k1] + x[k2]) / 2``, as in pandas and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolens.session import materialize, release

#: Bounds of up to so many groups are broadcast; above, Spark picks the join.
BROADCAST_GROUPS = 50_000


def _place(v: str, lo: str, hi: str, buckets: int) -> Column:
    """Bucket of ``v`` between ``lo`` < ``hi``, monotone in v."""
    inf = "CAST('Infinity' AS DOUBLE)"
    t = lambda x: (f"(CASE WHEN {x} = {inf} THEN 1000D WHEN {x} = -{inf} THEN -1000D "  # noqa: E731
                   f"ELSE signum({x}) * log1p(abs({x})) END)")
    close = f"(abs({lo}) < {inf} AND abs({hi}) < {inf} AND {hi} / 2 - {lo} / 2 <= 5e-7 * greatest(abs({lo}), abs({hi})))"
    share = (f"CASE WHEN {close} THEN ({v} - {lo}) / ({hi} - {lo}) "
             f"WHEN {t(hi)} > {t(lo)} THEN ({t(v)} - {t(lo)}) / ({t(hi)} - {t(lo)}) ELSE CASE WHEN {v} = {lo} THEN 0D ELSE 1D END END")
    return F.expr(f"CAST(least(floor(({share}) * {buckets}), {buckets - 1}) AS INT)")


def column_medians(df: DataFrame, keys: list[str], cols: list[str], buckets: int = 1024, max_passes: int = 200) -> DataFrame:
    """Rows (keys, col, median) for every group and column with a value.

    NULL and NaN are no values; rows with a null key belong to no group.
    """
    if not cols:
        raise ValueError("no columns")
    base = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    if keys:
        base = base.dropna(subset=keys)
    at = range(len(cols))
    stats = base.groupBy(*keys).agg(*[e for i in at for e in (
        F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"a{i}"), F.max(f"v{i}").alias(f"z{i}"))])
    state = stats.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("lo"), F.col(f"z{i}").alias("hi")) for i in at])).alias("s"))
    half = "(lo + hi) / 2"
    # one or two values, or equal ends: the answer is there
    state = state.select(*keys, "s.*").where("n > 0").selectExpr(
        *keys, "c", "n", "lo", "hi", "CAST(0 AS BIGINT) AS below", f"CASE WHEN n <= 2 OR lo = hi THEN {half} END AS median")
    fields = [*keys, "c", "n", "lo", "hi", "below", "median"]
    state = materialize(state.select(*fields), "median-state")
    for _ in range(max_passes):
        open_ = state.where("median IS NULL")
        left = open_.agg(F.collect_set("c").alias("c")).first()["c"]  # at most one entry per column
        if not left:
            break
        bounds = open_.groupBy(*keys).agg(*[F.max(F.when(F.col("c") == i, F.struct("lo", "hi"))).alias(f"s{i}") for i in left])
        if keys:
            small = open_.select(*keys).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
            joined = base.join(F.broadcast(bounds) if small else bounds, on=keys)
        else:
            joined = base.crossJoin(F.broadcast(bounds))  # one row
        long = joined.select(*keys, F.explode(F.array(*[
            F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v"), F.col(f"s{i}.lo").alias("lo"), F.col(f"s{i}.hi").alias("hi"))
            for i in left])).alias("x")).select(*keys, "x.*").where("v >= lo AND v <= hi")
        hist = long.groupBy(*keys, "c", _place("v", "lo", "hi", buckets).alias("b")).agg(
            F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        by = Window.partitionBy(*keys, "c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        ranks = open_.select(*keys, "c", "n", "below")
        hist = hist.withColumn("before", F.coalesce(F.sum("k").over(by), F.lit(0))).join(ranks, on=[*keys, "c"])
        hist = hist.withColumn("before", F.col("before") + F.col("below"))
        holds = lambda r: f"before <= ({r}) AND ({r}) < before + k"
        low, high = holds("(n - 1) div 2"), holds("n div 2")
        found = hist.where(f"({low}) OR ({high})").groupBy(*keys, "c", "n").agg(
            F.count("*").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("below"),
            F.max(F.expr(f"CASE WHEN {low} THEN hi END")).alias("x1"), F.max(F.expr(f"CASE WHEN {high} THEN lo END")).alias("x2"))
        found = found.withColumn("median", F.expr(f"CASE WHEN parts = 2 THEN (x1 + x2) / 2 WHEN lo = hi THEN {half} END"))
        before = state
        state = materialize(state.where("median IS NOT NULL").select(*fields).unionByName(found.select(*fields)), "median-state")
        release(before)
    else:
        raise RuntimeError("column_medians did not settle")
    names = F.expr("CASE c " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(cols)) + " END")
    return state.select(*keys, names.alias("col"), "median")


def exact_medians(values: DataFrame, group_cols: list[str], value_col: str = "v", buckets: int = 1024) -> DataFrame:
    """``group_cols + [median]`` of one column for every group with a value."""
    return column_medians(values, list(group_cols), [value_col], buckets).select(*group_cols, "median")
