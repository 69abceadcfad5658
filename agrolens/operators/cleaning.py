"""Cleaning and combining: median imputation (A04/A05), all-null-label drop
(P11), missing-value report (A09), lossless downcast plan (P20), union of
slices/regions (U01/U02)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.functions.values import rnd
from agrolens.operators.quantiles import column_medians
from agrolens.session import materialize, release

SLICE_KEYS = ["region", "data_year", "data_month"]


def null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """One pass, one row: NULL/NaN count per column (a bounded driver read)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    exprs = []
    for c in cols:
        miss = F.col(c).isNull()
        if types[c] in ("double", "float"):
            miss = miss | F.isnan(c)
        exprs.append(F.count_if(miss).alias(c))
    row = df.agg(*exprs).first()
    return {c: int(row[c]) for c in cols}


def _fill(df: DataFrame, med: DataFrame, keys: list[str], cols: list[str], tag: str) -> DataFrame:
    """coalesce(c, median_c) with the medians pivoted to one row per key."""
    wide = med.groupBy(*keys).pivot("col", cols).agg(F.first("median"))
    wide = wide.select(*keys, *[F.col(c).alias(f"_{tag}_{c}") for c in cols])
    j = df.join(wide, on=keys, how="left") if keys else df.crossJoin(F.broadcast(wide))
    return j.select(*[(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")),
                                  F.col(f"_{tag}_{c}")).alias(c) if c in cols else F.col(c))
                      for c in df.columns])


def approximate_medians(df: DataFrame, keys: list[str], cols: list[str], accuracy: int) -> DataFrame:
    """Rows (keys, col, median) by Spark's mergeable quantile sketch, in one partially aggregated pass.

    The value is one of the column's; its rank is within n / ``accuracy`` (and
    one) of the middle of the group's n values.  NULL and NaN are no values.
    """
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.dropna(subset=keys) if keys else df
    wide = rows.groupBy(*keys).agg(*[F.percentile_approx(clean(c), 0.5, accuracy).alias(c) for c in cols])
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("median")) for c in cols])).alias("m"))
    return long.select(*keys, "m.*").where("median IS NOT NULL")


def median_impute(df: DataFrame, cols: list[str], keys: list[str] | None = None,
                  checkpoint: bool = False, accuracy: int | None = None) -> DataFrame:
    """Fill NULL/NaN in ``cols`` with the exact median of the column within
    ``keys`` (whole frame when empty).  Only columns that have gaps are
    processed (decided from a one-row count).  ``accuracy``: approximate
    medians of that accuracy instead (see ``approximate_medians``)."""
    keys = list(keys or [])
    if checkpoint:
        df = materialize(df, "impute_input")
    counts = null_counts(df, cols)
    gaps = [c for c in cols if counts[c] > 0]
    if not gaps:
        return df
    med = column_medians(df, keys, gaps) if accuracy is None else approximate_medians(df, keys, gaps, accuracy)
    return _fill(df, med, keys, gaps, "slice" if keys else "global")


def impute_two_level(df: DataFrame, feature_cols: list[str], label_cols: list[str],
                     slice_keys: list[str] | None = None, carry: list[str] | None = None,
                     accuracy: int | None = None) -> DataFrame:
    """A04 in the reference order: per-slice median fill -> drop rows whose
    labels are all NULL (P11) -> union (one table here) -> global median fill
    of what is still missing (over the already-filled values).

    ``accuracy``: opt-in approximate medians, one pass instead of several.
    ``carry``: extra columns to keep (default: all).  When given, the labels
    are reduced to one ``any label present`` flag before materialising, so the
    passes read a narrow table."""
    slice_keys = slice_keys or SLICE_KEYS
    if carry is not None:
        present = [c for c in label_cols if c in df.columns]
        has = " OR ".join(f"`{c}` IS NOT NULL" for c in present) or "true"
        keep = list(dict.fromkeys([*carry, *slice_keys, *feature_cols]))
        df = df.selectExpr(*[f"`{c}`" for c in keep], f"({has}) AS _has_label")
        label_cols = []
    # several passes read the input: write it once as parquet in the shared
    # checkpoint folder (survives executor loss, cuts the lineage, and each
    # pass reads only its columns)
    base = materialize(df, "impute_base")
    step1 = median_impute(base, feature_cols, slice_keys, accuracy=accuracy)
    step1 = step1.where("_has_label").drop("_has_label") if "_has_label" in step1.columns \
        else drop_all_null_labels(step1, label_cols)
    step2 = materialize(step1, "impute_slice_filled")
    release(base)
    return median_impute(step2, feature_cols, [], accuracy=accuracy)


def drop_all_null_labels(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """Drop rows where every label is NULL."""
    present = [c for c in label_cols if c in df.columns]
    return df.dropna(how="all", subset=present) if present else df


def missing_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count and % of missing values per column, only columns with gaps.
    One aggregation pass, then an unpivot of the single row."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        miss = F.col(c).isNull()
        if types[c] in ("double", "float"):
            miss = miss | F.isnan(c)
        aggs.append(F.count_if(miss).alias(c))
    one = df.agg(*aggs)
    long = one.unpivot(["_n"], cols, "column", "n_missing")
    return long.where(F.col("n_missing") > 0).select(
        "column", "n_missing", rnd(F.col("n_missing") * 100.0 / F.col("_n"), 2).alias("pct_missing"))


def downcast_plan(df: DataFrame, cols: list[str]) -> DataFrame:
    """P20: per column, the smallest lossless type: integers by min/max into
    tinyint/smallint/int, other doubles to float when the float32 round trip is
    exact for every row.  One aggregation pass; result is one row per column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.count_if(x.isNotNull() & (x != F.floor(x))).alias(f"{c}__frac"),
                 F.count_if(x.isNotNull() & (x.cast("float").cast("double") != x)).alias(f"{c}__f32")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min_value"),
                     F.col(f"{c}__max").alias("max_value"), F.col(f"{c}__frac").alias("n_fractional"),
                     F.col(f"{c}__f32").alias("n_float_inexact")) for c in cols]
    t = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    is_int = (F.col("n_fractional") == 0) & F.col("min_value").isNotNull()
    target = (F.when(is_int & (F.col("min_value") >= -128) & (F.col("max_value") <= 127), "tinyint")
              .when(is_int & (F.col("min_value") >= -32768) & (F.col("max_value") <= 32767), "smallint")
              .when(is_int & (F.col("min_value") >= -2147483648) & (F.col("max_value") <= 2147483647), "int")
              .when(F.col("n_float_inexact") == 0, "float").otherwise("double"))
    return t.withColumn("target_type", target)


def apply_downcast(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name, missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
