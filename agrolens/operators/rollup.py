"""Regional roll-ups and summaries: A06 (+W02/T03), A07, A08, A10, A28, P10.

Rows are reduced by partial-aggregated ``groupBy`` first; rankings run on the
aggregated table (17 crops per region), never on the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolens.constants import CROPS, ROLLUP_SUITABILITY_WEIGHTS
from agrolens.functions.rules_sql import RuleText
from agrolens.operators.features import exact_avg_sql

R = RuleText("spark")


def region_filter(df: DataFrame, region: str | None) -> DataFrame:
    """P10: by the one-hot flag when present, else case-insensitive name,
    else all rows (decided at plan time)."""
    if not region:
        return df
    r = region.lower()
    if f"region_{r}" in df.columns:
        return df.where(F.col(f"region_{r}") == 1)
    if "region" in df.columns:
        return df.where(F.lower(F.col("region")) == r)
    return df


def suitability_long(df: DataFrame) -> DataFrame:
    """(region, crop, ord, label) for the 17 suitability targets (one stack)."""
    parts = ", ".join(f"'{c}', {i}, lower(CAST(crop_suitability_{c} AS STRING))" for i, c in enumerate(CROPS)
                      if f"crop_suitability_{c}" in df.columns)
    n = sum(1 for c in CROPS if f"crop_suitability_{c}" in df.columns)
    return df.selectExpr("region", f"stack({n}, {parts}) AS (crop, ord, label)")


def region_rollup(df: DataFrame, top_k: int | None = None) -> DataFrame:
    """A06 + W02: weighted suitability index (poor = 0.0), class shares,
    rank within region (score desc, then crop order)."""
    long = suitability_long(df)
    w = ROLLUP_SUITABILITY_WEIGHTS
    agg = long.groupBy("region", "crop", "ord").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("label") == k).alias(f"n_{k}") for k in w])
    S = " + ".join(f"CAST(n_{k} AS DOUBLE) * {R.d(v)}" for k, v in w.items())
    pct = {k: f"(CAST(n_{k} AS DOUBLE) / CAST(n AS DOUBLE)) * {R.d(100)}" for k in w}
    scored = agg.selectExpr(
        "region", "crop", "ord", "n",
        f"(({S}) / CAST(n AS DOUBLE)) * {R.d(100)} AS _score",
        *[f"{pct[k]} AS _{k}" for k in w])
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("_score"), F.asc("ord")))
    out = scored.withColumn("rank", rank.cast("int"))
    if top_k:
        out = out.where(F.col("rank") <= top_k)
    return out.selectExpr(
        "concat(upper(substring(region, 1, 1)), lower(substring(region, 2))) AS region", "rank", "crop",
        f"{R.rnd('_score', 2)} AS suitability_score", f"{R.rnd('_excellent', 2)} AS excellent_pct",
        f"{R.rnd('_good', 2)} AS good_pct", f"{R.rnd('_excellent + _good', 2)} AS suitable_pct",
        f"{R.rnd('_moderate', 2)} AS moderate_pct", f"{R.rnd('_poor', 2)} AS poor_pct", "n AS total_samples")


def class_distribution(df: DataFrame, targets: list[str]) -> DataFrame:
    """Count per class for each class target."""
    parts = ", ".join(f"'{t}', CAST({t} AS STRING)" for t in targets)
    long = df.selectExpr(f"stack({len(targets)}, {parts}) AS (target, class)")
    return long.groupBy("target", "class").agg(F.count(F.lit(1)).alias("n"))


def numeric_range(df: DataFrame, targets: list[str]) -> DataFrame:
    """Min / max / mean per numeric target (exact-sum mean)."""
    parts = ", ".join(f"'{t}', CAST({t} AS DOUBLE)" for t in targets)
    long = df.selectExpr(f"stack({len(targets)}, {parts}) AS (target, v)")
    return long.groupBy("target").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"),
                                      F.expr(exact_avg_sql("v")).alias("mean_value"))


def region_first_row(df: DataFrame, key: str, sample_cols: list[str]) -> DataFrame:
    """A10: per region the first key, the row count and the first row's values
    (``min_by`` aggregates partially: no region lands whole in one task)."""
    return df.groupBy("region").agg(
        F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n_rows"),
        *[F.min_by(c, F.col(key)).alias(f"first_{c}") for c in sample_cols])


def region_compare(df: DataFrame, rollup: DataFrame, k: int = 3) -> DataFrame:
    """Top-k crops, mean yield/health/precipitation/temperature per region."""
    top = (rollup.where(F.col("rank") <= k).groupBy(F.lower("region").alias("region"))
           .agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "crop"))),
                                                lambda x: x["crop"])).alias("top_crops")))
    means = df.groupBy("region").agg(*[F.expr(exact_avg_sql(c)).alias(f"mean_{c}") for c in
                                       ["crop_yield_t_ha", "crop_health_score", "chirps_precipitation_mm_mean",
                                        "mean_temperature_c_mean"]])
    return means.join(top, on="region", how="left")
