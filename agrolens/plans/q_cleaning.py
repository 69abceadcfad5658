"""Queries for cleaning/combining: A04, A05, A09, P11, P20, U01/U02."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.constants import FEATURES, REGION_FLAGS, REGIONS, STATIC_FEATURES, TARGETS
from agrolens.operators import cleaning as CL
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import labelled_rows, training_rows
from agrolens.plans.registry import dk_round, register, sp_round
from agrolens.sources import fixtures as FX

DOUBLE_FEATURES = [c for c in FEATURES if c not in REGION_FLAGS + ["valid_agriculture_mask", "data_month"]]


def _impute_sql(two_level: bool) -> str:
    cols = DOUBLE_FEATURES
    ctes = Q.labelled_ctes()
    if two_level:
        med = ", ".join(f"median({c}) AS m_{c}" for c in cols)
        fill = ", ".join(f"coalesce(r.{c}, md.m_{c}) AS {c}" for c in cols)
        not_all_null = " OR ".join(f"{t} IS NOT NULL" for t in TARGETS)
        ctes += [("smed", f"SELECT region, data_year, data_month, {med} FROM labelled "
                          "GROUP BY region, data_year, data_month"),
                 ("filled", f"SELECT r.* REPLACE ({fill}) FROM labelled r LEFT JOIN smed md "
                            "ON r.region = md.region AND r.data_year = md.data_year AND r.data_month = md.data_month "
                            f"WHERE {not_all_null}")]
        src = "filled"
    else:
        src = "labelled"
    gmed = ", ".join(f"median({c}) AS g_{c}" for c in cols)
    gfill = ", ".join(f"coalesce(f.{c}, g.g_{c}) AS {c}" for c in cols)
    ctes += [("gmed", f"SELECT {gmed} FROM {src}"),
             ("final", f"SELECT f.* REPLACE ({gfill}) FROM {src} f CROSS JOIN gmed g")]
    return Q.with_ctes(ctes, "SELECT sample_id, " + ", ".join(f"{dk_round(c)} AS {c}" for c in cols) + " FROM final")


def _present(df):
    return df.selectExpr("sample_id", *[f"{sp_round(f'CAST({c} AS DOUBLE)')} AS {c}" for c in DOUBLE_FEATURES])


@register("impute_two_level", _impute_sql(True))
def impute_two_level(spark, sf):
    """Exact per-slice (region, year, month) median fill -> drop rows with
    all labels NULL -> exact global median fill of what is left."""
    df = labelled_rows(spark, sf)
    return _present(CL.impute_two_level(df, DOUBLE_FEATURES, TARGETS, carry=["sample_id"]))


@register("impute_global", _impute_sql(False))
def impute_global(spark, sf):
    """One-level (whole frame) exact median fill."""
    return _present(CL.median_impute(labelled_rows(spark, sf).select("sample_id", *DOUBLE_FEATURES), DOUBLE_FEATURES, [], checkpoint=True))


@register("missing_report", Q.with_ctes(
    Q.rows_ctes(),
    "SELECT column_name AS \"column\", n_missing, " + dk_round("n_missing * 100.0 / n", 2) + " AS pct_missing FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS n_missing, count(*) AS n FROM rows"
                         for c in FEATURES) + ") AS t WHERE n_missing > 0"))
def missing_report(spark, sf):
    """Count and % missing per feature column (only columns with gaps)."""
    return CL.missing_report(training_rows(spark, sf), FEATURES)


# P20 runs over the source columns (static + raw monthly), whose values are
# engine-independent; derived averages differ in the last bit between engines.
DOWNCAST_COLS = STATIC_FEATURES + ["chirps_precipitation_mm", "mean_temperature_c", "solar_radiation_mj_m2_day",
                                   "era5_soil_moisture_m3_m3", "ndvi_median", "ndwi_mcf_median",
                                   "s1_vh_db_median", "s1_vv_db_median", "data_month"]


def _downcast_sql() -> str:
    parts = []
    for c in DOWNCAST_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", min({x}) AS min_value, max({x}) AS max_value, "
                     f"count_if({x} IS NOT NULL AND {x} <> floor({x})) AS n_fractional, "
                     f"count_if({x} IS NOT NULL AND CAST(CAST({x} AS FLOAT) AS DOUBLE) <> {x}) AS n_float_inexact "
                     f"FROM src")
    body = " UNION ALL ".join(parts)
    is_int = "(n_fractional = 0 AND min_value IS NOT NULL)"
    tgt = (f"CASE WHEN {is_int} AND min_value >= -128 AND max_value <= 127 THEN 'tinyint' "
           f"WHEN {is_int} AND min_value >= -32768 AND max_value <= 32767 THEN 'smallint' "
           f"WHEN {is_int} AND min_value >= -2147483648 AND max_value <= 2147483647 THEN 'int' "
           f"WHEN n_float_inexact = 0 THEN 'float' ELSE 'double' END")
    return Q.with_ctes([("grid_static", None), ("obs_month", None),
                        ("src", "SELECT m.*, s.* EXCLUDE (grid_id, system_index) FROM obs_month m "
                                "JOIN grid_static s ON m.grid_id = s.grid_id")],
                       f"SELECT *, {tgt} AS target_type FROM ({body}) AS t")


@register("downcast_plan", _downcast_sql())
def downcast_plan(spark, sf):
    """P20: smallest lossless type per source column (one aggregation pass)."""
    src = FX.obs_month(spark, sf).join(FX.grid_static(spark, sf).drop("system_index"), on="grid_id")
    return CL.downcast_plan(src, DOWNCAST_COLS)


_SPLIT_COLS = {r: (["system_index", "region", "latitude", "longitude"] if i % 2 == 0
                   else ["system_index", "region", "latitude"]) for i, r in enumerate(REGIONS)}


@register("union_regions", Q.with_ctes(
    [("grid_static", None)],
    " UNION ALL BY NAME ".join(
        f"SELECT {', '.join(cols)} FROM grid_static WHERE region = '{r}'" for r, cols in _SPLIT_COLS.items())))
def union_regions(spark, sf):
    """Per-region frames with different column sets, unioned by
    name; missing columns become NULL."""
    gs = FX.grid_static(spark, sf)
    frames = [gs.where(F.col("region") == r).select(*cols) for r, cols in _SPLIT_COLS.items()]
    return CL.union_all(frames)


_APPROX = ["soil_soc_g_kg_0_30cm", "chirps_precipitation_mm", "ndvi_median_mean"]
_ACCURACY = 200


@register("impute_approx", Q.with_ctes(
    Q.rows_ctes(),
    " UNION ALL ".join(f"SELECT region, data_year, data_month, '{c}' AS \"col\", count({c}) AS n, true AS within_bound, true AS occurs FROM rows "
                       f"GROUP BY region, data_year, data_month HAVING count({c}) > 0" for c in _APPROX)))
def impute_approx(spark, sf):
    """A04, opt-in sketch: the approximate median of every slice is one of its
    values, and its rank lies within n / accuracy (and one) of the middle."""
    rows = training_rows(spark, sf)
    med = CL.approximate_medians(rows, CL.SLICE_KEYS, _APPROX, _ACCURACY)
    long = rows.select(*CL.SLICE_KEYS, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in _APPROX])).alias("x"))
    long = long.select(*CL.SLICE_KEYS, "x.*").where("v IS NOT NULL").join(med, [*CL.SLICE_KEYS, "col"])
    got = long.groupBy(*CL.SLICE_KEYS, "col").agg(
        F.count("*").alias("n"), F.count_if(F.col("v") < F.col("median")).alias("below"), F.count_if(F.col("v") <= F.col("median")).alias("upto"))
    slack = F.col("n") / _ACCURACY + 1
    return got.select(*CL.SLICE_KEYS, "col", "n", ((F.col("below") <= F.col("n") / 2 + slack) & (F.col("upto") >= F.col("n") / 2 - slack)).alias("within_bound"),
                      (F.col("upto") > F.col("below")).alias("occurs"))
