"""Queries for roll-ups, rankings and samples: A06-A08, A10, A28, W02, W05-W07,
T03, T06, S16."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agrolens.constants import CLASS_TARGETS, CROPS, NUMERIC_TARGETS, ROLLUP_SUITABILITY_WEIGHTS
from agrolens.functions import labels as L
from agrolens.functions.composites import CompositeText
from agrolens.operators import ranking as RK
from agrolens.operators import rollup as RU
from agrolens.plans import oracle_rules
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import labelled_rows, training_rows
from agrolens.plans.q_scoring import types_of
from agrolens.plans.registry import dk_round, register, sp_round
from agrolens.session import materialize, scratch_path

_COMPARED = ["crop_yield_t_ha", "crop_health_score", "chirps_precipitation_mm_mean", "mean_temperature_c_mean"]

D = Q.d

# ------------------------------------------------------------------ A06 / W02 / T03

_LONG = " UNION ALL ".join(
    f"SELECT region, '{c}' AS crop, {i} AS ord, lower(CAST(crop_suitability_{c} AS VARCHAR)) AS label FROM labelled"
    for i, c in enumerate(CROPS))
_S = " + ".join(f"CAST(n_{k} AS DOUBLE) * {D(v)}" for k, v in ROLLUP_SUITABILITY_WEIGHTS.items())
_ROLLUP_CTES = Q.labelled_ctes() + [
    ("lg", _LONG),
    ("ag", "SELECT region, crop, ord, count(*) AS n, " + ", ".join(
        f"count_if(label = '{k}') AS n_{k}" for k in ROLLUP_SUITABILITY_WEIGHTS) + " FROM lg GROUP BY region, crop, ord"),
    ("sc", f"SELECT *, (({_S}) / CAST(n AS DOUBLE)) * {D(100)} AS _score, " + ", ".join(
        f"(CAST(n_{k} AS DOUBLE) / CAST(n AS DOUBLE)) * {D(100)} AS _{k}" for k in ROLLUP_SUITABILITY_WEIGHTS)
     + " FROM ag"),
    ("rk", "SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY _score DESC, ord) AS INTEGER) AS rank "
           "FROM sc")]
_ROLLUP_SELECT = ("SELECT concat(upper(substring(region, 1, 1)), lower(substring(region, 2))) AS region, rank, crop, "
                  f"{dk_round('_score', 2)} AS suitability_score, {dk_round('_excellent', 2)} AS excellent_pct, "
                  f"{dk_round('_good', 2)} AS good_pct, {dk_round('_excellent + _good', 2)} AS suitable_pct, "
                  f"{dk_round('_moderate', 2)} AS moderate_pct, {dk_round('_poor', 2)} AS poor_pct, "
                  "n AS total_samples FROM rk")


@register("region_rollup", Q.with_ctes(_ROLLUP_CTES, _ROLLUP_SELECT))
def region_rollup(spark, sf):
    """A06 + W02: regional suitability index and class shares, ranked."""
    return RU.region_rollup(labelled_rows(spark, sf))


@register("region_top_k", Q.with_ctes(_ROLLUP_CTES, _ROLLUP_SELECT + " WHERE rank <= 5"))
def region_top_k(spark, sf):
    """Top-5 crops per region."""
    return RU.region_rollup(labelled_rows(spark, sf), top_k=5)


# ------------------------------------------------------------------ A07 / A08

@register("class_distribution", Q.with_ctes(
    Q.labelled_ctes(), "SELECT target, class, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, CAST({t} AS VARCHAR) AS class FROM labelled" for t in CLASS_TARGETS)
    + ") AS t GROUP BY target, class"))
def class_distribution(spark, sf):
    """Class counts per class target."""
    return RU.class_distribution(labelled_rows(spark, sf), CLASS_TARGETS)


@register("numeric_range", Q.with_ctes(
    Q.labelled_ctes(), "SELECT target, min_value, max_value, " + dk_round("mean_value") + " AS mean_value FROM ("
    + "SELECT target, min(v) AS min_value, max(v) AS max_value, " + Q.xavg("v") + " AS mean_value FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS target, CAST({t} AS DOUBLE) AS v FROM labelled" for t in NUMERIC_TARGETS)
    + ") AS t GROUP BY target) AS u"))
def numeric_range(spark, sf):
    """Min / max / mean per numeric target."""
    return RU.numeric_range(labelled_rows(spark, sf), NUMERIC_TARGETS).selectExpr(
        "target", "min_value", "max_value", f"{sp_round('mean_value')} AS mean_value")


# ------------------------------------------------------------------ A10

_FIRST_COLS = ["elevation_m", "chirps_precipitation_mm", "ndvi_median_mean"]


@register("region_first_row", Q.with_ctes(
    Q.rows_ctes(), "SELECT region, min(sample_id) AS first_key, count(*) AS n_rows, "
    + ", ".join(f"arg_min({c}, sample_id) AS first_{c}" for c in _FIRST_COLS) + " FROM rows GROUP BY region"))
def region_first_row(spark, sf):
    """A10: per region the first key, row count and first-row values."""
    return RU.region_first_row(training_rows(spark, sf), "sample_id", _FIRST_COLS)


# ------------------------------------------------------------------ W05 / W06 / W07

@register("region_samples", Q.with_ctes(
    Q.rows_ctes() + [("r", "SELECT sample_id, region, row_number() OVER (PARTITION BY region ORDER BY sample_id) AS rn, "
                           "count(*) OVER (PARTITION BY region) AS n FROM rows")],
    "SELECT sample_id, region, rn FROM r WHERE (rn - 1) % greatest(1, n // 400) = 0"))
def region_samples(spark, sf):
    """Every n-th row per region (about 400 per region), skew-safe numbering."""
    rows = training_rows(spark, sf).select("sample_id", "region")
    return RK.every_nth(rows, ["region"], "sample_id", 400).select("sample_id", "region", "rn")


@register("region_middle", Q.with_ctes(
    Q.rows_ctes() + [("r", "SELECT sample_id, region, row_number() OVER (PARTITION BY region ORDER BY sample_id) AS rn, "
                           "count(*) OVER (PARTITION BY region) AS n FROM rows")],
    "SELECT region, CASE WHEN rn = 1 THEN 'first' ELSE 'middle' END AS position, sample_id FROM r "
    "WHERE rn = 1 OR rn = n // 2 + 1"))
def region_middle(spark, sf):
    """First and middle row per region."""
    rows = training_rows(spark, sf).select("sample_id", "region")
    return RK.first_and_middle(rows, ["region"], "sample_id").select("region", "position", "sample_id")


@register("row_index", Q.with_ctes(
    [("grid_static", None)], "SELECT system_index, row_number() OVER (ORDER BY system_index) - 1 AS index "
                             "FROM grid_static"))
def row_index(spark, sf):
    """Surrogate 0..n-1 index in key order without a one-partition window."""
    from agrolens.sources import fixtures as FX
    return RK.surrogate_index(FX.grid_static(spark, sf).select("system_index"), "system_index")


# ------------------------------------------------------------------ S16 / T06

MAP_COLS = ["sample_id", "index", "lat", "lon", "region", "rank", "crop", "score"]


def _map_sql() -> str:
    return Q.with_ctes(
        Q.labelled_ctes() + [
            ("r", "SELECT *, row_number() OVER (PARTITION BY region ORDER BY sample_id) AS rn, "
                  "count(*) OVER (PARTITION BY region) AS n FROM labelled"),
            ("smp", "SELECT * FROM r WHERE (rn - 1) % greatest(1, n // 400) = 0"),
            ("ranked", oracle_rules.ranked_crops("smp"))],
        f"SELECT k.sample_id, s.system_index AS index, s.latitude AS lat, s.longitude AS lon, s.region, "
        f"CAST(k.idx + 1 AS INTEGER) AS rank, k.crop, {oracle_rules.adjusted('k.idx')} AS score "
        f"FROM ranked k JOIN smp s ON k.sample_id = s.sample_id")


@register("map_points", _map_sql())
def map_points(spark, sf):
    """S16 + T06: ~400 sampled points per region with all 17 crops ranked
    ([crop, score] pairs, flattened)."""
    rows = training_rows(spark, sf)
    # the narrow keys are numbered; only the sampled rows (about 400 a region) are joined back and scored
    keys = RK.every_nth(rows.select("region", "sample_id"), ["region"], "sample_id", 400).select("sample_id")
    smp = L.with_labels(rows.join(keys, on="sample_id", how="left_semi"))
    pts = smp.selectExpr("sample_id", "system_index AS index", "latitude AS lat", "longitude AS lon", "region",
                         *[c for c in smp.columns if c.startswith("crop_")])
    ranked = CompositeText("spark", pts.columns, types_of(pts)).recommender_rows(pts, MAP_COLS[:5], None)
    return ranked.select(*MAP_COLS[:7], F.col("suitability_score").alias("score"))


@register("map_points_file", Q.with_ctes(
    [("m", _map_sql())],
    "SELECT index, lat, lon, region, count(*) AS n_crops, min(crop || ':' || CAST(score AS VARCHAR)) FILTER (rank = 1) AS first "
    "FROM m GROUP BY sample_id, index, lat, lon, region"))
def map_points_file(spark, sf):
    """S16 sink: one JSON document per point, written and read back."""
    path = scratch_path(spark, f"map-points-{uuid.uuid4().hex[:12]}")
    map_points_json(map_points(spark, sf), path)
    back = spark.read.schema("index string, lat double, lon double, region string, recommendations array<array<string>>").json(path)
    return back.selectExpr("index", "lat", "lon", "region", "CAST(size(recommendations) AS BIGINT) AS n_crops",
                           "concat(recommendations[0][0], ':', recommendations[0][1]) AS first")


def map_points_json(points, path: str) -> None:
    """S16 sink: one compact JSON document per point with [[crop, score], ...]."""
    nested = points.groupBy("sample_id", "index", "lat", "lon", "region").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "crop", "score"))),
                    lambda x: F.array(x["crop"], x["score"].cast("string"))).alias("recommendations"))
    nested.drop("sample_id").write.mode("overwrite").json(path)


# ------------------------------------------------------------------ A28

@register("region_compare", Q.with_ctes(
    _ROLLUP_CTES + [
        ("top", "SELECT lower(region) AS region, string_agg(crop, ', ' ORDER BY rank) AS top_crops FROM rk "
                "WHERE rank <= 3 GROUP BY region"),
        ("mn", "SELECT region, " + ", ".join(
            f"{Q.xavg(c)} AS mean_{c}" for c in ["crop_yield_t_ha", "crop_health_score",
                                                  "chirps_precipitation_mm_mean", "mean_temperature_c_mean"])
         + " FROM labelled GROUP BY region")],
    "SELECT mn.region, " + ", ".join(
        f"{dk_round('mean_' + c)} AS mean_{c}" for c in ["crop_yield_t_ha", "crop_health_score",
                                                        "chirps_precipitation_mm_mean", "mean_temperature_c_mean"])
    + ", top.top_crops FROM mn LEFT JOIN top ON mn.region = top.region"))
def region_compare(spark, sf):
    """Regional comparison (top-3 crops, mean yield/health/climate)."""
    # read by the ranking and by the means: written once, the columns that they use
    lab = materialize(labelled_rows(spark, sf).select("region", *[f"crop_suitability_{c}" for c in CROPS], *_COMPARED), "compared")
    out = RU.region_compare(lab, RU.region_rollup(lab))
    return out.selectExpr("region", *[f"{sp_round('mean_' + c)} AS mean_{c}" for c in _COMPARED], "top_crops")
