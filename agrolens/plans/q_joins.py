"""Queries for the join operators J01-J12 (+ A27 scenario comparison)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.constants import ALIGNMENT_COLUMNS, FEATURES, REGIONS
from agrolens.functions import labels as L
from agrolens.functions.values import rnd
from agrolens.operators import features as FT
from agrolens.operators import joins as J
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import training_rows
from agrolens.plans.registry import dk_round, register, sp_round
from agrolens.sources import fixtures as FX

# --------------------------------------------------------------- J01/J02

_DYN_LAT = "CASE WHEN grid_id % 3 = 0 THEN NULL ELSE CAST(10 + grid_id % 19 AS DOUBLE) END"


@register("static_dynamic_join", Q.with_ctes(
    [("grid_static", None), ("obs_month", None),
     ("dyn", f"SELECT sample_id, system_index, grid_id, {_DYN_LAT} AS latitude FROM obs_month")],
    "SELECT d.sample_id, d.system_index, d.grid_id, s.grid_id AS grid_id_static, s.region, "
    "coalesce(d.latitude, s.latitude) AS latitude, s.latitude AS latitude_static, s.longitude, s.elevation_m "
    "FROM dyn d LEFT JOIN grid_static s ON d.system_index = s.system_index"))
def static_dynamic_join(spark, sf):
    """J01+J02: dynamic LEFT JOIN static on system_index; clashes get the
    ``_static`` suffix, latitude prefers the dynamic reading."""
    dyn = FX.obs_month(spark, sf).selectExpr("sample_id", "system_index", "grid_id", f"{_DYN_LAT} AS latitude")
    st = FX.grid_static(spark, sf).select("system_index", "grid_id", "region", "latitude", "longitude", "elevation_m")
    j = FT.join_static(dyn, st, key="system_index")
    return j.select("sample_id", "system_index", "grid_id", "grid_id_static", "region", "latitude",
                    "latitude_static", "longitude", "elevation_m")


# --------------------------------------------------------------- J03

_V2 = ("SELECT concat('g', cast(p_partkey*2 as string)) AS system_index, (p_partkey*13 % 500)/1 AS elevation_m, "
       "CAST(NULL AS DOUBLE) AS surface_water_occurrence_pct, 2 AS version FROM part WHERE p_partkey % 8 = 1")


def _versions(spark, sf):
    v1 = FX.grid_update(spark, sf).withColumn("version", F.lit(1))
    v2 = FX.table(spark, sf, "part").where("p_partkey % 8 = 1").selectExpr(
        "concat('g', cast(p_partkey*2 as string)) AS system_index", "(p_partkey*13 % 500)/1 AS elevation_m",
        "CAST(NULL AS DOUBLE) AS surface_water_occurrence_pct", "2 AS version")
    return v1.unionByName(v2)


@register("last_wins_join", Q.with_ctes(
    [("grid_static", None), ("grid_update", None),
     ("v", "SELECT system_index, elevation_m, surface_water_occurrence_pct, 1 AS version FROM grid_update "
           "UNION ALL " + _V2),
     ("last", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_index ORDER BY version DESC) AS rn "
              "FROM v) AS t WHERE rn = 1")],
    "SELECT d.system_index, d.region, "
    "CASE WHEN l.system_index IS NOT NULL THEN l.elevation_m ELSE d.elevation_m END AS elevation_m, "
    "CASE WHEN l.system_index IS NOT NULL THEN l.surface_water_occurrence_pct "
    "ELSE d.surface_water_occurrence_pct END AS surface_water_occurrence_pct "
    "FROM grid_static d LEFT JOIN last l ON d.system_index = l.system_index"))
def last_wins_join(spark, sf):
    """Static side wins on clashes (NULLs included); among duplicated
    static keys the latest version wins."""
    dyn = FX.grid_static(spark, sf).select("system_index", "region", "elevation_m", "surface_water_occurrence_pct")
    return FT.last_wins_merge(dyn, _versions(spark, sf), key="system_index", order_col="version")


# --------------------------------------------------------------- J04 upsert

_UPSERT_SQL = [("grid_static", None), ("grid_update", None),
               ("up", "SELECT m.system_index, m.grid_id, "
                      "CASE WHEN u.system_index IS NOT NULL THEN u.elevation_m ELSE m.elevation_m END AS elevation_m, "
                      "CASE WHEN u.system_index IS NOT NULL THEN u.surface_water_occurrence_pct "
                      "ELSE m.surface_water_occurrence_pct END AS surface_water_occurrence_pct, "
                      "u.system_index IS NOT NULL AS updated "
                      "FROM grid_static m LEFT JOIN grid_update u ON m.system_index = u.system_index")]


def _upserted(spark, sf):
    master = FX.grid_static(spark, sf).select("system_index", "grid_id", "elevation_m", "surface_water_occurrence_pct")
    return J.upsert(master, FX.grid_update(spark, sf), key="system_index").withColumnRenamed("_updated", "updated")


@register("upsert", Q.with_ctes(_UPSERT_SQL, "SELECT * FROM up"))
def upsert(spark, sf):
    """Keyed upsert; NULLs in the feed overwrite; unknown keys ignored."""
    return _upserted(spark, sf)


@register("upsert_summary", Q.with_ctes(
    _UPSERT_SQL, "SELECT count(*) AS points_total, count_if(updated) AS points_updated FROM up"))
def upsert_summary(spark, sf):
    """J04 counts: rows unchanged in number, points updated = semi-join size."""
    return _upserted(spark, sf).agg(F.count(F.lit(1)).alias("points_total"),
                                    F.count_if("updated").alias("points_updated"))


# --------------------------------------------------------------- J05

@register("coord_lookup", Q.with_ctes(
    [("grid_static", None), ("grid_update", None)],
    "SELECT u.system_index, coalesce(s.latitude, 21.0) AS latitude, coalesce(s.longitude, 96.0) AS longitude "
    "FROM grid_update u LEFT JOIN grid_static s ON u.system_index = s.system_index"))
def coord_lookup(spark, sf):
    """Coordinates for requested keys, default (21.0, 96.0)."""
    keys = FX.grid_update(spark, sf).select("system_index")
    return J.coordinate_lookup(keys, FX.grid_static(spark, sf), "system_index")


# --------------------------------------------------------------- J07

_CMP = ALIGNMENT_COLUMNS
_DYNAMIC = {"chirps_precipitation_mm", "mean_temperature_c", "solar_radiation_mj_m2_day"}
_OWN_FLAG_SQL = "CASE lower(region) " + " ".join(f"WHEN '{r}' THEN region_{r}" for r in REGIONS) + " END"


def _alignment_sql() -> str:
    f_cols = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS f_{c}" for c in _CMP)
    s_cols = ", ".join(f"CAST({'m' if c in _DYNAMIC else 'g'}.{c} AS DOUBLE) AS s_{c}" for c in _CMP)
    mism = ", ".join(
        f"count_if(f.sample_id IS NOT NULL AND s.sample_id IS NOT NULL AND s_{c} IS NOT NULL AND NOT isnan(s_{c}) "
        f"AND NOT isinf(s_{c}) AND NOT coalesce(abs(f_{c} - s_{c}) <= 1e-6 + 1e-5 * abs(s_{c}), false)) "
        f"AS mismatch_{c}" for c in _CMP)
    return Q.with_ctes(
        Q.rows_ctes() + [
            ("f", f"SELECT sample_id, data_month AS f_data_month, {_OWN_FLAG_SQL} AS f_region_flag, {f_cols} FROM rows"),
            ("s", f"SELECT m.sample_id, m.data_month AS s_data_month, {s_cols} FROM obs_month m "
                  "JOIN grid_static g ON m.grid_id = g.grid_id")],
        "SELECT count_if(f.sample_id IS NOT NULL) AS n_features, count_if(s.sample_id IS NOT NULL) AS n_source, "
        "count_if(s.sample_id IS NULL) AS missing_in_source, count_if(f.sample_id IS NULL) AS missing_in_features, "
        "count_if(f.sample_id IS NOT NULL AND s.sample_id IS NOT NULL "
        "AND f_data_month IS DISTINCT FROM s_data_month) AS month_mismatch, "
        "count_if(f.sample_id IS NOT NULL AND s.sample_id IS NOT NULL AND NOT coalesce(f_region_flag = 1, false)) "
        f"AS region_mismatch, {mism} FROM f FULL OUTER JOIN s ON f.sample_id = s.sample_id")


@register("alignment_report", _alignment_sql())
def alignment_report(spark, sf):
    """Feature extract (float32 serving copy) vs its source, by key."""
    rows = training_rows(spark, sf, columns=["sample_id", "grid_id", "data_month", *[f"region_{r}" for r in REGIONS], "region", *_CMP])
    feats = rows.selectExpr("sample_id", "grid_id", "data_month", f"{_OWN_FLAG_SQL} AS region_flag",
                            *[f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in _CMP])
    src = (FX.obs_month(spark, sf).repartition("grid_id").join(FX.grid_static(spark, sf).drop("system_index"), on="grid_id")
           .selectExpr("sample_id", "grid_id", "data_month", *[f"CAST({c} AS DOUBLE) AS {c}" for c in _CMP]))
    # a sample's grid is in its id
    return J.alignment_report(feats, src, "sample_id", _CMP, region_col="region_flag", near="grid_id")


# --------------------------------------------------------------- J10

@register("contamination", Q.with_ctes(
    Q.rows_ctes() + [
     ("te", f"SELECT DISTINCT {', '.join(FEATURES)} FROM rows WHERE (data_month + data_year) % 5 = 0"),
     ("tr", f"SELECT DISTINCT {', '.join(FEATURES)} FROM rows WHERE (data_month + data_year) % 5 <> 0"),
     ("ov", "SELECT * FROM te INTERSECT SELECT * FROM tr"),
     ("c", "SELECT (SELECT count(*) FROM te) AS n_test_distinct, (SELECT count(*) FROM ov) AS n_overlap")],
    f"SELECT n_test_distinct, n_overlap, "
    f"{dk_round('n_overlap * 100.0 / greatest(n_test_distinct, 1)', 4)} AS overlap_pct, "
    f"n_overlap * 100.0 / greatest(n_test_distinct, 1) > 5.0 AS contaminated FROM c"))
def contamination(spark, sf):
    """Test rows whose whole feature tuple is also in train (test: a
    fifth of the months, so a grid cell is on both sides)."""
    rows, features = FT.coded_rows(FX.obs_month(spark, sf), FX.grid_static(spark, sf), ["data_year"])
    res = J.contamination(rows, F.expr("(data_month + data_year) % 5 = 0"), features)
    return res.withColumn("overlap_pct", rnd(F.col("n_overlap") * 100.0 / F.greatest(F.col("n_test_distinct"),
                                                                                       F.lit(1)), 4))


# --------------------------------------------------------------- J11

@register("point_lookup", Q.with_ctes(
    Q.rows_ctes() + [("grid_update", None)],
    "SELECT sample_id, system_index, elevation_m FROM rows "
    "WHERE system_index IN (SELECT system_index FROM grid_update)"))
def point_lookup(spark, sf):
    """Rows for the keys named in another table (semi-join)."""
    rows = training_rows(spark, sf).select("sample_id", "system_index", "elevation_m")
    return J.lookup(rows, FX.grid_update(spark, sf), "system_index")


# --------------------------------------------------------------- J12 + A27

SCENARIO_TARGETS = ["crop_suitability_monsoon_rice", "crop_suitability_dry_season_rice",
                    "crop_suitability_maize", "crop_suitability_chili", "drought_risk_score",
                    "flood_risk_level", "irrigation_need"]


def _scenario_sql() -> str:
    repl = ", ".join(f"s.{c} AS {c}" for c in FX.SCENARIO_COLUMNS)
    per = ", ".join(
        f"max(CASE WHEN scenario = 'monsoon' THEN CAST({t} AS STRING) END) AS m_{t}, "
        f"max(CASE WHEN scenario = 'dry' THEN CAST({t} AS STRING) END) AS d_{t}" for t in SCENARIO_TARGETS)
    unp = " UNION ALL ".join(
        f"SELECT region, '{t}' AS target, m_{t} IS DISTINCT FROM d_{t} AS changed FROM pairs" for t in SCENARIO_TARGETS)
    return Q.with_ctes(
        Q.rows_ctes() + [("scenario", None),
                         ("xrows", f"SELECT r.* REPLACE ({repl}), s.scenario FROM rows r CROSS JOIN scenario s")]
        + Q.label_chain("xrows", "xl", "x")
        + [("pairs", f"SELECT sample_id, region, {per} FROM xl GROUP BY sample_id, region"),
           ("lg", unp)],
        f"SELECT region, target, count(*) AS n_rows, count_if(changed) AS n_changed, "
        f"{dk_round('count_if(changed) * 1.0 / count(*)', 4)} AS share_changed FROM lg GROUP BY region, target")


@register("scenario_compare", _scenario_sql())
def scenario_compare(spark, sf):
    """J12 + A27: every row scored under both seasons side by side in one
    projection; per region and target, how many rows change.  The only
    shuffle is the small partially aggregated roll-up."""
    pairs = J.side_by_side(training_rows(spark, sf), FX.scenario(spark), SCENARIO_TARGETS, L.with_labels)
    parts = ", ".join(f"'{t}', NOT (CAST(monsoon_{t} AS STRING) <=> CAST(dry_{t} AS STRING))" for t in SCENARIO_TARGETS)
    lg = pairs.selectExpr("region", f"stack({len(SCENARIO_TARGETS)}, {parts}) AS (target, changed)")
    return lg.groupBy("region", "target").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("changed").alias("n_changed"),
        F.expr(f"{sp_round('count_if(changed) * 1.0 / count(1)', 4)} AS share_changed"))


@register("scenario_rows", Q.with_ctes(
    Q.rows_ctes() + [("scenario", None)],
    "SELECT r.sample_id, s.scenario, s.data_month, s.chirps_precipitation_mm, s.ndvi_median_mean, r.elevation_m "
    "FROM rows r CROSS JOIN scenario s"))
def scenario_rows(spark, sf):
    """Each row x each scenario, the scenario's columns overriding the row's."""
    x = J.expand_scenarios(training_rows(spark, sf), FX.scenario(spark))
    return x.selectExpr("sample_id", "scenario", "CAST(data_month AS INT) AS data_month", "chirps_precipitation_mm", "ndvi_median_mean", "elevation_m")
