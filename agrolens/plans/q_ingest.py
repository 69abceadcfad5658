"""Queries for upload normalisation and feature preparation: S12, P01-P09,
P13-P17, A02, J06, R01/R02, A26."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.constants import AGG_FEATURES, CROP_AREA_FEATURES, FEATURES, REGION_FLAGS, REGIONS, TARGETS
from agrolens.operators import features as FT
from agrolens.operators import ingest as IN
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import training_rows
from agrolens.plans.registry import register
from agrolens.sources import fixtures as FX

_NUM = "CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"


def _dn(c: str) -> str:
    return _NUM.format(c=c)


def upload_view(spark, sf):
    """The dirty upload: obs_dirty without its key column, so the index comes
    from the 'index' column (P13 fallback chain)."""
    return FX.obs_dirty(spark, sf).drop("system_index")


_UPLOAD = [("obs", None), ("obs_month", None), ("obs_dirty", None),
           ("upload", "SELECT * EXCLUDE (system_index) FROM obs_dirty")]


@register("normalise_upload", Q.with_ctes(
    _UPLOAD, "SELECT CAST(index AS VARCHAR) AS meta_index, CAST(index AS VARCHAR) AS meta_sample_id, "
             f"coalesce({_dn('lat')}, 0.0) AS meta_lat, CAST(0.0 AS DOUBLE) AS meta_lon, 'unknown' AS meta_region, "
             f"{_dn('chirps_precipitation_mm')} AS chirps_precipitation_mm FROM upload"))
def normalise_upload(spark, sf):
    """S12 + P13/P14/P09/P15 + P04: key, coordinates, region fallback, meta."""
    out = IN.normalise_upload(upload_view(spark, sf))
    return out.selectExpr("meta_index", "meta_sample_id", "meta_lat", "meta_lon", "meta_region",
                          "nanvl(try_cast(chirps_precipitation_mm AS DOUBLE), CAST(NULL AS DOUBLE)) "
                          "AS chirps_precipitation_mm")


@register("parse_year_month", Q.with_ctes(
    _UPLOAD, "SELECT index, year_month, coalesce(regexp_matches(year_month, '^20\\d\\d-(0[1-9]|1[0-2])$'), false) "
             "AS year_month_valid, CASE WHEN regexp_matches(year_month, '^20\\d\\d-(0[1-9]|1[0-2])$') "
             "THEN CAST(substring(year_month, 1, 4) AS INTEGER) END AS data_year, "
             "coalesce(CAST(CASE WHEN regexp_matches(year_month, '^20\\d\\d-(0[1-9]|1[0-2])$') "
             "THEN CAST(substring(year_month, 6, 2) AS INTEGER) END AS DOUBLE), 6.0) AS data_month FROM upload"))
def parse_year_month(spark, sf):
    """P16 + P17: parse 'YYYY-MM' (malformed -> NULL) and inject the
    observation month (2024-06) where the month is missing."""
    up = upload_view(spark, sf)
    parsed = up.select("index", "year_month", *[c.alias(k) for k, c in
                                                 IN.parse_year_month(F.col("year_month")).items()])
    return IN.inject_month(parsed, "2024-06")


_STRICT_TARGETS = {t: FEATURES for t in TARGETS}


def _strict_sql() -> str:
    miss = " + ".join(f"(CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END)" for c in FEATURES)
    inf = " + ".join(f"(CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END)" for c in FEATURES)
    return Q.with_ctes(
        Q.rows_ctes() + [("v", f"SELECT sample_id, ({miss}) AS n_missing, ({inf}) AS n_infinite FROM rows")],
        "SELECT sample_id, CASE WHEN n_infinite > 0 OR n_missing > 0 THEN 40 ELSE 0 END AS n_errors, "
        "(n_infinite > 0 OR n_missing > 0) AS row_failed, "
        "CASE WHEN n_infinite > 0 THEN printf('crop_health_score: feature row contains %d infinite values', n_infinite) "
        "WHEN n_missing > 0 THEN printf('crop_health_score: model does not support %d missing values', n_missing) "
        "END AS health_error FROM v")


@register("strict_validate", _strict_sql())
def strict_validate(spark, sf):
    """Per row and target, missing / non-finite feature errors (every
    target uses the 75-feature list here)."""
    v = IN.strict_validate(training_rows(spark, sf), _STRICT_TARGETS)
    return v.selectExpr("sample_id", "n_errors", "row_failed", "errors['crop_health_score'] AS health_error")


@register("batch_outcome", Q.with_ctes(
    Q.rows_ctes() + [("v", "SELECT sample_id, (" + " + ".join(
        f"(CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END)"
        for c in FEATURES) + ") > 0 AS row_failed FROM rows")],
    "SELECT count_if(NOT row_failed) AS successful_rows, count_if(row_failed) AS failed_rows FROM v"))
def batch_outcome(spark, sf):
    """A row fails only if no target succeeded."""
    return IN.batch_outcome(IN.strict_validate(training_rows(spark, sf), _STRICT_TARGETS))


@register("align_features", Q.with_ctes(
    _UPLOAD, "SELECT index, " + ", ".join(
        (f"coalesce({_dn(c)}, 0.0) AS {c}" if c == "chirps_precipitation_mm" else f"CAST(0.0 AS DOUBLE) AS {c}")
        for c in FEATURES) + " FROM upload"))
def align_features(spark, sf):
    """A model's 75 features in order from a sparse upload (absent -> 0.0)."""
    up = upload_view(spark, sf)
    return up.selectExpr("index", *IN.align_exprs(up, FEATURES))


_KEEP = FT.ID_COLS + ["elevation_m", "chirps_precipitation_mm", "mean_temperature_c", "lat", "not_a_column"]


@register("keep_list", Q.with_ctes(
    _UPLOAD, "SELECT " + ", ".join(
        (f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" if c in ("chirps_precipitation_mm", "year_month", "lat")
         else f"'' AS {c}") for c in _KEEP) + " FROM upload"))
def keep_list(spark, sf):
    """P02 (and P01's absent-column rule): ordered keep list over an upload,
    absent columns as ''."""
    return FT.keep_or_blank(upload_view(spark, sf), _KEEP)


@register("region_onehot", Q.with_ctes(
    [("grid_static", None)], "SELECT system_index, region, " + ", ".join(
        f"CAST(lower(region) = '{r}' AS INTEGER) AS region_{r}" for r in REGIONS)
    + ", coalesce(" + ", ".join(f"CASE WHEN lower(region) = '{r}' THEN '{r}' END" for r in reversed(REGIONS))
    + ", 'unknown') AS region_back FROM grid_static"))
def region_onehot(spark, sf):
    """P08 + P09: six 0/1 flags and the inverse (later flag wins)."""
    return IN.onehot_and_back(FX.grid_static(spark, sf).select("system_index", "region")).select(
        "system_index", "region", *REGION_FLAGS, "region_back")


@register("crop_area_lookup", Q.with_ctes(
    [("grid_static", None)], "SELECT grid_id, region, " + ", ".join(
        f"{Q.crop_area_case(c[len('crop_area_pct_'):], 'lower(region)')} AS {c}" for c in CROP_AREA_FEATURES)
    + " FROM grid_static"))
def crop_area_lookup(spark, sf):
    """(region, crop) -> area % with 1.0 for unknown pairs."""
    gs = FX.grid_static(spark, sf)
    ex = FT.crop_area_exprs("region")
    return gs.selectExpr("grid_id", "region", *[f"{ex[c]} AS {c}" for c in CROP_AREA_FEATURES])


def _single_month_sql() -> str:
    cols = []
    for c in AGG_FEATURES:
        sig, stat = c.rsplit("_", 1)
        if c == "ndvi_median_growing_season_mean":
            cols.append(f"ndvi_median AS {c}")
        elif stat in ("mean", "max", "min"):
            cols.append(f"{sig} AS {c}")
        else:
            cols.append(f"CAST(0.0 AS DOUBLE) AS {c}")
    return Q.with_ctes([("obs", None), ("obs_month", None)], "SELECT sample_id, " + ", ".join(cols) + " FROM obs_month")


@register("single_month_stats", _single_month_sql())
def single_month_stats(spark, sf):
    """Single-month approximations (mean=max=min=value, range=cv=0)."""
    return FT.single_month_stats(FX.obs_month(spark, sf)).select("sample_id", *AGG_FEATURES)


# FIXED VALUES — an example label-rule configuration (threshold, categorical, unknown type)
RULES = {
    "wet_month": {"type": "threshold", "source": "chirps_precipitation_mm", "direction": "above", "value": 200},
    "dry_month": {"type": "threshold", "source": "chirps_precipitation_mm", "direction": "below", "value": 40},
    "lat_band": {"type": "categorical", "source": "lat", "mapping": {"0": "equator", "45": "mid"},
                 "default": "other"},
    "unsupported": {"type": "spline", "source": "lat"},
}


@register("rule_labels", Q.with_ctes(
    _UPLOAD, "SELECT index, "
             f"CASE WHEN coalesce({_dn('chirps_precipitation_mm')}, 0.0) > 200.0 THEN '1' ELSE '0' END AS wet_month, "
             f"CASE WHEN coalesce({_dn('chirps_precipitation_mm')}, 0.0) <= 40.0 THEN '1' ELSE '0' END AS dry_month, "
             "coalesce(CASE coalesce(CAST(lat AS VARCHAR), '') WHEN '0' THEN 'equator' WHEN '45' THEN 'mid' END, "
             "'other') AS lat_band, '' AS unsupported FROM upload"))
def rule_labels(spark, sf):
    """R01 + R02: config-driven threshold / categorical labels."""
    return IN.apply_rules(upload_view(spark, sf), RULES).select("index", *RULES)


# P09 variants on flags with gaps and double flags: grid % 7 = 0 -> no flag,
# grid % 11 = 0 -> the bago flag is set as well
def _flag_sql(r: str) -> str:
    return (f"CASE WHEN grid_id % 7 = 0 THEN 0 WHEN lower(region) = '{r}' THEN 1 "
            f"WHEN grid_id % 11 = 0 AND '{r}' = 'bago' THEN 1 ELSE 0 END")


def _inverse_sql(order: list[str], none: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN region_{r} = 1 THEN '{r}' END" for r in order) + f", '{none}')"


@register("region_inverse", Q.with_ctes(
    [("grid_static", None),
     ("f", "SELECT system_index, " + ", ".join(f"{_flag_sql(r)} AS region_{r}" for r in REGIONS) + " FROM grid_static")],
    "SELECT system_index, " + _inverse_sql(list(reversed(REGIONS)), "unknown") + " AS region_upload, "
    + _inverse_sql(list(reversed(REGIONS)), "") + " AS region_update, "
    + _inverse_sql(REGIONS, "yangon") + " AS region_lookup FROM f"))
def region_inverse(spark, sf):
    """Region from one-hot flags — upload (later flag wins, 'unknown'),
    update (later flag wins, ''), lookup loop (first flag wins, 'yangon')."""
    flags = FX.grid_static(spark, sf).selectExpr(
        "system_index", *[f"{_flag_sql(r)} AS region_{r}" for r in REGIONS])
    return flags.select(
        "system_index",
        FT.region_from_flags(flags, none_value="unknown").alias("region_upload"),
        FT.region_from_flags(flags, none_value="").alias("region_update"),
        FT.region_from_flags(flags, none_value="yangon", first_wins=True).alias("region_lookup"))
