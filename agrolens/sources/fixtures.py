"""Derived views that give the driver's TPC-H-like tables the agronomic
shapes (grid_static, obs, obs_month, obs_dirty, grid_update, scenario).

Every view is a lazy DataFrame over the parquet scan, so its work grows with
the tables and Catalyst prunes the columns it does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Expression lists of the derived views (FIXTURES.md B1-B5).  They are fed to
# ``selectExpr`` so Catalyst parses them JVM-side in one call.
GRID_STATIC_EXPRS = [
    "p_partkey AS grid_id",
    "concat('g', cast(p_partkey as string)) AS system_index",
    "CASE p_size % 6 WHEN 0 THEN 'ayeyawaddy' WHEN 1 THEN 'bago' WHEN 2 THEN 'magway' "
    "WHEN 3 THEN 'mandalay' WHEN 4 THEN 'sagaing' ELSE 'yangon' END AS region",
    "9 + (p_partkey*37 % 2000)/100 AS latitude",
    "92 + (p_partkey*53 % 1000)/100 AS longitude",
    "(p_partkey*97 % 900)/1 AS elevation_m",
    "(p_partkey*31 % 240)/10 AS slope_degrees",
    "(p_partkey*71 % 360)/1 AS aspect_degrees",
    "(p_partkey*389 % 6000)/1 AS distance_to_surface_water_m",
    "CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE 5 + (p_partkey*43 % 350)/10 END AS soil_cec_cmol_kg_0_30cm",
    "(p_partkey*17 % 60)/1 AS soil_clay_pct_0_30cm",
    "(p_partkey*29 % 90)/1 AS soil_sand_pct_0_30cm",
    "(p_partkey*13 % 50)/1 AS soil_silt_pct_0_30cm",
    "CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE (p_partkey*59 % 450)/10 END AS soil_soc_g_kg_0_30cm",
    "9/2 + (p_partkey*11 % 40)/10 AS soil_ph_h2o_0_30cm",
    "(p_partkey*23 % 100)/1 AS surface_water_occurrence_pct",
    "(p_partkey*5 % 13)/1 AS surface_water_seasonality_months",
    "(p_partkey*67 % 350)/10 AS distance_to_road_km",
    "(p_partkey*19 % 25)/10 AS road_density_km_per_sqkm",
    "(p_partkey*83 % 600)/10 AS distance_to_railway_km",
    "(p_partkey*7 % 8)/10 AS railway_density_km_per_sqkm",
    "(p_partkey*41 % 250)/10 AS distance_to_river_km",
    "(p_partkey*3 % 15)/10 AS river_density_km_per_sqkm",
    "(p_partkey*47 % 30)/100 AS urban_fraction",
    "(p_partkey*61 % 30)/100 AS builtup_fraction",
    "(p_partkey*73 % 100)/100 AS cropland_fraction",
    "1 - (p_partkey*73 % 100)/100 AS non_cropland_fraction",
    "(p_partkey*37 % 40)/100 AS permanent_water_fraction",
    "(p_partkey*89 % 1500)/1 AS population_density",
    "CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS valid_agriculture_mask",
]

OBS_EXPRS = [
    "l_partkey AS grid_id",
    "concat('g', cast(l_partkey as string)) AS system_index",
    "concat(cast(year(l_shipdate) as string), '-', lpad(cast(month(l_shipdate) as string), 2, '0')) AS year_month",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity*8 END AS chirps_precipitation_mm",
    "16 + l_discount*200 + l_tax*50 AS mean_temperature_c",
    "10 + l_tax*200 AS solar_radiation_mj_m2_day",
    "0.05 + (l_extendedprice/105000)*0.4 AS era5_soil_moisture_m3_m3",
    "0.1 + (l_quantity/50)*0.7 AS ndvi_median",
    "-0.5 + l_discount*8 AS ndwi_mcf_median",
    "-22 + l_tax*150 AS s1_vh_db_median",
    "-16 + l_discount*100 AS s1_vv_db_median",
]

# (aggregate, signal) of the monthly view: min/max keep values bit-identical
OBS_MONTH_AGGS = [("min", "chirps_precipitation_mm"), ("max", "mean_temperature_c"),
                  ("max", "solar_radiation_mj_m2_day"), ("min", "era5_soil_moisture_m3_m3"),
                  ("max", "ndvi_median"), ("min", "ndwi_mcf_median"),
                  ("max", "s1_vh_db_median"), ("max", "s1_vv_db_median")]

OBS_DIRTY_EXPRS = [
    "concat(' ', sample_id) AS index",
    "system_index",
    "CASE WHEN grid_id % 5 = 0 THEN 'n/a' WHEN grid_id % 5 = 1 THEN '' WHEN grid_id % 5 = 2 THEN 'NaN' "
    "ELSE cast(cast(chirps_precipitation_mm as int) as string) END AS chirps_precipitation_mm",
    "CASE WHEN data_month = 2 THEN concat(cast(data_year as string), '-13') ELSE year_month END AS year_month",
    "CASE WHEN grid_id % 7 = 0 THEN 'bad' ELSE cast(grid_id % 90 as string) END AS lat",
]

GRID_UPDATE_EXPRS = [
    "concat('g', cast(p_partkey*2 as string)) AS system_index",
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey*101 % 700)/1 END AS elevation_m",
    "(p_partkey*37 % 100)/1 AS surface_water_occurrence_pct",
]


def grid_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one row per grid cell (part) with 25 static features."""
    return table(spark, sf_dir, "part").selectExpr(*GRID_STATIC_EXPRS)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: raw readings (no key; NULL precipitation on line 7)."""
    return table(spark, sf_dir, "lineitem").selectExpr(*OBS_EXPRS)


def obs_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (grid_id, year_month).  Partial aggregation combines a
    hot grid map-side before the shuffle.  The groups are those of the readings'
    (grid_id, system_index, year_month), told apart by the numbers that these
    strings are made from: shorter rows to hash and to shuffle."""
    read = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS grid_id", "year(l_shipdate) AS _year", "month(l_shipdate) AS _month", *OBS_EXPRS[3:])
    agg = read.groupBy("grid_id", "_year", "_month").agg(*[F.expr(f"{fn}({c}) AS {c}") for fn, c in OBS_MONTH_AGGS])
    named = agg.selectExpr(
        "grid_id", "concat('g', cast(grid_id as string)) AS system_index",
        "concat(cast(_year as string), '-', lpad(cast(_month as string), 2, '0')) AS year_month", *[c for _, c in OBS_MONTH_AGGS])
    return named.selectExpr(
        "grid_id", "system_index", "year_month",
        "concat('mm_', cast(grid_id as string), '__', year_month) AS sample_id",
        "cast(substring(year_month, 1, 4) as int) AS data_year",
        "cast(substring(year_month, 6, 2) as int) AS data_month",
        *[c for _, c in OBS_MONTH_AGGS])


def obs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String columns with junk for coercion and parsing operators."""
    return obs_month(spark, sf_dir).selectExpr(*OBS_DIRTY_EXPRS)


def grid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert feed — changed values, NULLs that must overwrite, unknown keys."""
    return table(spark, sf_dir, "part").where("p_partkey % 4 = 1").selectExpr(*GRID_UPDATE_EXPRS)


SCENARIO_COLUMNS = ["data_month", "chirps_precipitation_mm", "chirps_precipitation_mm_mean",
                    "mean_temperature_c", "mean_temperature_c_mean", "era5_soil_moisture_m3_m3_mean",
                    "ndvi_median_mean", "ndvi_median_growing_season_mean", "ndwi_mcf_median_mean",
                    "solar_radiation_mj_m2_day"]

# FIXED VALUES — seasonal what-if overrides (monsoon / dry).
SCENARIO_ROWS = [
    ("monsoon", 8, 350.0, 300.0, 26.5, 27.0, 0.45, 0.75, 0.72, 0.35, 14.5),
    ("dry", 1, 5.0, 10.0, 24.0, 24.5, 0.18, 0.42, 0.50, -0.15, 21.0),
]


def scenario(spark: SparkSession) -> DataFrame:
    """Two fixed scenario rows (a reference table, broadcast by size)."""
    schema = "scenario string, data_month int, " + ", ".join(f"{c} double" for c in SCENARIO_COLUMNS[1:])
    return spark.createDataFrame(SCENARIO_ROWS, schema)
