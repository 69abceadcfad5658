"""SQL text for the DuckDB oracle.

Fixture CTEs are the views of FIXTURES.md.  Query-level SQL (joins,
aggregates, windows) is written by hand per query; the rule formulas come
from ``oracle_rules``.  Every computed column carries the same alias
as on the Spark side; numeric literals are typed DOUBLE so that DuckDB does
not switch to DECIMAL arithmetic.
"""

from __future__ import annotations

from agrolens.constants import (AGG_FEATURES, FEATURES, REGIONAL_CROP_PCT, REGIONS,
                                STATIC_FEATURES, UNKNOWN_CROP_PCT)
from agrolens.plans import oracle_rules as R

# ------------------------------------------------------------------ fixtures

GRID_STATIC = """
SELECT p_partkey AS grid_id, concat('g', cast(p_partkey as string)) AS system_index,
 CASE p_size % 6 WHEN 0 THEN 'ayeyawaddy' WHEN 1 THEN 'bago' WHEN 2 THEN 'magway'
   WHEN 3 THEN 'mandalay' WHEN 4 THEN 'sagaing' ELSE 'yangon' END AS region,
 9 + (p_partkey*37 % 2000)/100 AS latitude, 92 + (p_partkey*53 % 1000)/100 AS longitude,
 (p_partkey*97 % 900)/1 AS elevation_m, (p_partkey*31 % 240)/10 AS slope_degrees,
 (p_partkey*71 % 360)/1 AS aspect_degrees, (p_partkey*389 % 6000)/1 AS distance_to_surface_water_m,
 CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE 5 + (p_partkey*43 % 350)/10 END AS soil_cec_cmol_kg_0_30cm,
 (p_partkey*17 % 60)/1 AS soil_clay_pct_0_30cm, (p_partkey*29 % 90)/1 AS soil_sand_pct_0_30cm,
 (p_partkey*13 % 50)/1 AS soil_silt_pct_0_30cm,
 CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE (p_partkey*59 % 450)/10 END AS soil_soc_g_kg_0_30cm,
 9/2 + (p_partkey*11 % 40)/10 AS soil_ph_h2o_0_30cm,
 (p_partkey*23 % 100)/1 AS surface_water_occurrence_pct, (p_partkey*5 % 13)/1 AS surface_water_seasonality_months,
 (p_partkey*67 % 350)/10 AS distance_to_road_km, (p_partkey*19 % 25)/10 AS road_density_km_per_sqkm,
 (p_partkey*83 % 600)/10 AS distance_to_railway_km, (p_partkey*7 % 8)/10 AS railway_density_km_per_sqkm,
 (p_partkey*41 % 250)/10 AS distance_to_river_km, (p_partkey*3 % 15)/10 AS river_density_km_per_sqkm,
 (p_partkey*47 % 30)/100 AS urban_fraction, (p_partkey*61 % 30)/100 AS builtup_fraction,
 (p_partkey*73 % 100)/100 AS cropland_fraction, 1 - (p_partkey*73 % 100)/100 AS non_cropland_fraction,
 (p_partkey*37 % 40)/100 AS permanent_water_fraction, (p_partkey*89 % 1500)/1 AS population_density,
 CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS valid_agriculture_mask
FROM part"""

OBS = """
SELECT l_partkey AS grid_id, concat('g', cast(l_partkey as string)) AS system_index,
 concat(cast(year(l_shipdate) as string), '-', lpad(cast(month(l_shipdate) as string), 2, '0')) AS year_month,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity*8 END AS chirps_precipitation_mm,
 16 + l_discount*200 + l_tax*50 AS mean_temperature_c, 10 + l_tax*200 AS solar_radiation_mj_m2_day,
 0.05 + (l_extendedprice/105000)*0.4 AS era5_soil_moisture_m3_m3,
 0.1 + (l_quantity/50)*0.7 AS ndvi_median, -0.5 + l_discount*8 AS ndwi_mcf_median,
 -22 + l_tax*150 AS s1_vh_db_median, -16 + l_discount*100 AS s1_vv_db_median
FROM lineitem"""

OBS_MONTH = """
SELECT grid_id, system_index, year_month,
 concat('mm_', cast(grid_id as string), '__', year_month) AS sample_id,
 cast(substring(year_month, 1, 4) as int) AS data_year, cast(substring(year_month, 6, 2) as int) AS data_month,
 min(chirps_precipitation_mm) AS chirps_precipitation_mm, max(mean_temperature_c) AS mean_temperature_c,
 max(solar_radiation_mj_m2_day) AS solar_radiation_mj_m2_day, min(era5_soil_moisture_m3_m3) AS era5_soil_moisture_m3_m3,
 max(ndvi_median) AS ndvi_median, min(ndwi_mcf_median) AS ndwi_mcf_median,
 max(s1_vh_db_median) AS s1_vh_db_median, max(s1_vv_db_median) AS s1_vv_db_median
FROM obs GROUP BY grid_id, system_index, year_month"""

OBS_DIRTY = """
SELECT concat(' ', sample_id) AS index, system_index,
 CASE WHEN grid_id % 5 = 0 THEN 'n/a' WHEN grid_id % 5 = 1 THEN '' WHEN grid_id % 5 = 2 THEN 'NaN'
   ELSE cast(cast(chirps_precipitation_mm as int) as string) END AS chirps_precipitation_mm,
 CASE WHEN data_month = 2 THEN concat(cast(data_year as string), '-13') ELSE year_month END AS year_month,
 CASE WHEN grid_id % 7 = 0 THEN 'bad' ELSE cast(grid_id % 90 as string) END AS lat
FROM obs_month"""

GRID_UPDATE = """
SELECT concat('g', cast(p_partkey*2 as string)) AS system_index,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey*101 % 700)/1 END AS elevation_m,
 (p_partkey*37 % 100)/1 AS surface_water_occurrence_pct
FROM part WHERE p_partkey % 4 = 1"""

SCENARIO = """
SELECT scenario, cast(data_month as int) AS data_month,
 cast(chirps_precipitation_mm as double) AS chirps_precipitation_mm,
 cast(chirps_precipitation_mm_mean as double) AS chirps_precipitation_mm_mean,
 cast(mean_temperature_c as double) AS mean_temperature_c,
 cast(mean_temperature_c_mean as double) AS mean_temperature_c_mean,
 cast(era5_soil_moisture_m3_m3_mean as double) AS era5_soil_moisture_m3_m3_mean,
 cast(ndvi_median_mean as double) AS ndvi_median_mean,
 cast(ndvi_median_growing_season_mean as double) AS ndvi_median_growing_season_mean,
 cast(ndwi_mcf_median_mean as double) AS ndwi_mcf_median_mean,
 cast(solar_radiation_mj_m2_day as double) AS solar_radiation_mj_m2_day
FROM (VALUES
 ('monsoon', 8, 350.0, 300.0, 26.5, 27.0, 0.45, 0.75, 0.72, 0.35, 14.5),
 ('dry', 1, 5.0, 10.0, 24.0, 24.5, 0.18, 0.42, 0.50, -0.15, 21.0))
 AS t(scenario, data_month, chirps_precipitation_mm, chirps_precipitation_mm_mean, mean_temperature_c,
 mean_temperature_c_mean, era5_soil_moisture_m3_m3_mean, ndvi_median_mean, ndvi_median_growing_season_mean,
 ndwi_mcf_median_mean, solar_radiation_mj_m2_day)"""

FIXTURE_SQL = {"grid_static": GRID_STATIC, "obs": OBS, "obs_month": OBS_MONTH, "obs_dirty": OBS_DIRTY,
               "grid_update": GRID_UPDATE, "scenario": SCENARIO}
FIXTURE_DEPS = {"obs_month": ["obs"], "obs_dirty": ["obs", "obs_month"]}


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    """WITH name AS (...), ... body — fixtures first, in dependency order."""
    names = [n for n, _ in ctes]
    ordered: list[tuple[str, str]] = []
    seen: set[str] = set()

    def add(name, text):
        if name in seen:
            return
        for dep in FIXTURE_DEPS.get(name, []):
            add(dep, FIXTURE_SQL[dep])
        seen.add(name)
        ordered.append((name, text))

    for n, t in ctes:
        add(n, t if t is not None else FIXTURE_SQL[n])
    del names
    inner = ",\n".join(f"{n} AS ({t})" for n, t in ordered)
    return f"WITH {inner}\n{body}"


# ------------------------------------------------------------------ helpers

def d(x) -> str:
    """Double literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def rnd(x: str, n: int) -> str:
    sc = d(10 ** n)
    return f"(round_even(({x}) * {sc}, 0) / {sc})"


# ------------------------------------------------------------------ A01 stats

FULL = ["chirps_precipitation_mm", "era5_soil_moisture_m3_m3", "mean_temperature_c",
        "ndvi_median", "ndwi_mcf_median", "solar_radiation_mj_m2_day"]


def xavg(x: str) -> str:
    """Mean over an exact sum of 1e-10 units (same definition as the Spark side)."""
    units = f"CAST(CAST(round_even(({x}) * CAST(1e10 AS DOUBLE), 0) AS BIGINT) AS HUGEINT)"
    return f"((CAST(sum({units}) AS DOUBLE) / CAST(1e10 AS DOUBLE)) / CAST(count({x}) AS DOUBLE))"


def grid_stats_select(src: str = "obs_month", key: str = "grid_id", documented: bool = False) -> str:
    cols = [key]
    for s in FULL:
        cols += [f"{xavg(s)} AS {s}_mean", f"max({s}) AS {s}_max", f"min({s}) AS {s}_min",
                 f"max({s}) - min({s}) AS {s}_range",
                 f"abs(coalesce(coalesce(stddev_samp({s}), 0.0) / nullif({xavg(s)}, 0.0), 0.0)) AS {s}_cv"]
    if documented:
        cols.append(f"coalesce({xavg('CASE WHEN ndvi_median > 0.4 THEN ndvi_median END')}, {xavg('ndvi_median')})"
                    " AS ndvi_median_growing_season_mean")
    else:
        cols.append(f"{xavg('ndvi_median')} AS ndvi_median_growing_season_mean")
    cols += [f"{xavg('s1_vh_db_median')} AS s1_vh_db_median_mean", f"{xavg('s1_vv_db_median')} AS s1_vv_db_median_mean"]
    inner = f"SELECT {', '.join(cols)} FROM {src} GROUP BY {key}"
    return f"SELECT {key}, {', '.join(AGG_FEATURES)} FROM ({inner}) AS _s"


def crop_area_case(crop: str, region_expr: str = "lower(region)") -> str:
    whens = " ".join(f"WHEN '{r}' THEN {d(REGIONAL_CROP_PCT[r].get(crop, UNKNOWN_CROP_PCT))}" for r in REGIONS)
    return f"coalesce(CASE {region_expr} {whens} END, {d(UNKNOWN_CROP_PCT)})"


def region_flag(r: str, region_expr: str = "lower(region)") -> str:
    return f"CAST(coalesce({region_expr}, '') = '{r}' AS INTEGER)"


def training_rows_select(documented: bool = False) -> str:
    """rows: obs_month + stats + static + crop area + region flags."""
    ids = ["m.sample_id", "m.grid_id", "m.system_index", "m.year_month", "m.data_year",
           "s.region", "s.latitude", "s.longitude"]
    feats = []
    for c in FEATURES:
        if c in STATIC_FEATURES:
            feats.append(f"s.{c}")
        elif c in ("chirps_precipitation_mm", "mean_temperature_c", "solar_radiation_mj_m2_day", "data_month"):
            feats.append(f"m.{c}")
        elif c in AGG_FEATURES:
            feats.append(f"st.{c}")
        elif c.startswith("crop_area_pct_"):
            feats.append(f"{crop_area_case(c[len('crop_area_pct_'):], 'lower(s.region)')} AS {c}")
        elif c.startswith("region_"):
            feats.append(f"{region_flag(c[len('region_'):], 'lower(s.region)')} AS {c}")
    return (f"SELECT {', '.join(ids + feats)} FROM obs_month m "
            f"LEFT JOIN grid_stats st ON m.grid_id = st.grid_id "
            f"LEFT JOIN grid_static s ON m.grid_id = s.grid_id")


ROW_IDS = ["sample_id", "grid_id", "system_index", "year_month", "data_year", "region", "latitude", "longitude"]


def rows_ctes(documented: bool = False) -> list[tuple[str, str]]:
    return [("grid_static", None), ("obs", None), ("obs_month", None),
            ("grid_stats", grid_stats_select(documented=documented)),
            ("rows", training_rows_select(documented))]


# ------------------------------------------------------------------ F01-F10 / L01-L40

def label_chain(src: str, out: str = "labelled", tag: str = "") -> list[tuple[str, str]]:
    """CTEs computing the 40 targets over any feature CTE ``src``."""
    return R.label_ctes(src, out, tag)


def labelled_ctes(documented: bool = False) -> list[tuple[str, str]]:
    """CTEs ending in ``labelled`` = rows + components + 40 targets."""
    return rows_ctes(documented) + R.label_ctes("rows")
