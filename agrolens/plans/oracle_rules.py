"""DuckDB SQL of the rules for the oracle: ten components, 40 targets.

Written apart from the engine's ``functions/rules_sql.py`` (no shared text or
helper), from the rules' published definition; only the crop profiles, fixed
values, are the same table.
"""

from __future__ import annotations

from agrolens.constants import CROP_PROFILES, CROPS, RICE_CROPS, WATERLOG_SENSITIVE_CROPS

COMPONENTS = """
 least(greatest(
  exp(-0.5 * (((coalesce(chirps_precipitation_mm_mean, 0) * 12.0 - 1400.0) / 600.0) * ((coalesce(chirps_precipitation_mm_mean, 0) * 12.0 - 1400.0) / 600.0)))
  * least(greatest(1.0 - coalesce(chirps_precipitation_mm_cv, 1) * 0.5, 0.3), 1.0), 0.0), 1.0) AS precip_s,
 least(greatest(
  least(greatest(1.0 - abs(coalesce(era5_soil_moisture_m3_m3_mean, 0.15) - 0.30::DOUBLE) / 0.3::DOUBLE, 0.0), 1.0)
  * least(greatest(coalesce(era5_soil_moisture_m3_m3_min, 0.05) / 0.15::DOUBLE, 0.0), 1.0)
  * least(greatest(1.0 - coalesce(era5_soil_moisture_m3_m3_cv, 0.5) * 0.4::DOUBLE, 0.3), 1.0), 0.0), 1.0) AS sm_s,
 CASE WHEN coalesce(mean_temperature_c_max, 35) > 38
  THEN least(greatest(1.0 - (coalesce(mean_temperature_c_max, 35) - 38) / 10.0::DOUBLE, 0.1), 1.0) ELSE 1.0 END::DOUBLE AS o_heat,
 CASE WHEN coalesce(mean_temperature_c_min, 15) < 10
  THEN least(greatest((coalesce(mean_temperature_c_min, 15) - 5) / 5.0::DOUBLE, 0.1), 1.0) ELSE 1.0 END::DOUBLE AS o_frost,
 least(greatest(1.0 - (coalesce(mean_temperature_c_range, 0) - 10) / 20.0::DOUBLE, 0.5), 1.0)::DOUBLE AS o_span,
 coalesce(mean_temperature_c_mean, 25)::DOUBLE AS o_temp,
 least(greatest(1.0 - coalesce(chirps_precipitation_mm_cv, 1) * 0.5, 0.3), 1.0)::DOUBLE AS o_steady,
 (coalesce(chirps_precipitation_mm_mean, 0) * 12.0)::DOUBLE AS o_rain,
 least(greatest(
  least(greatest(coalesce(ndvi_median_mean, 0.3) / 0.6::DOUBLE, 0.0), 1.0) * 0.4::DOUBLE
  + least(greatest(coalesce(ndvi_median_growing_season_mean, 0.4) / 0.65::DOUBLE, 0.0), 1.0) * 0.4::DOUBLE
  + least(greatest(coalesce(ndvi_median_max, 0.5) / 0.75::DOUBLE, 0.0), 1.0) * 0.2::DOUBLE, 0.0), 1.0) AS ndvi_s,
 least(greatest(
  least(greatest((coalesce(ndwi_mcf_median_mean, -0.2) + 0.3::DOUBLE) / 0.6::DOUBLE, 0.0), 1.0) * 0.6::DOUBLE
  + least(greatest((coalesce(ndwi_mcf_median_max, 0.0) + 0.2::DOUBLE) / 0.5::DOUBLE, 0.0), 1.0) * 0.4::DOUBLE, 0.0), 1.0) AS ndwi_s,
 least(greatest(
  least(greatest(coalesce(soil_soc_g_kg_0_30cm, 20) / 40.0::DOUBLE, 0.0), 1.0) * 0.30::DOUBLE
  + least(greatest(coalesce(soil_cec_cmol_kg_0_30cm, 20) / 35.0::DOUBLE, 0.0), 1.0) * 0.25::DOUBLE
  + exp(-0.5 * (((coalesce(soil_ph_h2o_0_30cm, 6.5) - 6.5::DOUBLE) / 0.8::DOUBLE) * ((coalesce(soil_ph_h2o_0_30cm, 6.5) - 6.5::DOUBLE) / 0.8::DOUBLE))) * 0.20::DOUBLE
  + exp(-0.5 * (((coalesce(soil_clay_pct_0_30cm, 25) - 25) / 15.0::DOUBLE) * ((coalesce(soil_clay_pct_0_30cm, 25) - 25) / 15.0::DOUBLE))) * 0.10::DOUBLE
  + least(greatest(coalesce(soil_silt_pct_0_30cm, 35) / 40.0::DOUBLE, 0.0), 1.0) * 0.10::DOUBLE
  + least(greatest(1.0 - (coalesce(soil_sand_pct_0_30cm, 40) - 50) / 50.0::DOUBLE, 0.1), 1.0) * 0.05::DOUBLE, 0.0), 1.0) AS soil_s,
 least(greatest(
  CASE WHEN coalesce(elevation_m, 50) < 300 THEN 1.0::DOUBLE
   ELSE least(greatest(1.0 - (coalesce(elevation_m, 50) - 300) / 700.0::DOUBLE, 0.2), 1.0) END * 0.4::DOUBLE
  + least(greatest(1.0 - coalesce(slope_degrees, 3) / 20.0::DOUBLE, 0.1), 1.0) * 0.4::DOUBLE
  + (0.75::DOUBLE + 0.25::DOUBLE * cos((coalesce(aspect_degrees, 180) - 180) * 0.017453292519943295::DOUBLE)) * 0.2::DOUBLE, 0.0), 1.0) AS terrain_s,
 least(greatest(
  least(greatest(1.0 - least(coalesce(distance_to_surface_water_m, 2000)::DOUBLE, coalesce(distance_to_river_km, 2.0) * 1000.0::DOUBLE) / 5000.0::DOUBLE, 0.1), 1.0) * 0.5::DOUBLE
  + least(greatest(coalesce(surface_water_occurrence_pct, 50) / 90.0::DOUBLE, 0.0), 1.0) * 0.3::DOUBLE
  + least(greatest(coalesce(surface_water_seasonality_months, 6) / 10.0::DOUBLE, 0.0), 1.0) * 0.2::DOUBLE, 0.0), 1.0) AS water_s,
 least(greatest(
  least(greatest(coalesce(solar_radiation_mj_m2_day_mean, 18) / 20.0::DOUBLE, 0.0), 1.0)
  * CASE WHEN coalesce(solar_radiation_mj_m2_day_max, 22) > 25
     THEN least(greatest(1.0 - (coalesce(solar_radiation_mj_m2_day_max, 22) - 25) / 10.0::DOUBLE, 0.4), 1.0) ELSE 1.0 END::DOUBLE, 0.0), 1.0) AS solar_s,
 least(greatest((
  least(greatest((coalesce(s1_vh_db_median_mean, -15) + 20) / 12.0::DOUBLE, 0.0), 1.0)
  + least(greatest((coalesce(s1_vv_db_median_mean, -10) + 16) / 12.0::DOUBLE, 0.0), 1.0)) / 2.0::DOUBLE, 0.0), 1.0) AS radar_s,
 coalesce(crop_area_pct_monsoon_rice, 20.0) + coalesce(crop_area_pct_dry_season_rice, 10.0) AS o_rice_share,
 (coalesce(elevation_m, 100) < 60 AND coalesce(slope_degrees, 5) < 3.0
  AND (coalesce(surface_water_occurrence_pct, 0) > 15 OR coalesce(era5_soil_moisture_m3_m3_mean, 0.25) > 0.27)) AS o_paddy,
 (coalesce(surface_water_occurrence_pct, 0) > 25
  OR (coalesce(elevation_m, 100) < 30 AND coalesce(slope_degrees, 5) < 1.5 AND coalesce(era5_soil_moisture_m3_m3_mean, 0.25) > 0.30)) AS o_wet"""

_TEMPERATURE = "least(greatest(exp(-0.5 * (((o_temp - {o}) / {w}) * ((o_temp - {o}) / {w}))) * o_heat * o_frost * o_span, 0.0), 1.0)"

#: Targets that others use, rounded once.
SHARED = f"""
 round_even(least(greatest(
  least(greatest(1.0 - coalesce(distance_to_road_km, 10.0) / 30.0::DOUBLE, 0.0), 1.0) * 0.4::DOUBLE
  + least(greatest(coalesce(road_density_km_per_sqkm, 0.5) / 2.0::DOUBLE, 0.0), 1.0) * 0.3::DOUBLE
  + least(greatest(1.0 - coalesce(distance_to_railway_km, 20.0) / 50.0::DOUBLE, 0.0), 1.0) * 0.2::DOUBLE
  + least(greatest(coalesce(railway_density_km_per_sqkm, 0.1) / 0.5::DOUBLE, 0.0), 1.0) * 0.1::DOUBLE, 0.0), 1.0) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS o_market,
 round_even(least(greatest(5.5::DOUBLE * least(greatest(
  least(precip_s, sm_s, temp_s, soil_s) * 0.35::DOUBLE + ndvi_s * 0.25::DOUBLE + sm_s * 0.15::DOUBLE + soil_s * 0.15::DOUBLE + water_s * 0.10::DOUBLE, 0.0), 1.0)
  * least(greatest(1.0 - (coalesce(slope_degrees, 3) - 5) / 30.0::DOUBLE, 0.6), 1.0), 0.5), 6.0) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS o_yield,
 round_even(least(greatest(
  ndvi_s * 0.28::DOUBLE + sm_s * 0.20::DOUBLE + {_TEMPERATURE.format(o="27.0::DOUBLE", w="7.0::DOUBLE")} * 0.18::DOUBLE + ndwi_s * 0.13::DOUBLE
  + soil_s * 0.12::DOUBLE + solar_s * 0.05::DOUBLE + radar_s * 0.04::DOUBLE, 0.0), 1.0) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS o_health"""


def _four(x: str) -> str:
    return f"round_even(least(greatest({x}, 0.0), 1.0) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE"


def _suitability(crop: str) -> str:
    t_best, t_width, r_best, r_width, weights = CROP_PROFILES[crop]
    rain = (f"least(greatest(exp(-0.5 * (((o_rain - {r_best}::DOUBLE) / {r_width}::DOUBLE) * ((o_rain - {r_best}::DOUBLE) / {r_width}::DOUBLE)))"
            " * o_steady, 0.0), 1.0)")
    temp = _TEMPERATURE.format(o=f"{t_best}::DOUBLE", w=f"{t_width}::DOUBLE")
    parts = zip([rain, "sm_s", temp, "ndvi_s", "ndwi_s", "soil_s", "terrain_s", "water_s", "solar_s"], weights, strict=True)
    score = "(" + " + ".join(f"{p} * {w}::DOUBLE" for p, w in parts) + ")"
    if crop in RICE_CROPS:
        score = f"(CASE WHEN o_paddy THEN {score} * 1.2::DOUBLE ELSE {score} END) * CASE WHEN o_rice_share > 50.0 THEN 1.15 ELSE 1.0 END::DOUBLE"
    elif crop in WATERLOG_SENSITIVE_CROPS:
        score = f"(CASE WHEN o_wet THEN {score} * 0.75::DOUBLE ELSE {score} END) * CASE WHEN o_rice_share > 70.0 THEN 0.9 ELSE 1.0 END::DOUBLE"
    s = f"least(greatest({score}, 0.0), 1.0)"
    return f"CASE WHEN {s} > 0.80::DOUBLE THEN 'excellent' WHEN {s} > 0.60::DOUBLE THEN 'good' WHEN {s} > 0.40::DOUBLE THEN 'moderate' ELSE 'poor' END"


def _irrigation() -> str:
    rain, wet = "coalesce(chirps_precipitation_mm_mean, 100)", "coalesce(era5_soil_moisture_m3_m3_mean, 0.2)"
    low, dry, water = ("coalesce(chirps_precipitation_mm_min, 20)", "coalesce(era5_soil_moisture_m3_m3_min, 0.08)",
                       "coalesce(ndwi_mcf_median_mean, -0.2)")
    demand = f"""(CASE WHEN {rain} < 50 THEN 0.30 WHEN {rain} < 100 THEN 0.15 ELSE 0.0 END::DOUBLE
  + CASE WHEN {low} < 10 THEN 0.15 WHEN {low} < 30 THEN 0.07 ELSE 0.0 END::DOUBLE
  + least(greatest(coalesce(chirps_precipitation_mm_cv, 0.5) * 0.15::DOUBLE, 0.0), 0.10)
  + CASE WHEN {wet} < 0.10::DOUBLE THEN 0.25 WHEN {wet} < 0.18::DOUBLE THEN 0.12 ELSE 0.0 END::DOUBLE
  + CASE WHEN {dry} < 0.06::DOUBLE THEN 0.15 WHEN {dry} < 0.12::DOUBLE THEN 0.07 ELSE 0.0 END::DOUBLE
  + CASE WHEN {water} < -0.3::DOUBLE THEN 0.15 WHEN {water} < 0 THEN 0.05 ELSE 0.0 END::DOUBLE
  + least(greatest((coalesce(soil_sand_pct_0_30cm, 40) - 40) / 60.0::DOUBLE * 0.10::DOUBLE, 0.0), 0.10)
  - least(greatest((coalesce(soil_clay_pct_0_30cm, 25) - 30) / 40.0::DOUBLE * 0.05::DOUBLE, 0.0), 0.05)
  + CASE WHEN coalesce(distance_to_surface_water_m, 2000) > 3000 THEN 0.05 ELSE 0.0 END::DOUBLE
  - least(greatest(coalesce(surface_water_occurrence_pct, 50) / 90.0::DOUBLE * 0.05::DOUBLE, 0.0), 0.05))"""
    return f"CASE WHEN {demand} >= 0.35::DOUBLE THEN 2 WHEN {demand} >= 0.18::DOUBLE THEN 1 ELSE 0 END"


def _unit(x: str, low: str = "0.0") -> str:
    return f"least(greatest({x}, {low}), 1.0)"


def targets() -> dict[str, str]:
    """Target -> SQL over a relation that has COMPONENTS and SHARED."""
    out = {f"crop_suitability_{c}": _suitability(c) for c in CROPS}
    out |= {"crop_health_score": "o_health", "crop_yield_t_ha": "o_yield", "irrigation_need": _irrigation(),
            "current_month_precipitation_mm": "coalesce(chirps_precipitation_mm, 0.0)::DOUBLE",
            "current_month_mean_temperature_c": "coalesce(mean_temperature_c, 25.0)::DOUBLE",
            "current_month_solar_rad_mj_m2_day": "coalesce(solar_radiation_mj_m2_day, 18.0)::DOUBLE",
            "market_integration_score": "o_market"}
    out["flood_risk_level"] = """CASE
 WHEN coalesce(surface_water_occurrence_pct, 0) > 50
  OR (coalesce(elevation_m, 100) < 15 AND coalesce(slope_degrees, 5) < 1.0 AND coalesce(s1_vv_db_median_mean, -12) > -9) THEN 2
 WHEN coalesce(surface_water_occurrence_pct, 0) > 20 OR (coalesce(elevation_m, 100) < 35 AND coalesce(slope_degrees, 5) < 2.5) THEN 1 ELSE 0 END"""
    out["drought_risk_score"] = _four(
        _unit("(0.25::DOUBLE - coalesce(era5_soil_moisture_m3_m3_min, 0.20)) / 0.25::DOUBLE") + " * 0.4::DOUBLE + "
        + _unit("(-0.2::DOUBLE - coalesce(ndwi_mcf_median_mean, -0.2)) / 0.5::DOUBLE") + " * 0.3::DOUBLE"
        " + coalesce(era5_soil_moisture_m3_m3_cv, 0.3) * 0.15::DOUBLE + coalesce(chirps_precipitation_mm_cv, 0.5) * 0.15::DOUBLE")
    out["heat_stress_risk"] = """CASE WHEN coalesce(mean_temperature_c_max, 30) > 38.0 OR coalesce(mean_temperature_c_mean, 25) > 32.0 THEN 2
 WHEN coalesce(mean_temperature_c_max, 30) > 34.0 OR coalesce(mean_temperature_c_mean, 25) > 29.0 THEN 1 ELSE 0 END"""
    out["optimal_planting_month"] = """CASE WHEN lower(coalesce(region, '')) IN ('ayeyawaddy', 'bago', 'yangon') THEN 5
 WHEN lower(coalesce(region, '')) = 'magway' AND coalesce(mean_temperature_c_mean, 25) > 28 THEN 7 ELSE 6 END"""
    out["nitrogen_requirement_level"] = """CASE WHEN coalesce(soil_soc_g_kg_0_30cm, 25) > 35.0 THEN 0
 WHEN coalesce(soil_soc_g_kg_0_30cm, 25) < 15.0 THEN 2 ELSE 1 END"""
    out["phosphorus_requirement_level"] = """CASE
 WHEN coalesce(soil_ph_h2o_0_30cm, 6.5) BETWEEN 6.0 AND 7.0 AND coalesce(soil_cec_cmol_kg_0_30cm, 20) >= 25.0 THEN 0
 WHEN coalesce(soil_ph_h2o_0_30cm, 6.5) < 5.5 OR coalesce(soil_ph_h2o_0_30cm, 6.5) > 7.5 OR coalesce(soil_cec_cmol_kg_0_30cm, 20) < 12.0 THEN 2
 ELSE 1 END"""
    out["soil_erosion_risk"] = """CASE
 WHEN coalesce(slope_degrees, 2) > 10.0 OR (coalesce(slope_degrees, 2) > 5.0 AND coalesce(chirps_precipitation_mm_max, 100) > 400) THEN 2
 WHEN coalesce(slope_degrees, 2) > 4.0 OR coalesce(chirps_precipitation_mm_max, 100) > 300 THEN 1 ELSE 0 END"""
    road, density, crop, river = ("coalesce(distance_to_road_km, 10.0)", "coalesce(road_density_km_per_sqkm, 0.5)",
                                  "coalesce(cropland_fraction, 0.5)", "coalesce(distance_to_river_km, 5.0)")
    people, town, built = ("coalesce(population_density, 100.0)", "coalesce(urban_fraction, 0.05)", "coalesce(builtup_fraction, 0.05)")
    out["post_harvest_loss_risk"] = _four(
        f"{_unit(f'{road} / 25.0::DOUBLE')} * 0.4::DOUBLE + {_unit(f'1.0 - {density} / 1.5::DOUBLE')} * 0.3::DOUBLE "
        f"+ {_unit(crop)} * 0.15::DOUBLE + {_unit(f'{river} / 20.0::DOUBLE')} * 0.15::DOUBLE")
    out["supply_chain_efficiency"] = _four(
        f"o_market * 0.6::DOUBLE + {_unit(f'{people} / 1000.0::DOUBLE', '0.1')} * 0.25::DOUBLE + {crop} * 0.15::DOUBLE")
    out["cold_chain_potential"] = _four(
        f"{_unit(f'{density} / 2.0::DOUBLE')} * 0.4::DOUBLE + {_unit(f'({town} + {built}) / 0.4::DOUBLE')} * 0.4::DOUBLE "
        f"+ {_unit(f'{people} / 800.0::DOUBLE')} * 0.2::DOUBLE")
    out["agricultural_land_conversion_risk"] = _four(
        f"({_unit(f'({town} + {built}) / 0.3::DOUBLE')} * 0.4::DOUBLE + {_unit(f'{people} / 1000.0::DOUBLE')} * 0.3::DOUBLE "
        f"+ {_unit(f'{density} / 2.0::DOUBLE')} * 0.3::DOUBLE) * {_unit(f'{crop} * 1.5::DOUBLE', '0.2')}")
    out["urban_encroachment_risk"] = _four(
        f"{_unit(f'{town} * 2.0::DOUBLE + {built} * 2.0::DOUBLE')} * 0.45::DOUBLE + {_unit(f'{people} / 1200.0::DOUBLE')} * 0.35::DOUBLE "
        f"+ {_unit('1.0 - coalesce(distance_to_road_km, 5.0) / 20.0::DOUBLE')} * 0.20::DOUBLE")
    streams, pools = "coalesce(river_density_km_per_sqkm, 0.3)", "coalesce(permanent_water_fraction, 0.05)"
    out["irrigation_potential"] = _four(
        f"{_unit(f'1.0 - {river} / 15.0::DOUBLE')} * 0.35::DOUBLE + {_unit(streams)} * 0.25::DOUBLE "
        f"+ {_unit('coalesce(surface_water_occurrence_pct, 20.0) / 80.0::DOUBLE')} * 0.25::DOUBLE + {_unit(f'{pools} / 0.3::DOUBLE')} * 0.15::DOUBLE")
    out["surface_water_occurrence"] = _four(
        "coalesce(surface_water_occurrence_pct, 0.0) / 100.0::DOUBLE * 0.7::DOUBLE + coalesce(permanent_water_fraction, 0.0) * 0.3::DOUBLE")
    out["water_scarcity_risk"] = _four(
        f"{_unit(f'1.0 - {streams}')} * 0.3::DOUBLE + {_unit('1.0 - coalesce(chirps_precipitation_mm_mean, 100.0) / 180.0::DOUBLE')} * 0.4::DOUBLE "
        f"+ {_unit('(0.35::DOUBLE - coalesce(era5_soil_moisture_m3_m3_mean, 0.2)) / 0.35::DOUBLE')} * 0.3::DOUBLE")
    out["agricultural_gdp_forecast"] = _four(
        f"{_unit('o_yield / 6.0::DOUBLE')} * 0.4::DOUBLE + o_market * 0.3::DOUBLE + {crop} * 0.2::DOUBLE + o_health * 0.1::DOUBLE")
    return out


def components_select(src: str) -> str:
    """``src`` with the components; the temperature component needs its own parts first."""
    temp = _TEMPERATURE.format(o="27.0::DOUBLE", w="8.0::DOUBLE")
    return f"SELECT *, {temp} AS temp_s FROM (SELECT *, {COMPONENTS} FROM {src}) AS c"


def label_ctes(src: str, out: str = "labelled", tag: str = "") -> list[tuple[str, str]]:
    """CTEs that end in ``out``: ``src`` with components and the 40 targets."""
    body = ", ".join(f"{e} AS {t}" for t, e in targets().items())
    return [(f"oc{tag}", components_select(src)), (f"os{tag}", f"SELECT *, {SHARED} FROM oc{tag}"), (out, f"SELECT *, {body} FROM os{tag}")]


# ------------------------------------------------------------------ fallback estimators E01-E25

def _levels(high: str, medium: str) -> tuple[str, str]:
    return (f"CASE WHEN {high} THEN 2 WHEN {medium} THEN 1 ELSE 0 END",
            f"CASE WHEN {high} THEN 'High' WHEN {medium} THEN 'Medium' ELSE 'Low' END")


def _nearest(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10.0 ** digits}::DOUBLE, 0) / {10.0 ** digits}::DOUBLE"


def _shown(pattern: str, x: str, digits: int) -> str:
    return f"printf('{pattern}', {_nearest(x, digits)})"


def fallback(corrected: bool = False) -> dict[str, tuple[str, str]]:
    """Target -> (value, label) of the fallback estimators over feature rows."""
    green, carbon, acid = "coalesce(ndvi_median_mean, 0.55)", "coalesce(soil_soc_g_kg_0_30cm, 12.0)", "coalesce(soil_ph_h2o_0_30cm, 6.2)"
    moist, rain, warm = ("coalesce(era5_soil_moisture_m3_m3_mean, 0.28)", "coalesce(chirps_precipitation_mm_mean, 120.0)",
                         "coalesce(mean_temperature_c_mean, 27.5)")
    water, road = "coalesce(distance_to_surface_water_m, 500.0)", "coalesce(distance_to_road_km, 5.0)"
    people, built = "coalesce(population_density, 150.0)", "coalesce(builtup_fraction, 0.05)"
    slope, sun = "coalesce(slope_degrees, 3.0)", "coalesce(solar_radiation_mj_m2_day_mean, 18.5)"
    out: dict[str, tuple[str, str]] = {}
    fit = (f"({green} * 0.4::DOUBLE + least({carbon} / 25.0::DOUBLE, 1.0) * 0.3::DOUBLE + least({moist} / 0.4::DOUBLE, 1.0) * 0.3::DOUBLE)")
    grade = f"CASE WHEN {fit} > 0.75 THEN 'excellent' WHEN {fit} > 0.55 THEN 'good' WHEN {fit} > 0.35 THEN 'moderate' ELSE 'poor' END"
    for crop in CROPS:
        out[f"crop_suitability_{crop}"] = fit, grade
    health = _unit(f"{green} * 0.5::DOUBLE + least({moist} / 0.35::DOUBLE, 1.0) * 0.3::DOUBLE + least({carbon} / 20.0::DOUBLE, 1.0) * 0.2::DOUBLE")
    out["crop_health_score"] = _nearest(health, 3), _shown("%.1f%%", f"{health} * 100.0::DOUBLE", 1)
    harvest = _nearest(f"3.8::DOUBLE * ({green} / 0.6::DOUBLE * least({carbon} / 15.0::DOUBLE, 1.2) * least({moist} / 0.25::DOUBLE, 1.1))", 2)
    out["crop_yield_t_ha"] = f"least(greatest({harvest}, 0.5), 7.5)", f"concat(CAST({harvest} AS VARCHAR), ' tons/ha')"
    out["irrigation_need"] = _levels(f"({moist} < 0.18 AND {rain} < 50)", f"({moist} < 0.28 OR {rain} < 100)")
    current = {"current_month_precipitation_mm": (rain, "%.1f mm"), "current_month_mean_temperature_c": (warm, "%.1f °C"),
               "current_month_solar_rad_mj_m2_day": (sun, "%.1f MJ/m²/day")}
    for target, (x, pattern) in current.items():
        out[target] = (_nearest(x, 1), _shown(pattern, x, 1)) if corrected else ("0.5::DOUBLE", "'Moderate'")
    out["flood_risk_level"] = _levels(f"({rain} > 250 OR {water} < 100)", f"({rain} > 150 OR {water} < 300)")
    thirst = _unit(f"1.0::DOUBLE - ({moist} / 0.4::DOUBLE * 0.6::DOUBLE + {rain} / 200.0::DOUBLE * 0.4::DOUBLE)")
    out["drought_risk_score"] = _nearest(thirst, 3), _shown("%.1f%%", f"{thirst} * 100.0::DOUBLE", 1)
    out["heat_stress_risk"] = f"CASE WHEN {warm} > 34.0 THEN 1 ELSE 0 END", f"CASE WHEN {warm} > 34.0 THEN 'High' ELSE 'Normal' END"
    out["optimal_planting_month"] = (f"CASE WHEN {rain} > 100 THEN 5 ELSE 11 END",
                                     f"CASE WHEN {rain} > 100 THEN 'May (Monsoon)' ELSE 'November (Dry Season)' END")
    out["nitrogen_requirement_level"] = _levels(f"{carbon} < 10.0", f"{carbon} < 18.0")
    off = f"({acid} < 5.5 OR {acid} > 7.5)"
    out["phosphorus_requirement_level"] = f"CASE WHEN {off} THEN 2 ELSE 1 END", f"CASE WHEN {off} THEN 'High' ELSE 'Medium' END"
    out["soil_erosion_risk"] = _levels(f"{slope} > 15.0", f"{slope} > 6.0")
    near = _unit(f"1.0::DOUBLE - {road} / 20.0::DOUBLE", "0.1")
    out["market_integration_score"] = _nearest(near, 2), _shown("%.0f/100", f"{near} * 100.0::DOUBLE", 0)
    out["post_harvest_loss_risk"] = _levels(f"{road} > 15.0", f"{road} > 5.0")
    chain = f"least(greatest(0.9::DOUBLE - {road} * 0.03::DOUBLE, 0.2), 0.95)"
    out["supply_chain_efficiency"] = _nearest(chain, 2), _shown("%.0f%%", f"{chain} * 100.0::DOUBLE", 0)
    cold = _unit(f"{built} * 5.0::DOUBLE + {people} / 500.0::DOUBLE", "0.1")
    out["cold_chain_potential"] = _nearest(cold, 2), _shown("%.0f%%", f"{cold} * 100.0::DOUBLE", 0)
    out["agricultural_land_conversion_risk"] = _levels(f"({built} > 0.15 OR {people} > 400)", f"{built} > 0.05")
    out["urban_encroachment_risk"] = _levels(f"{built} > 0.20", f"{built} > 0.08")
    ditch = _unit(f"1.0::DOUBLE - {water} / 2000.0::DOUBLE", "0.05")
    out["irrigation_potential"] = _nearest(ditch, 2), _shown("%.0f%%", f"{ditch} * 100.0::DOUBLE", 0)
    open_water = "coalesce(surface_water_occurrence_pct, 15.0) / 100.0::DOUBLE"
    out["surface_water_occurrence"] = _nearest(open_water, 2), _shown("%.1f%%", f"{open_water} * 100.0::DOUBLE", 1)
    out["water_scarcity_risk"] = _levels(f"({moist} < 0.15 AND {water} > 1000)", f"{moist} < 0.25")
    money = _nearest(f"1250.0::DOUBLE * ({green} / 0.5::DOUBLE) * ({carbon} / 12.0::DOUBLE)", 2)
    out["agricultural_gdp_forecast"] = money, f"concat('$', format('{{:,.2f}}', {money}), '/ha/yr')"
    return out


# ------------------------------------------------------------------ composites C01-C14 over the relation of the 40 targets

_SCORE = {"excellent": 100.0, "good": 75.0, "moderate": 40.0, "poor": 10.0}
_HEX = {"excellent": "#10B981", "good": "#3B82F6", "moderate": "#F59E0B", "poor": "#EF4444"}


def _pick(x: str, table: dict, default: str) -> str:
    found = " ".join(f"WHEN {x} = '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE") for k, v in table.items())
    return f"CASE {found} ELSE {default} END"


def crops_long(src: str) -> str:
    """One row per sample and crop: label, base score, area, composite score, colour."""
    rows = " UNION ALL ".join(
        f"SELECT sample_id, '{c}' AS crop, {i} AS ord, lower(crop_suitability_{c}) AS label, coalesce(crop_area_pct_{c}, 0)::DOUBLE AS area "
        f"FROM {src} WHERE crop_suitability_{c} IS NOT NULL" for i, c in enumerate(CROPS))
    return (f"SELECT *, base + area * 0.1::DOUBLE AS composite FROM (SELECT *, {_pick('label', _SCORE, '40.0::DOUBLE')} AS base, "
            f"{_pick('label', _HEX, chr(39) + '#3B82F6' + chr(39))} AS color FROM ({rows}) AS l) AS b")


def adjusted(idx: str) -> str:
    return f"round_even(greatest(1.0, least(100.0, base + area * 0.05::DOUBLE - {idx} * 0.1::DOUBLE)) * 10.0::DOUBLE, 0) / 10.0::DOUBLE"


def ranked_crops(src: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY base DESC, composite DESC, ord) - 1 AS idx FROM ({crops_long(src)}) AS c"


def _health(score: str) -> tuple[str, str]:
    steps = (("Critical", 0.20, "#8B5CF6"), ("Poor", 0.40, "#EF4444"), ("Moderate", 0.60, "#F59E0B"), ("Good", 0.80, "#3B82F6"))
    of = lambda k, last: "CASE " + " ".join(f"WHEN {score} < {s[1]}::DOUBLE THEN '{s[k]}'" for s in steps) + f" ELSE '{last}' END"
    return of(0, "Excellent"), of(2, "#10B981")


def health_layer() -> dict[str, str]:
    score = "coalesce(crop_health_score, 0.6)::DOUBLE"
    name, color = _health(score)
    return {"status": "'experimental'", "health_score": score, "health_class": name, "map_color_hex": color, "field_validated": "false",
            "ndvi_median": "nullif(ndvi_median_mean, 0)::DOUBLE"}


def _danger(target: str) -> str:
    return f"CASE lower(CAST({target} AS VARCHAR)) WHEN '1' THEN 0.5 WHEN 'medium' THEN 0.5 WHEN 'moderate' THEN 0.5 " \
           "WHEN '2' THEN 1.0 WHEN 'high' THEN 1.0 WHEN 'critical' THEN 1.0 ELSE 0.0 END::DOUBLE"


def _grade(worst: str, high: float, medium: float) -> str:
    return f"CASE WHEN {worst} >= {high}::DOUBLE THEN 'high' WHEN {worst} >= {medium}::DOUBLE THEN 'medium' ELSE 'low' END"


def risk_alerts() -> dict[str, str]:
    parts = {"flood_score": _danger("flood_risk_level"), "drought_score": "coalesce(drought_risk_score, 0.0)::DOUBLE",
             "heat_score": _danger("heat_stress_risk"), "erosion_score": _danger("soil_erosion_risk"),
             "water_scarcity_score": "coalesce(water_scarcity_risk, 0.0)::DOUBLE"}
    return {"status": "'experimental'", **parts, "overall_level": _grade(f"greatest({', '.join(parts.values())})", 0.7, 0.4),
            "advisory_status": "'human_review_required'", "approved_action": "CAST(NULL AS VARCHAR)", "field_validated": "false"}


def land_use() -> dict[str, str]:
    lost, town = "coalesce(agricultural_land_conversion_risk, 0.0)::DOUBLE", "coalesce(urban_encroachment_risk, 0.0)::DOUBLE"
    return {"status": "'experimental'", "field_validated": "false", "risk_level": _grade(f"greatest({lost}, {town})", 0.6, 0.3),
            "conversion_risk_score": lost, "urban_encroachment_score": town, "cropland_fraction": "cropland_fraction::DOUBLE"}


def health_map() -> dict[str, str]:
    score = "coalesce(crop_health_score, 0.65)::DOUBLE"
    name, color = _health(score)
    return {"health_score": score, "health_status": name, "status_color_hex": color, "ndvi_median": "coalesce(ndvi_median_mean, 0.55)::DOUBLE",
            "ndwi_water_index": "coalesce(ndwi_mcf_median_mean, 0.15)::DOUBLE",
            "soil_moisture_m3_m3": "coalesce(era5_soil_moisture_m3_m3_mean, 0.28)::DOUBLE"}


def location_panel() -> dict[str, str]:
    plain = {"organic_carbon_g_kg": ("soil_soc_g_kg_0_30cm", 12.0), "ph_level": ("soil_ph_h2o_0_30cm", 6.5),
             "cec_cmol_kg": ("soil_cec_cmol_kg_0_30cm", 15.0), "clay_pct": ("soil_clay_pct_0_30cm", 30.0),
             "sand_pct": ("soil_sand_pct_0_30cm", 40.0), "silt_pct": ("soil_silt_pct_0_30cm", 30.0), "elevation_m": ("elevation_m", 15.0),
             "slope_degrees": ("slope_degrees", 2.0), "distance_to_surface_water_m": ("distance_to_surface_water_m", 450.0),
             "surface_water_occurrence_pct": ("surface_water_occurrence_pct", 20.0)}
    month = {"precipitation_mm": ("chirps_precipitation_mm_mean", 120.0), "mean_temperature_c": ("mean_temperature_c_mean", 27.5),
             "solar_radiation_mj_m2_day": ("solar_radiation_mj_m2_day_mean", 18.5)}
    return {k: f"coalesce({c}, {d})::DOUBLE" for k, (c, d) in plain.items()} \
        | {k: _nearest(f"coalesce({c}, {d})::DOUBLE", 1) for k, (c, d) in month.items()}


def agronomic_pattern() -> dict[str, str]:
    label = lambda t: f"concat(upper(left(CAST({t} AS VARCHAR), 1)), lower(substr(CAST({t} AS VARCHAR), 2)))"
    carbon, acid = "coalesce(soil_soc_g_kg_0_30cm, 12.0)", "coalesce(soil_ph_h2o_0_30cm, 6.5)"
    need, month = label("irrigation_need"), label("optimal_planting_month")
    return {"soil_fertility_status": f"CASE WHEN {carbon} <= 10.0 THEN 'Low' WHEN {carbon} <= 18.0 THEN 'Moderate' ELSE 'High' END",
            "soil_acidity_status": f"CASE WHEN {acid} < 6.0 THEN 'Acidic' WHEN {acid} <= 7.2 THEN 'Optimal' ELSE 'Alkaline' END",
            "irrigation_need_status": need, "optimal_planting_season": month, "nitrogen_requirement": label("nitrogen_requirement_level"),
            "phosphorus_requirement": label("phosphorus_requirement_level"), "potassium_requirement": "'Medium'",
            "suggested_mix_kg_ha": "'N: 90 kg/ha | P2O5: 45 kg/ha | K2O: 30 kg/ha'",
            "advice": f"concat('Optimal planting window begins in ', {month}, '.|Maintain irrigation frequency according to ', {need}, "
                      "' deficit level.|Incorporate organic compost to enhance Cation Exchange Capacity (CEC) and soil structure.')"}


def market_module() -> dict[str, str]:
    market = "coalesce(market_integration_score, 0.75)::DOUBLE"
    return {"market_integration_score": market, "post_harvest_loss_risk": f"coalesce({_shown('%.2f', 'post_harvest_loss_risk', 2)}, 'Medium')",
            "supply_chain_efficiency_pct": _nearest("coalesce(supply_chain_efficiency, 0.80)::DOUBLE * 100.0::DOUBLE", 1),
            "cold_chain_potential_pct": _nearest("coalesce(cold_chain_potential, 0.65)::DOUBLE * 100.0::DOUBLE", 1),
            "transport_accessibility": f"CASE WHEN {market} > 0.7::DOUBLE THEN 'Good' ELSE 'Moderate' END"}


def gdp_module() -> dict[str, str]:
    money = "coalesce(agricultural_gdp_forecast, 1250.0)::DOUBLE"
    return {"estimated_agricultural_gdp_usd_ha": money, "projected_yield_value_usd_ha": _nearest(f"{money} * 0.85::DOUBLE", 2),
            "economic_rating": f"CASE WHEN {money} > 1500 THEN 'High Productivity Zone' ELSE 'Standard Production Zone' END"}


_WEIGHT = {"excellent": 1.0, "good": 0.75, "moderate": 0.40, "poor": 0.10}


def suitabilities(src: str) -> str:
    """One row per sample and crop of the suitability module (an unknown class is moderate)."""
    rows = " UNION ALL ".join(f"SELECT sample_id, '{c}' AS crop, {i} AS ord, lower(CAST(crop_suitability_{c} AS VARCHAR)) AS raw, "
                              "coalesce(market_integration_score, 0.75)::DOUBLE AS market, coalesce(crop_yield_t_ha, 3.8)::DOUBLE AS harvest "
                              f"FROM {src}" for i, c in enumerate(CROPS))
    known = f"SELECT *, CASE WHEN raw IN ('excellent', 'good', 'moderate', 'poor') THEN raw ELSE 'moderate' END AS suitability_class FROM ({rows}) AS l"
    return (f"SELECT *, concat(upper(left(suitability_class, 1)), substr(suitability_class, 2)) AS suitability_label, "
            f"{_pick('suitability_class', _WEIGHT, '0.4::DOUBLE')} AS suitability_score, "
            f"{_pick('suitability_class', _HEX, chr(39) + '#F59E0B' + chr(39))} AS color_hex FROM ({known}) AS k")


def backend_ranking(src: str) -> str:
    """Crops by rounded weight and market score, in crop order on ties."""
    factor = "CASE WHEN crop LIKE '%rice%' THEN 1.1 WHEN crop IN ('maize', 'sugarcane') THEN 1.2 ELSE 0.6 END::DOUBLE"
    names = " ".join(f"WHEN '{c}' THEN '{' '.join(w.capitalize() for w in c.split('_'))}'" for c in CROPS)
    scored = (f"SELECT sample_id, crop, ord, CASE crop {names} END AS crop_display_name, "
              f"{_nearest('suitability_score * 0.7::DOUBLE + market * 0.3::DOUBLE', 3)} AS rank_score, suitability_class, "
              f"{_nearest(f'harvest * {factor}', 2)} AS expected_yield_t_ha, color_hex AS suitability_color, "
              "concat('High agronomic fit for ', replace(crop, '_', ' '), ' with favorable soil & moisture conditions.') AS rationale "
              f"FROM ({suitabilities(src)}) AS s")
    return f"SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank_score DESC, ord) AS rk FROM ({scored}) AS r"


def alerts_long(src: str, corrected: bool) -> str:
    """One row per sample and alert that fires.  Classes are text, so only the
    corrected reading compares them with numbers."""
    flood = "TRY_CAST(flood_risk_level AS INTEGER)" if corrected else "NULL"
    heat = "TRY_CAST(heat_stress_risk AS INTEGER)" if corrected else "NULL"
    dry, scarce = "coalesce(drought_risk_score, 0.2)::DOUBLE", f"coalesce({_shown('%.2f', 'water_scarcity_risk', 2)}, 'Low')"
    return f"""
SELECT sample_id, 1 AS ord, 'FLOOD_RISK' AS type, severity, concat(upper(left(severity, 1)), lower(substr(severity, 2)), ' Flood Risk Detected') AS title,
 'High precipitation volume or proximity to water bodies creates localized flood potential.' AS description,
 'Ensure surface drainage channels are clear and elevate seed beds.' AS action
 FROM (SELECT sample_id, CASE {flood} WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END AS severity FROM {src}) AS a WHERE severity IS NOT NULL
UNION ALL SELECT sample_id, 2, 'DROUGHT_RISK', severity, concat(upper(left(severity, 1)), lower(substr(severity, 2)), ' Drought Stress Alert'),
 concat('Soil moisture deficit index at ', {_shown('%.1f', 'dry * 100.0::DOUBLE', 1)}, '%.'), 'Schedule supplementary drip or canal irrigation immediately.'
 FROM (SELECT sample_id, {dry} AS dry, CASE WHEN {dry} > 0.75 THEN 'CRITICAL' WHEN {dry} > 0.5 THEN 'HIGH' END AS severity FROM {src}) AS b WHERE severity IS NOT NULL
UNION ALL SELECT sample_id, 3, 'HEAT_STRESS', 'HIGH', 'High Heat Stress Warning', 'Temperatures exceed optimal growth threshold during daytime hours.',
 'Apply organic mulch to retain soil moisture and reduce root zone heat.' FROM {src} WHERE {heat} = 1
UNION ALL SELECT sample_id, 4, 'WATER_SCARCITY', upper(label), concat(label, ' Water Scarcity Risk'),
 'Surface water proximity and precipitation levels indicate potential irrigation constraints.',
 'Adopt drought-tolerant seed varieties and water conservation techniques.'
 FROM (SELECT sample_id, {scarce} AS label FROM {src}) AS c WHERE label IN ('High', 'Medium')"""


def alert_counts(src: str, corrected: bool) -> str:
    return (f"SELECT p.sample_id, CAST(count(a.type) AS INTEGER) AS alert_count, "
            f"coalesce(string_agg(a.type || ':' || a.severity, '|' ORDER BY a.ord), '') AS alerts "
            f"FROM {src} p LEFT JOIN ({alerts_long(src, corrected)}) AS a ON p.sample_id = a.sample_id GROUP BY p.sample_id")
