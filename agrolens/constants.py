"""Reference tables and fixed lists.

Everything in this module is data, not logic: crop profiles, regional crop
shares, class weights, colours, physical bounds and the feature/target
lists.  They are small (<= 102 rows) and are folded into column
expressions or turned into tiny broadcast DataFrames.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference for identical results.
# ---------------------------------------------------------------------------

REGIONS = ["ayeyawaddy", "bago", "magway", "mandalay", "sagaing", "yangon"]

CROPS = [
    "monsoon_rice", "dry_season_rice", "maize", "sugarcane", "cassava",
    "durian", "mangosteen", "longan", "mango", "chili", "tomato",
    "black_gram", "green_gram", "pigeon_pea", "groundnut", "sesame", "rubber",
]

# crop -> (t_opt, t_spread, rain_opt_mm, rain_spread_mm,
#          weights for [precip, soil_moisture, temperature, ndvi, ndwi,
#                       soil_fertility, terrain, water_proximity, solar])
CROP_PROFILES = {
    "monsoon_rice":    (25, 6, 1800, 600, [0.18, 0.20, 0.12, 0.12, 0.10, 0.10, 0.06, 0.08, 0.04]),
    "dry_season_rice": (26, 6, 1400, 500, [0.12, 0.20, 0.12, 0.12, 0.10, 0.10, 0.06, 0.12, 0.06]),
    "maize":           (25, 6, 800, 400,  [0.16, 0.14, 0.14, 0.12, 0.08, 0.14, 0.10, 0.06, 0.06]),
    "sugarcane":       (27, 6, 1500, 500, [0.16, 0.16, 0.13, 0.12, 0.08, 0.12, 0.09, 0.08, 0.06]),
    "cassava":         (26, 7, 1000, 500, [0.14, 0.12, 0.14, 0.12, 0.08, 0.14, 0.12, 0.07, 0.07]),
    "durian":          (27, 5, 1800, 600, [0.15, 0.15, 0.14, 0.13, 0.09, 0.12, 0.09, 0.07, 0.06]),
    "mangosteen":      (27, 5, 2000, 600, [0.14, 0.16, 0.14, 0.13, 0.09, 0.12, 0.09, 0.07, 0.06]),
    "longan":          (25, 6, 1200, 500, [0.14, 0.13, 0.14, 0.12, 0.09, 0.13, 0.10, 0.08, 0.07]),
    "mango":           (26, 7, 1000, 500, [0.13, 0.12, 0.15, 0.12, 0.09, 0.13, 0.12, 0.08, 0.06]),
    "chili":           (25, 6, 900, 400,  [0.14, 0.13, 0.14, 0.12, 0.08, 0.15, 0.10, 0.08, 0.06]),
    "tomato":          (22, 5, 800, 400,  [0.13, 0.13, 0.16, 0.12, 0.08, 0.15, 0.10, 0.07, 0.06]),
    "black_gram":      (26, 6, 900, 400,  [0.14, 0.14, 0.14, 0.12, 0.08, 0.16, 0.10, 0.06, 0.06]),
    "green_gram":      (26, 6, 800, 350,  [0.14, 0.14, 0.14, 0.12, 0.08, 0.16, 0.10, 0.06, 0.06]),
    "pigeon_pea":      (27, 7, 750, 400,  [0.12, 0.12, 0.16, 0.12, 0.08, 0.16, 0.12, 0.06, 0.06]),
    "groundnut":       (26, 6, 850, 400,  [0.14, 0.13, 0.14, 0.12, 0.08, 0.17, 0.10, 0.06, 0.06]),
    "sesame":          (28, 6, 700, 350,  [0.12, 0.11, 0.16, 0.12, 0.07, 0.18, 0.12, 0.06, 0.06]),
    "rubber":          (27, 5, 2200, 600, [0.18, 0.18, 0.14, 0.12, 0.08, 0.12, 0.08, 0.06, 0.04]),
}

RICE_CROPS = ["monsoon_rice", "dry_season_rice"]
WATERLOG_SENSITIVE_CROPS = ["mango", "durian", "longan", "mangosteen", "cassava",
                            "tomato", "sesame", "pigeon_pea"]

# region -> crop -> share of cropped area in percent (unknown pair -> 1.0)
REGIONAL_CROP_PCT = {
    "ayeyawaddy": {
        "monsoon_rice": 62.0, "dry_season_rice": 24.0, "black_gram": 7.0, "green_gram": 2.5,
        "maize": 1.0, "groundnut": 1.0, "chili": 0.8, "sesame": 0.5, "cassava": 0.3,
        "sugarcane": 0.3, "mango": 0.2, "pigeon_pea": 0.1, "tomato": 0.1, "durian": 0.05,
        "mangosteen": 0.05, "longan": 0.05, "rubber": 0.05,
    },
    "bago": {
        "monsoon_rice": 58.0, "dry_season_rice": 18.0, "black_gram": 10.0, "green_gram": 5.0,
        "sugarcane": 3.0, "groundnut": 1.5, "sesame": 1.5, "maize": 1.2, "rubber": 0.8,
        "mango": 0.3, "chili": 0.3, "cassava": 0.2, "pigeon_pea": 0.1, "tomato": 0.05,
        "durian": 0.02, "mangosteen": 0.02, "longan": 0.01,
    },
    "yangon": {
        "monsoon_rice": 65.0, "dry_season_rice": 15.0, "black_gram": 6.0, "green_gram": 4.0,
        "groundnut": 2.5, "chili": 2.0, "tomato": 1.5, "cassava": 1.2, "mango": 1.0,
        "maize": 0.8, "sesame": 0.4, "sugarcane": 0.3, "rubber": 0.2, "pigeon_pea": 0.05,
        "durian": 0.02, "mangosteen": 0.02, "longan": 0.01,
    },
    "magway": {
        "sesame": 32.0, "groundnut": 22.0, "pigeon_pea": 14.0, "monsoon_rice": 11.0,
        "green_gram": 8.0, "maize": 4.5, "dry_season_rice": 3.5, "chili": 1.5,
        "black_gram": 1.5, "tomato": 0.8, "mango": 0.5, "sugarcane": 0.4, "cassava": 0.2,
        "rubber": 0.05, "durian": 0.01, "mangosteen": 0.01, "longan": 0.03,
    },
    "mandalay": {
        "sesame": 26.0, "groundnut": 19.0, "pigeon_pea": 16.0, "monsoon_rice": 13.0,
        "green_gram": 9.0, "maize": 6.0, "dry_season_rice": 4.0, "chili": 2.5,
        "tomato": 2.0, "mango": 1.2, "sugarcane": 0.8, "black_gram": 0.4, "cassava": 0.05,
        "rubber": 0.01, "durian": 0.01, "mangosteen": 0.01, "longan": 0.02,
    },
    "sagaing": {
        "monsoon_rice": 32.0, "sesame": 18.0, "groundnut": 14.0, "maize": 10.0,
        "pigeon_pea": 9.0, "green_gram": 6.0, "dry_season_rice": 5.0, "black_gram": 2.5,
        "sugarcane": 1.5, "chili": 0.8, "mango": 0.5, "tomato": 0.4, "cassava": 0.2,
        "rubber": 0.05, "durian": 0.01, "mangosteen": 0.01, "longan": 0.03,
    },
}
UNKNOWN_CROP_PCT = 1.0

# class -> weight: service/pipeline recommender (poor = 0.10) and the regional
# roll-up (poor = 0.0) use different tables.
SUITABILITY_WEIGHTS = {"excellent": 1.0, "good": 0.75, "moderate": 0.40, "poor": 0.10}
ROLLUP_SUITABILITY_WEIGHTS = {"excellent": 1.0, "good": 0.75, "moderate": 0.40, "poor": 0.0}
UNKNOWN_SUITABILITY_WEIGHT = 0.40

SUITABILITY_COLORS = {"excellent": "#10B981", "good": "#3B82F6",
                      "moderate": "#F59E0B", "poor": "#EF4444"}
HEALTH_COLORS = {"Excellent": "#10B981", "Good": "#3B82F6", "Moderate": "#F59E0B",
                 "Poor": "#EF4444", "Critical": "#8B5CF6"}

# Physical bounds per numeric target (lo, hi)
PHYSICAL_BOUNDS = {
    "crop_yield_t_ha": (0.0, 20.0),
    "crop_health_score": (0.0, 1.0),
    "drought_risk_score": (0.0, 1.0),
    "market_integration_score": (0.0, 1.0),
    "post_harvest_loss_risk": (0.0, 1.0),
    "supply_chain_efficiency": (0.0, 1.0),
    "cold_chain_potential": (0.0, 1.0),
    "agricultural_land_conversion_risk": (0.0, 1.0),
    "urban_encroachment_risk": (0.0, 1.0),
    "irrigation_potential": (0.0, 1.0),
    "surface_water_occurrence": (0.0, 1.0),
    "water_scarcity_risk": (0.0, 1.0),
    "current_month_mean_temperature_c": (0.0, 55.0),
    "current_month_precipitation_mm": (0.0, 3000.0),
    "current_month_solar_rad_mj_m2_day": (0.0, 40.0),
}

# Domain feature weights used for sample weighting (1.0 = neutral)
FEATURE_WEIGHTS = {
    "soil_soc_g_kg_0_30cm": 3.0, "soil_cec_cmol_kg_0_30cm": 2.5, "soil_ph_h2o_0_30cm": 2.5,
    "soil_clay_pct_0_30cm": 1.5, "soil_sand_pct_0_30cm": 1.5, "soil_silt_pct_0_30cm": 1.2,
    "era5_soil_moisture_m3_m3_mean": 3.0, "era5_soil_moisture_m3_m3_min": 2.5,
    "era5_soil_moisture_m3_m3_cv": 1.8, "ndwi_mcf_median_mean": 2.0, "ndwi_mcf_median_max": 1.5,
    "distance_to_surface_water_m": 1.8, "surface_water_occurrence_pct": 1.5,
    "surface_water_seasonality_months": 1.3,
    "chirps_precipitation_mm_mean": 2.5, "chirps_precipitation_mm_min": 2.0,
    "chirps_precipitation_mm_cv": 1.8, "chirps_precipitation_mm_max": 1.5,
    "chirps_precipitation_mm_range": 1.3, "chirps_precipitation_mm": 1.5,
    "ndvi_median_mean": 2.5, "ndvi_median_growing_season_mean": 2.5, "ndvi_median_max": 2.0,
    "ndvi_median_min": 1.5,
    "mean_temperature_c_mean": 2.0, "mean_temperature_c_max": 1.8, "mean_temperature_c_min": 1.8,
    "mean_temperature_c_range": 1.5, "mean_temperature_c": 1.5,
    "solar_radiation_mj_m2_day_mean": 1.8, "solar_radiation_mj_m2_day_max": 1.5,
    "solar_radiation_mj_m2_day": 1.5,
    "elevation_m": 1.8, "slope_degrees": 1.5, "aspect_degrees": 1.0,
    "s1_vh_db_median_mean": 1.3, "s1_vv_db_median_mean": 1.3,
    "data_month": 1.5, "region_ayeyawaddy": 1.0, "region_bago": 1.0, "region_magway": 1.0,
    "region_mandalay": 1.0, "region_sagaing": 1.0, "region_yangon": 1.0,
    "crop_area_pct_monsoon_rice": 3.5, "crop_area_pct_dry_season_rice": 3.0,
    "crop_area_pct_sesame": 2.5, "crop_area_pct_groundnut": 2.5, "crop_area_pct_black_gram": 2.5,
    "crop_area_pct_green_gram": 2.5, "crop_area_pct_pigeon_pea": 2.5, "crop_area_pct_maize": 2.0,
    "crop_area_pct_sugarcane": 2.0, "crop_area_pct_cassava": 2.0, "crop_area_pct_durian": 2.0,
    "crop_area_pct_mangosteen": 2.0, "crop_area_pct_longan": 2.0, "crop_area_pct_mango": 2.0,
    "crop_area_pct_chili": 2.0, "crop_area_pct_tomato": 2.0, "crop_area_pct_rubber": 2.0,
    "distance_to_road_km": 2.0, "road_density_km_per_sqkm": 1.8, "distance_to_railway_km": 1.5,
    "railway_density_km_per_sqkm": 1.2, "distance_to_river_km": 2.2,
    "river_density_km_per_sqkm": 1.8, "urban_fraction": 1.5, "builtup_fraction": 1.5,
    "cropland_fraction": 2.5, "non_cropland_fraction": 1.5, "permanent_water_fraction": 1.8,
    "population_density": 1.5, "valid_agriculture_mask": 2.0,
}

# Fallback-estimator input defaults (feature -> default)
FALLBACK_DEFAULTS = {
    "ndvi_median_mean": 0.55, "soil_soc_g_kg_0_30cm": 12.0, "soil_ph_h2o_0_30cm": 6.2,
    "era5_soil_moisture_m3_m3_mean": 0.28, "chirps_precipitation_mm_mean": 120.0,
    "mean_temperature_c_mean": 27.5, "distance_to_surface_water_m": 500.0,
    "distance_to_road_km": 5.0, "population_density": 150.0, "builtup_fraction": 0.05,
}

# Default coordinates used by the coordinate lookup when a key is unknown
DEFAULT_LATITUDE = 21.0
DEFAULT_LONGITUDE = 96.0

# Locator bounds
LAT_BOUNDS = (9.0, 29.0)
LON_BOUNDS = (92.0, 102.0)

# Diagnostic thresholds
LEAKAGE_CORR = 0.999
LEAKAGE_MIN_PAIRS = 10
OVERFIT_GAP_CLF = 0.05
OVERFIT_GAP_REG = 0.08
LOW_SCORE_CLF = 0.80
LOW_SCORE_REG = 0.70
MAJORITY_LIFT_MIN = 0.01
BIAS_RATIO = 0.05
OUTLIER_SHARE = 0.01
HETERO_CORR = 0.40
MIN_TRAIN_ROWS = 50

# ---------------------------------------------------------------------------
# FIXED VALUES — column lists, in the order that feature vectors and exports use
# ---------------------------------------------------------------------------

STATIC_FEATURES = [
    "elevation_m", "slope_degrees", "aspect_degrees", "distance_to_surface_water_m",
    "soil_cec_cmol_kg_0_30cm", "soil_clay_pct_0_30cm", "soil_sand_pct_0_30cm",
    "soil_silt_pct_0_30cm", "soil_soc_g_kg_0_30cm", "soil_ph_h2o_0_30cm",
    "surface_water_occurrence_pct", "surface_water_seasonality_months",
    "distance_to_road_km", "road_density_km_per_sqkm", "distance_to_railway_km",
    "railway_density_km_per_sqkm", "distance_to_river_km", "river_density_km_per_sqkm",
    "urban_fraction", "builtup_fraction", "cropland_fraction", "non_cropland_fraction",
    "permanent_water_fraction", "population_density", "valid_agriculture_mask",
]
DYNAMIC_RAW = ["chirps_precipitation_mm", "mean_temperature_c", "solar_radiation_mj_m2_day"]

# raw monthly signal -> statistics kept for it
SIGNAL_STATS = {
    "chirps_precipitation_mm": ["mean", "max", "min", "range", "cv"],
    "era5_soil_moisture_m3_m3": ["mean", "max", "min", "cv"],
    "mean_temperature_c": ["mean", "max", "min", "range"],
    "ndvi_median": ["mean", "max", "min"],
    "ndwi_mcf_median": ["mean", "max"],
    "solar_radiation_mj_m2_day": ["mean", "max"],
}
# signals for which every statistic is computed before the keep-list trims them
FULL_STAT_SIGNALS = ["chirps_precipitation_mm", "era5_soil_moisture_m3_m3", "mean_temperature_c",
                     "ndvi_median", "ndwi_mcf_median", "solar_radiation_mj_m2_day"]
RADAR_SIGNALS = ["s1_vh_db_median", "s1_vv_db_median"]
RAW_SIGNALS = FULL_STAT_SIGNALS + RADAR_SIGNALS

AGG_FEATURES = [
    "chirps_precipitation_mm_mean", "chirps_precipitation_mm_max", "chirps_precipitation_mm_min",
    "chirps_precipitation_mm_range", "chirps_precipitation_mm_cv",
    "era5_soil_moisture_m3_m3_mean", "era5_soil_moisture_m3_m3_max",
    "era5_soil_moisture_m3_m3_min", "era5_soil_moisture_m3_m3_cv",
    "mean_temperature_c_mean", "mean_temperature_c_max", "mean_temperature_c_min",
    "mean_temperature_c_range",
    "ndvi_median_mean", "ndvi_median_max", "ndvi_median_min", "ndvi_median_growing_season_mean",
    "ndwi_mcf_median_mean", "ndwi_mcf_median_max",
    "s1_vh_db_median_mean", "s1_vv_db_median_mean",
    "solar_radiation_mj_m2_day_mean", "solar_radiation_mj_m2_day_max",
]
CROP_AREA_FEATURES = [f"crop_area_pct_{c}" for c in CROPS]
REGION_FLAGS = [f"region_{r}" for r in REGIONS]

# The 75 model features in serving order
FEATURES = (STATIC_FEATURES + DYNAMIC_RAW + AGG_FEATURES + ["data_month"]
            + CROP_AREA_FEATURES + REGION_FLAGS)

SUITABILITY_TARGETS = [f"crop_suitability_{c}" for c in CROPS]
TARGETS = SUITABILITY_TARGETS + [
    "crop_health_score", "crop_yield_t_ha", "irrigation_need",
    "current_month_precipitation_mm", "current_month_mean_temperature_c",
    "current_month_solar_rad_mj_m2_day",
    "flood_risk_level", "drought_risk_score", "heat_stress_risk",
    "optimal_planting_month", "nitrogen_requirement_level", "phosphorus_requirement_level",
    "soil_erosion_risk", "market_integration_score", "post_harvest_loss_risk",
    "supply_chain_efficiency", "cold_chain_potential", "agricultural_land_conversion_risk",
    "urban_encroachment_risk", "irrigation_potential", "surface_water_occurrence",
    "water_scarcity_risk", "agricultural_gdp_forecast",
]
INT_CLASS_TARGETS = ["irrigation_need", "flood_risk_level", "heat_stress_risk",
                     "optimal_planting_month", "nitrogen_requirement_level",
                     "phosphorus_requirement_level", "soil_erosion_risk"]
CLASS_TARGETS = SUITABILITY_TARGETS + INT_CLASS_TARGETS
NUMERIC_TARGETS = [t for t in TARGETS if t not in CLASS_TARGETS]

COMPOSITES = ["crop_recommender", "crop_health", "economic_roi", "risk_alerts", "land_use"]
COMPOSITE_DEPENDENCIES = {
    "crop_recommender": SUITABILITY_TARGETS,
    "crop_health": ["crop_health_score"],
    "economic_roi": [],
    "risk_alerts": ["flood_risk_level", "drought_risk_score", "heat_stress_risk",
                    "soil_erosion_risk", "water_scarcity_risk"],
    "land_use": ["agricultural_land_conversion_risk", "urban_encroachment_risk"],
}


def crop_ordinal(crop: str) -> int:
    return CROPS.index(crop)


# ---------------------------------------------------------------------------
# FIXED VALUES — target metadata (task type, unit, group, expected classes,
# value range) used by the model catalogue.
# ---------------------------------------------------------------------------
SUITABILITY_CLASSES = ["poor", "moderate", "good", "excellent"]
TARGET_METADATA = {
    **{t: {"task_type": "classification", "unit": "suitability_class", "group": "crop_suitability",
           "expected_classes": SUITABILITY_CLASSES} for t in SUITABILITY_TARGETS},
    "crop_health_score": {"task_type": "regression", "unit": "score_0_to_1", "group": "crop_health",
                          "value_range": (0.0, 1.0)},
    "crop_yield_t_ha": {"task_type": "regression", "unit": "tonnes_per_hectare", "group": "yield",
                        "value_range": (0.0, None)},
    "irrigation_need": {"task_type": "classification", "unit": "class_0_to_2", "group": "farm_management",
                        "expected_classes": [0, 1, 2]},
    "current_month_precipitation_mm": {"task_type": "regression", "unit": "millimetres", "group": "climate",
                                       "value_range": (0.0, None)},
    "current_month_mean_temperature_c": {"task_type": "regression", "unit": "degrees_celsius", "group": "climate",
                                         "value_range": (-80.0, 80.0)},
    "current_month_solar_rad_mj_m2_day": {"task_type": "regression", "unit": "megajoules_per_square_metre_per_day",
                                          "group": "climate", "value_range": (0.0, None)},
    "flood_risk_level": {"task_type": "classification", "unit": "class_0_to_2", "group": "risk",
                         "expected_classes": [0, 1, 2]},
    "drought_risk_score": {"task_type": "regression", "unit": "score_0_to_1", "group": "risk",
                           "value_range": (0.0, 1.0)},
    "heat_stress_risk": {"task_type": "classification", "unit": "class_0_to_2", "group": "risk",
                         "expected_classes": [0, 1, 2]},
    "optimal_planting_month": {"task_type": "classification", "unit": "month_1_to_12", "group": "farm_management",
                               "expected_classes": list(range(1, 13))},
    "nitrogen_requirement_level": {"task_type": "classification", "unit": "class_0_to_2",
                                   "group": "farm_management", "expected_classes": [0, 1, 2]},
    "phosphorus_requirement_level": {"task_type": "classification", "unit": "class_0_to_2",
                                     "group": "farm_management", "expected_classes": [0, 1, 2]},
    "soil_erosion_risk": {"task_type": "classification", "unit": "class_0_to_2", "group": "risk",
                          "expected_classes": [0, 1, 2]},
}
_SCORE_GROUPS = {
    "market_integration_score": "market", "post_harvest_loss_risk": "market", "supply_chain_efficiency": "market",
    "cold_chain_potential": "market", "agricultural_land_conversion_risk": "land_use",
    "urban_encroachment_risk": "land_use", "irrigation_potential": "water", "surface_water_occurrence": "water",
    "water_scarcity_risk": "water", "agricultural_gdp_forecast": "economic",
}
for _t, _g in _SCORE_GROUPS.items():
    TARGET_METADATA[_t] = {"task_type": "regression", "unit": "score_0_to_1", "group": _g, "value_range": (0.0, 1.0)}
assert set(TARGET_METADATA) == set(TARGETS)


# FIXED VALUES: importance tier of every target.
IMPORTANCE_TIERS = {
    "crop_suitability_monsoon_rice": "high",
    "crop_suitability_dry_season_rice": "high",
    "crop_suitability_black_gram": "high",
    "crop_suitability_groundnut": "high",
    "crop_health_score": "high",
    "crop_yield_t_ha": "high",
    "irrigation_need": "high",
    "flood_risk_level": "high",
    "drought_risk_score": "high",
    "heat_stress_risk": "high",
    "crop_suitability_maize": "medium",
    "crop_suitability_sugarcane": "medium",
    "crop_suitability_cassava": "medium",
    "crop_suitability_chili": "medium",
    "crop_suitability_tomato": "medium",
    "crop_suitability_green_gram": "medium",
    "crop_suitability_pigeon_pea": "medium",
    "crop_suitability_sesame": "medium",
    "crop_suitability_rubber": "medium",
    "current_month_precipitation_mm": "medium",
    "current_month_mean_temperature_c": "medium",
    "current_month_solar_rad_mj_m2_day": "medium",
    "optimal_planting_month": "medium",
    "nitrogen_requirement_level": "medium",
    "phosphorus_requirement_level": "medium",
    "soil_erosion_risk": "medium",
    "market_integration_score": "medium",
    "post_harvest_loss_risk": "medium",
    "supply_chain_efficiency": "medium",
    "cold_chain_potential": "medium",
    "agricultural_land_conversion_risk": "medium",
    "urban_encroachment_risk": "medium",
    "irrigation_potential": "medium",
    "surface_water_occurrence": "medium",
    "water_scarcity_risk": "medium",
    "agricultural_gdp_forecast": "high",
    "crop_suitability_durian": "low",
    "crop_suitability_mangosteen": "low",
    "crop_suitability_longan": "low",
    "crop_suitability_mango": "low",
}
assert set(IMPORTANCE_TIERS) == set(TARGETS)

# FIXED VALUES: columns that the alignment report compares.
ALIGNMENT_COLUMNS = [
    "elevation_m",
    "slope_degrees",
    "aspect_degrees",
    "distance_to_surface_water_m",
    "soil_cec_cmol_kg_0_30cm",
    "soil_clay_pct_0_30cm",
    "soil_sand_pct_0_30cm",
    "soil_silt_pct_0_30cm",
    "soil_soc_g_kg_0_30cm",
    "soil_ph_h2o_0_30cm",
    "surface_water_occurrence_pct",
    "surface_water_seasonality_months",
    "distance_to_road_km",
    "road_density_km_per_sqkm",
    "distance_to_railway_km",
    "railway_density_km_per_sqkm",
    "distance_to_river_km",
    "river_density_km_per_sqkm",
    "urban_fraction",
    "builtup_fraction",
    "cropland_fraction",
    "non_cropland_fraction",
    "permanent_water_fraction",
    "population_density",
    "valid_agriculture_mask",
    "chirps_precipitation_mm",
    "mean_temperature_c",
    "solar_radiation_mj_m2_day",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — display names of the targets in the model catalogue.  Crop
# suitabilities and the other scores are named by rule (see display_name).
# ---------------------------------------------------------------------------
DISPLAY_NAMES = {
    "crop_health_score": "Crop health surrogate score",
    "crop_yield_t_ha": "Crop yield surrogate estimate",
    "irrigation_need": "Irrigation need class",
    "current_month_precipitation_mm": "Current-month precipitation reconstruction",
    "current_month_mean_temperature_c": "Current-month mean temperature reconstruction",
    "current_month_solar_rad_mj_m2_day": "Current-month solar radiation reconstruction",
    "flood_risk_level": "Flood risk surrogate class",
    "drought_risk_score": "Drought risk surrogate score",
    "heat_stress_risk": "Heat-stress risk surrogate class",
    "optimal_planting_month": "Optimal planting month surrogate class",
    "nitrogen_requirement_level": "Nitrogen requirement surrogate class",
    "phosphorus_requirement_level": "Phosphorus requirement surrogate class",
    "soil_erosion_risk": "Soil erosion risk surrogate class",
}


def display_name(target: str) -> str:
    """Name of a target as the catalogue shows it."""
    if target in DISPLAY_NAMES:
        return DISPLAY_NAMES[target]
    words = target.removeprefix("crop_suitability_").replace("_", " ").title()
    return f"{words} suitability" if target.startswith("crop_suitability_") else f"{words} surrogate score"
