"""The rule formulas (F01-F10, L01-L40) as SQL expression text.

``RuleText("spark", columns)`` gives Spark SQL expressions that the library
feeds to ``selectExpr``; Catalyst parses each target once (a handful of driver
round trips instead of thousands of Column calls) and whole-stage codegen
compiles them.  Junk strings become NULL (``try_cast``), NaN becomes NULL
(``nanvl``) and absent columns become their default literal.  The DuckDB
statements that the queries are compared with are written apart, in
``plans/oracle_rules.py``.

Rounding is numpy's (half-even on the scaled binary value): ``rint`` in
Spark, ``round_even`` in DuckDB — bit-identical for every double.
"""

from __future__ import annotations

from agrolens.constants import CROP_PROFILES, CROPS, RICE_CROPS, WATERLOG_SENSITIVE_CROPS


class RuleText:
    def __init__(self, dialect: str = "spark", columns=None, types=None):
        assert dialect in ("spark", "duckdb")
        self.dialect = dialect
        self.columns = None if columns is None else set(columns)
        # names of string-typed columns (need try_cast); None = unknown
        self.types = dict(types or {})

    # ------------------------------------------------------------ helpers

    def has(self, name: str) -> bool:
        return self.columns is None or name in self.columns

    def d(self, x) -> str:
        """Double literal."""
        return f"CAST({float(x)!r} AS DOUBLE)"

    def num(self, name: str) -> str:
        if self.dialect == "duckdb":
            return name
        t = self.types.get(name)
        if t is not None and t in ("double", "float", "int", "bigint", "smallint", "tinyint"):
            base = name if t == "double" else f"CAST({name} AS DOUBLE)"
        else:
            base = f"try_cast({name} AS DOUBLE)"
        return f"nanvl({base}, CAST(NULL AS DOUBLE))"

    def v(self, name: str, default) -> str:
        if not self.has(name):
            return self.d(default)
        return f"coalesce({self.num(name)}, {self.d(default)})"

    def clip(self, x: str, lo=0.0, hi=1.0) -> str:
        return f"least(greatest({x}, {self.d(lo)}), {self.d(hi)})"

    def gauss(self, x: str, o, s) -> str:
        z = f"(({x}) - {self.d(o)}) / {self.d(s)}"
        return f"exp({self.d(-0.5)} * (({z}) * ({z})))"

    def rnd(self, x: str, n: int) -> str:
        sc = self.d(10 ** n)
        if self.dialect == "spark":
            return f"(rint(({x}) * {sc}) / {sc})"
        return f"(round_even(({x}) * {sc}, 0) / {sc})"

    def wsum(self, terms) -> str:
        parts = [f"({c}) * {self.d(w)}" for c, w in terms]
        acc = parts[0]
        for p in parts[1:]:
            acc = f"({acc} + {p})"
        return acc

    def region_lower(self) -> str:
        if not self.has("region"):
            return "''"
        return "lower(coalesce(CAST(region AS STRING), ''))"

    # ------------------------------------------------------------ rules

    def temp_pens(self) -> tuple[str, str, str]:
        tmax, tmin, trng = (self.v("mean_temperature_c_max", 35), self.v("mean_temperature_c_min", 15),
                            self.v("mean_temperature_c_range", 0))
        heat = f"(CASE WHEN {tmax} > 38 THEN {self.clip(f'1.0 - ({tmax} - 38) / 10.0', 0.1, 1.0)} ELSE {self.d(1)} END)"
        frost = f"(CASE WHEN {tmin} < 10 THEN {self.clip(f'({tmin} - 5) / 5.0', 0.1, 1.0)} ELSE {self.d(1)} END)"
        rng = self.clip(f"1.0 - ({trng} - 10) / 20.0", 0.5, 1.0)
        return heat, frost, rng

    def cv_pen(self) -> str:
        return self.clip(f"1.0 - {self.v('chirps_precipitation_mm_cv', 1)} * 0.5", 0.3, 1.0)

    def precip_sql(self, opt=1400.0, spread=600.0) -> str:
        annual = f"({self.v('chirps_precipitation_mm_mean', 0)} * 12.0)"
        return self.clip(f"{self.gauss(annual, opt, spread)} * {self.cv_pen()}")

    def sm_sql(self) -> str:
        base = self.clip(f"1.0 - abs({self.v('era5_soil_moisture_m3_m3_mean', 0.15)} - 0.30) / 0.3")
        dr = self.clip(f"{self.v('era5_soil_moisture_m3_m3_min', 0.05)} / 0.15")
        cvp = self.clip(f"1.0 - {self.v('era5_soil_moisture_m3_m3_cv', 0.5)} * 0.4", 0.3, 1.0)
        return self.clip(f"{base} * {dr} * {cvp}")

    def temp_sql(self, t_opt=27.0, t_sp=8.0) -> str:
        heat, frost, rng = self.temp_pens()
        base = self.gauss(self.v("mean_temperature_c_mean", 25), t_opt, t_sp)
        return self.clip(f"{base} * {heat} * {frost} * {rng}")

    def ndvi_sql(self) -> str:
        b = self.clip(f"{self.v('ndvi_median_mean', 0.3)} / 0.6")
        gs = self.clip(f"{self.v('ndvi_median_growing_season_mean', 0.4)} / 0.65")
        pk = self.clip(f"{self.v('ndvi_median_max', 0.5)} / 0.75")
        return self.clip(f"{b} * 0.4 + {gs} * 0.4 + {pk} * 0.2")

    def ndwi_sql(self) -> str:
        b = self.clip(f"({self.v('ndwi_mcf_median_mean', -0.2)} + 0.3) / 0.6")
        pk = self.clip(f"({self.v('ndwi_mcf_median_max', 0.0)} + 0.2) / 0.5")
        return self.clip(f"{b} * 0.6 + {pk} * 0.4")

    def soil_sql(self) -> str:
        soc = self.clip(f"{self.v('soil_soc_g_kg_0_30cm', 20)} / 40.0")
        cec = self.clip(f"{self.v('soil_cec_cmol_kg_0_30cm', 20)} / 35.0")
        ph = self.gauss(self.v("soil_ph_h2o_0_30cm", 6.5), 6.5, 0.8)
        clay = self.gauss(self.v("soil_clay_pct_0_30cm", 25), 25, 15)
        silt = self.clip(f"{self.v('soil_silt_pct_0_30cm', 35)} / 40.0")
        sand = self.clip(f"1.0 - ({self.v('soil_sand_pct_0_30cm', 40)} - 50) / 50", 0.1, 1.0)
        return self.clip(self.wsum([(soc, 0.30), (cec, 0.25), (ph, 0.20), (clay, 0.10), (silt, 0.10), (sand, 0.05)]))

    def terrain_sql(self) -> str:
        e = self.v("elevation_m", 50)
        es = f"(CASE WHEN {e} < 300 THEN {self.d(1)} ELSE {self.clip(f'1.0 - ({e} - 300) / 700', 0.2, 1.0)} END)"
        ss = self.clip(f"1.0 - {self.v('slope_degrees', 3)} / 20.0", 0.1, 1.0)
        asp = f"({self.d(0.75)} + {self.d(0.25)} * cos(({self.v('aspect_degrees', 180)} - 180) * {self.d(0.017453292519943295)}))"
        return self.clip(f"{es} * 0.4 + {ss} * 0.4 + {asp} * 0.2")

    def water_sql(self) -> str:
        dist = self.v("distance_to_surface_water_m", 2000)
        if self.has("distance_to_river_km"):
            dist = f"least({dist}, {self.v('distance_to_river_km', 2.0)} * 1000.0)"
        ds = self.clip(f"1.0 - {dist} / 5000.0", 0.1, 1.0)
        oc = self.clip(f"{self.v('surface_water_occurrence_pct', 50)} / 90.0")
        se = self.clip(f"{self.v('surface_water_seasonality_months', 6)} / 10.0")
        return self.clip(f"{ds} * 0.5 + {oc} * 0.3 + {se} * 0.2")

    def solar_sql(self) -> str:
        b = self.clip(f"{self.v('solar_radiation_mj_m2_day_mean', 18)} / 20.0")
        mx = self.v("solar_radiation_mj_m2_day_max", 22)
        pen = f"(CASE WHEN {mx} > 25 THEN {self.clip(f'1.0 - ({mx} - 25) / 10', 0.4, 1.0)} ELSE {self.d(1)} END)"
        return self.clip(f"{b} * {pen}")

    def radar_sql(self) -> str:
        vh = self.clip(f"({self.v('s1_vh_db_median_mean', -15)} + 20) / 12.0")
        vv = self.clip(f"({self.v('s1_vv_db_median_mean', -10)} + 16) / 12.0")
        return self.clip(f"({vh} + {vv}) / 2")

    def components(self) -> dict[str, str]:
        """F01-F10 with their reference defaults (temperature at 27/8)."""
        return {"precip_s": self.precip_sql(), "sm_s": self.sm_sql(), "temp_s": self.temp_sql(),
                "ndvi_s": self.ndvi_sql(), "ndwi_s": self.ndwi_sql(), "soil_s": self.soil_sql(),
                "terrain_s": self.terrain_sql(), "water_s": self.water_sql(), "solar_s": self.solar_sql(),
                "radar_s": self.radar_sql()}

    def stage1_exprs(self) -> dict[str, str]:
        """Shared components, materialised once per row."""
        heat, frost, rng = self.temp_pens()
        extra = {
            "_t_heat": heat, "_t_frost": frost, "_t_rng": rng, "_cv_pen": self.cv_pen(),
            "_rain_annual": f"({self.v('chirps_precipitation_mm_mean', 0)} * 12.0)",
            "_t_mean": self.v("mean_temperature_c_mean", 25),
            "_temp_health": self.clip(f"{self.gauss(self.v('mean_temperature_c_mean', 25), 27, 7)} * {heat} * {frost} * {rng}"),
        }
        return {**self.components(), **extra, **self.modifier_exprs()}

    def stage1_select(self, src: str = "rows") -> str:
        cols = ", ".join(f"{e} AS {k}" for k, e in self.stage1_exprs().items())
        return f"SELECT *, {cols} FROM {src}"

    def market_sql(self) -> str:
        rd = self.clip(f"1.0 - {self.v('distance_to_road_km', 10.0)} / 30.0")
        rl = self.clip(f"1.0 - {self.v('distance_to_railway_km', 20.0)} / 50.0")
        rdn = self.clip(f"{self.v('road_density_km_per_sqkm', 0.5)} / 2.0")
        rln = self.clip(f"{self.v('railway_density_km_per_sqkm', 0.1)} / 0.5")
        return self.rnd(self.clip(self.wsum([(rd, 0.4), (rdn, 0.3), (rl, 0.2), (rln, 0.1)])), 4)

    def yield_sql(self) -> str:
        lim = "least(precip_s, sm_s, temp_s, soil_s)"
        comp = self.wsum([(lim, 0.35), ("ndvi_s", 0.25), ("sm_s", 0.15), ("soil_s", 0.15), ("water_s", 0.10)])
        y = f"({self.d(5.5)} * {self.clip(comp)})"
        slope = self.v("slope_degrees", 3)
        y = f"({y} * {self.clip(f'1.0 - ({slope} - 5) / 30.0', 0.6, 1.0)})"
        return self.rnd(self.clip(y, 0.5, 6.0), 3)

    def health_sql(self) -> str:
        s = self.wsum([("ndvi_s", 0.28), ("sm_s", 0.20), ("_temp_health", 0.18), ("ndwi_s", 0.13),
                  ("soil_s", 0.12), ("solar_s", 0.05), ("radar_s", 0.04)])
        return self.rnd(self.clip(s), 4)

    def stage15_exprs(self) -> dict[str, str]:
        """Targets reused by other targets, rounded once."""
        return {"_market": self.market_sql(), "_yield": self.yield_sql(), "_health": self.health_sql()}

    def stage15_select(self, src: str = "s1") -> str:
        return f"SELECT *, {self.market_sql()} AS _market, {self.yield_sql()} AS _yield, {self.health_sql()} AS _health FROM {src}"

    def suitability_class_sql(self, score: str) -> str:
        return (f"(CASE WHEN {score} <= 0.40 THEN 'poor' WHEN {score} <= 0.60 THEN 'moderate' "
                f"WHEN {score} <= 0.80 THEN 'good' ELSE 'excellent' END)")

    def suitability_score_sql(self, crop: str) -> str:
        t_opt, t_sp, r_opt, r_sp, w = CROP_PROFILES[crop]
        precip = self.clip(f"{self.gauss('_rain_annual', r_opt, r_sp)} * _cv_pen")
        temp = self.clip(f"{self.gauss('_t_mean', t_opt, t_sp)} * _t_heat * _t_frost * _t_rng")
        comps = [precip, "sm_s", temp, "ndvi_s", "ndwi_s", "soil_s", "terrain_s", "water_s", "solar_s"]
        score = self.wsum(list(zip(comps, w)))
        # the paddy / waterlogging conditions and rice-share factors are shared
        # by several crops: staged once per row in stage 1
        if crop in RICE_CROPS:
            score = (f"((CASE WHEN _paddy THEN ({score}) * {self.d(1.2)} ELSE ({score}) END) * _rice_boost)")
        elif crop in WATERLOG_SENSITIVE_CROPS:
            score = (f"((CASE WHEN _waterlog THEN ({score}) * {self.d(0.75)} ELSE ({score}) END) * _rice_pen)")
        return self.clip(score)

    def modifier_exprs(self) -> dict[str, str]:
        """Site modifiers of the suitability scores (rice paddies, waterlogging)."""
        elev, slope = self.v("elevation_m", 100), self.v("slope_degrees", 5)
        occ, sm = self.v("surface_water_occurrence_pct", 0), self.v("era5_soil_moisture_m3_m3_mean", 0.25)
        rice = f"({self.v('crop_area_pct_monsoon_rice', 20.0)} + {self.v('crop_area_pct_dry_season_rice', 10.0)})"
        return {
            "_paddy": f"({elev} < 60 AND {slope} < 3.0 AND ({occ} > 15 OR {sm} > 0.27))",
            "_rice_boost": f"(CASE WHEN {rice} > 50.0 THEN {self.d(1.15)} ELSE {self.d(1)} END)",
            "_waterlog": f"({occ} > 25 OR ({elev} < 30 AND {slope} < 1.5 AND {sm} > 0.30))",
            "_rice_pen": f"(CASE WHEN {rice} > 70.0 THEN {self.d(0.9)} ELSE {self.d(1)} END)",
        }

    def irrigation_need_sql(self) -> str:
        rain, rmin, rcv = (self.v("chirps_precipitation_mm_mean", 100), self.v("chirps_precipitation_mm_min", 20),
                           self.v("chirps_precipitation_mm_cv", 0.5))
        smm, smn, ndwi = (self.v("era5_soil_moisture_m3_m3_mean", 0.2), self.v("era5_soil_moisture_m3_m3_min", 0.08),
                          self.v("ndwi_mcf_median_mean", -0.2))
        sand, clay = self.v("soil_sand_pct_0_30cm", 40), self.v("soil_clay_pct_0_30cm", 25)
        dist, occ = self.v("distance_to_surface_water_m", 2000), self.v("surface_water_occurrence_pct", 50)

        def step(c1, v1, c2, v2):
            return f"(CASE WHEN {c1} THEN {self.d(v1)} WHEN {c2} THEN {self.d(v2)} ELSE {self.d(0)} END)"

        dm = step(f"{rain} < 50", 0.30, f"{rain} < 100", 0.15)
        dm = f"({dm} + {step(f'{rmin} < 10', 0.15, f'{rmin} < 30', 0.07)})"
        dm = f"({dm} + {self.clip(f'{rcv} * 0.15', 0, 0.10)})"
        dm = f"({dm} + {step(f'{smm} < 0.10', 0.25, f'{smm} < 0.18', 0.12)})"
        dm = f"({dm} + {step(f'{smn} < 0.06', 0.15, f'{smn} < 0.12', 0.07)})"
        dm = f"({dm} + {step(f'{ndwi} < -0.3', 0.15, f'{ndwi} < 0', 0.05)})"
        dm = f"({dm} + {self.clip(f'({sand} - 40) / 60.0 * 0.10', 0, 0.10)})"
        dm = f"({dm} - {self.clip(f'({clay} - 30) / 40.0 * 0.05', 0, 0.05)})"
        dm = f"({dm} + (CASE WHEN {dist} > 3000 THEN {self.d(0.05)} ELSE {self.d(0)} END))"
        dm = f"({dm} - {self.clip(f'{occ} / 90 * 0.05', 0, 0.05)})"
        return f"(CASE WHEN {dm} >= 0.35 THEN 2 WHEN {dm} >= 0.18 THEN 1 ELSE 0 END)"

    def target_sql(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for crop in CROPS:
            out[f"crop_suitability_{crop}"] = self.suitability_class_sql(self.suitability_score_sql(crop))
        out["crop_health_score"] = "_health"
        out["crop_yield_t_ha"] = "_yield"
        out["irrigation_need"] = self.irrigation_need_sql()
        out["current_month_precipitation_mm"] = self.v("chirps_precipitation_mm", 0.0)
        out["current_month_mean_temperature_c"] = self.v("mean_temperature_c", 25.0)
        out["current_month_solar_rad_mj_m2_day"] = self.v("solar_radiation_mj_m2_day", 18.0)

        occ0, elev, sl5, vv = (self.v("surface_water_occurrence_pct", 0), self.v("elevation_m", 100), self.v("slope_degrees", 5),
                               self.v("s1_vv_db_median_mean", -12))
        high = f"({occ0} > 50 OR ({elev} < 15 AND {sl5} < 1.0 AND {vv} > -9))"
        med = f"({occ0} > 20 OR ({elev} < 35 AND {sl5} < 2.5))"
        out["flood_risk_level"] = f"(CASE WHEN {high} THEN 2 WHEN {med} THEN 1 ELSE 0 END)"

        smd = self.clip(f"(0.25 - {self.v('era5_soil_moisture_m3_m3_min', 0.20)}) / 0.25")
        wd = self.clip(f"(-0.2 - {self.v('ndwi_mcf_median_mean', -0.2)}) / 0.5")
        out["drought_risk_score"] = self.rnd(self.clip(self.wsum([(smd, 0.4), (wd, 0.3), (self.v("era5_soil_moisture_m3_m3_cv", 0.3), 0.15),
                                                    (self.v("chirps_precipitation_mm_cv", 0.5), 0.15)])), 4)
        tmax, tmean = self.v("mean_temperature_c_max", 30), self.v("mean_temperature_c_mean", 25)
        out["heat_stress_risk"] = (f"(CASE WHEN {tmax} > 38.0 OR {tmean} > 32.0 THEN 2 "
                                   f"WHEN {tmax} > 34.0 OR {tmean} > 29.0 THEN 1 ELSE 0 END)")
        reg = self.region_lower()
        out["optimal_planting_month"] = (f"(CASE WHEN {reg} IN ('ayeyawaddy', 'bago', 'yangon') THEN 5 "
                                         f"WHEN {reg} = 'magway' AND {tmean} > 28 THEN 7 ELSE 6 END)")
        soc = self.v("soil_soc_g_kg_0_30cm", 25)
        out["nitrogen_requirement_level"] = f"(CASE WHEN {soc} > 35.0 THEN 0 WHEN {soc} < 15.0 THEN 2 ELSE 1 END)"
        ph, cec = self.v("soil_ph_h2o_0_30cm", 6.5), self.v("soil_cec_cmol_kg_0_30cm", 20)
        out["phosphorus_requirement_level"] = (
            f"(CASE WHEN {ph} >= 6.0 AND {ph} <= 7.0 AND {cec} >= 25.0 THEN 0 "
            f"WHEN {ph} < 5.5 OR {ph} > 7.5 OR {cec} < 12.0 THEN 2 ELSE 1 END)")
        sl2, pmax = self.v("slope_degrees", 2), self.v("chirps_precipitation_mm_max", 100)
        out["soil_erosion_risk"] = (f"(CASE WHEN {sl2} > 10.0 OR ({sl2} > 5.0 AND {pmax} > 400) THEN 2 "
                                    f"WHEN {sl2} > 4.0 OR {pmax} > 300 THEN 1 ELSE 0 END)")
        out["market_integration_score"] = "_market"

        dr10, rdn, cf, dv5 = (self.v("distance_to_road_km", 10.0), self.v("road_density_km_per_sqkm", 0.5),
                              self.v("cropland_fraction", 0.5), self.v("distance_to_river_km", 5.0))
        iso = f"({self.clip(f'{dr10} / 25.0')} * 0.4 + {self.clip(f'1.0 - {rdn} / 1.5')} * 0.3)"
        phl = f"(({iso} + {self.clip(cf)} * 0.15) + {self.clip(f'{dv5} / 20.0')} * 0.15)"
        out["post_harvest_loss_risk"] = self.rnd(self.clip(phl), 4)
        pop = self.v("population_density", 100.0)
        out["supply_chain_efficiency"] = self.rnd(self.clip(self.wsum([("_market", 0.6), (self.clip(f"{pop} / 1000.0", 0.1, 1.0), 0.25),
                                                         (cf, 0.15)])), 4)
        urb, blt = self.v("urban_fraction", 0.05), self.v("builtup_fraction", 0.05)
        sroad = self.clip(f"{rdn} / 2.0")
        out["cold_chain_potential"] = self.rnd(self.clip(self.wsum([(sroad, 0.4), (self.clip(f"({urb} + {blt}) / 0.4"), 0.4),
                                                      (self.clip(f"{pop} / 800.0"), 0.2)])), 4)
        conv = (f"({self.wsum([(self.clip(f'({urb} + {blt}) / 0.3'), 0.4), (self.clip(f'{pop} / 1000.0'), 0.3), (sroad, 0.3)])}"
                f" * {self.clip(f'{cf} * 1.5', 0.2, 1.0)})")
        out["agricultural_land_conversion_risk"] = self.rnd(self.clip(conv), 4)
        dr5 = self.v("distance_to_road_km", 5.0)
        enc = self.wsum([(self.clip(f"{urb} * 2.0 + {blt} * 2.0"), 0.45), (self.clip(f"{pop} / 1200.0"), 0.35),
                    (self.clip(f"1.0 - {dr5} / 20.0"), 0.20)])
        out["urban_encroachment_risk"] = self.rnd(self.clip(enc), 4)
        rvd = self.v("river_density_km_per_sqkm", 0.3)
        pot = self.wsum([(self.clip(f"1.0 - {dv5} / 15.0"), 0.35), (self.clip(f"{rvd} / 1.0"), 0.25),
                    (self.clip(f"{self.v('surface_water_occurrence_pct', 20.0)} / 80.0"), 0.25),
                    (self.clip(f"{self.v('permanent_water_fraction', 0.05)} / 0.3"), 0.15)])
        out["irrigation_potential"] = self.rnd(self.clip(pot), 4)
        swo = self.clip(f"{self.v('surface_water_occurrence_pct', 0.0)} / 100.0 * 0.7 + {self.v('permanent_water_fraction', 0.0)} * 0.3")
        out["surface_water_occurrence"] = self.rnd(self.clip(swo), 4)
        scar = self.wsum([(self.clip(f"1.0 - {rvd} / 1.0"), 0.3),
                     (self.clip(f"1.0 - {self.v('chirps_precipitation_mm_mean', 100.0)} / 180.0"), 0.4),
                     (self.clip(f"(0.35 - {self.v('era5_soil_moisture_m3_m3_mean', 0.2)}) / 0.35"), 0.3)])
        out["water_scarcity_risk"] = self.rnd(self.clip(scar), 4)
        gdp = self.wsum([(self.clip("_yield / 6.0"), 0.4), ("_market", 0.3), (cf, 0.2), ("_health", 0.1)])
        out["agricultural_gdp_forecast"] = self.rnd(self.clip(gdp), 4)
        return out

