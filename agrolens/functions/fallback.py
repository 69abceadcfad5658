"""Fallback estimators (E01-E25) as SQL expression text.

Each target yields a typed ``value`` expression and a ``label`` expression.
Inputs read their fallback defaults when absent or NULL.  Target-name drift
is kept as named behaviour: under the service names the three current-month
targets fall through to the generic estimator (0.5, "Moderate"); the
``corrected`` option maps them to the pass-through estimators E05-E07.
"""

from __future__ import annotations

import re

from agrolens.constants import FALLBACK_DEFAULTS, SUITABILITY_TARGETS, TARGETS
from agrolens.functions.rules_sql import RuleText

CURRENT_MONTH = {"current_month_precipitation_mm": "precip",
                 "current_month_mean_temperature_c": "temp",
                 "current_month_solar_rad_mj_m2_day": "solar"}


class FallbackText:
    def __init__(self, dialect: str = "spark", columns=None, types=None):
        self.R = RuleText(dialect, columns, types)
        self.dialect = dialect

    def f(self, name: str, default=None) -> str:
        return self.R.v(name, FALLBACK_DEFAULTS[name] if default is None else default)

    def fmt(self, pattern: str, x: str) -> str:
        """printf-style label; the value is pre-rounded half-even to the
        pattern's decimals so both engines print the same digits."""
        decimals = int(re.search(r"%\.(\d)f", pattern).group(1))
        fn = "format_string" if self.dialect == "spark" else "printf"
        return f"{fn}('{pattern}', {self.R.rnd(x, decimals)})"

    def level3(self, high: str, med: str) -> tuple[str, str]:
        v = f"(CASE WHEN {high} THEN 2 WHEN {med} THEN 1 ELSE 0 END)"
        lab = f"(CASE WHEN {high} THEN 'High' WHEN {med} THEN 'Medium' ELSE 'Low' END)"
        return v, lab

    def exprs(self, corrected: bool = False) -> dict[str, tuple[str, str]]:
        d, rnd, clip = self.R.d, self.R.rnd, self.R.clip
        ndvi, soc, ph = self.f("ndvi_median_mean"), self.f("soil_soc_g_kg_0_30cm"), self.f("soil_ph_h2o_0_30cm")
        moist, precip = self.f("era5_soil_moisture_m3_m3_mean"), self.f("chirps_precipitation_mm_mean")
        temp, wd = self.f("mean_temperature_c_mean"), self.f("distance_to_surface_water_m")
        road, pop, built = self.f("distance_to_road_km"), self.f("population_density"), self.f("builtup_fraction")
        out: dict[str, tuple[str, str]] = {}

        s = (f"((({ndvi}) * {d(0.4)} + least(({soc}) / {d(25)}, {d(1)}) * {d(0.3)}) "
             f"+ least(({moist}) / {d(0.4)}, {d(1)}) * {d(0.3)})")
        cat = (f"(CASE WHEN {s} > 0.75 THEN 'excellent' WHEN {s} > 0.55 THEN 'good' "
               f"WHEN {s} > 0.35 THEN 'moderate' ELSE 'poor' END)")
        for t in SUITABILITY_TARGETS:
            out[t] = (s, cat)

        h = (f"least(greatest((({ndvi}) * {d(0.5)} + least(({moist}) / {d(0.35)}, {d(1)}) * {d(0.3)}) "
             f"+ least(({soc}) / {d(20)}, {d(1)}) * {d(0.2)}, {d(0)}), {d(1)})")
        out["crop_health_score"] = (rnd(h, 3), self.fmt("%.1f%%", f"({h}) * {d(100)}"))

        mult = (f"((({ndvi}) / {d(0.6)}) * least(({soc}) / {d(15)}, {d(1.2)}) "
                f"* least(({moist}) / {d(0.25)}, {d(1.1)}))")
        yv = rnd(f"{d(3.8)} * {mult}", 2)
        out["crop_yield_t_ha"] = (clip(yv, 0.5, 7.5), f"concat(CAST({yv} AS STRING), ' tons/ha')")

        out["irrigation_need"] = self.level3(f"(({moist}) < 0.18 AND ({precip}) < 50)",
                                             f"(({moist}) < 0.28 OR ({precip}) < 100)")

        solar = self.f("solar_radiation_mj_m2_day_mean", 18.5)
        passthrough = {"precip": (precip, "%.1f mm"), "temp": (temp, "%.1f °C"),
                       "solar": (solar, "%.1f MJ/m²/day")}
        for t, key in CURRENT_MONTH.items():
            if corrected:
                x, pat = passthrough[key]
                out[t] = (rnd(x, 1), self.fmt(pat, x))
            else:
                out[t] = (d(0.5), "'Moderate'")

        out["flood_risk_level"] = self.level3(f"(({precip}) > 250 OR ({wd}) < 100)",
                                              f"(({precip}) > 150 OR ({wd}) < 300)")
        dr = clip(f"{d(1)} - ((({moist}) / {d(0.4)}) * {d(0.6)} + (({precip}) / {d(200)}) * {d(0.4)})")
        out["drought_risk_score"] = (rnd(dr, 3), self.fmt("%.1f%%", f"({dr}) * {d(100)}"))
        out["heat_stress_risk"] = (f"(CASE WHEN ({temp}) > 34.0 THEN 1 ELSE 0 END)",
                                   f"(CASE WHEN ({temp}) > 34.0 THEN 'High' ELSE 'Normal' END)")
        out["optimal_planting_month"] = (f"(CASE WHEN ({precip}) > 100 THEN 5 ELSE 11 END)",
                                         f"(CASE WHEN ({precip}) > 100 THEN 'May (Monsoon)' "
                                         f"ELSE 'November (Dry Season)' END)")
        out["nitrogen_requirement_level"] = self.level3(f"(({soc}) < 10.0)", f"(({soc}) < 18.0)")
        p_hi = f"(({ph}) < 5.5 OR ({ph}) > 7.5)"
        out["phosphorus_requirement_level"] = (f"(CASE WHEN {p_hi} THEN 2 ELSE 1 END)",
                                               f"(CASE WHEN {p_hi} THEN 'High' ELSE 'Medium' END)")
        slope = self.R.v("slope_degrees", 3.0)
        out["soil_erosion_risk"] = self.level3(f"(({slope}) > 15.0)", f"(({slope}) > 6.0)")

        mk = clip(f"{d(1)} - ({road}) / {d(20)}", 0.1, 1.0)
        out["market_integration_score"] = (rnd(mk, 2), self.fmt("%.0f/100", f"({mk}) * {d(100)}"))
        out["post_harvest_loss_risk"] = self.level3(f"(({road}) > 15.0)", f"(({road}) > 5.0)")
        ef = clip(f"{d(0.9)} - ({road}) * {d(0.03)}", 0.2, 0.95)
        out["supply_chain_efficiency"] = (rnd(ef, 2), self.fmt("%.0f%%", f"({ef}) * {d(100)}"))
        cc = clip(f"({built}) * {d(5)} + ({pop}) / {d(500)}", 0.1, 1.0)
        out["cold_chain_potential"] = (rnd(cc, 2), self.fmt("%.0f%%", f"({cc}) * {d(100)}"))
        out["agricultural_land_conversion_risk"] = self.level3(f"(({built}) > 0.15 OR ({pop}) > 400)",
                                                               f"(({built}) > 0.05)")
        out["urban_encroachment_risk"] = self.level3(f"(({built}) > 0.20)", f"(({built}) > 0.08)")
        ip = clip(f"{d(1)} - ({wd}) / {d(2000)}", 0.05, 1.0)
        out["irrigation_potential"] = (rnd(ip, 2), self.fmt("%.0f%%", f"({ip}) * {d(100)}"))
        sw = f"({self.R.v('surface_water_occurrence_pct', 15.0)}) / {d(100)}"
        out["surface_water_occurrence"] = (rnd(sw, 2), self.fmt("%.1f%%", f"({sw}) * {d(100)}"))
        out["water_scarcity_risk"] = self.level3(f"(({moist}) < 0.15 AND ({wd}) > 1000)", f"(({moist}) < 0.25)")
        gdp = rnd(f"{d(1250)} * (({ndvi}) / {d(0.5)}) * (({soc}) / {d(12)})", 2)
        out["agricultural_gdp_forecast"] = (gdp, f"concat('$', {self.money(gdp)}, '/ha/yr')")
        assert set(out) == set(TARGETS)
        return out

    def money(self, x: str) -> str:
        if self.dialect == "spark":
            return f"format_number({x}, 2)"
        return f"format('{{:,.2f}}', {x})"

    def generic(self) -> tuple[str, str]:
        """Any other target."""
        return self.R.d(0.5), "'Moderate'"
