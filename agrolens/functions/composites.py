"""Composite results over a prediction set (C01-C14) as SQL expression text.

Predictions are columns named after the targets: class targets hold the
class (string or int), numeric targets hold a double.  Raw features are the
feature columns of the same row.  Everything is a per-row expression —
arrays of structs are sorted with ``array_sort`` inside the row, so ranking
17 crops never shuffles.
"""

from __future__ import annotations

from agrolens.constants import CROPS, HEALTH_COLORS, SUITABILITY_COLORS, SUITABILITY_WEIGHTS, UNKNOWN_SUITABILITY_WEIGHT
from agrolens.functions.rules_sql import RuleText

DEFAULT_RECOMMENDER_COLOR = "#3B82F6"

# FIXED VALUES — composite text constants
ROI_REASON = "VERIFIED_ECONOMIC_INPUTS_REQUIRED"
ROI_MESSAGE = ("ROI is withheld until verified crop price, input cost and currency-period "
               "data are supplied.")
EXPERIMENTAL = "experimental"
ADVISORY_STATUS = "human_review_required"
MAP_STYLE = {"opacity": 0.75, "stroke_color": "#FFFFFF", "stroke_width": 1.5}
POTASSIUM_REQUIREMENT = "Medium"
SUGGESTED_MIX = "N: 90 kg/ha | P2O5: 45 kg/ha | K2O: 30 kg/ha"
COMPOST_ADVICE = "Incorporate organic compost to enhance Cation Exchange Capacity (CEC) and soil structure."
FLOOD_DESCRIPTION = "High precipitation volume or proximity to water bodies creates localized flood potential."
FLOOD_ACTION = "Ensure surface drainage channels are clear and elevate seed beds."
DROUGHT_ACTION = "Schedule supplementary drip or canal irrigation immediately."
HEAT_TITLE = "High Heat Stress Warning"
HEAT_DESCRIPTION = "Temperatures exceed optimal growth threshold during daytime hours."
HEAT_ACTION = "Apply organic mulch to retain soil moisture and reduce root zone heat."
WATER_DESCRIPTION = "Surface water proximity and precipitation levels indicate potential irrigation constraints."
WATER_ACTION = "Adopt drought-tolerant seed varieties and water conservation techniques."
# end of fixed values


def display_name(crop: str) -> str:
    return crop.replace("_", " ").title()


class CompositeText:
    def __init__(self, dialect: str = "spark", columns=None, types=None):
        self.R = RuleText(dialect, columns, types)
        self.dialect = dialect

    # ---------------------------------------------------------------- helpers
    def d(self, x) -> str:
        return self.R.d(x)

    def has(self, name: str) -> bool:
        return self.R.has(name)

    def str_col(self, name: str) -> str:
        return f"CAST({name} AS STRING)" if self.dialect == "spark" else f"CAST({name} AS VARCHAR)"

    def num_or(self, name: str, default) -> str:
        """float(value) with a default for missing/junk (try_cast)."""
        if not self.has(name):
            return self.d(default)
        if self.dialect == "spark":
            return f"coalesce(try_cast({name} AS DOUBLE), {self.d(default)})"
        return f"coalesce(TRY_CAST({name} AS DOUBLE), {self.d(default)})"

    def case_map(self, x: str, mapping: dict, default: str, as_double: bool = False) -> str:
        whens = " ".join(f"WHEN '{k}' THEN {self.d(v) if as_double else repr(v)}" for k, v in mapping.items())
        return f"coalesce(CASE {x} {whens} END, {default})"

    def capitalize(self, x: str) -> str:
        return f"concat(upper(substring({x}, 1, 1)), lower(substring({x}, 2)))"

    # ---------------------------------------------------------------- C01
    def recommender_items(self, weights=None) -> list[dict[str, str]]:
        """Per crop: label, base % (round 1), composite, area, colour, ordinal."""
        weights = weights or SUITABILITY_WEIGHTS
        items = []
        for i, crop in enumerate(CROPS):
            t = f"crop_suitability_{crop}"
            if not self.has(t):
                continue
            lbl = f"lower({self.str_col(t)})"
            w = self.case_map(lbl, weights, self.d(UNKNOWN_SUITABILITY_WEIGHT), as_double=True)
            pct = self.R.rnd(f"({w}) * {self.d(100)}", 1)
            area = f"coalesce({self.R.num(f'crop_area_pct_{crop}')}, {self.d(0)})" \
                if self.has(f"crop_area_pct_{crop}") else self.d(0)
            items.append({"crop": crop, "ord": str(i), "null": f"{t} IS NULL", "label": lbl, "base": pct,
                          "composite": f"({pct} + ({area}) * {self.d(0.1)})", "area": area,
                          "color": self.case_map(lbl, SUITABILITY_COLORS, f"'{DEFAULT_RECOMMENDER_COLOR}'")})
        return items

    def adjusted(self, base: str, area: str, idx: str) -> str:
        """base + 0.05*area - 0.1*rank0, clamped to 1..100, 1 decimal."""
        adj = f"(({base} + ({area}) * {self.d(0.05)}) - CAST({idx} AS DOUBLE) * {self.d(0.1)})"
        return self.R.rnd(f"greatest({self.d(1)}, least({self.d(100)}, {adj}))", 1)

    def recommender_staged(self, df):
        """Spark only: ``df`` with each crop's base % and area as columns
        ``_base_i``, ``_area_i`` and all labels and areas as the arrays ``_labs``,
        ``_areas``, computed once."""
        items = self.recommender_items()
        df = df.selectExpr("*", *[f"{it['label']} AS _lab_{it['ord']}" for it in items],
                           *[f"{it['area']} AS _area_{it['ord']}" for it in items])
        base = lambda i: self.R.rnd(f"({self.case_map(f'_lab_{i}', SUITABILITY_WEIGHTS, self.d(UNKNOWN_SUITABILITY_WEIGHT), True)}) "  # noqa: E731
                                    f"* {self.d(100)}", 1)
        of = lambda p: ", ".join(f"_{p}_{it['ord']}" for it in items)
        return df.selectExpr("*", f"array({of('lab')}) AS _labs", f"array({of('area')}) AS _areas", *[
            f"CASE WHEN _lab_{it['ord']} IS NOT NULL THEN {base(it['ord'])} END AS _base_{it['ord']}" for it in items])

    def recommender_sorted(self) -> tuple[str, str]:
        """Spark only, over staged columns: the crops as (-base, -composite,
        ordinal) in ascending order with NULL predictions first, and the
        number of predictions.  Everything else is looked up by ordinal after
        the cut; no higher-order functions (evaluated without codegen)."""
        ords = [it["ord"] for it in self.recommender_items()]
        structs = ", ".join(f"IF(_base_{i} IS NULL, NULL, named_struct('k1', -_base_{i}, 'k2', -(_base_{i} + _area_{i} * {self.d(0.1)}), "
                            f"'ord', {i}))" for i in ords)
        return f"sort_array(array({structs}), true)", "(" + " + ".join(f"IF(_base_{i} IS NULL, 0, 1)" for i in ords) + ")"

    def recommender_pick(self, entry: str, idx: str) -> dict[str, str]:
        """The fields of the ranked ``entry`` at 0-based rank ``idx``."""
        at = {it["ord"]: n for n, it in enumerate(self.recommender_items(), 1)}
        place = f"{entry}.ord + 1" if list(at) == [str(n - 1) for n in at.values()] else (
            f"CASE {entry}.ord " + " ".join(f"WHEN {i} THEN {n}" for i, n in at.items()) + " END")
        label = f"element_at(_labs, {place})"
        return {"crop": f"elt({entry}.ord + 1, " + ", ".join(f"'{c}'" for c in CROPS) + ")", "suitability": label,
                "suitability_score": self.adjusted(f"(-{entry}.k1)", f"element_at(_areas, {place})", idx),
                "composite_score": f"(-{entry}.k2)",
                "color_code": self.case_map(f"({label})", SUITABILITY_COLORS, f"'{DEFAULT_RECOMMENDER_COLOR}'")}

    def recommender_rows(self, df, keep: list[str], top_k: int | None = 5):
        """C01 flattened: one row per (sample, rank)."""
        arr, n_valid = self.recommender_sorted()
        n = len(self.recommender_items())
        length = f"least({top_k}, {n_valid})" if top_k else n_valid
        ex = self.recommender_staged(df).selectExpr("*", f"posexplode(slice({arr}, {n} - {n_valid} + 1, {length})) AS (pos, r)")
        return ex.selectExpr(*keep, "CAST(pos + 1 AS INT) AS rank", *[f"{e} AS {k}" for k, e in self.recommender_pick("r", "pos").items()])

    # ---------------------------------------------------------------- C02
    def health_class(self, score: str) -> tuple[str, str]:
        cls = (f"(CASE WHEN {score} >= 0.80 THEN 'Excellent' WHEN {score} >= 0.60 THEN 'Good' "
               f"WHEN {score} >= 0.40 THEN 'Moderate' WHEN {score} >= 0.20 THEN 'Poor' ELSE 'Critical' END)")
        col = (f"(CASE WHEN {score} >= 0.80 THEN '{HEALTH_COLORS['Excellent']}' "
               f"WHEN {score} >= 0.60 THEN '{HEALTH_COLORS['Good']}' "
               f"WHEN {score} >= 0.40 THEN '{HEALTH_COLORS['Moderate']}' "
               f"WHEN {score} >= 0.20 THEN '{HEALTH_COLORS['Poor']}' ELSE '{HEALTH_COLORS['Critical']}' END)")
        return cls, col

    def health_layer(self) -> dict[str, str]:
        score = self.num_or("crop_health_score", 0.6)
        cls, col = self.health_class(score)
        mean = self.R.num("ndvi_median_mean") if self.has("ndvi_median_mean") else "CAST(NULL AS DOUBLE)"
        raw = self.R.num("ndvi_median") if self.has("ndvi_median") else "CAST(NULL AS DOUBLE)"
        ndvi = f"(CASE WHEN {mean} IS NULL OR {mean} = 0 THEN {raw} ELSE {mean} END)"
        return {"status": f"'{EXPERIMENTAL}'", "health_score": score, "health_class": cls, "ndvi_median": ndvi,
                "map_color_hex": col, "field_validated": "false"}

    # ---------------------------------------------------------------- C03
    def economic_roi(self) -> dict[str, str]:
        return {"roi_status": "'unavailable'", "roi_reason_code": f"'{ROI_REASON}'",
                "roi_message": f"'{ROI_MESSAGE}'"}

    # ---------------------------------------------------------------- C04
    def class_score(self, name: str) -> str:
        if not self.has(name):
            return self.d(0)
        x = f"lower({self.str_col(name)})"
        m = {"0": 0.0, "low": 0.0, "1": 0.5, "medium": 0.5, "moderate": 0.5, "2": 1.0, "high": 1.0, "critical": 1.0}
        return self.case_map(x, m, self.d(0), as_double=True)

    def risk_alerts(self) -> dict[str, str]:
        s = {"flood": self.class_score("flood_risk_level"),
             "drought": self.num_or("drought_risk_score", 0.0),
             "heat": self.class_score("heat_stress_risk"),
             "erosion": self.class_score("soil_erosion_risk"),
             "water_scarcity": self.num_or("water_scarcity_risk", 0.0)}
        mx = f"greatest({', '.join(s.values())})"
        level = f"(CASE WHEN {mx} >= 0.7 THEN 'high' WHEN {mx} >= 0.4 THEN 'medium' ELSE 'low' END)"
        none = "CAST(NULL AS STRING)" if self.dialect == "spark" else "CAST(NULL AS VARCHAR)"
        return {"status": f"'{EXPERIMENTAL}'", **{f"{k}_score": v for k, v in s.items()}, "overall_level": level,
                "advisory_status": f"'{ADVISORY_STATUS}'", "approved_action": none, "field_validated": "false"}

    # ---------------------------------------------------------------- C05
    def land_use(self) -> dict[str, str]:
        conv = self.num_or("agricultural_land_conversion_risk", 0.0)
        urb = self.num_or("urban_encroachment_risk", 0.0)
        mx = f"greatest({conv}, {urb})"
        crop = self.R.num("cropland_fraction") if self.has("cropland_fraction") else "CAST(NULL AS DOUBLE)"
        return {"status": f"'{EXPERIMENTAL}'", "field_validated": "false", "risk_level": f"(CASE WHEN {mx} >= 0.6 THEN 'high' WHEN {mx} >= 0.3 THEN 'medium' ELSE 'low' END)",
                "conversion_risk_score": conv, "urban_encroachment_score": urb, "cropland_fraction": crop}

    # ---------------------------------------------------------------- C07-C09
    def suitability_module(self, crop: str, staged: str | None = None) -> dict[str, str]:
        """Class (unknown -> moderate), label, weight, colour, and what the
        model said of it (columns ``<target>_probabilities`` and
        ``<target>_is_fallback`` where the prediction set has them).
        ``staged``: a column that holds the class already."""
        t = f"crop_suitability_{crop}"
        raw = f"lower({self.str_col(t)})" if self.has(t) else "'moderate'"
        known = "('" + "', '".join(SUITABILITY_WEIGHTS) + "')"
        cls = staged or f"(CASE WHEN {raw} IN {known} THEN {raw} ELSE 'moderate' END)"
        probs, fallback = f"{t}_probabilities", f"{t}_is_fallback"
        none = "CAST(NULL AS MAP<STRING, DOUBLE>)" if self.dialect == "spark" else "CAST(NULL AS MAP(VARCHAR, DOUBLE))"
        known_column = lambda c: self.R.columns is not None and self.has(c)
        return {"class": cls, "label": self.capitalize(cls),
                "weight": self.case_map(cls, SUITABILITY_WEIGHTS, self.d(0.4), as_double=True),
                "color": self.case_map(cls, SUITABILITY_COLORS, "'#F59E0B'"),
                "probabilities": probs if known_column(probs) else none,
                "is_fallback": fallback if known_column(fallback) else "false"}

    def ranking_items(self) -> list[dict[str, str]]:
        """C09 per crop: rank score, expected yield, display name."""
        market = self.num_or("market_integration_score", 0.75)
        yld = self.num_or("crop_yield_t_ha", 3.8)
        items = []
        for i, crop in enumerate(CROPS):
            m = self.suitability_module(crop)
            factor = 1.1 if "rice" in crop else (1.2 if crop in ("maize", "sugarcane") else 0.6)
            items.append({"crop": crop, "ord": str(i), "display": display_name(crop),
                          "rank_score": self.R.rnd(f"({m['weight']}) * {self.d(0.7)} + ({market}) * {self.d(0.3)}", 3),
                          "class": m["class"],
                          "rationale": f"High agronomic fit for {crop.replace('_', ' ')} with favorable soil & moisture conditions.",
                          "yield": self.R.rnd(f"({yld}) * {self.d(factor)}", 2),
                          "color": m["color"]})
        return items

    def ranking_array(self, top_k: int | None = 5) -> str:
        assert self.dialect == "spark"
        structs = ", ".join(
            f"named_struct('k1', -{it['rank_score']}, 'ord', {it['ord']}, 'crop', '{it['crop']}', "
            f"'crop_display_name', initcap(replace('{it['crop']}', '_', ' ')), 'rank_score', {it['rank_score']}, "
            f"'suitability_class', {it['class']}, 'expected_yield_t_ha', {it['yield']}, "
            f"'suitability_color', {it['color']}, 'rationale', '{it['rationale']}')" for it in self.ranking_items())
        # natively sorted: a fallback expression would evaluate all its structs uncompiled
        arr = f"sort_array(array({structs}), true)"
        return f"slice({arr}, 1, {top_k})" if top_k else arr

    # ---------------------------------------------------------------- C08
    def health_map(self) -> dict[str, str]:
        score = self.num_or("crop_health_score", 0.65)
        cls, col = self.health_class(score)
        return {"health_score": score, "health_status": cls, "status_color_hex": col,
                "ndvi_median": self.R.v("ndvi_median_mean", 0.55) if self.has("ndvi_median_mean") else self.d(0.55),
                "ndwi_water_index": self.R.v("ndwi_mcf_median_mean", 0.15),
                "soil_moisture_m3_m3": self.R.v("era5_soil_moisture_m3_m3_mean", 0.28)}

    def map_style(self) -> dict[str, str]:
        """How the map draws the row."""
        return {"fill_color": self.health_map()["status_color_hex"], "opacity": self.d(MAP_STYLE["opacity"]),
                "stroke_color": f"'{MAP_STYLE['stroke_color']}'", "stroke_width": self.d(MAP_STYLE["stroke_width"])}

    # ---------------------------------------------------------------- C10
    def location_panel(self) -> dict[str, str]:
        v = self.R.v
        rnd = self.R.rnd
        return {"organic_carbon_g_kg": v("soil_soc_g_kg_0_30cm", 12.0), "ph_level": v("soil_ph_h2o_0_30cm", 6.5),
                "cec_cmol_kg": v("soil_cec_cmol_kg_0_30cm", 15.0), "clay_pct": v("soil_clay_pct_0_30cm", 30.0),
                "sand_pct": v("soil_sand_pct_0_30cm", 40.0), "silt_pct": v("soil_silt_pct_0_30cm", 30.0),
                # the pipeline's climate targets have no model: fallback pass-through
                "precipitation_mm": rnd(v("chirps_precipitation_mm_mean", 120.0), 1),
                "mean_temperature_c": rnd(v("mean_temperature_c_mean", 27.5), 1),
                "solar_radiation_mj_m2_day": rnd(v("solar_radiation_mj_m2_day_mean", 18.5), 1),
                "elevation_m": v("elevation_m", 15.0), "slope_degrees": v("slope_degrees", 2.0),
                "distance_to_surface_water_m": v("distance_to_surface_water_m", 450.0),
                "surface_water_occurrence_pct": v("surface_water_occurrence_pct", 20.0)}

    # ---------------------------------------------------------------- C11
    def alerts(self, corrected: bool = False) -> list[dict[str, str]]:
        """C11: the four alerts in order: severity (null: none), type, title,
        description and action.

        Model class values are strings, so the reference's integer tests
        (flood == 2, heat == 1) never fire on model output; ``corrected``
        compares the integer value instead."""
        def cls_eq(name: str, k: int) -> str:
            if not self.has(name):
                return "FALSE"
            if corrected:
                return f"(try_cast({self.str_col(name)} AS INT) = {k})" if self.dialect == "spark" \
                    else f"(TRY_CAST({self.str_col(name)} AS INTEGER) = {k})"
            # reference: string model classes never equal an int; int values do
            if self.R.types.get(name) in ("int", "bigint", "smallint", "tinyint"):
                return f"({name} = {k})"
            return "FALSE"

        drought = self.num_or("drought_risk_score", 0.2)
        water = self.regression_label("water_scarcity_risk", "Low")
        flood = (f"CASE WHEN {cls_eq('flood_risk_level', 2)} THEN 'HIGH' "
                 f"WHEN {cls_eq('flood_risk_level', 1)} THEN 'MEDIUM' END")
        dry = f"CASE WHEN {drought} > 0.75 THEN 'CRITICAL' WHEN {drought} > 0.5 THEN 'HIGH' END"
        shown = "format_string" if self.dialect == "spark" else "printf"
        percent = f"{shown}('%.1f', {self.R.rnd(f'({drought}) * {self.d(100)}', 1)})"
        return [
            {"type": "FLOOD_RISK", "severity": flood, "title": f"concat({self.capitalize(f'({flood})')}, ' Flood Risk Detected')",
             "description": f"'{FLOOD_DESCRIPTION}'", "action": f"'{FLOOD_ACTION}'"},
            {"type": "DROUGHT_RISK", "severity": dry, "title": f"concat({self.capitalize(f'({dry})')}, ' Drought Stress Alert')",
             "description": f"concat('Soil moisture deficit index at ', {percent}, '%.')", "action": f"'{DROUGHT_ACTION}'"},
            {"type": "HEAT_STRESS", "severity": f"CASE WHEN {cls_eq('heat_stress_risk', 1)} THEN 'HIGH' END", "title": f"'{HEAT_TITLE}'",
             "description": f"'{HEAT_DESCRIPTION}'", "action": f"'{HEAT_ACTION}'"},
            {"type": "WATER_SCARCITY", "severity": f"CASE WHEN {water} IN ('High', 'Medium') THEN upper({water}) END",
             "title": f"concat({water}, ' Water Scarcity Risk')", "description": f"'{WATER_DESCRIPTION}'", "action": f"'{WATER_ACTION}'"}]

    def alert_list(self, corrected: bool = False) -> dict[str, str]:
        """C11: number of alerts and their TYPE:SEVERITY list."""
        alerts = self.alerts(corrected)
        count = " + ".join(f"(CASE WHEN ({a['severity']}) IS NULL THEN 0 ELSE 1 END)" for a in alerts)
        names = ", ".join(f"CASE WHEN ({a['severity']}) IS NOT NULL THEN concat('{a['type']}:', {a['severity']}) END" for a in alerts)
        return {"alert_count": f"({count})", "alerts": f"concat_ws('|', {names})"}

    def alert_array(self, corrected: bool = False) -> str:
        """Spark only: the alerts that fire, as array<struct>."""
        assert self.dialect == "spark"
        items = ", ".join(
            f"IF(({a['severity']}) IS NULL, NULL, named_struct('type', '{a['type']}', 'severity', {a['severity']}, 'title', {a['title']}, "
            f"'description', {a['description']}, 'action', {a['action']}))" for a in self.alerts(corrected))
        return f"array_compact(array({items}))"

    def regression_label(self, name: str, default: str) -> str:
        """label of a numeric model prediction: '%.2f'."""
        if not self.has(name):
            return f"'{default}'"
        fn = "format_string" if self.dialect == "spark" else "printf"
        return f"coalesce({fn}('%.2f', {self.R.rnd(name, 2)}), '{default}')"

    def class_label(self, name: str, default: str) -> str:
        """label of a class model prediction: capitalize(str(value))."""
        if not self.has(name):
            return f"'{default}'"
        return f"coalesce({self.capitalize(self.str_col(name))}, '{default}')"

    # ---------------------------------------------------------------- C12-C14
    def agronomic_pattern(self) -> dict[str, str]:
        soc = self.R.v("soil_soc_g_kg_0_30cm", 12.0)
        ph = self.R.v("soil_ph_h2o_0_30cm", 6.5)
        return {
            "soil_fertility_status": f"(CASE WHEN {soc} > 18.0 THEN 'High' WHEN {soc} > 10.0 THEN 'Moderate' ELSE 'Low' END)",
            "soil_acidity_status": f"(CASE WHEN {ph} >= 6.0 AND {ph} <= 7.2 THEN 'Optimal' "
                                   f"WHEN {ph} < 6.0 THEN 'Acidic' ELSE 'Alkaline' END)",
            "irrigation_need_status": self.class_label("irrigation_need", "Medium"),
            "optimal_planting_season": self.class_label("optimal_planting_month", "May (Monsoon)"),
            "nitrogen_requirement": self.class_label("nitrogen_requirement_level", "Medium"),
            "phosphorus_requirement": self.class_label("phosphorus_requirement_level", "Medium"),
            "potassium_requirement": f"'{POTASSIUM_REQUIREMENT}'",
            "suggested_mix_kg_ha": f"'{SUGGESTED_MIX}'",
            "advice": "concat_ws('|', " + ", ".join(self.advice()) + ")",
        }

    def advice(self) -> list[str]:
        """The advice list."""
        month = self.class_label("optimal_planting_month", "May (Monsoon)")
        need = self.class_label("irrigation_need", "Medium")
        return [f"concat('Optimal planting window begins in ', {month}, '.')",
                f"concat('Maintain irrigation frequency according to ', {need}, ' deficit level.')", f"'{COMPOST_ADVICE}'"]

    def market_module(self) -> dict[str, str]:
        mkt = self.num_or("market_integration_score", 0.75)
        sc = self.num_or("supply_chain_efficiency", 0.80)
        cold = self.num_or("cold_chain_potential", 0.65)
        return {"market_integration_score": mkt,
                "post_harvest_loss_risk": self.regression_label("post_harvest_loss_risk", "Medium"),
                "supply_chain_efficiency_pct": self.R.rnd(f"({sc}) * {self.d(100)}", 1),
                "cold_chain_potential_pct": self.R.rnd(f"({cold}) * {self.d(100)}", 1),
                "transport_accessibility": f"(CASE WHEN {mkt} > 0.7 THEN 'Good' ELSE 'Moderate' END)"}

    def gdp_module(self) -> dict[str, str]:
        gdp = self.num_or("agricultural_gdp_forecast", 1250.0)
        return {"estimated_agricultural_gdp_usd_ha": gdp,
                "projected_yield_value_usd_ha": self.R.rnd(f"({gdp}) * {self.d(0.85)}", 2),
                "economic_rating": f"(CASE WHEN {gdp} > 1500 THEN 'High Productivity Zone' "
                                   f"ELSE 'Standard Production Zone' END)"}
