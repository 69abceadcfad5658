"""Query catalogue: name -> (Spark plan builder, DuckDB oracle SQL).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the whole driver tables; each oracle is an independent SQL statement
over the same tables.  Floating outputs that are not rounded by the rule
itself are presented with numpy-style rounding to 6 decimals in both
engines, so that last-bit differences of sums/exp between engines do not
decide the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.constants import AGG_FEATURES, FEATURES, STATIC_FEATURES, TARGETS
from agrolens.functions import labels as L
from agrolens.functions.rules_sql import RuleText
from agrolens.operators import features as FT
from agrolens.plans import sqltext as Q
from agrolens.sources import fixtures as FX

from agrolens.plans.registry import ORACLE, QUERIES, dk_round, register, sp_round  # noqa: F401


# ----------------------------------------------------------------- shared plans

def training_rows(spark: SparkSession, sf: str, documented: bool = False, columns: list[str] | None = None) -> DataFrame:
    return FT.training_rows(FX.obs_month(spark, sf), FX.grid_static(spark, sf), documented, columns)


def labelled_grids(spark: SparkSession, sf: str, keep_components: bool = False, months: list[str] | None = None) -> DataFrame:
    """The grids with the targets that depend on the grid alone, and their ``months`` (those columns of them)."""
    grid = FT.grid_rows(FX.obs_month(spark, sf), FX.grid_static(spark, sf), months=months)
    return L.with_labels(grid, [t for t in TARGETS if t not in L.MONTHLY_TARGETS], keep_components)


def labelled_months(grid: DataFrame) -> DataFrame:
    """The monthly rows of ``labelled_grids`` with all targets, behind them what else the grids have."""
    rows = L.with_monthly_labels(FT.monthly_rows(grid))
    first = [*FT.ROW_IDS, *FEATURES]
    more = [c for c in grid.columns if c not in {*first, *TARGETS, "months"}]
    return rows.select(*first, *[c for c in more if c in L.COMPONENTS], *TARGETS, *[c for c in more if c not in L.COMPONENTS])


def labelled_rows(spark: SparkSession, sf: str, keep_components: bool = False) -> DataFrame:
    return labelled_months(labelled_grids(spark, sf, keep_components))


# ----------------------------------------------------------------- A01 grid stats

@register("grid_stats", Q.with_ctes(
    [("obs", None), ("obs_month", None), ("gs", Q.grid_stats_select())],
    "SELECT grid_id, " + ", ".join(f"{dk_round(c)} AS {c}" for c in AGG_FEATURES) + " FROM gs"))
def grid_stats(spark, sf):
    """A01 over the monthly series: one partial-aggregated shuffle on grid_id."""
    gs = FT.grid_stats(FX.obs_month(spark, sf))
    return gs.selectExpr("grid_id", *[f"{sp_round(c)} AS {c}" for c in AGG_FEATURES])


@register("growing_season_documented", Q.with_ctes(
    [("obs", None), ("obs_month", None), ("gs", Q.grid_stats_select(documented=True))],
    "SELECT grid_id, " + dk_round("ndvi_median_growing_season_mean")
    + " AS ndvi_median_growing_season_mean, " + dk_round("ndvi_median_mean") + " AS ndvi_median_mean FROM gs"))
def growing_season_documented(spark, sf):
    """A03, documented variant (mean over months with NDVI > 0.4)."""
    gs = FT.grid_stats(FX.obs_month(spark, sf), documented_growing_season=True)
    return gs.selectExpr("grid_id", f"{sp_round('ndvi_median_growing_season_mean')} AS ndvi_median_growing_season_mean",
                         f"{sp_round('ndvi_median_mean')} AS ndvi_median_mean")


# ----------------------------------------------------------------- flagship

def health_class(score):
    return (F.when(score >= 0.80, "Excellent").when(score >= 0.60, "Good").when(score >= 0.40, "Moderate")
            .when(score >= 0.20, "Poor").otherwise("Critical"))


def health_class_sql(score: str) -> str:
    return (f"(CASE WHEN {score} >= 0.80 THEN 'Excellent' WHEN {score} >= 0.60 THEN 'Good' "
            f"WHEN {score} >= 0.40 THEN 'Moderate' WHEN {score} >= 0.20 THEN 'Poor' ELSE 'Critical' END)")


# the grid-level frame: static columns + per-grid statistics (no monthly or
# crop-area columns: those read their defaults, as on the Spark side)
_GRID_COLUMNS = ["grid_id", "system_index", "region", "latitude", "longitude", *STATIC_FEATURES, *AGG_FEATURES]
_ABSENT = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in FEATURES if c not in _GRID_COLUMNS)

_HEALTH_GRID_SQL = Q.with_ctes(
    [("grid_static", None), ("obs", None), ("obs_month", None), ("gs", Q.grid_stats_select()),
     ("g", f"SELECT s.*, gs.* EXCLUDE (grid_id), {_ABSENT} FROM gs JOIN grid_static s ON gs.grid_id = s.grid_id"),
     *Q.label_chain("g"),
     ("h", "SELECT region, crop_health_score, CASE WHEN crop_health_score < 0.20 THEN 'Critical' WHEN crop_health_score < 0.40 THEN 'Poor' "
           "WHEN crop_health_score < 0.60 THEN 'Moderate' WHEN crop_health_score < 0.80 THEN 'Good' ELSE 'Excellent' END AS health_class "
           "FROM labelled")],
    f"SELECT region, health_class, count(*) AS n_grids, {dk_round('avg(crop_health_score)')} AS mean_health "
    f"FROM h GROUP BY region, health_class")


@register("health_by_region", _HEALTH_GRID_SQL)
def health_by_region(spark, sf):
    """Minimum slice: scan -> A01 -> components -> L18 -> C02 class -> roll-up."""
    gs = FT.grid_stats(FX.obs_month(spark, sf))
    grid = gs.join(FX.grid_static(spark, sf), on="grid_id", how="inner")
    h = L.with_labels(grid, targets=["crop_health_score"])
    return (h.selectExpr("region", "crop_health_score", f"{health_class_sql('crop_health_score')} AS health_class")
            .groupBy("region", "health_class")
            .agg(F.expr("count(1) AS n_grids"), F.expr(f"{sp_round('avg(crop_health_score)')} AS mean_health")))


# ----------------------------------------------------------------- F01-F10

def _component_builder(comp: str) -> Builder:
    def build(spark, sf):
        grid = FT.grid_rows(FX.obs_month(spark, sf), FX.grid_static(spark, sf))
        R = RuleText("spark", grid.columns, L._types(grid))
        return FT.monthly_rows(grid.selectExpr(f"{sp_round(R.components()[comp])} AS {comp}", "months")).select("sample_id", comp)
    return build


for _comp in L.COMPONENTS:
    register(f"component_{_comp[:-2]}", Q.with_ctes(
        Q.labelled_ctes(), f"SELECT sample_id, {dk_round(_comp)} AS {_comp} FROM labelled"))(
        _component_builder(_comp))


# ----------------------------------------------------------------- L01-L40

def _label_builder(target: str) -> Builder:
    def build(spark, sf):
        return labelled_rows(spark, sf).select("sample_id", target)
    return build


for _t in TARGETS:
    register(f"label_{_t}", Q.with_ctes(Q.labelled_ctes(), f"SELECT sample_id, {_t} FROM labelled"))(
        _label_builder(_t))


@register("labels_all", Q.with_ctes(Q.labelled_ctes(), f"SELECT sample_id, {', '.join(TARGETS)} FROM labelled"))
def labels_all(spark, sf):
    """The 40-target projection over every training row (headline)."""
    return labelled_rows(spark, sf).select("sample_id", *TARGETS)


def _load_all():
    # query modules register themselves on import
    from agrolens.plans import (q_cleaning, q_ingest, q_io, q_joins, q_ml, q_quality, q_rollup,  # noqa: F401
                                q_catalog, q_scoring, q_stream)


def queries():
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
