"""Queries for the catalogue and composition helpers: J08, J09 (+M13, U04),
C06 (+P22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.constants import (CLASS_TARGETS, COMPOSITES, CROPS, FEATURES, IMPORTANCE_TIERS, PHYSICAL_BOUNDS,
                                TARGET_METADATA, TARGETS, display_name)
from agrolens.functions.composites import CompositeText
from agrolens.functions.fallback import FallbackText
from agrolens.operators import catalog_ops as CO
from agrolens.operators import cleaning as CL
from agrolens.operators import features as FT
from agrolens.operators import ingest as IN
from agrolens.operators import quality as QA
from agrolens.operators import rollup as RU
from agrolens.plans import oracle_rules
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import labelled_grids, labelled_rows, training_rows
from agrolens.plans.q_quality import NUM_EVAL, scored_tables, shown
from agrolens.plans.q_scoring import LABELLED_COLUMNS, types_of
from agrolens.plans.registry import ORACLE, register
from agrolens.session import ensure_checkpoint_dir
from agrolens.sources import fixtures as FX

# ------------------------------------------------------------------ J08

_FBD = oracle_rules.fallback()


@register("prediction_feature_lookup", Q.with_ctes(
    Q.rows_ctes() + [("p", "SELECT sample_id, " + ", ".join(f"{_FBD[f'crop_suitability_{c}'][1]} AS predicted_{c}" for c in CROPS)
                      + " FROM rows")],
    "SELECT p.*, " + ", ".join(f"r.crop_area_pct_{c}" for c in CROPS) + ", r.region FROM p "
    "JOIN rows r ON p.sample_id = r.sample_id"))
def prediction_feature_lookup(spark, sf):
    """The predictions of all crops joined back to their feature rows by
    key (one equi join instead of a per-prediction scan)."""
    rows = training_rows(spark, sf)
    fx = FallbackText("spark", rows.columns, types_of(rows)).exprs()
    preds = rows.selectExpr("sample_id", *[f"{fx[f'crop_suitability_{c}'][1]} AS predicted_{c}" for c in CROPS])
    return preds.join(rows.select("sample_id", *[f"crop_area_pct_{c}" for c in CROPS], "region"), on="sample_id")


# ------------------------------------------------------------------ C06 (+P22)

_LAYERS = {"crop_health": ("health_layer", "health_"), "economic_roi": ("economic_roi", ""), "risk_alerts": ("risk_alerts", "risk_"),
           "land_use": ("land_use", "land_")}


def _layer_columns(C: CompositeText, wanted: list[str]) -> dict[str, str]:
    out = {}
    for name in wanted:
        if name in _LAYERS:
            method, prefix = _LAYERS[name]
            out |= {f"{prefix}{k.removeprefix(prefix)}": e for k, e in getattr(C, method)().items()}
    return out


def build_requested(lab, wanted: list[str], top_k: int = 5, key: str = "sample_id"):
    """The ``wanted`` composites side by side, one row per ``key``; the
    recommender gives its ``top_k`` crops as ``crop:score|crop:score``."""
    targets = CO.resolve_targets([], wanted)
    df = lab.select(key, *targets, *[c for c in lab.columns if c.startswith("crop_area_pct_")],
                    "cropland_fraction", "ndvi_median_mean")
    C = CompositeText("spark", df.columns, types_of(df))
    cols = [f"{e} AS {k}" for k, e in _layer_columns(C, wanted).items()]
    if "crop_recommender" in wanted:
        arr, n_valid = C.recommender_sorted()
        df = C.recommender_staged(df).selectExpr("*", f"{arr} AS _ranked", f"{n_valid} AS _valid")
        names = []
        for i in range(top_k):
            df = df.selectExpr("*", f"CASE WHEN _valid > {i} THEN element_at(_ranked, {len(C.recommender_items())} - _valid + {i + 1}) END AS _r{i}")
            p = C.recommender_pick(f"_r{i}", str(i))
            names.append(f"CASE WHEN _r{i} IS NOT NULL THEN concat({p['crop']}, ':', CAST({p['suitability_score']} AS STRING)) END")
        cols.append(f"concat_ws('|', {', '.join(names)}) AS top_crops")
    return df.selectExpr(key, *cols)


def requested_rows(spark, sf, wanted: list[str]):
    """C06 for every monthly row: what the composites read is a grid's, so they are built once for all its months."""
    built = build_requested(labelled_grids(spark, sf).withColumn("samples", F.col("months.sample_id")), wanted, key="samples")
    return built.select(F.explode("samples").alias("sample_id"), *built.columns[1:])


def _requested_sql(wanted: list[str], top_k: int = 5) -> str:
    layers = {"crop_health": ("health_", oracle_rules.health_layer()), "risk_alerts": ("risk_", oracle_rules.risk_alerts()),
              "land_use": ("land_", oracle_rules.land_use()),
              "economic_roi": ("", CompositeText("duckdb", LABELLED_COLUMNS).economic_roi())}  # fixed texts
    cols = "".join(f", {e} AS {prefix}{k.removeprefix(prefix)}" for name in wanted if name in layers
                   for prefix, found in [layers[name]] for k, e in found.items())
    if "crop_recommender" not in wanted:
        return Q.with_ctes(Q.labelled_ctes(), f"SELECT sample_id{cols} FROM labelled")
    return Q.with_ctes(
        Q.labelled_ctes() + [
            ("rk", oracle_rules.ranked_crops("labelled")),
            ("top", f"SELECT sample_id, string_agg(concat(crop, ':', CAST({oracle_rules.adjusted('idx')} AS VARCHAR)), '|' ORDER BY idx) "
                    f"AS top_crops FROM rk WHERE idx < {top_k} GROUP BY sample_id")],
        f"SELECT l.sample_id{cols}, coalesce(t.top_crops, '') AS top_crops FROM labelled l LEFT JOIN top t ON l.sample_id = t.sample_id")


@register("requested_composites", _requested_sql(COMPOSITES))
def requested_composites(spark, sf):
    """The requested composites (default: all five) side by side; the
    prediction set is resolved with P22 (composites pull their targets)."""
    return requested_rows(spark, sf, COMPOSITES)


@register("requested_subset", _requested_sql(["risk_alerts", "land_use"]))
def requested_subset(spark, sf):
    """C06 + P22: two requested composites pull only their own targets."""
    return requested_rows(spark, sf, ["risk_alerts", "land_use"])


# ------------------------------------------------------------------ J09 (+M13, U04)

def _catalog_sql() -> str:
    meta = ", ".join(
        "('{}', '{}', '{}', '{}', {})".format(t, display_name(t), TARGET_METADATA[t]["task_type"], TARGET_METADATA[t]["group"],
                                        "NULL" if TARGET_METADATA[t].get("expected_classes") is None else
                                        "[" + ", ".join(f"'{c}'" for c in TARGET_METADATA[t]["expected_classes"]) + "]")
        for t in TARGETS)
    return f"""
WITH dim AS (SELECT * FROM (VALUES {meta}) AS v(target, display_name, task_type, "group", expected)),
sc_pairs AS ({ORACLE['confusion']}),
seen AS (SELECT target, list(DISTINCT y) AS classes FROM sc_pairs GROUP BY target),
clf AS (SELECT target, sum(n) FILTER (y = yhat) / sum(n) AS score FROM sc_pairs GROUP BY target),
reg AS (SELECT target, r2 AS score FROM ({ORACLE['reg_metrics']}) AS m),
flags AS (SELECT DISTINCT target FROM (SELECT target FROM ({ORACLE['bounds']}) AS b WHERE n_violations > 0
  UNION ALL SELECT target FROM ({ORACLE['bias_checks']}) AS c WHERE biased
  UNION ALL SELECT target FROM ({ORACLE['majority_lift']}) AS l WHERE no_lift) AS x),
j AS (SELECT d.*, coalesce(clf.score, reg.score, CASE WHEN d.task_type = 'classification' THEN 0.0 END) AS score, f.target IS NOT NULL AS flagged,
  CASE WHEN d.expected IS NOT NULL AND s.classes IS NOT NULL
       THEN list_filter(d.expected, lambda e: NOT list_contains(s.classes, e)) END AS missing
  FROM dim d LEFT JOIN clf ON d.target = clf.target LEFT JOIN reg ON d.target = reg.target
  LEFT JOIN flags f ON d.target = f.target LEFT JOIN seen s ON d.target = s.target)
SELECT target, display_name, task_type, "group", {shown("score", False)} AS score,
 CASE WHEN flagged OR coalesce(len(missing), 0) > 0 THEN 'flagged' ELSE 'healthy' END AS validation_status,
 CAST(1 + CAST(flagged AS INTEGER) + CAST(coalesce(len(missing), 0) > 0 AS INTEGER) AS INTEGER) AS n_warnings,
 array_to_string(missing, ',') AS missing_classes FROM j"""


@register("catalog_join", _catalog_sql())
def catalog_join(spark, sf):
    """Target dimension LEFT JOIN metrics LEFT JOIN diagnostics, with
    missing expected classes (U04) flagging a target."""
    ensure_checkpoint_dir(spark)
    sc, sn = scored_tables(spark, sf)
    clf = QA.clf_metrics(QA.class_stats(QA.confusion(sc))).select("target", F.col("accuracy").alias("score"))
    reg = QA.reg_metrics(sn).select("target", F.col("r2").alias("score"))
    metrics = clf.unionByName(reg)
    bias = QA.bias_checks(sn)
    issues = (QA.bounds_check(sn, PHYSICAL_BOUNDS).where("n_violations > 0").select("target")
              .withColumn("issue", F.lit("BOUNDARY VIOLATIONS"))
              .unionByName(bias.where("biased").select("target").withColumn("issue", F.lit("SYSTEMATIC PREDICTION BIAS")))
              .unionByName(QA.majority_lift(sc).where("no_lift").select("target")
                           .withColumn("issue", F.lit("NO LIFT OVER MAJORITY BASELINE"))))
    targets = spark.createDataFrame([(t,) for t in CLASS_TARGETS + NUM_EVAL], "target string")
    diag = QA.health_rollup(issues, targets).select("target", "overall_status", "issues")
    observed = sc.groupBy("target").agg(F.array_sort(F.collect_set("y")).alias("classes"))
    cat = CO.model_catalog(CO.target_dim(spark), metrics, diag, observed)
    return cat.select("target", "display_name", "task_type", "group", F.expr(shown("score", True)).alias("score"), "validation_status", "n_warnings",
                      F.array_join("missing_classes", ",").alias("missing_classes"))


# ------------------------------------------------------------------ P23 / P10 / P11 / P01 / P07

@register("importance_tiers", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{t}', '{tier}')" for i, (t, tier) in enumerate(IMPORTANCE_TIERS.items())) + ") AS v(ord, target, tier), "
    "(SELECT count(*) AS n_part FROM part) AS p")
def importance_tiers(spark, sf):
    """The tier table (beside the number of grid cells it is used on)."""
    t = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(IMPORTANCE_TIERS.items())], "ord int, target string, tier string")
    return t.crossJoin(F.broadcast(FX.table(spark, sf, "part").agg(F.count("*").alias("n_part"))))  # one row


@register("pending_by_tier", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}')" for t, x in IMPORTANCE_TIERS.items() if x in ("high", "low") and not t.startswith("crop_suitability")) + ") AS v(target) "
    "WHERE (SELECT count(*) FROM part) > 0")
def pending_by_tier(spark, sf):
    """Selected tiers minus the targets already in a ledger (here: those
    of the suitability group, read from the catalogue)."""
    from agrolens.operators import ml as ML
    ledger = CO.target_dim(spark).where("group = 'crop_suitability'").select("target")
    some = FX.table(spark, sf, "part").limit(1).count()
    left = CO.pending_targets(spark, ML.tier_targets(["high", "low"]), ledger) if some else []
    return spark.createDataFrame([(t,) for t in left], "target string")


@register("region_rows", Q.with_ctes(
    Q.rows_ctes() + [("g", "SELECT region, count(*) AS n FROM grid_static GROUP BY region")],
    "SELECT 'flag' AS way, count(*) AS n FROM rows WHERE region_bago = 1 "
    "UNION ALL SELECT 'name', n FROM g WHERE region = 'bago' UNION ALL SELECT 'all', sum(n) FROM g"))
def region_rows(spark, sf):
    """P10: the region predicate by one-hot flag, by name, and without region."""
    rows, gs = training_rows(spark, sf), FX.grid_static(spark, sf)
    of = lambda way, df: df.agg(F.lit(way).alias("way"), F.count("*").alias("n"))
    return of("flag", RU.region_filter(rows, "Bago")).unionByName(of("name", RU.region_filter(gs, "BAGO"))) \
        .unionByName(of("all", RU.region_filter(gs, None)))


_GONE = "grid_id % 7 = 2"


@register("unlabelled_rows", Q.with_ctes(
    Q.labelled_ctes(), f"SELECT region, count(*) AS n FROM labelled WHERE NOT ({_GONE}) GROUP BY region"))
def unlabelled_rows(spark, sf):
    """Rows whose labels are all missing (here: a seventh of the grid) go."""
    lab = labelled_rows(spark, sf)
    some = lab.selectExpr("region", *[f"CASE WHEN {_GONE} THEN NULL ELSE {t} END AS {t}" for t in TARGETS])
    return CL.drop_all_null_labels(some, TARGETS).groupBy("region").agg(F.count("*").alias("n"))


@register("kept_columns", Q.with_ctes(
    [("grid_static", None)], "SELECT system_index, region, elevation_m FROM grid_static"))
def kept_columns(spark, sf):
    """An ordered keep list; repeated and absent names are skipped."""
    return FT.keep_columns(FX.grid_static(spark, sf), ["system_index", "region", "no_such", "elevation_m", "region"])


_INF = "CASE WHEN grid_id % 11 = 4 THEN CAST('Infinity' AS DOUBLE) ELSE mean_temperature_c END"


@register("strict_infinite", Q.with_ctes(
    Q.rows_ctes() + [
        ("v", "SELECT sample_id, (" + " + ".join(
            f"(CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END)" for c in FEATURES)
         + ") AS n_missing, grid_id % 11 = 4 AS infinite FROM rows"),
        ("m", "SELECT *, CASE WHEN infinite THEN ': feature row contains 1 infinite values' "
              "WHEN n_missing > 0 THEN printf(': model does not support %d missing values', n_missing) END AS tail FROM v")],
    "SELECT sample_id, CASE WHEN tail IS NULL THEN 0 ELSE 40 END AS n_errors, md5(concat_ws('|', "
    + ", ".join(f"'{t}' || tail" for t in sorted(TARGETS)) + ")) AS messages FROM m"))
def strict_infinite(spark, sf):
    """Rows with infinities (an eleventh of the grid); the messages of all 40 targets."""
    rows = training_rows(spark, sf).withColumn("mean_temperature_c", F.expr(_INF))
    v = IN.strict_validate(rows, {t: FEATURES for t in TARGETS})
    return v.selectExpr("sample_id", "n_errors", "md5(CAST(array_join(sort_array(map_values(errors)), '|') AS BINARY)) AS messages")


@register("downcast_rows", Q.with_ctes(
    [("grid_static", None)], "SELECT system_index, elevation_m, soil_clay_pct_0_30cm, slope_degrees FROM grid_static"))
def downcast_rows(spark, sf):
    """P20: the lossless downcast applied; values are unchanged."""
    gs = FX.grid_static(spark, sf).select("system_index", "elevation_m", "soil_clay_pct_0_30cm", "slope_degrees")
    plan = {r["column"]: r["target_type"] for r in CL.downcast_plan(gs, gs.columns[1:]).collect()}  # one row per column
    small = CL.apply_downcast(gs, plan)
    return small.select("system_index", *[F.col(c).cast("double").alias(c) for c in gs.columns[1:]])
