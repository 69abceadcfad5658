"""Queries for the ML layer: M01-M04, and the forest training, evaluation and
scoring paths M05-M12, C16, A18.  Forests are not comparable row by row with
SQL: their oracles state what must hold (sizes of the exact split, scores in
range, probabilities summing to one, importances summing to one)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolens.constants import CLASS_TARGETS, FEATURE_WEIGHTS, FEATURES, TARGETS
from agrolens.functions.fallback import FallbackText
from agrolens.operators import cleaning as CL
from agrolens.operators import ml as ML
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import labelled_rows, training_rows
from agrolens.plans.q_scoring import types_of
from agrolens.plans.registry import dk_round, register, sp_round
from agrolens.session import materialize, scratch_path
from agrolens.sources import files as IO

# ------------------------------------------------------------------ M01


def _weights_sql() -> str:
    boosted = [(c, fw) for c, fw in FEATURE_WEIGHTS.items() if c in FEATURES and fw > 1.0]
    x = "coalesce(CAST({c} AS DOUBLE), 0.0)"
    mm = ", ".join(f"min({x.format(c=c)}) AS _mn_{c}, max({x.format(c=c)}) AS _mx_{c}" for c, _ in boosted)
    w = "CAST(1.0 AS DOUBLE)"
    for c, fw in boosted:
        rng = f"(_mx_{c} - _mn_{c})"
        w = f"({w} + CASE WHEN {rng} > 0 THEN (({x.format(c=c)} - _mn_{c}) / {rng}) * {Q.d(fw - 1.0)} ELSE 0.0 END)"
    return Q.with_ctes(
        Q.rows_ctes() + [("mm", f"SELECT {mm} FROM rows"),
                         ("raw", f"SELECT r.sample_id, {w} AS _w FROM rows r CROSS JOIN mm"),
                         ("mean", f"SELECT {Q.xavg('_w')} AS _wmean FROM raw")],
        f"SELECT sample_id, {dk_round('least(greatest(_w / _wmean, 0.5), 3.0)')} AS sample_weight "
        "FROM raw CROSS JOIN mean")


@register("sample_weights", _weights_sql())
def sample_weights(spark, sf):
    """Domain-weighted sample weights (mean-normalised, clipped)."""
    used = [c for c in FEATURES if c in FEATURE_WEIGHTS]
    rows = materialize(training_rows(spark, sf).select("sample_id", *used), "weighed")  # read by two aggregates and the result
    out = ML.sample_weights(rows, FEATURES)
    return out.selectExpr("sample_id", f"{sp_round('sample_weight')} AS sample_weight")


# ------------------------------------------------------------------ M02 / M04

_LONG_CLASSES = " UNION ALL ".join(f"SELECT '{t}' AS target, CAST({t} AS VARCHAR) AS class FROM labelled"
                                   for t in CLASS_TARGETS)


def _long_classes(df):
    parts = ", ".join(f"'{t}', CAST({t} AS STRING)" for t in CLASS_TARGETS)
    return df.selectExpr("sample_id", f"stack({len(CLASS_TARGETS)}, {parts}) AS (target, class)")


@register("label_index", Q.with_ctes(
    Q.labelled_ctes() + [("lc", _LONG_CLASSES)],
    "SELECT target, class, CAST(dense_rank() OVER (PARTITION BY target ORDER BY class) - 1 AS DOUBLE) AS label "
    "FROM (SELECT DISTINCT target, class FROM lc) AS d"))
def label_index(spark, sf):
    """Alphabetical label codes per class target (StringIndexer
    alphabetAsc semantics, computed on the distinct-class table)."""
    d = _long_classes(labelled_rows(spark, sf)).select("target", "class").distinct()
    return d.withColumn("label", (F.dense_rank().over(Window.partitionBy("target").orderBy("class")) - 1)
                        .cast("double"))


@register("class_weights", Q.with_ctes(
    Q.labelled_ctes() + [("lc", _LONG_CLASSES),
                         ("c", "SELECT target, class, count(*) AS n_class FROM lc GROUP BY target, class"),
                         ("t", "SELECT target, CAST(sum(n_class) AS BIGINT) AS n, count(*) AS k FROM c GROUP BY target")],
    f"SELECT c.target, c.class, c.n_class, {dk_round('t.n / (t.k * c.n_class)')} AS class_weight "
    "FROM c JOIN t ON c.target = t.target"))
def class_weights(spark, sf):
    """Balanced class weights n / (k * n_c) for every class target."""
    lc = _long_classes(labelled_rows(spark, sf))
    c = lc.groupBy("target", "class").agg(F.count(F.lit(1)).alias("n_class"))
    t = c.groupBy("target").agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.join(t, on="target").selectExpr("target", "class", "n_class",
                                             f"{sp_round('n / (k * n_class)')} AS class_weight")


# ------------------------------------------------------------------ M03

@register("split_summary", Q.with_ctes(
    Q.labelled_ctes() + [("lc", _LONG_CLASSES),
                         ("c", "SELECT target, class, count(*) AS n FROM lc GROUP BY target, class")],
    "SELECT target, class, n, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS n_test FROM c"))
def split_summary(spark, sf):
    """Exact stratified 80/20 split of every class target (places in one
    hash order per class); per class the row and test counts."""
    rows = materialize(labelled_rows(spark, sf).select("sample_id", *[F.col(t).cast("string").alias(t) for t in CLASS_TARGETS]), "classes")
    flagged = ML.with_test_flags(rows, CLASS_TARGETS, "sample_id")
    parts = ", ".join(f"'{t}', {t}, test_{t}" for t in CLASS_TARGETS)
    return flagged.selectExpr(f"stack({len(CLASS_TARGETS)}, {parts}) AS (target, class, test)").groupBy("target", "class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("test").alias("n_test"))


# ------------------------------------------------------------------ M05-M12

CLASSES = [t for t in TARGETS if t in CLASS_TARGETS]
NUMBERS = [t for t in TARGETS if t not in CLASS_TARGETS]
#: Least held-out accuracy (class targets) or R2 (numeric ones) of the quick profile's forests on the fixture rows:
FLOORS = {
    "crop_suitability_monsoon_rice": 0.9,
    "crop_suitability_dry_season_rice": 0.91,
    "crop_suitability_maize": 0.96,
    "crop_suitability_sugarcane": 0.96,
    "crop_suitability_cassava": 0.95,
    "crop_suitability_durian": 0.9,
    "crop_suitability_mangosteen": 0.89,
    "crop_suitability_longan": 0.95,
    "crop_suitability_mango": 0.95,
    "crop_suitability_chili": 0.96,
    "crop_suitability_tomato": 0.95,
    "crop_suitability_black_gram": 0.96,
    "crop_suitability_green_gram": 0.96,
    "crop_suitability_pigeon_pea": 0.95,
    "crop_suitability_groundnut": 0.96,
    "crop_suitability_sesame": 0.95,
    "crop_suitability_rubber": 0.96,
    "crop_health_score": 0.75,
    "crop_yield_t_ha": 0.78,
    "irrigation_need": 0.92,
    "current_month_precipitation_mm": 0.64,
    "current_month_mean_temperature_c": 0.7,
    "current_month_solar_rad_mj_m2_day": 0.71,
    "flood_risk_level": 0.96,
    "drought_risk_score": 0.82,
    "heat_stress_risk": 0.96,
    "optimal_planting_month": 0.96,
    "nitrogen_requirement_level": 0.96,
    "phosphorus_requirement_level": 0.95,
    "soil_erosion_risk": 0.96,
    "market_integration_score": 0.76,
    "post_harvest_loss_risk": 0.77,
    "supply_chain_efficiency": 0.79,
    "cold_chain_potential": 0.8,
    "agricultural_land_conversion_risk": 0.86,
    "urban_encroachment_risk": 0.79,
    "irrigation_potential": 0.79,
    "surface_water_occurrence": 0.83,
    "water_scarcity_risk": 0.82,
    "agricultural_gdp_forecast": 0.81,
}
#: Least mean macro F1 or R2 over the folds of the screening profile.
CV_FLOORS = {t: 0.7 if t in CLASS_TARGETS else 0.5 for t in TARGETS}


def model_table(spark, sf):
    """Imputed (exact global medians), weighted, assembled training table."""
    lab = labelled_rows(spark, sf)
    dbl = [c for c in FEATURES if c not in ("valid_agriculture_mask", "data_month") and not c.startswith("region_")]
    imp = CL.median_impute(lab, dbl, [], checkpoint=True)
    return ML.assemble(ML.sample_weights(imp, FEATURES), FEATURES)


def _store(spark, sf, name: str) -> str:
    """Path of one of the tables or folders of ``sf`` that this application shares."""
    tag = hashlib.md5(f"{sf} {spark.sparkContext.applicationId}".encode()).hexdigest()[:12]
    return scratch_path(spark, f"{name}-{tag}")


def prepared_table(spark, sf):
    table = _store(spark, sf, "model-table")
    if not ML._exists(spark, f"{table}/_SUCCESS"):
        model_table(spark, sf).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


def model_store(spark, sf, targets=TARGETS) -> str:
    """Folder of the models of ``targets`` (all 40) of ``sf`` (P23: trained once, then known from the ledger)."""
    out = _store(spark, sf, "models")
    ML.train_all(spark, prepared_table(spark, sf), targets, out, "sample_id", FEATURES, at_once=8)
    return out


def scored_store(spark, sf) -> tuple[str, str]:
    """Paths of the scores of all rows and targets and of what the writing job observed, written once."""
    table, usage = _store(spark, sf, "scores"), _store(spark, sf, "usage")
    if not ML._exists(spark, f"{usage}/_SUCCESS"):
        rows = prepared_table(spark, sf)
        models, reasons = ML.load_models(spark, model_store(spark, sf), TARGETS)
        fx = FallbackText("spark", rows.columns, types_of(rows)).exprs()
        scored = ML.score_targets(ML.spread(rows), models, reasons, fx, ["sample_id"])
        seen = IO.write_observed(scored, table, ML.usage_metrics(TARGETS))
        ML.usage_rows(spark, seen, TARGETS, reasons).coalesce(1).write.mode("overwrite").parquet(usage)
    return table, usage


def _names(targets):
    return ", ".join(f"('{t}')" for t in targets)


def _floors(targets):
    """VALUES of (target, floor): the least held-out accuracy or R2 that a target's forest must reach."""
    return ", ".join(f"('{t}', {Q.d(FLOORS[t])})" for t in targets)


@register("train_classifier", Q.with_ctes(
    Q.labelled_ctes() + [("lc", _LONG_CLASSES), ("c", "SELECT target, class, count(*) AS n FROM lc GROUP BY target, class"),
                         ("s", "SELECT target, sum(n) AS n, sum(floor(n * 0.2 + 0.5)) AS n_test FROM c GROUP BY target")],
    "SELECT target, 'trained' AS status, CAST(n - n_test AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, "
    f"floor_of AS least, true AS reached, true AS scores_in_range FROM s JOIN (VALUES {_floors(CLASSES)}) AS f(target, floor_of) USING (target)"))
def train_classifier(spark, sf):
    """M05 + M09 + M12: forests of all class targets (balanced x sample
    weights, exact stratified split): sizes, and what must hold of the
    held-out scores (a least accuracy per target)."""
    m = ML.metrics_table(ML.ledger(spark, model_store(spark, sf, CLASSES))).where("type = 'classification'")
    least = spark.createDataFrame([(t, FLOORS[t]) for t in CLASSES], "target string, least double")
    return m.join(F.broadcast(least), "target").selectExpr(
        "target", "status", "n_train", "n_test", "least", "accuracy >= least AS reached",
        "accuracy BETWEEN 0 AND 1 AND f1_macro BETWEEN 0 AND 1 AND f1_weighted BETWEEN 0 AND 1 AS scores_in_range")


@register("train_regressor", Q.with_ctes(
    Q.rows_ctes() + [("s", "SELECT count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_test FROM rows")],
    "SELECT target, 'trained' AS status, n - n_test AS n_train, n_test, floor_of AS least, true AS reached, true AS errors_ordered "
    f"FROM s, (VALUES {_floors(NUMBERS)}) AS f(target, floor_of)"))
def train_regressor(spark, sf):
    """M06 + M09 + M12: forests of all numeric targets (a least R2 per target)."""
    m = ML.metrics_table(ML.ledger(spark, model_store(spark, sf, NUMBERS))).where("type = 'regression'")
    least = spark.createDataFrame([(t, FLOORS[t]) for t in NUMBERS], "target string, least double")
    return m.join(F.broadcast(least), "target").selectExpr(
        "target", "status", "n_train", "n_test", "least", "r2 >= least AS reached",
        "mae >= 0 AND rmse >= mae AND y_pred_min >= y_test_min - rmse AND y_pred_max <= y_test_max + rmse AS errors_ordered")


@register("train_metrics")
def train_metrics(spark, sf):
    """The metrics table as trained, all 40 targets (scores of the forests: rows-only)."""
    return ML.metrics_table(ML.ledger(spark, model_store(spark, sf))).drop("detail", "cv_scores", "cv_mean", "cv_std")


@register("training_tables", Q.with_ctes(
    Q.rows_ctes() + [("n", "SELECT count(*) AS n FROM rows")],
    f"SELECT target, CAST({len(FEATURES)} AS BIGINT) AS n_importances, CAST({len(FEATURES)} AS BIGINT) AS n_importances_csv, n AS n_rows, n AS n_rows_csv, "
    f"5 AS top_features FROM n, (VALUES {_names(TARGETS)}) AS t(target)"))
def training_tables(spark, sf):
    """The metrics and importance tables as published, Parquet and CSV side by side."""
    path = f"{_store(spark, sf, 'training-tables')}-{uuid.uuid4().hex[:8]}"
    ML.export_tables(spark, model_store(spark, sf), path)
    of = lambda name, csv: IO.read_published(spark, f"{path}/{name}", csv=csv)
    rows = [of("metrics", csv).select("target", (F.col("n_train").cast("long") + F.col("n_test").cast("long")).alias(f"n_rows{x}"),
                                      *([] if csv else [F.size(F.split("top5_features", "\\|")).alias("top_features")])) for csv, x in ((False, ""), (True, "_csv"))]
    imp = [of("importance", csv).groupBy("target").agg(F.count("*").alias(f"n_importances{x}")) for csv, x in ((False, ""), (True, "_csv"))]
    return rows[0].join(rows[1], "target").join(imp[0], "target").join(imp[1], "target").select(
        "target", "n_importances", "n_importances_csv", "n_rows", "n_rows_csv", "top_features")


@register("cv_scores", f"SELECT target, 5 AS folds, true AS in_range, true AS mean_of_folds, true AS reached "
                       f"FROM (VALUES {_floors(TARGETS)}) AS f(target, floor_of) WHERE (SELECT count(*) FROM lineitem) > 0")
def cv_scores(spark, sf):
    """5-fold cross-validation (exact stratified folds over all rows) of
    all 40 targets: macro F1 of class targets, R2 of numeric ones."""
    out = _store(spark, sf, "cv-models")
    ML.train_all(spark, prepared_table(spark, sf), TARGETS, out, "sample_id", FEATURES, profile="screen", cv=True, at_once=8)
    m = ML.metrics_table(ML.ledger(spark, out))
    least = spark.createDataFrame([(t, CV_FLOORS[t]) for t in TARGETS], "target string, least double")
    return m.join(F.broadcast(least), "target").selectExpr(
        "target", "size(cv_scores) AS folds", "forall(cv_scores, x -> x <= 1 AND (x >= 0 OR type = 'regression')) AS in_range",
        "abs(cv_mean - aggregate(cv_scores, 0D, (a, x) -> a + x) / size(cv_scores)) < 1e-12 AND cv_std >= 0 AS mean_of_folds",
        "cv_mean >= least AS reached")


@register("importance", f"SELECT target, CAST({len(FEATURES)} AS BIGINT) AS n_features, true AS sums_to_one, true AS ranked "
                        f"FROM (VALUES {_names(TARGETS)}) AS t(target)")
def importance(spark, sf):
    """M08 + T04: the importance table of all 40 targets: all features,
    summing to one, ranked by falling importance."""
    imp = ML.importance_table(ML.ledger(spark, model_store(spark, sf)))
    before = F.lag("importance").over(Window.partitionBy("target").orderBy("rank"))
    return imp.withColumn("falls", F.coalesce(before >= F.col("importance"), F.lit(True))).groupBy("target").agg(
        F.count("*").alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"), F.every("falls").alias("ranked"))


@register("importance_top5")
def importance_top5(spark, sf):
    """The five most important features of every target (rows-only)."""
    return ML.importance_table(ML.ledger(spark, model_store(spark, sf))).where("rank <= 5")


@register("score_all")
def score_all(spark, sf):
    """M10 + M11 + C16: every row scored for all 40 targets in one chained
    pass: the saved model where one loads, the fallback estimator otherwise."""
    s = spark.read.parquet(scored_store(spark, sf)[0])
    return s.selectExpr("sample_id", *[f"{t}.value AS {t}" for t in TARGETS], *[f"{t}.is_fallback AS {t}_is_fallback" for t in TARGETS],
                        "round(least(" + ", ".join(f"{t}.confidence" for t in CLASSES) + "), 6) AS least_confidence")


@register("score_checks", Q.with_ctes(
    Q.labelled_ctes() + [("lc", _LONG_CLASSES), ("k", "SELECT target, count(DISTINCT class) AS n_classes FROM lc GROUP BY target"),
                         ("n", "SELECT count(*) AS n FROM labelled")],
    "SELECT target, n AS n_rows, n AS n_keys, n AS n_known_class, n AS n_labelled, true AS agrees FROM n, k"))
def score_checks(spark, sf):
    """Decoded scores of every class target: each row once, its class one
    of the target's, label and confidence (largest of the probabilities) in
    place, and the share of rows with the true class above its floor."""
    s, rows = spark.read.parquet(scored_store(spark, sf)[0]), prepared_table(spark, sf)
    truth = rows.select("sample_id", *[F.col(t).cast("string").alias(f"true_{t}") for t in CLASSES])
    known = rows.agg(*[F.collect_set(F.col(t).cast("string")).alias(t) for t in CLASSES]).first()  # a few classes per target
    long = s.join(truth, "sample_id").select("sample_id", F.explode(F.array(*[F.struct(
        F.lit(t).alias("target"), F.col(f"{t}.value").alias("v"), F.col(f"{t}.label").alias("label"), F.col(f"{t}.confidence").alias("c"),
        F.col(f"true_{t}").alias("y"), F.lit(FLOORS[t]).alias("least"), F.lit(len(known[t])).alias("k"),
        F.col(f"{t}.value").isin(known[t]).alias("known")) for t in CLASSES])).alias("x"))
    return long.select("sample_id", "x.*").groupBy("target").agg(
        F.count("*").alias("n_rows"), F.count_distinct("sample_id").alias("n_keys"), F.count_if("known").alias("n_known_class"),
        F.count_if(F.expr("label = initcap(v) AND c >= 1 / k - 1e-9 AND c <= 1 + 1e-9")).alias("n_labelled"),
        (F.count_if(F.col("v") == F.col("y")) >= F.max("least") * F.count("y")).alias("agrees"))


@register("model_usage", Q.with_ctes(
    Q.rows_ctes() + [("n", "SELECT count(*) AS n FROM rows")],
    "SELECT target, n AS n_rows, n AS n_model, CAST(0 AS BIGINT) AS n_fallback, CAST(0 AS BIGINT) AS n_null, "
    f"CAST(0 AS BIGINT) AS n_bad_sum, false AS has_reason FROM n, (VALUES {_names(TARGETS)}) AS t(target)"))
def model_usage(spark, sf):
    """A25 + M11: per target how many rows a model and how many the fallback
    scored, as the job that wrote the scores observed it."""
    return spark.read.parquet(scored_store(spark, sf)[1]).selectExpr(
        "target", "n_rows", "n_model", "n_fallback", "n_null", "n_bad_sum", "reason IS NOT NULL AS has_reason")


@register("run_metrics", Q.with_ctes(
    Q.rows_ctes() + [("n", "SELECT count(*) AS n FROM rows")],
    "SELECT n AS total_rows, n * 40 AS total_predictions, n * 40 AS model_predictions, CAST(0 AS BIGINT) AS fallback_predictions, "
    "CAST(0 AS BIGINT) AS targets_without_model, n AS written_rows FROM n"))
def run_metrics(spark, sf):
    """Run totals of the export of all scores, observed in the writing
    job, beside the rows that the files say they hold."""
    path, usage = scored_store(spark, sf)
    total = spark.read.parquet(usage).agg(
        F.max("n_rows").alias("total_rows"), F.sum(F.col("n_model") + F.col("n_fallback")).alias("total_predictions"),
        F.sum("n_model").alias("model_predictions"), F.sum("n_fallback").alias("fallback_predictions"),
        F.count_if(F.col("reason").isNotNull()).alias("targets_without_model"))
    return total.crossJoin(spark.read.parquet(path).agg(F.count("*").alias("written_rows")))  # a row each; counted from the files' footers


@register("prob_checks", Q.with_ctes(
    Q.rows_ctes(), "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_non_finite, CAST(0 AS BIGINT) AS n_bad_sum, target "
                   f"FROM rows, (VALUES {_names(CLASSES)}) AS t(target) GROUP BY target"))
def prob_checks(spark, sf):
    """Probabilities finite and summing to 1, every classifier on all
    rows, observed by the job that wrote the scores."""
    u = spark.read.parquet(scored_store(spark, sf)[1]).where(F.col("target").isin(CLASSES))
    return u.selectExpr("n_rows AS n", "n_non_finite", "n_bad_sum", "target")


@register("unseen_labels", Q.with_ctes(
    Q.labelled_ctes() + [("seen", "SELECT DISTINCT crop_suitability_maize AS c FROM labelled WHERE data_month <= 6")],
    "SELECT count(*) AS n_rows, count_if(crop_suitability_maize IN (SELECT c FROM seen WHERE c <> 'good')) AS n_known FROM labelled"))
def unseen_labels(spark, sf):
    """Rows whose label an encoder of the first half-year without
    'good' knows (the class list is read from the data: a few values)."""
    # read three times: written once, two columns
    lab = materialize(labelled_rows(spark, sf).select("data_month", "crop_suitability_maize"), "maize")
    seen = [r[0] for r in lab.where("data_month <= 6 AND crop_suitability_maize <> 'good'").select("crop_suitability_maize").distinct().collect()]
    known = ML.known_labels(lab, "crop_suitability_maize", seen)
    return lab.agg(F.count("*").alias("n_rows")).crossJoin(known.agg(F.count("*").alias("n_known")))
