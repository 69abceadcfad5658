"""Queries for the quality checks A11-A24 and the fingerprint A29.

y = rule target (L*), yhat = fallback estimate (E*) on the same rows: a real
disagreement without a trained model.  Split: grid_id % 5 = 0 is the test
split (plain arithmetic, repeatable in SQL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.constants import CLASS_TARGETS, FEATURES, NUMERIC_TARGETS, PHYSICAL_BOUNDS, STATIC_FEATURES, SUITABILITY_TARGETS
from agrolens.functions.fallback import FallbackText
from agrolens.operators import quality as QA
from agrolens.plans import oracle_rules
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import labelled_grids, labelled_months, labelled_rows, training_rows
from agrolens.plans.q_joins import contamination
from agrolens.plans.registry import ORACLE, dk_round, register, sp_round
from agrolens.plans.q_scoring import types_of
from agrolens.session import ensure_checkpoint_dir, materialize
from agrolens.sources import fixtures as FX

# four numeric targets have a level 0..2 as their fallback value; it counts as a number
NUM_EVAL = NUMERIC_TARGETS
SPLIT = "CASE WHEN grid_id % 5 = 0 THEN 'test' ELSE 'train' END"


def _yhat_col(t: str) -> str:
    return f"fbl_{t}" if t in SUITABILITY_TARGETS else f"fb_{t}"


# ------------------------------------------------------------------ scored tables (Spark)

def scored_base(spark, sf) -> DataFrame:
    """Labels and fallback estimates (a grid's, given to each of its months) side by side."""
    grid = labelled_grids(spark, sf)
    fx = FallbackText("spark", grid.columns, types_of(grid)).exprs()
    cols = [f"{v} AS fb_{t}" for t, (v, _) in fx.items()] + [f"{fx[t][1]} AS fbl_{t}" for t in SUITABILITY_TARGETS]
    return labelled_months(grid.selectExpr("*", *cols)).withColumn("split", F.expr(SPLIT))


def stacked_class(base: DataFrame) -> DataFrame:
    return base.selectExpr("sample_id", "split", QA.stack_expr({t: (t, _yhat_col(t)) for t in CLASS_TARGETS}, "STRING"))


def stacked_numeric(base: DataFrame) -> DataFrame:
    return base.selectExpr("sample_id", "split", QA.stack_expr({t: (t, f"fb_{t}") for t in NUM_EVAL}, "DOUBLE"))


def scored_class(spark, sf) -> DataFrame:
    return stacked_class(scored_base(spark, sf))


def scored_numeric(spark, sf) -> DataFrame:
    return stacked_numeric(scored_base(spark, sf))


def scored_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Class and numeric targets for several checks: the wide rows are written once, a reader takes
    them apart (written apart they are 40 rows for each)."""
    used = dict.fromkeys(["sample_id", "split", *CLASS_TARGETS, *map(_yhat_col, CLASS_TARGETS), *NUM_EVAL, *[f"fb_{t}" for t in NUM_EVAL]])
    base = materialize(scored_base(spark, sf).select(*used), "scored")
    return stacked_class(base), stacked_numeric(base)


# ------------------------------------------------------------------ scored tables (SQL)

_FBD = oracle_rules.fallback()
_SCORED_CTES = Q.labelled_ctes() + [
    ("fbk", "SELECT *, " + ", ".join(f"{v} AS fb_{t}" for t, (v, _) in _FBD.items()) + ", "
     + ", ".join(f"{_FBD[t][1]} AS fbl_{t}" for t in SUITABILITY_TARGETS) + " FROM labelled"),
    ("sc", " UNION ALL ".join(f"SELECT sample_id, {SPLIT} AS split, '{t}' AS target, CAST({t} AS VARCHAR) AS y, "
                              f"CAST({_yhat_col(t)} AS VARCHAR) AS yhat FROM fbk" for t in CLASS_TARGETS)),
    ("sn", " UNION ALL ".join(f"SELECT sample_id, {SPLIT} AS split, '{t}' AS target, CAST({t} AS DOUBLE) AS y, "
                              f"CAST(fb_{t} AS DOUBLE) AS yhat FROM fbk" for t in NUM_EVAL)),
]


def shown(c: str, spark: bool) -> str:
    """Presentation of a float: 9 decimals, from 1 upwards 7 significant digits (magnitudes: always)."""
    sig = f"CAST(format_string('%.6e', {c}) AS DOUBLE)" if spark else f"CAST(printf('%.6e', {c}) AS DOUBLE)"
    sig = f"CASE WHEN {c} IS NULL THEN NULL ELSE {sig} END"
    return sig if c in _MAGNITUDES else f"CASE WHEN abs({c}) >= 1 THEN {sig} ELSE {sp_round(c) if spark else dk_round(c)} END"


def _pres(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.selectExpr(*[f"{shown(c, True)} AS {c}" if c in _FLOATS else c for c in cols])


_MAGNITUDES = {"mae", "rmse", "residual_std", "target_std"}
_FLOATS = {"precision", "recall", "f1", "accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted",
           "mae", "rmse", "r2", "mean_bias", "residual_mean", "residual_std", "r", "pct_violations",
           "baseline_accuracy", "model_accuracy", "lift", "target_std", "hetero_corr", "score_train", "score_test",
           "gap", "y_true_min", "y_true_max", "y_pred_min", "y_pred_max", "pred_min", "pred_max"}


def _dk(cols: list[str]) -> str:
    return ", ".join(f"{shown(c, False)} AS {c}" if c in _FLOATS else c for c in cols)


# ------------------------------------------------------------------ A11 / A12 / A21

_CS_CTES = [
    ("conf", "SELECT target, y, yhat, count(*) AS n FROM sc GROUP BY target, y, yhat"),
    ("sup", "SELECT target, y AS class, sum(n) AS support FROM conf GROUP BY target, y"),
    ("prd", "SELECT target, yhat AS class, sum(n) AS predicted FROM conf GROUP BY target, yhat"),
    ("tpt", "SELECT target, y AS class, n AS tp FROM conf WHERE y = yhat"),
    ("cs0", "SELECT coalesce(s.target, p.target) AS target, coalesce(s.class, p.class) AS class, "
            "CAST(coalesce(t.tp, 0) AS BIGINT) AS tp, CAST(coalesce(s.support, 0) AS BIGINT) AS support, "
            "CAST(coalesce(p.predicted, 0) AS BIGINT) AS predicted FROM sup s FULL OUTER JOIN prd p "
            "ON s.target = p.target AND s.class = p.class LEFT JOIN tpt t "
            "ON t.target = coalesce(s.target, p.target) AND t.class = coalesce(s.class, p.class)"),
    ("cs", "SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
           "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, "
           "CASE WHEN 2 * tp + (predicted - tp) + (support - tp) > 0 "
           "THEN 2 * tp / (2 * tp + (predicted - tp) + (support - tp)) ELSE 0.0 END AS f1 FROM cs0")]

REPORT_COLS = ["target", "class", "tp", "support", "predicted", "precision", "recall", "f1"]
METRIC_COLS = ["target", "n_samples", "accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]


@register("confusion", Q.with_ctes(_SCORED_CTES, "SELECT target, y, yhat, count(*) AS n FROM sc "
                                                 "GROUP BY target, y, yhat"))
def confusion(spark, sf):
    """A11 base: confusion counts per class target (partial-aggregated)."""
    return QA.confusion(scored_class(spark, sf))


@register("clf_report", Q.with_ctes(_SCORED_CTES + _CS_CTES, f"SELECT {_dk(REPORT_COLS)} FROM cs"))
def clf_report(spark, sf):
    """Per-class precision/recall/F1/support."""
    return _pres(QA.class_stats(QA.confusion(scored_class(spark, sf))), REPORT_COLS)


@register("clf_metrics", Q.with_ctes(
    _SCORED_CTES + _CS_CTES + [
        ("m", "SELECT target, CAST(sum(support) AS BIGINT) AS n_samples, sum(tp) / sum(support) AS accuracy, "
              "avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro, "
              "sum(f1 * support) / sum(support) AS f1_weighted FROM cs GROUP BY target")],
    f"SELECT {_dk(METRIC_COLS)} FROM m"))
def clf_metrics(spark, sf):
    """Accuracy, macro P/R/F1, weighted F1 (zero_division = 0)."""
    st = QA.class_stats(QA.confusion(scored_class(spark, sf)))
    return _pres(QA.clf_metrics(st), METRIC_COLS)


@register("class_collapse", Q.with_ctes(
    _SCORED_CTES + [("sc_test", "SELECT * FROM sc WHERE split = 'test'")]
    + [(n, t.replace("FROM sc GROUP", "FROM sc_test GROUP")) for n, t in _CS_CTES[:1]] + _CS_CTES[1:],
    "SELECT target, class, recall = 0 AS zero_recall, precision = 0 AS zero_precision FROM cs "
    "WHERE recall = 0 OR precision = 0"))
def class_collapse(spark, sf):
    """Classes with zero recall or zero precision on the test split."""
    st = QA.class_stats(QA.confusion(scored_class(spark, sf).where("split = 'test'")))
    return st.where("recall = 0 OR precision = 0").selectExpr(
        "target", "class", "recall = 0 AS zero_recall", "precision = 0 AS zero_precision")


# ------------------------------------------------------------------ A13 / A14

REG_COLS = ["target", "n_samples", "mae", "rmse", "r2", "mean_bias"]


@register("reg_metrics", Q.with_ctes(
    _SCORED_CTES + [
        ("m", "SELECT target, count(*) AS n_samples, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, "
              "CASE WHEN var_pop(y) > 0 THEN 1.0 - avg((yhat - y) * (yhat - y)) / var_pop(y) "
              "WHEN max(abs(yhat - y)) = 0 THEN 1.0 ELSE 0.0 END AS r2, avg(yhat - y) AS mean_bias "
              "FROM sn WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY target")],
    f"SELECT {_dk(REG_COLS)} FROM m"))
def reg_metrics(spark, sf):
    """MAE, RMSE, R2, mean bias."""
    return _pres(QA.reg_metrics(scored_numeric(spark, sf)), REG_COLS)


RES_COLS = ["target", "residual_mean", "residual_std", "y_true_min", "y_true_max", "y_pred_min", "y_pred_max"]


@register("residuals", Q.with_ctes(
    _SCORED_CTES + [
        ("m", "SELECT target, avg(y - yhat) AS residual_mean, stddev_pop(y - yhat) AS residual_std, "
              "min(y) AS y_true_min, max(y) AS y_true_max, min(yhat) AS y_pred_min, max(yhat) AS y_pred_max "
              "FROM sn GROUP BY target")],
    f"SELECT {_dk(RES_COLS)} FROM m"))
def residuals(spark, sf):
    """Residual summary (population std)."""
    return _pres(QA.residual_summary(scored_numeric(spark, sf)), RES_COLS)


# ------------------------------------------------------------------ A15 / A16

CORR_TARGETS = NUMERIC_TARGETS + CLASS_TARGETS


def _corr_sql() -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
    # class targets count by the place of their class in code point order
    coded = ", ".join([f"CAST({t} AS DOUBLE) AS y_{t}" for t in NUMERIC_TARGETS]
                      + [f"CAST(dense_rank() OVER (ORDER BY CAST({t} AS VARCHAR)) - 1 AS DOUBLE) AS y_{t}" for t in CLASS_TARGETS])
    aggs = ", ".join(f"covar_pop(x, y_{t}) AS cov_{t}, stddev_pop(y_{t}) AS sd_{t}" for t in CORR_TARGETS)
    unions = " UNION ALL ".join(
        f"SELECT '{t}' AS target, feature, n_valid, CASE WHEN sd_x * sd_{t} = 0 THEN NULL "
        f"ELSE cov_{t} / (sd_x * sd_{t}) END AS r FROM g" for t in CORR_TARGETS)
    return Q.with_ctes(
        Q.labelled_ctes() + [
            ("fx", f"SELECT {coded}, {casts} FROM labelled"),
            ("lg", f"UNPIVOT fx ON {', '.join(FEATURES)} INTO NAME feature VALUE x"),
            ("g", f"SELECT feature, count(*) AS n_valid, stddev_pop(x) AS sd_x, {aggs} FROM lg "
                  "WHERE NOT isnan(x) GROUP BY feature"),
            ("c", unions)],
        f"SELECT target, feature, n_valid, {dk_round('r', 7)} AS r, target = feature AS target_in_features, "
        "(target = feature OR coalesce(abs(r) >= 0.999 AND n_valid > 10, false)) AS leakage FROM c")


@register("feature_target_corr", _corr_sql())
def feature_target_corr(spark, sf):
    """Feature-target Pearson r of all 40 targets with the leakage flags."""
    rows = QA.encode_classes(labelled_rows(spark, sf), CLASS_TARGETS)
    out = QA.feature_target_corr(rows, FEATURES, CORR_TARGETS)
    return out.selectExpr("target", "feature", "n_valid", f"{sp_round('r', 7)} AS r", "target_in_features", "leakage")


@register("zero_variance", Q.with_ctes(
    Q.rows_ctes(), " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, "
        f"(min(CAST({c} AS DOUBLE)) = max(CAST({c} AS DOUBLE)) AND count({c}) > 1) AS zero_variance FROM rows"
        for c in FEATURES)))
def zero_variance(spark, sf):
    """Constant features."""
    return QA.zero_variance(training_rows(spark, sf), FEATURES)


# ------------------------------------------------------------------ A17 / A19 / A20 / A22

BOUND_COLS = ["target", "n", "n_violations", "pct_violations", "pred_min", "pred_max"]
_BVALUES = ", ".join(f"('{t}', {lo!r}, {hi!r})" for t, (lo, hi) in PHYSICAL_BOUNDS.items())


@register("bounds", Q.with_ctes(
    _SCORED_CTES + [("b", f"SELECT * FROM (VALUES {_BVALUES}) AS t(target, lo, hi)"),
                    ("m", "SELECT s.target, count(*) AS n, count_if(yhat < lo OR yhat > hi) AS n_violations, "
                          "count_if(yhat < lo OR yhat > hi) * 100.0 / count(*) AS pct_violations, "
                          "min(yhat) AS pred_min, max(yhat) AS pred_max FROM sn s JOIN b ON s.target = b.target "
                          "GROUP BY s.target")],
    f"SELECT {_dk(BOUND_COLS)} FROM m"))
def bounds(spark, sf):
    """Predictions outside physical bounds."""
    return _pres(QA.bounds_check(scored_numeric(spark, sf), PHYSICAL_BOUNDS), BOUND_COLS)


LIFT_COLS = ["target", "majority_class", "n_test", "baseline_accuracy", "model_accuracy", "lift", "no_lift"]


@register("majority_lift", Q.with_ctes(
    _SCORED_CTES + [
        ("tc", "SELECT target, y, count(*) AS c FROM sc WHERE split = 'train' GROUP BY target, y"),
        ("mj", "SELECT target, y AS majority_class FROM (SELECT *, row_number() OVER (PARTITION BY target "
               "ORDER BY c DESC, y) AS rn FROM tc) AS t WHERE rn = 1"),
        ("m", "SELECT s.target, mj.majority_class, count(*) AS n_test, "
              "count_if(s.y = mj.majority_class) / count(*) AS baseline_accuracy, "
              "count_if(s.y = s.yhat) / count(*) AS model_accuracy, count(DISTINCT s.y) AS k "
              "FROM sc s JOIN mj ON s.target = mj.target WHERE split = 'test' GROUP BY s.target, mj.majority_class"),
        ("m2", "SELECT *, model_accuracy - baseline_accuracy AS lift, "
               "(model_accuracy - baseline_accuracy <= 0.01 AND k > 1) AS no_lift FROM m")],
    f"SELECT {_dk(LIFT_COLS)} FROM m2"))
def majority_lift(spark, sf):
    """Lift over the majority-class baseline."""
    return _pres(QA.majority_lift(scored_class(spark, sf)), LIFT_COLS)


BIAS_COLS = ["target", "n", "mean_bias", "rmse", "target_std", "n_outliers", "hetero_corr", "biased", "outliers",
             "heteroscedastic"]


@register("bias_checks", Q.with_ctes(
    _SCORED_CTES + [
        ("t", "SELECT * FROM sn WHERE split = 'test'"),
        ("m", "SELECT target, count(*) AS n, avg(yhat - y) AS mean_bias, "
              "sqrt(avg((yhat - y) * (yhat - y))) AS rmse, stddev_pop(y) AS target_std, "
              "CASE WHEN stddev_pop(abs(yhat)) * stddev_pop(abs(yhat - y)) = 0 THEN NULL "
              "ELSE covar_pop(abs(yhat), abs(yhat - y)) / (stddev_pop(abs(yhat)) * stddev_pop(abs(yhat - y))) END "
              "AS hetero_corr FROM t GROUP BY target"),
        ("c", "SELECT t.target, count_if(abs(yhat - y) > 3 * rmse) AS n_outliers FROM t JOIN m "
              "ON t.target = m.target GROUP BY t.target"),
        ("r", "SELECT m.target, n, mean_bias, rmse, target_std, n_outliers, hetero_corr, "
              "(target_std > 1e-6 AND abs(mean_bias) / target_std > 0.05) AS biased, "
              "(n_outliers * 100.0 / n > 1.0) AS outliers, "
              "coalesce(n > 10 AND hetero_corr > 0.4, false) AS heteroscedastic FROM m JOIN c ON m.target = c.target")],
    f"SELECT {_dk(BIAS_COLS)} FROM r"))
def bias_checks(spark, sf):
    """Bias, outlier and heteroscedasticity checks on the test split."""
    return _pres(QA.bias_checks(scored_numeric(spark, sf)), BIAS_COLS)


GAP_COLS = ["target", "kind", "score_train", "score_test", "gap", "overfit_status"]


@register("generalisation_gap", Q.with_ctes(
    _SCORED_CTES + [
        ("acc", "SELECT target, split, count_if(y = yhat) / count(*) AS score FROM sc GROUP BY target, split"),
        ("r2", "SELECT target, split, CASE WHEN var_pop(y) > 0 THEN 1.0 - avg((yhat - y) * (yhat - y)) / var_pop(y) "
               "WHEN max(abs(yhat - y)) = 0 THEN 1.0 ELSE 0.0 END AS score FROM sn "
               "WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY target, split"),
        ("both_kinds", "SELECT *, 'classification' AS kind FROM acc UNION ALL SELECT *, 'regression' AS kind FROM r2"),
        ("p", "SELECT target, kind, max(CASE WHEN split = 'train' THEN score END) AS score_train, "
              "max(CASE WHEN split = 'test' THEN score END) AS score_test FROM both_kinds GROUP BY target, kind"),
        ("g", "SELECT *, score_train - score_test AS gap, CASE WHEN score_train - score_test > "
              "(CASE WHEN kind = 'classification' THEN 0.05 ELSE 0.08 END) THEN 'overfit' "
              "WHEN score_test < (CASE WHEN kind = 'classification' THEN 0.8 ELSE 0.7 END) THEN 'underfit' "
              "ELSE 'ok' END AS overfit_status FROM p")],
    f"SELECT {_dk(GAP_COLS)} FROM g"))
def generalisation_gap(spark, sf):
    """train/test score gap."""
    return _pres(QA.generalisation_gap(scored_class(spark, sf), scored_numeric(spark, sf)), GAP_COLS)


# ------------------------------------------------------------------ A23 / A24 / A29

@register("health_rollup")  # oracle below
def health_rollup(spark, sf):
    """Union of the checks -> per target status and issue list."""
    return QA.health_rollup(*_issues(spark, sf))


def _issues(spark, sf):
    """(target, issue) of all checks, and the targets."""
    # the scored tables feed seven checks: materialise them once (reliable
    # checkpoint in the shared folder) instead of re-planning the labels 7x
    ensure_checkpoint_dir(spark)
    sc, sn = scored_tables(spark, sf)
    bias = materialize(QA.bias_checks(sn), "bias_checks")
    st = QA.class_stats(QA.confusion(sc.where("split = 'test'")))
    issues = [
        st.where("recall = 0 OR precision = 0").select("target").distinct()
        .withColumn("issue", F.lit("MINORITY CLASS COLLAPSE")),
        QA.majority_lift(sc).where("no_lift").select("target").withColumn("issue", F.lit("NO LIFT OVER MAJORITY BASELINE")),
        QA.bounds_check(sn, PHYSICAL_BOUNDS).where("n_violations > 0").select("target")
        .withColumn("issue", F.lit("BOUNDARY VIOLATIONS")),
        bias.where("biased").select("target").withColumn("issue", F.lit("SYSTEMATIC PREDICTION BIAS")),
        bias.where("outliers").select("target").withColumn("issue", F.lit("HIGH OUTLIER ERRORS")),
        bias.where("heteroscedastic").select("target").withColumn("issue", F.lit("HETEROSCEDASTICITY")),
        QA.generalisation_gap(sc, sn).where("overfit_status <> 'ok'").selectExpr(
            "target", "CASE WHEN overfit_status = 'overfit' THEN 'OVERFITTING DETECTED' "
                      "ELSE 'UNDERFITTING / LOW CAPACITY' END AS issue"),
        feature_target_corr(spark, sf).where("leakage").select("target").distinct()
        .withColumn("issue", F.lit("TARGET LEAKAGE SUSPECTED")),
        contamination(spark, sf).where("contaminated").select(F.explode(F.array(*map(F.lit, CLASS_TARGETS + NUM_EVAL))).alias("target"))
        .withColumn("issue", F.lit("DATA CONTAMINATION")),
    ]
    allissues = issues[0]
    for x in issues[1:]:
        allissues = allissues.unionByName(x)
    return allissues, spark.createDataFrame([(t,) for t in CLASS_TARGETS + NUM_EVAL], "target string")


def _rollup_sql() -> str:
    """The checks' own oracles as subqueries, joined by hand."""
    of = {n: f"({ORACLE[n]}) AS {n}" for n in ("class_collapse", "majority_lift", "bounds", "bias_checks", "generalisation_gap",
                                              "feature_target_corr", "contamination")}
    targets = ", ".join(f"('{t}')" for t in CLASS_TARGETS + NUM_EVAL)
    return f"""
WITH tg AS (SELECT * FROM (VALUES {targets}) AS t(target)),
bc AS (SELECT * FROM {of['bias_checks']}),
iss AS (SELECT DISTINCT target, 'MINORITY CLASS COLLAPSE' AS issue FROM {of['class_collapse']}
 UNION SELECT target, 'NO LIFT OVER MAJORITY BASELINE' FROM {of['majority_lift']} WHERE no_lift
 UNION SELECT target, 'BOUNDARY VIOLATIONS' FROM {of['bounds']} WHERE n_violations > 0
 UNION SELECT target, 'SYSTEMATIC PREDICTION BIAS' FROM bc WHERE biased
 UNION SELECT target, 'HIGH OUTLIER ERRORS' FROM bc WHERE outliers
 UNION SELECT target, 'HETEROSCEDASTICITY' FROM bc WHERE heteroscedastic
 UNION SELECT target, CASE overfit_status WHEN 'overfit' THEN 'OVERFITTING DETECTED' ELSE 'UNDERFITTING / LOW CAPACITY' END
  FROM {of['generalisation_gap']} WHERE overfit_status <> 'ok'
 UNION SELECT target, 'TARGET LEAKAGE SUSPECTED' FROM {of['feature_target_corr']} WHERE leakage
 UNION SELECT target, 'DATA CONTAMINATION' FROM tg WHERE (SELECT max(contaminated) FROM {of['contamination']}))
SELECT tg.target, count(issue) AS issues_count, coalesce(string_agg(issue, ' | ' ORDER BY issue), '') AS issues,
 CASE WHEN count(issue) > 0 THEN 'flagged' ELSE 'healthy' END AS overall_status
FROM tg LEFT JOIN iss ON tg.target = iss.target GROUP BY tg.target"""


ORACLE["health_rollup"] = _rollup_sql()


@register("health_summary", f"""
WITH r AS ({_rollup_sql()}), names AS (SELECT DISTINCT unnest(string_split(issues, ' | ')) AS issue FROM r WHERE issues <> '')
SELECT 'target' AS scope, target, issues_count, issues, CAST(issues_count = 0 AS BIGINT) AS n_healthy, CAST(issues_count > 0 AS BIGINT) AS n_flagged FROM r
UNION ALL SELECT 'overall', NULL, CAST(sum(issues_count) AS BIGINT), (SELECT coalesce(string_agg(issue, ' | ' ORDER BY issue), '') FROM names),
 CAST(sum(CASE WHEN issues_count = 0 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN issues_count > 0 THEN 1 ELSE 0 END) AS BIGINT) FROM r""")
def health_summary(spark, sf):
    """Healthy and flagged targets, per target and overall, in one aggregate."""
    return QA.health_summary(*_issues(spark, sf))


@register("locator_check", Q.with_ctes(
    Q.rows_ctes(),
    "SELECT count(*) AS n_rows, count_if(NOT (latitude BETWEEN 9.0 AND 29.0)) AS lat_out_of_bounds, "
    "count_if(NOT (longitude BETWEEN 92.0 AND 102.0)) AS lon_out_of_bounds, "
    "(SELECT count(*) FROM (SELECT sample_id FROM rows GROUP BY sample_id HAVING count(*) > 1) AS d) "
    "AS duplicate_keys FROM rows"))
def locator_check(spark, sf):
    """Key uniqueness and coordinate bounds."""
    return QA.locator_check(training_rows(spark, sf))


# the columns of both tables as (name, type): the statement below writes every value of every row
_GRID_TYPES = {"grid_id": "i", "system_index": "s", "region": "s"}
_OBS_TYPES = {"grid_id": "i", "system_index": "s", "year_month": "s", "sample_id": "s", "data_year": "i", "data_month": "i"}


def _value_sql(c: str, tag: str) -> str:
    """DuckDB text of one value: null, whole number, text with its length, or a double as mantissa and exponent."""
    if tag == "i":
        return f"coalesce('i' || CAST({c} AS VARCHAR), 'n')"
    if tag == "s":
        return f"coalesce('s' || CAST(length({c}) AS VARCHAR) || ':' || {c}, 'n')"
    x = f"(CASE WHEN {c} <> 0 AND isfinite(CAST({c} AS DOUBLE)) THEN abs(CAST({c} AS DOUBLE)) ELSE 1::DOUBLE END)"
    return (f"CASE WHEN {c} IS NULL THEN 'n' WHEN isnan(CAST({c} AS DOUBLE)) THEN 'dnan' "
            f"WHEN isinf(CAST({c} AS DOUBLE)) THEN CASE WHEN {c} < 0 THEN 'd-inf' ELSE 'dinf' END WHEN {c} = 0 THEN 'd0' "
            f"ELSE (SELECT CASE WHEN {c} < 0 THEN 'd-' ELSE 'd' END || CAST(CAST(CASE WHEN m < 1 THEN m * 2 WHEN m >= 2 THEN m / 2 ELSE m END "
            f"* 4503599627370496 AS BIGINT) AS VARCHAR) || 'p' || CAST(CASE WHEN m < 1 THEN e - 1 WHEN m >= 2 THEN e + 1 ELSE e END AS VARCHAR) "
            f"FROM (SELECT e, {x} / pow(2::DOUBLE, e) AS m FROM (SELECT CAST(floor(log2({x})) AS INTEGER) AS e) AS a) AS b) END")


def _print_sql(table: str, columns: list[str], types: dict[str, str], by: str) -> str:
    row = " || '|' || ".join(f"'{c}=' || {_value_sql(c, types.get(c, 'd'))}" for c in sorted(columns, key=lambda c: c not in types))
    return (f"SELECT '{table}' AS source, CAST({by} AS VARCHAR) AS part, count(*) AS n_rows, "
            f"CAST(sum(CAST(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS content_hash FROM {table} GROUP BY {by}")


_GRID_COLUMNS = ["grid_id", "system_index", "region", "latitude", "longitude", *STATIC_FEATURES]
_OBS_COLUMNS = ["grid_id", "system_index", "year_month", "sample_id", "data_year", "data_month", "chirps_precipitation_mm", "mean_temperature_c",
                "solar_radiation_mj_m2_day", "era5_soil_moisture_m3_m3", "ndvi_median", "ndwi_mcf_median", "s1_vh_db_median", "s1_vv_db_median"]


@register("fingerprint", Q.with_ctes(
    [("grid_static", None), ("obs", None), ("obs_month", None),
     ("fp_grid", f"SELECT {', '.join(c if c in _GRID_TYPES else f'CAST({c} AS DOUBLE) AS {c}' for c in _GRID_COLUMNS)} FROM grid_static"),
     ("fp_obs", f"SELECT {', '.join(c if c in _OBS_TYPES else f'CAST({c} AS DOUBLE) AS {c}' for c in _OBS_COLUMNS)} FROM obs_month")],
    _print_sql("fp_grid", _GRID_COLUMNS, _GRID_TYPES, "region") + " UNION ALL " + _print_sql("fp_obs", _OBS_COLUMNS, _OBS_TYPES, "data_year")))
def fingerprint(spark, sf):
    """Rows and an order-free hash of the content of every column, of the
    grid per region and of the monthly readings per year."""
    def shown(df, columns, types, name, by):
        typed = df.select(*[F.col(c) if c in types else F.col(c).cast("double").alias(c) for c in columns])
        return QA.content_fingerprint(typed, [by]).select(F.lit(name).alias("source"), F.col(by).cast("string").alias("part"), "n_rows", "content_hash")
    return shown(FX.grid_static(spark, sf), _GRID_COLUMNS, _GRID_TYPES, "fp_grid", "region").unionByName(
        shown(FX.obs_month(spark, sf), _OBS_COLUMNS, _OBS_TYPES, "fp_obs", "data_year"))
