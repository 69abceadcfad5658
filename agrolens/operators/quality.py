"""Model and data quality checks (A11-A24) on long "scored" tables.

Inputs are long tables built with one ``stack`` projection (no shuffle):
class targets as ``(target, split, y, yhat)`` strings, numeric targets as
``(target, split, y, yhat)`` doubles.  Every metric is an aggregate grouped by
target (partial aggregation; the confusion table is tiny), so a target that
owns most rows never gathers them in one task.  Means and variances are the
built-in double moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolens.constants import (BIAS_RATIO, HETERO_CORR, LAT_BOUNDS, LEAKAGE_CORR, LEAKAGE_MIN_PAIRS,
                                LON_BOUNDS, LOW_SCORE_CLF, LOW_SCORE_REG, MAJORITY_LIFT_MIN,
                                OUTLIER_SHARE, OVERFIT_GAP_CLF, OVERFIT_GAP_REG)
from agrolens.session import materialize


def stack_expr(pairs: dict[str, tuple[str, str]], cast: str) -> str:
    """stack(n, 'target', CAST(y), CAST(yhat), ...) AS (target, y, yhat)."""
    parts = ", ".join(f"'{t}', CAST({y} AS {cast}), CAST({yh} AS {cast})" for t, (y, yh) in pairs.items())
    return f"stack({len(pairs)}, {parts}) AS (target, y, yhat)"


# ----------------------------------------------------------------- A11/A12

def confusion(scored: DataFrame, keys=("target",)) -> DataFrame:
    return scored.groupBy(*keys, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))


def class_stats(conf: DataFrame, keys=("target",)) -> DataFrame:
    """Per (target, class) over the classes seen in y or yhat: tp, support,
    predicted, precision/recall/f1 with zero_division = 0."""
    k = list(keys)
    # each confusion cell counts once as "true class y" and once as "predicted
    # class yhat": one explode + one groupBy, the confusion table is read once
    roles = conf.select(*k, F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("yhat").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("r"))
    s = roles.groupBy(*k, "r.class").agg(F.sum("r.tp").alias("tp"), F.sum("r.support").alias("support"),
                                          F.sum("r.predicted").alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    den = 2 * F.col("tp") + (F.col("predicted") - F.col("tp")) + (F.col("support") - F.col("tp"))
    f1 = F.when(den > 0, 2 * F.col("tp") / den).otherwise(F.lit(0.0))
    return s.select(*k, "class", "tp", "support", "predicted", prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"))


def clf_metrics(stats: DataFrame, keys=("target",)) -> DataFrame:
    """Accuracy, macro precision/recall/F1, weighted F1."""
    k = list(keys)
    return stats.groupBy(*k).agg(
        F.sum("support").alias("n_samples"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


# ----------------------------------------------------------------- A13/A14

def reg_metrics(scored: DataFrame, keys=("target",)) -> DataFrame:
    """MAE, RMSE, R2, mean bias (yhat - y) over the rows that have both
    values.  R2 = 1 - MSE / population variance of y; a constant y gives 1
    where every error is 0, else 0.  Built-in double moments in one pass, so
    errors of any size count."""
    k = list(keys)
    err = F.col("yhat") - F.col("y")
    agg = scored.where("y IS NOT NULL AND yhat IS NOT NULL").groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("_mse"),
        F.var_pop("y").alias("_var"), F.avg(err).alias("mean_bias"))
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.col("_mse") / F.col("_var")) \
        .otherwise(F.when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(*k, "n_samples", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"), "mean_bias")


def residual_summary(scored: DataFrame, keys=("target",)) -> DataFrame:
    """residual = y - yhat; mean, population std, min/max of y and yhat."""
    k = list(keys)
    return scored.groupBy(*k).agg(
        F.avg(F.col("y") - F.col("yhat")).alias("residual_mean"),
        F.stddev_pop(F.col("y") - F.col("yhat")).alias("residual_std"),
        F.min("y").alias("y_true_min"), F.max("y").alias("y_true_max"),
        F.min("yhat").alias("y_pred_min"), F.max("yhat").alias("y_pred_max"))


# ----------------------------------------------------------------- A15/A16

def encode_classes(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Class targets as codes 0, 1, ... by the code point order of their
    classes (null stays null).  The class lists are read in one aggregation;
    a class target has a handful of classes."""
    one = rows.agg(*[F.sort_array(F.collect_set(F.col(t).cast("string"))).alias(t) for t in targets]).first()
    code = {t: F.expr("CASE " + " ".join(f"WHEN CAST({t} AS STRING) = '{c}' THEN {i}D" for i, c in enumerate(one[t])) + " END")
            for t in targets if one[t]}
    return rows.withColumns(code)


_MOMENTS = {"nx": "long", "mx": "double", "sxx": "double", "x_low": "double", "x_high": "double"}
_PAIR_MOMENTS = {"n": "long", "m_x": "double", "m_y": "double", "sxy": "double", "syy": "double", "y_low": "double", "y_high": "double"}


def _task_moments(features: list[str], targets: list[str], one: list[str], pair: list[str]):
    """Turns the Arrow batches of a task into its moments: a row per feature, with arrays over the targets.

    Sums are of differences from means, batches are merged by their means'
    distance; least and largest values tell a constant column from rounding.
    """
    def moments(batches):
        import numpy as np
        import pyarrow as pa

        def of_targets(y, there):
            n = there.sum(axis=0).astype(float)
            mean = np.where(there, y, 0).sum(axis=0) / np.maximum(n, 1)
            dy = np.where(there, y - mean, 0)
            return n, mean, dy, (dy * dy).sum(axis=0), np.where(there, y, np.inf).min(axis=0), np.where(there, y, -np.inf).max(axis=0)

        def merged(p, q):
            """Of (n, mean a, mean b, sum of products): two sets of rows as one."""
            n = p[0] + q[0]
            of = np.maximum(n, 1)
            da, db = q[1] - p[1], q[2] - p[2]
            return n, p[1] + da * (q[0] / of), p[2] + db * (q[0] / of), p[3] + q[3] + da * db * (p[0] * q[0] / of)

        size = (len(features), len(targets))
        xx, xy, yy = [tuple(np.zeros(k) for _ in range(4)) for k in (size[0], size, size)]
        x_low, x_high, y_low, y_high = [np.full(k, v) for k in (size[0], size) for v in (np.inf, -np.inf)]
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            y = np.column_stack([at[f"y_{t}"].to_numpy(zero_copy_only=False) for t in targets])
            there = np.column_stack([at[f"y_{t}"].is_valid().to_numpy(zero_copy_only=False) for t in targets])
            whole = of_targets(y, there)
            nx, mx, sxx = (np.zeros(size[0]) for _ in range(3))
            n, m_x, m_y, sxy, syy = (np.zeros(size) for _ in range(5))
            for i, f in enumerate(features):
                x = at[f"x_{f}"].to_numpy(zero_copy_only=False)
                rows = ~np.isnan(x)  # null or NaN: no pair
                if not rows.any():
                    continue
                full = rows.all()
                x, w = (x, there) if full else (x[rows], there[rows])
                n[i], m_y[i], dy, syy[i], low, high = whole if full else of_targets(y[rows], w)
                nx[i], mx[i] = len(x), x.mean()
                dx = x - mx[i]
                sxx[i], sxy[i] = dx @ dx, dx @ dy  # dy sums to nothing: any centre of x serves
                m_x[i] = mx[i] + (dx @ w) / np.maximum(n[i], 1)
                x_low[i], x_high[i] = min(x_low[i], x.min()), max(x_high[i], x.max())
                y_low[i], y_high[i] = np.minimum(y_low[i], low), np.maximum(y_high[i], high)
            xx, xy, yy = merged(xx, (nx, mx, mx, sxx)), merged(xy, (n, m_x, m_y, sxy)), merged(yy, (n, m_y, m_y, syy))
        seen = np.flatnonzero(xx[0])
        if len(seen):
            cols = [xx[0].astype(int), xx[1], xx[3], x_low, x_high, xy[0].astype(int), xy[1], xy[2], xy[3], yy[3], y_low, y_high]
            yield pa.RecordBatch.from_arrays([pa.array([features[i] for i in seen]), *[pa.array(c[seen].tolist()) for c in cols]], names=["feature", *one, *pair])
    return moments


def feature_target_corr(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Pearson r of every feature with every target over rows where both
    are present; r is covar_pop / (sd_x * sd_y) with a zero guard (a constant
    column has no r).  Each task multiplies its batches' matrices of features
    and targets; only a task's moments, a row per feature with an array over
    the targets, are shuffled and merged."""
    wide = rows.select(*[F.col(c).cast("double").alias(f"x_{c}") for c in features], *[F.col(c).cast("double").alias(f"y_{c}") for c in targets])
    schema = ", ".join(["feature string", *[f"{c} {k}" for c, k in _MOMENTS.items()], *[f"{c} array<{k}>" for c, k in _PAIR_MOMENTS.items()]])
    parts = wide.mapInArrow(_task_moments(features, targets, [*_MOMENTS], [*_PAIR_MOMENTS]), schema)
    pairs = parts.select("feature", *_MOMENTS, F.explode(F.arrays_zip(F.array(*map(F.lit, targets)).alias("target"), *_PAIR_MOMENTS)).alias("p")) \
        .select("feature", *_MOMENTS, "p.*")
    by = Window.partitionBy("target", "feature")  # a row per task
    off = lambda mean, n: F.col(mean) - F.try_divide(F.sum(F.col(n) * F.col(mean)).over(by), F.sum(n).over(by))
    pairs = pairs.withColumns({"dx": off("mx", "nx"), "d_x": off("m_x", "n"), "d_y": off("m_y", "n")})

    def spread(within: str, n: str, d: str, low: str, high: str) -> Column:
        constant = (F.min(low) == F.max(high)) & (F.abs(F.min(low)) < float("inf"))
        return F.when(constant, 0.0).otherwise(F.sqrt(F.try_divide(F.sum(F.col(within) + F.col(n) * F.col(d) * F.col(d)), F.sum(n))))

    out = pairs.groupBy("target", "feature").agg(
        F.sum("nx").alias("n_valid"), F.try_divide(F.sum(F.col("sxy") + F.col("n") * F.col("d_x") * F.col("d_y")), F.sum("n")).alias("cov"),
        spread("sxx", "nx", "dx", "x_low", "x_high").alias("sd_x"), spread("syy", "n", "d_y", "y_low", "y_high").alias("sd_y"))
    out = out.select("target", "feature", "n_valid", F.try_divide("cov", F.col("sd_x") * F.col("sd_y")).alias("r"))
    near = F.coalesce((F.abs("r") >= LEAKAGE_CORR) & (F.col("n_valid") > LEAKAGE_MIN_PAIRS), F.lit(False))
    own = F.col("target") == F.col("feature")  # the target itself among the features
    return out.withColumn("target_in_features", own).withColumn("leakage", own | near)


def zero_variance(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features whose non-null values are all equal (count > 1)."""
    aggs = []
    for c in features:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.min(x).alias(f"{c}__lo"), F.max(x).alias(f"{c}__hi")]
    one = rows.agg(*aggs)
    t = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__n").alias("n"),
                 ((F.col(f"{c}__lo") == F.col(f"{c}__hi")) & (F.col(f"{c}__n") > 1)).alias("zero_variance"))
        for c in features])).alias("z"))
    return t.select("z.*")


# ----------------------------------------------------------------- A17-A22

def bounds_check(scored: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Predictions outside physical bounds per target."""
    b = scored.sparkSession.createDataFrame([(t, float(lo), float(hi)) for t, (lo, hi) in bounds.items()],
                                            "target string, lo double, hi double")
    j = scored.join(F.broadcast(b), on="target")  # fixed-size table (15 rows)
    bad = (F.col("yhat") < F.col("lo")) | (F.col("yhat") > F.col("hi"))
    return j.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_violations"),
        (F.count_if(bad) * 100.0 / F.count(F.lit(1))).alias("pct_violations"),
        F.min("yhat").alias("pred_min"), F.max("yhat").alias("pred_max"))


def majority_lift(scored: DataFrame) -> DataFrame:
    """Majority class of y on the train split (ties -> smallest class),
    its accuracy on the test split vs the predictions' accuracy there.  One
    pass: counts per (target, class), then per target from that small table."""
    test = F.col("split") == "test"
    per = scored.groupBy("target", "y").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(test).alias("test"),
        F.count_if(test & (F.col("y") == F.col("yhat"))).alias("hits"))
    first = F.struct(-F.col("train"), F.col("y"))
    out = per.groupBy("target").agg(
        F.min_by(F.when(F.col("train") > 0, F.col("y")), first).alias("majority_class"), F.sum("test").alias("n_test"),
        (F.min_by("test", first) / F.sum("test")).alias("baseline_accuracy"), (F.sum("hits") / F.sum("test")).alias("model_accuracy"),
        F.count_if((F.col("test") > 0) & F.col("y").isNotNull()).alias("_k")).where("n_test > 0 AND majority_class IS NOT NULL")
    lift = F.col("model_accuracy") - F.col("baseline_accuracy")
    return out.select("target", "majority_class", "n_test", "baseline_accuracy", "model_accuracy",
                      lift.alias("lift"), ((lift <= MAJORITY_LIFT_MIN) & (F.col("_k") > 1)).alias("no_lift"))


def bias_checks(scored: DataFrame) -> DataFrame:
    """A20 on the test split: systematic bias, >3*RMSE outliers, and
    correlation of |yhat| with |yhat - y| (two passes: moments, then counts)."""
    # two passes read the rows: they are written once, narrow
    t = materialize(scored.where(F.col("split") == "test").select("target", "y", "yhat"), "bias-rows")
    m = t.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("yhat") - F.col("y")).alias("mean_bias"),
        F.sqrt(F.avg((F.col("yhat") - F.col("y")) * (F.col("yhat") - F.col("y")))).alias("rmse"),
        F.stddev_pop("y").alias("target_std"),
        F.try_divide(F.covar_pop(F.abs("yhat"), F.abs(F.col("yhat") - F.col("y"))),
                     F.stddev_pop(F.abs("yhat")) * F.stddev_pop(F.abs(F.col("yhat") - F.col("y")))).alias("hetero_corr"))
    j = t.join(F.broadcast(m.select("target", "rmse")), on="target")  # one row per target
    c = j.groupBy("target").agg(
        F.count_if(F.abs(F.col("yhat") - F.col("y")) > 3 * F.col("rmse")).alias("n_outliers"))
    r = m.join(F.broadcast(c), on="target")
    ratio = F.try_divide(F.abs("mean_bias"), F.col("target_std"))
    share = F.col("n_outliers") * 100.0 / F.col("n")
    return r.select(
        "target", "n", "mean_bias", "rmse", "target_std", "n_outliers", "hetero_corr",
        ((F.col("target_std") > 1e-6) & (ratio > BIAS_RATIO)).alias("biased"),
        (share > OUTLIER_SHARE * 100).alias("outliers"),
        F.coalesce((F.col("n") > 10) & (F.col("hetero_corr") > HETERO_CORR), F.lit(False)).alias("heteroscedastic"))


def generalisation_gap(scored_cls: DataFrame, scored_num: DataFrame) -> DataFrame:
    """Train vs test score (accuracy / R2) and the gap flags."""
    acc = scored_cls.groupBy("target", "split").agg(
        (F.count_if(F.col("y") == F.col("yhat")) / F.count(F.lit(1))).alias("score"))
    r2 = reg_metrics(scored_num, keys=("target", "split")).select("target", "split", F.col("r2").alias("score"))
    both = (acc.withColumn("kind", F.lit("classification"))
            .unionByName(r2.withColumn("kind", F.lit("regression"))))
    p = both.groupBy("target", "kind").agg(
        F.max(F.when(F.col("split") == "train", F.col("score"))).alias("score_train"),
        F.max(F.when(F.col("split") == "test", F.col("score"))).alias("score_test"))
    gap = F.col("score_train") - F.col("score_test")
    thr = F.when(F.col("kind") == "classification", F.lit(OVERFIT_GAP_CLF)).otherwise(F.lit(OVERFIT_GAP_REG))
    low = F.when(F.col("kind") == "classification", F.lit(LOW_SCORE_CLF)).otherwise(F.lit(LOW_SCORE_REG))
    return p.select("target", "kind", "score_train", "score_test", gap.alias("gap"),
                    F.when(gap > thr, F.lit("overfit")).when(F.col("score_test") < low, F.lit("underfit"))
                    .otherwise(F.lit("ok")).alias("overfit_status"))


# ----------------------------------------------------------------- A23/A24

def health_rollup(issues: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target the number of issues and their names (sorted, ' | ')."""
    per = issues.groupBy("target").agg(F.count(F.lit(1)).alias("issues_count"),
                                       F.concat_ws(" | ", F.array_sort(F.collect_set("issue"))).alias("issues"))
    out = targets.join(per, on="target", how="left").fillna({"issues_count": 0, "issues": ""})
    return out.withColumn("overall_status", F.when(F.col("issues_count") > 0, "flagged").otherwise("healthy"))


def health_summary(issues: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target and overall (target null), in one aggregate over grouping sets: issues, their
    names, and how many targets are healthy or flagged."""
    table = targets.join(issues.select("target", "issue").distinct(), on="target", how="left")
    flagged = F.count_distinct(F.when(F.col("issue").isNotNull(), F.col("target")))
    out = table.rollup("target").agg(
        F.grouping("target").alias("level"), F.count("issue").alias("issues_count"),
        F.concat_ws(" | ", F.array_sort(F.collect_set("issue"))).alias("issues"),
        F.count_distinct("target").alias("n_targets"), flagged.alias("n_flagged"))
    return out.select(F.when(F.col("level") == 1, "overall").otherwise("target").alias("scope"), "target", "issues_count", "issues",
                      (F.col("n_targets") - F.col("n_flagged")).alias("n_healthy"), "n_flagged")


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def encoded_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the text ``_row`` that writes all columns of a row by name, type tag and exact content.

    Whole numbers, text with its length and booleans come first, then doubles as
    sign, mantissa and exponent of two (so the bits decide, not the printing);
    null is ``n``.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    doubles = [c for c, t in types.items() if t in ("double", "float")]

    def text(c: str, kind: str) -> str:
        if kind in _WHOLE:
            return f"concat('i', CAST(`{c}` AS STRING))"
        if kind == "boolean":
            return f"CASE WHEN `{c}` THEN 'b1' ELSE 'b0' END"
        return f"concat('s', CAST(length(CAST(`{c}` AS STRING)) AS STRING), ':', CAST(`{c}` AS STRING))"
    parts = [f"concat('{c}=', coalesce({text(c, t)}, 'n'))" for c, t in types.items() if c not in doubles]
    if doubles:
        # one lambda for all of them; the exponent by logarithm may be one off, the mantissa says so
        by = lambda step, times: f"concat(CAST(CAST(m * {times}D AS BIGINT) AS STRING), 'p', CAST(e + {step} AS STRING))"
        bits = f"CASE WHEN m < 1 THEN {by(-1, 2 ** 53)} WHEN m >= 2 THEN {by(1, 2 ** 51)} ELSE {by(0, 2 ** 52)} END"
        inner = f"transform(array(abs(x) / power(2D, e div 2) / power(2D, e - e div 2)), m -> {bits})[0]"
        exact = f"transform(array(CAST(floor(log2(abs(x))) AS INT)), e -> {inner})[0]"
        value = ("CASE WHEN x IS NULL THEN 'n' WHEN isnan(x) THEN 'dnan' WHEN x = 0 THEN 'd0' WHEN abs(x) = CAST('Infinity' AS DOUBLE) THEN "
                 f"CASE WHEN x < 0 THEN 'd-inf' ELSE 'dinf' END ELSE concat(CASE WHEN x < 0 THEN 'd-' ELSE 'd' END, {exact}) END")
        names, values = (", ".join(f(c) for c in doubles) for f in (lambda c: f"'{c}='", lambda c: f"CAST(`{c}` AS DOUBLE)"))
        parts.append(f"array_join(transform(array({values}), (x, i) -> concat(element_at(array({names}), i + 1), {value})), '|')")
    return df.selectExpr(*[f"`{c}`" for c in keep], f"concat_ws('|', {', '.join(parts)}) AS _row")


def content_fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows and an order-free hash of the content of all columns, per group of ``by``.

    A row's hash is the first 60 bits of the md5 of its columns' names, types
    and exact values; the group's is the sum of these (repeated rows do not
    cancel), as decimal text.  -0.0 counts as 0.
    """
    h = "CAST(CAST(conv(substring(md5(CAST(_row AS BINARY)), 1, 15), 16, 10) AS BIGINT) AS DECIMAL(38,0))"
    out = encoded_rows(df, by or []).selectExpr(*[f"`{c}`" for c in by or []], f"{h} AS _h").groupBy(*(by or []))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_h").cast("string").alias("content_hash"))


def locator_check(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Key uniqueness and coordinate bounds (one row)."""
    dups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(
        F.count(F.lit(1)).alias("duplicate_keys"))
    b = rows.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(~F.col("latitude").between(*LAT_BOUNDS)).alias("lat_out_of_bounds"),
                 F.count_if(~F.col("longitude").between(*LON_BOUNDS)).alias("lon_out_of_bounds"))
    return b.crossJoin(dups)
