"""Spark ML training, evaluation and scoring.

Random forests from ``pyspark.ml`` replace the reference's scikit-learn
models: the same hyper-parameters, not the same trees (compare metrics, not
predictions).  The assembled feature vector is built once and written to the
shared folder; the per-target loop is bounded and runs a few distributed fits
at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrolens.constants import FEATURE_WEIGHTS, IMPORTANCE_TIERS, MIN_TRAIN_ROWS, TARGET_METADATA
from agrolens.operators import quality as QA
from agrolens.operators.features import exact_avg_sql
from agrolens.session import materialize, put_file, release, scratch_path
from agrolens.sources import files as IO

# hyper-parameter profiles: full = reference production, quick = its quick mode,
# screen = a fifth of its trees, for cross-validating all targets
PROFILES = {"full": {"numTrees": 500, "maxDepth": 12, "minInstancesPerNode": 3},
            "quick": {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 5},
            "screen": {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 5}}
#: Rows of a fitted sample that make a task.
POOL_ROWS = 2_500
#: Labelled rows that concurrent fits may hold together: a fit keeps some 1.5 KB a row until it ends.
ROWS_AT_ONCE = 1_000_000
CV_FOLDS = 5
_HASH_BITS = 63


# ---------------------------------------------------------------- M01

def sample_weight_exprs(df: DataFrame, features: list[str]) -> tuple[list[str], str]:
    """Aggregates (min/max per boosted feature) and the weight expression.
    Features with weight <= 1, absent, or constant contribute nothing."""
    boosted = [(c, fw) for c, fw in FEATURE_WEIGHTS.items() if c in features and fw > 1.0]
    aggs = []
    for c, _ in boosted:
        x = f"coalesce(nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE)), 0.0)"
        aggs += [f"min({x}) AS _mn_{c}", f"max({x}) AS _mx_{c}"]
    w = "CAST(1.0 AS DOUBLE)"
    for c, fw in boosted:
        x = f"coalesce(nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE)), 0.0)"
        rng = f"(_mx_{c} - _mn_{c})"
        w = (f"({w} + CASE WHEN {rng} > 0 THEN (({x} - _mn_{c}) / {rng}) * CAST({fw - 1.0!r} AS DOUBLE) "
             f"ELSE 0.0 END)")
    return aggs, w


def sample_weights(df: DataFrame, features: list[str], out: str = "sample_weight") -> DataFrame:
    """M01 + W08: w = 1 + sum(minmax(x) * (fw - 1)), divided by its mean,
    clipped to [0.5, 3].  Two one-row aggregates joined back by broadcast
    (one row: a proven size bound)."""
    aggs, w = sample_weight_exprs(df, features)
    mm = df.agg(*[F.expr(a) for a in aggs]) if aggs else None
    base = df.crossJoin(F.broadcast(mm)) if mm is not None else df
    raw = base.selectExpr("*", f"{w} AS _w")
    mean = raw.agg(F.expr(exact_avg_sql("_w")).alias("_wmean"))
    res = raw.crossJoin(F.broadcast(mean)).withColumn(
        out, F.least(F.greatest(F.col("_w") / F.col("_wmean"), F.lit(0.5)), F.lit(3.0)))
    return res.drop("_w", "_wmean", *[c for c in res.columns if c.startswith("_mn_") or c.startswith("_mx_")])


# ---------------------------------------------------------------- M02 / M03 / M04

def label_indexer(target: str, out: str = "label") -> StringIndexer:
    """Alphabetical codes, as LabelEncoder (codes are not ordinal)."""
    return StringIndexer(inputCol=target, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="skip")


def key_hash(key: str, seed: int = 42) -> Column:
    """Seeded hash of the key, 0 .. 2**63 - 1: the order of every split."""
    return F.xxhash64(F.col(key).cast("string"), F.lit(seed)).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))


def stratified_cuts(df: DataFrame, strata: dict[str, str], key: str, fractions: tuple[float, ...], seed: int = 42) -> dict:
    """Places in the hash order that part every stratum exactly.

    ``strata``: name -> SQL expression of the stratum (null: no part of it).
    Returns {name: {stratum: [(hash, key) of the last row of each fraction]}},
    the fraction f of n rows being their first floor(f * n + 0.5).  Counts per
    slice of the hash range (4096 slices, partially aggregated) tell the slice
    that holds each place; only that slice's rows are numbered, so no stratum
    is sorted whole.  The result has one entry per stratum: few classes each.
    """
    spark, names = df.sparkSession, list(strata)
    u = key_hash(key, seed)
    rows = df.withColumn("_slice", F.shiftright(u, _HASH_BITS - 12))
    of_row = F.explode(F.array(*[F.struct(F.lit(i).alias("name"), F.expr(f"CAST({strata[n]} AS STRING)").alias("c")) for i, n in enumerate(names)])).alias("s")
    by = Window.partitionBy("name", "c")
    hist = rows.select("_slice", of_row).select("s.*", F.col("_slice").alias("slice")).where("c IS NOT NULL").groupBy("name", "c", "slice").agg(F.count("*").alias("n"))
    hist = hist.withColumn("all", F.sum("n").over(by)).withColumn(
        "before", F.coalesce(F.sum("n").over(by.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = hist.select("*", F.posexplode(F.array(*map(F.lit, fractions))).alias("i", "f")).withColumn(
        "place", F.floor(F.col("f") * F.col("all") + 0.5)).where("before < place AND place <= before + n")
    places = places.select("name", "c", "slice", "i", (F.col("place") - F.col("before")).alias("rank"))
    places = spark.createDataFrame(places.collect(), places.schema)  # classes x fractions rows, counted once for both joins
    # rows of other slices leave before they are taken apart
    some = rows.join(F.broadcast(places.select(F.col("slice").alias("_slice")).distinct()), "_slice", "left_semi").select(
        F.col(key).cast("string").alias("k"), u.alias("u"), "_slice", of_row).select("k", "u", "s.*", F.col("_slice").alias("slice"))
    inside = some.join(F.broadcast(places.select("name", "c", "slice").distinct()), ["name", "c", "slice"])
    inside = inside.withColumn("rank", F.row_number().over(Window.partitionBy("name", "c", "slice").orderBy("u", "k")))
    found = inside.join(F.broadcast(places), ["name", "c", "slice", "rank"]).select("name", "c", "i", "u", "k").collect()
    cuts: dict = {n: {} for n in strata}
    for r in found:
        cuts[names[r["name"]]].setdefault(r["c"], [None] * len(fractions))[r["i"]] = (r["u"], r["k"])
    return cuts


def part_expr(cuts: dict, stratum: str, key: str, seed: int = 42) -> Column:
    """Number of the part (0, 1, ...) of each row by ``stratified_cuts`` of one name; null without stratum."""
    u, k, c = key_hash(key, seed), F.col(key).cast("string"), F.expr(f"CAST({stratum} AS STRING)")
    out = F.lit(None).cast("int")
    for value, places in cuts.items():
        part = F.lit(0)
        for at in places:
            if at is not None:
                part = part + ((u > at[0]) | ((u == at[0]) & (k > F.lit(at[1])))).cast("int")
            # a fraction without a row: its part is empty and every row is beyond it
            else:
                part = part + F.lit(1)
        out = F.when(c == F.lit(value), part).otherwise(out)
    return out


def stratum_of(target: str) -> str:
    """Class targets are split by class, numeric ones as a whole."""
    return target if TARGET_METADATA[target]["task_type"] == "classification" else f"CASE WHEN {target} IS NOT NULL THEN 'all' END"


def with_test_flags(df: DataFrame, targets: list[str], key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact stratified split of every target at once: boolean columns
    ``test_<target>`` (null where the target is null), a projection only."""
    cuts = stratified_cuts(df, {t: stratum_of(t) for t in targets}, key, (test_fraction,), seed)
    return df.withColumns({f"test_{t}": part_expr(cuts[t], stratum_of(t), key, seed) == 0 for t in targets})


def known_labels(df: DataFrame, target: str, classes: list[str]) -> DataFrame:
    """Rows whose label the encoder knows."""
    return df.where(F.col(target).cast("string").isin(list(classes)))


def class_weights(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Balanced weights n / (k * n_c) (k classes) as a small table."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(tot)).withColumn(
        out, F.col("n") / (F.col("k") * F.col("n_class")))


# ---------------------------------------------------------------- M05-M08

def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Vector of the features (VectorAssembler rejects NULL: impute first)."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def train_classifier(train: DataFrame, target: str, profile: str = "quick", weight_col: str | None = None,
                     seed: int = 42) -> PipelineModel:
    """Indexer + random forest (sqrt feature subsets).  The node that a row has reached in
    each tree is kept between the levels, so no level walks the trees from their roots."""
    p = PROFILES[profile]
    extra = {"weightCol": weight_col} if weight_col else {}
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", predictionCol="prediction",
                                featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, **extra, **p)
    return _plain(Pipeline(stages=[label_indexer(target), rf]).fit(train))


def train_regressor(train: DataFrame, target: str, profile: str = "quick", weight_col: str | None = None,
                    seed: int = 42) -> PipelineModel:
    """Random forest regressor (sqrt feature subsets)."""
    p = PROFILES[profile]
    extra = {"weightCol": weight_col} if weight_col else {}
    rf = RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="prediction",
                               featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, **extra, **p)
    return _plain(Pipeline(stages=[rf]).fit(train))


def _plain(model: PipelineModel) -> PipelineModel:
    """The model without its training summary, which holds on to the session and its tables and would
    travel to the tasks with the forest."""
    return PipelineModel([*model.stages[:-1], model.stages[-1].copy()])


def decode(model: PipelineModel, scored: DataFrame, target: str) -> DataFrame:
    """Class label, probability map and confidence = max probability."""
    labels = model.stages[0].labels
    out = IndexToString(inputCol="prediction", outputCol=f"{target}_pred", labels=labels).transform(scored)
    probs = vector_to_array("probability")
    return out.withColumns({
        "probabilities": F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probs),
        "confidence": F.array_max(probs)})


def importance(model: PipelineModel, features: list[str], k: int | None = 5):
    """Feature importances joined to names (a 75-row table)."""
    rf = model.stages[-1]
    imp = rf.featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda x: -x[1])
    return rows[:k] if k else rows


def probability_checks(scored: DataFrame) -> DataFrame:
    """NaN/inf probabilities and rows whose probabilities do not sum to 1."""
    p = vector_to_array("probability")
    s = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    bad = F.exists(p, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_non_finite"),
                      F.count_if(F.abs(s - 1.0) > 1e-3).alias("n_bad_sum"))


def enough_rows(n: int) -> bool:
    """A target is trained only with at least 50 labelled rows."""
    return n >= MIN_TRAIN_ROWS


# ---------------------------------------------------------------- M09 / P12 / P23

def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


METRICS = ("type string, n_train long, n_fit long, n_test long, accuracy double, f1_macro double, f1_weighted double, cv_mean double, "
           "cv_std double, cv_scores array<double>, mae double, rmse double, r2 double, residual_mean double, residual_std double, "
           "y_test_min double, y_test_max double, y_pred_min double, y_pred_max double, top5_features array<string>")
#: One record for each target that a run has finished, in ``<out_dir>/ledger/<target>.json``.
RECORD = (f"target string, status string, detail string, model string, metrics struct<{METRICS.replace(' ', ':').replace(',:', ',')}>, "
          "importance array<struct<rank:int,feature:string,importance:double>>")


@dataclass
class Prepared:
    """One table for all fits of a run.

    ``rows``: key, features, sample_weight, the targets (classes as strings) and
    ``part_<target>``: the exact stratified fifth of each row (null without a
    value).  Part 0 is the held-out test split; the parts are the folds of the
    cross-validation.  ``pool``: the rows that any target's forests are fitted
    on, with ``fit_<target>``: all that have a value, unless a sample was asked
    for.  ``held``: the rows that any target tests on.  ``present``: labelled
    rows by target.
    """
    rows: DataFrame
    pool: DataFrame
    held: DataFrame
    present: dict[str, int]


def prepare(data: DataFrame, targets: list[str], key: str, fit_rows: int | None = None) -> Prepared:
    """Writes the tables of ``Prepared`` to the shared folder: a few passes for all targets together.

    A training split is fitted on whole; a caller may ask for a sample of about
    ``fit_rows`` of its rows, picked by a second hash of the key.  Every row is
    evaluated and scored.
    """
    text = [t for t in targets if TARGET_METADATA[t]["task_type"] == "classification"]
    data = data.withColumns({t: F.col(t).cast("string") for t in text})
    cuts = stratified_cuts(data, {t: stratum_of(t) for t in targets}, key, tuple(i / CV_FOLDS for i in range(1, CV_FOLDS)))
    rows = data.select(key, "features", "sample_weight", *targets,
                       *[part_expr(cuts[t], stratum_of(t), key).cast("tinyint").alias(f"part_{t}") for t in targets])
    rows = materialize(rows, "training")
    present = rows.agg(*[F.count(f"part_{t}").alias(t) for t in targets]).first().asDict()
    place = key_hash(key, 43)
    most = {t: (1 << _HASH_BITS) if fit_rows is None else min(1 << _HASH_BITS, int((1 << _HASH_BITS) * fit_rows * CV_FOLDS / ((CV_FOLDS - 1) * max(n, 1))))
            for t, n in present.items()}
    chosen = {f"fit_{t}": F.col(f"part_{t}").isNotNull() & ((place < m) if m < 1 << _HASH_BITS else F.lit(True)) for t, m in most.items()}
    any_of = lambda conditions: reduce(lambda x, y: x | y, conditions)
    pool = rows.withColumns(chosen).where(any_of([F.col(c) for c in chosen]))
    if fit_rows is not None:  # a level of a forest is a job: not one with a task for each file of the table
        pool = materialize(pool.repartition(-(-fit_rows // POOL_ROWS)), "fit-pool")
    held = rows.where(any_of([F.col(f"part_{t}") == 0 for t in targets]))
    return Prepared(rows, pool, materialize(held, "held-out"), present)


def _fit(train: DataFrame, target: str, profile: str) -> PipelineModel:
    """Sample weights, for classes times the balanced class weight."""
    if TARGET_METADATA[target]["task_type"] != "classification":
        return train_regressor(train, target, profile, "sample_weight")
    weight = {r["class"]: r["class_weight"] for r in class_weights(train, target).collect()}  # one row per class
    balanced = F.expr("CASE " + " ".join(f"WHEN {target} = '{c}' THEN {w!r}D" for c, w in weight.items()) + " END")
    return train_classifier(train.withColumn("_fit_weight", F.col("sample_weight") * balanced), target, profile, "_fit_weight")


def _predicted(model: PipelineModel, rows: DataFrame, target: str, fold: int) -> DataFrame:
    """(fold, y, yhat) of the rows; labels that the model does not know are left out."""
    classes = TARGET_METADATA[target]["task_type"] == "classification"
    if classes:
        rows = known_labels(rows, target, model.stages[0].labels)
    trees = forest_arrays(rows.sparkSession, {target: model}) if hasattr(model, "path") else {}
    if trees:
        p = with_votes(rows.select("features", target), trees)
        yhat = F.element_at(F.array(*map(F.lit, model.stages[0].labels)), F.array_position(f"v_{target}", F.array_max(f"v_{target}")).cast("int")) \
            if classes else F.col(f"v_{target}")  # ties: the first class, as in the model
    elif classes:
        p = decode(model, model.transform(rows), target)
        yhat = F.col(f"{target}_pred")
    else:
        p, yhat = model.transform(rows), F.col("prediction")
    y = F.col(target) if classes else F.col(target).cast("double")
    return p.select(F.lit(fold).alias("fold"), y.alias("y"), yhat.alias("yhat"))


def train_target(made: Prepared, target: str, features: list[str], profile: str = "quick", cv: bool = False,
                 path: str | None = None) -> tuple[PipelineModel, dict, list]:
    """Model, metrics and importances of one target; the model is saved to ``path`` before it is tested.

    The model is fitted without part 0 and tested on it.  With ``cv`` one more
    model is fitted without each other part, and every part is scored by the
    model that has not seen it (M07): fold scores are macro F1 of a class
    target, R2 of a numeric one.  All folds are evaluated in one job.
    """
    part = F.col(f"part_{target}")
    pool = made.pool.where(f"fit_{target}").select("features", "sample_weight", target, part.alias("part"))
    models = [_fit(pool.where(F.col("part") != k), target, profile) for k in range(CV_FOLDS if cv else 1)]
    if path:
        models[0].write().overwrite().save(path)
        models[0].path = path
    rows = (made.rows if cv else made.held).select("features", target, part.alias("part"))
    pairs = reduce(DataFrame.unionByName, [_predicted(m, rows.where(F.col("part") == k), target, k) for k, m in enumerate(models)])
    pairs = materialize(pairs, "pairs")  # several aggregates read what the forests give once
    size = pool.groupBy("part").count().collect()
    imp = importance(models[0], features, None)
    n_fit = sum(r["count"] for r in size if r["part"])
    out = {"type": TARGET_METADATA[target]["task_type"], "n_fit": n_fit, "top5_features": [f for f, _ in imp[:5]]}
    if out["type"] == "classification":
        found = {r["fold"]: r for r in QA.clf_metrics(QA.class_stats(QA.confusion(pairs, ["fold"]), ["fold"]), ["fold"]).collect()}
        score, m = "f1_macro", found[0]
        out |= {"n_test": m["n_samples"], **{c: m[c] for c in ("accuracy", "f1_macro", "f1_weighted")}}
    else:
        both = QA.reg_metrics(pairs, ["fold"]).join(QA.residual_summary(pairs.where("fold = 0"), ["fold"]), "fold", "left")
        found = {r["fold"]: r for r in both.collect()}
        score, m = "r2", found[0]
        out |= {"n_test": m["n_samples"], **{c: m[c] for c in ("mae", "rmse", "r2", "residual_mean", "residual_std", "y_pred_min", "y_pred_max")},
                "y_test_min": m["y_true_min"], "y_test_max": m["y_true_max"]}
    release(pairs)
    out["n_train"] = made.present[target] - out["n_test"]
    if cv:
        scores = [found[k][score] for k in range(CV_FOLDS)]
        mean = sum(scores) / len(scores)
        out |= {"cv_scores": scores, "cv_mean": mean, "cv_std": (sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5}
    return models[0], out, imp


def ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    """The records of all targets that runs over ``out_dir`` have finished (``RECORD``)."""
    return spark.read.schema(RECORD).json(f"{out_dir}/ledger") if _exists(spark, f"{out_dir}/ledger") else spark.createDataFrame([], RECORD)


def metrics_table(records: DataFrame) -> DataFrame:
    """A row of metrics for each target of the ledger."""
    return records.select("target", "status", "detail", "metrics.*")


def importance_table(records: DataFrame) -> DataFrame:
    """(target, rank, feature, importance) of every trained target."""
    return records.select("target", F.explode("importance").alias("i")).select("target", "i.*")


def export_tables(spark: SparkSession, out_dir: str, path: str) -> None:
    """Metrics and importances of the ledger as published tables ``<path>/metrics`` and ``<path>/importance``, with CSV copies."""
    records = ledger(spark, out_dir)
    flat = metrics_table(records)
    flat = flat.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("top5_features", "cv_scores")})
    IO.publish(flat, f"{path}/metrics", csv_copy=True, sort_by=["target"])
    IO.publish(importance_table(records), f"{path}/importance", csv_copy=True, sort_by=["target", "rank"])


def train_all(spark: SparkSession, data: DataFrame, targets: list[str], out_dir: str, key: str, features: list[str],
              profile: str = "quick", fit_rows: int | None = None, cv: bool | None = None, at_once: int = 4) -> list[str]:
    """Train, evaluate and save every pending target, up to ``at_once`` at a time (fewer, down to
    one, as the fitted rows become more: ``ROWS_AT_ONCE``).

    A target's model goes to ``<out_dir>/models/<target>/<run>``; then one small
    file ``<out_dir>/ledger/<target>.json`` commits model path, metrics and
    importances together.  A driver lost in between leaves every committed
    target as it is; the next call fits the others only.

    * P23: targets that the ledger has as trained or skipped are skipped;
    * P12: rows with a NULL target are dropped; targets with < 50 rows skipped;
    * a failing target is recorded, does not stop the others, and is tried again by the next call;
    * cross-validation runs with the full profile unless ``cv`` says otherwise.
    The loop is bounded by the number of targets (40); every fit is a
    distributed Spark ML job, in a scheduler pool of its target's name where the
    session schedules fairly.  Returns the targets trained in this call, in order.
    """
    from agrolens.operators.catalog_ops import pending_targets

    wanted = pending_targets(spark, targets, ledger(spark, out_dir).where("status <> 'failed'"))
    if not wanted:
        return []
    cv = profile == "full" if cv is None else cv
    made = prepare(data, wanted, key, fit_rows)
    run = uuid.uuid4().hex[:12]

    def one(t: str) -> bool:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", t)
        row = {"target": t, "status": "trained", "metrics": {"type": TARGET_METADATA[t]["task_type"]}}
        if not enough_rows(made.present[t]):
            row |= {"status": "skipped", "detail": f"{made.present[t]} rows"}
        else:
            try:
                model, row["metrics"], imp = train_target(made, t, features, profile, cv, f"{out_dir}/models/{t}/{run}")
                row["model"] = f"{out_dir}/models/{t}/{run}"
                row["importance"] = [{"rank": i + 1, "feature": f, "importance": float(v)} for i, (f, v) in enumerate(imp)]
            except Exception as e:  # noqa: BLE001 - isolate one target's failure
                row |= {"status": "failed", "detail": str(e)[:200]}
        put_file(spark, f"{out_dir}/ledger/{t}.json", json.dumps(row))
        return row["status"] == "trained"

    most = max(made.present.values())
    most = most if fit_rows is None else min(most, fit_rows)
    with ThreadPoolExecutor(max_workers=min(at_once, max(1, ROWS_AT_ONCE // max(most, 1)))) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), wanted))
    release(made.rows, made.held, *([] if fit_rows is None else [made.pool]))
    return [t for t, trained in zip(wanted, done, strict=True) if trained]


# ---------------------------------------------------------------- M10 / M11

def load_models(spark: SparkSession, out_dir: str, targets: list[str]) -> tuple[dict[str, PipelineModel], dict[str, str]]:
    """Saved models by target, and for the others the reason why there is none."""
    known = {r["target"]: r for r in ledger(spark, out_dir).select("target", "status", "detail", "model").collect()}  # a row per target

    def load(t: str) -> PipelineModel | str:
        r = known.get(t)
        if r is None or not r["model"]:
            return f"{r['status']}: {r['detail']}" if r else "not trained"
        try:
            model = PipelineModel.load(r["model"])
            model.path = r["model"]
            return model
        except Exception as e:  # noqa: BLE001 - a missing or broken model falls back
            return str(e).strip().splitlines()[0][:120]

    with ThreadPoolExecutor(max_workers=8) as pool:  # a model is read by a few small jobs
        found = dict(zip(targets, pool.map(inheritable_thread_target(spark)(load), targets), strict=True))
    models = {t: m for t, m in found.items() if not isinstance(m, str)}
    return models, {t: "Model not loaded: " + m for t, m in found.items() if isinstance(m, str)}


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over at least as many tasks as there are cores.

    4,000 trees a row cost far more than moving it; a large table has more
    partitions than cores and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def _shares(values: Column, total: Column) -> Column:
    return F.transform(values, lambda x: x / total)


def forest_arrays(spark: SparkSession, models: dict[str, PipelineModel]) -> dict[str, list[tuple]]:
    """The saved trees of each forest as arrays: per tree (depth, feature, threshold, first child, leaf values).

    Node 0 is the root and a right child follows its left one; a leaf is its
    own child below an infinite threshold.  Leaf values are the shares of the
    classes, or the prediction of a number.  All models are read in one job.
    Forests with categorical splits are left out.
    """
    data = {}
    for t, m in models.items():
        if not hasattr(m, "path"):
            m.path = scratch_path(spark, f"forest-{uuid.uuid4().hex[:12]}")
            m.write().save(m.path)
        data[f"{m.path}/stages/{len(m.stages) - 1}_{m.stages[-1].uid}/data"] = t
    # a run's folder and the stage name a model
    key = {tuple(p.split("/")[-4:-1]): t for p, t in data.items()}
    nodes = spark.read.parquet(*data).select(F.col("_metadata.file_path").alias("file"), "treeID", "nodeData.*").select(
        "file", "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("categories")).toArrow()
    file = nodes.column("file").combine_chunks().dictionary_encode()
    owner = np.array([list(data.values()).index(key[tuple(f.split("/")[-5:-2])]) for f in file.dictionary.to_pylist()])[file.indices.to_numpy()]
    out = {}
    for i, t in enumerate(data.values()):
        some = nodes.filter(pa.array(owner == i)).sort_by([("treeID", "ascending"), ("id", "ascending")]).combine_chunks()
        col = {c: some.column(c).to_numpy() for c in ("treeID", "prediction", "leftChild", "rightChild", "feature", "threshold", "categories")}
        if (col["categories"] >= 0).any():
            continue
        if len(models[t].stages) > 1:
            stats = some.column("impurityStats").combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1)
            total = np.zeros(len(stats))
            for c in range(stats.shape[1]):
                total += stats[:, c]
            values = np.divide(stats, total[:, None], out=np.zeros_like(stats), where=total[:, None] != 0)
        else:
            values = col["prediction"]
        ends = [*np.flatnonzero(np.diff(col["treeID"], prepend=-1)).tolist(), some.num_rows]
        out[t] = [_tree(*(col[c][a:z] for c in ("leftChild", "rightChild", "feature", "threshold")), values[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
    return out


def _tree(left: np.ndarray, right: np.ndarray, feature: np.ndarray, threshold: np.ndarray, values: np.ndarray) -> tuple:
    inner = np.flatnonzero(left >= 0)
    place = np.zeros(len(left), np.intp)
    place[left[inner]] = 1 + 2 * np.arange(len(inner))
    place[right[inner]] = 2 + 2 * np.arange(len(inner))
    at, first = np.zeros(len(left), np.intp), np.arange(len(left))
    limit, leaf = np.full(len(left), np.inf), np.empty_like(values)
    at[place[inner]], limit[place[inner]], first[place[inner]] = feature[inner], threshold[inner], place[left[inner]]
    leaf[place] = values
    depth, level = 0, np.zeros(1, np.intp)
    while len(level := level[first[level] != level]):
        level, depth = np.concatenate([first[level], first[level] + 1]), depth + 1
    return depth, at, limit, first, leaf


def with_votes(rows: DataFrame, forests: dict[str, list[tuple]], features: str = "features") -> DataFrame:
    """``rows`` with ``v_<target>``: a forest's votes of the classes (array) or its prediction of a number.

    The same sums in the same order as the model's own ``transform``.  A tree
    takes a block of rows down level by level: its nodes stay in the cache,
    where a row that meets 4,000 trees finds none of them there.
    """
    sent = rows.sparkSession.sparkContext.broadcast(forests)  # as large as the models
    kinds = {t: "array<double>" if trees[0][-1].ndim > 1 else "double" for t, trees in forests.items()}
    kept = [c for c in rows.columns if c != features]

    def run(batches: Iterator[pa.RecordBatch], block: int = 2048) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, block) for i in range(0, whole.num_rows, block)):
                n = b.num_rows
                x = b.column(features).flatten().to_numpy()
                width = len(x) // n
                x = np.where(np.isnan(x), np.inf, x)  # not below any threshold
                begin, out = np.arange(n) * width, []
                for trees in sent.value.values():
                    total = np.zeros((n, *trees[0][-1].shape[1:]))
                    for depth, at, limit, first, leaf in trees:
                        node = np.zeros(n, np.intp)
                        for _ in range(depth):
                            node = first.take(node) + (x.take(begin + at.take(node)) > limit.take(node))
                        total += leaf.take(node, axis=0)
                    if total.ndim > 1:
                        total = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * total.shape[1], pa.int32()), total.ravel())
                    else:
                        total = pa.array(total / len(trees))
                    out.append(total)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *out], [*kept, *(f"v_{t}" for t in kinds)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != features), *(f"v_{t} {k}" for t, k in kinds.items())])
    return rows.withColumn(features, vector_to_array(features)).mapInArrow(run, schema)


def score_targets(rows: DataFrame, models: dict[str, PipelineModel], reasons: dict[str, str], fallback: dict[str, tuple[str, str]],
                  keep: list[str]) -> DataFrame:
    """M10 + M11: every row scored for all targets of ``fallback`` in one chained pass.

    A target with a model gives its prediction (numbers as text), confidence
    (largest probability; null for numbers) and probability sum; one without
    gives the fallback estimate.  Columns: ``keep``, and per target a struct
    (value, label, confidence, probability_sum, is_fallback, reason).
    """
    fallen = {t: x for t, x in fallback.items() if t not in models}
    # only what the forests read goes through their projections
    d = rows.select(*keep, *(["features"] if models else []), *[
        F.struct(F.expr(f"CAST({value} AS STRING)").alias("value"), F.expr(f"CAST({label} AS STRING)").alias("label"),
                 F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("probability_sum"), F.lit(True).alias("is_fallback"),
                 F.lit(reasons.get(t)).cast("string").alias("reason")).alias(t) for t, (value, label) in fallen.items()])
    forests = forest_arrays(rows.sparkSession, models) if models else {}
    for t, m in models.items():
        if t in forests:
            continue
        rf = m.stages[-1].copy()
        if len(m.stages) > 1:  # the votes alone: one evaluation of the forest, the rest follows from them
            d = rf.setPredictionCol("").setProbabilityCol("").setRawPredictionCol(f"w_{t}").transform(d)
            d = d.withColumn(f"v_{t}", vector_to_array(f"w_{t}")).drop(f"w_{t}")
        else:
            d = rf.setPredictionCol(f"v_{t}").transform(d)
    if forests:
        d = with_votes(d, forests)
    out = [F.col(t) for t in fallen]
    for t in fallback:
        if t not in models:
            continue
        if len(models[t].stages) > 1:
            votes, q = F.col(f"v_{t}"), F.col(f"q_{t}")
            d = d.withColumn(f"n_{t}", F.aggregate(votes, F.lit(0.0), lambda a, b: a + b))
            d = d.withColumn(f"q_{t}", _shares(votes, F.col(f"n_{t}")))
            best = F.array_max(q)
            v = F.element_at(F.array(*map(F.lit, models[t].stages[0].labels)), F.array_position(q, best).cast("int"))  # ties: the first class, as in the model
            lab, conf, total = F.initcap(v), best, F.aggregate(q, F.lit(0.0), lambda a, b: a + b)
        else:
            v, conf, total = F.col(f"v_{t}").cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
            lab = F.format_string("%.2f", f"v_{t}")
        out.append(F.struct(v.alias("value"), lab.alias("label"), conf.alias("confidence"), total.alias("probability_sum"),
                            F.lit(False).alias("is_fallback"), F.lit(None).cast("string").alias("reason")).alias(t))
    order = {t: i for i, t in enumerate(fallback)}
    return d.select(*keep, *out).select(*keep, *sorted(order, key=order.get))


def usage_metrics(targets: list[str]) -> dict[str, Column]:
    """Per target the rows that a model or the fallback scored, missing values and bad
    probabilities, of ``score_targets``; to be observed by the job that writes the scores."""
    out = {"n_rows": F.count(F.lit(1))}
    for t in targets:
        total = F.col(f"{t}.probability_sum")
        out |= {f"model_{t}": F.count_if(~F.col(f"{t}.is_fallback")), f"fallback_{t}": F.count_if(f"{t}.is_fallback"),
                f"null_{t}": F.count_if(F.col(f"{t}.value").isNull()),
                f"infinite_{t}": F.count_if(F.isnan(total) | (F.abs(total) == F.lit(float("inf")))),
                f"sum_{t}": F.count_if(F.abs(total - 1) > 1e-3)}
    return out


def usage_rows(spark: SparkSession, seen: dict[str, int], targets: list[str], reasons: dict[str, str]) -> DataFrame:
    """A row for each target of what ``usage_metrics`` observed, with the reason for a fallback."""
    rows = [(t, seen["n_rows"], *[seen[f"{k}_{t}"] for k in ("model", "fallback", "null", "infinite", "sum")], reasons.get(t)) for t in targets]
    return spark.createDataFrame(rows, "target string, n_rows long, n_model long, n_fallback long, n_null long, n_non_finite long, n_bad_sum long, reason string")


def tier_targets(tiers: list[str]) -> list[str]:
    """Targets of the given importance tiers, in their order."""
    return [t for t, tier in IMPORTANCE_TIERS.items() if tier in tiers]
