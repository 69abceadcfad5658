"""The training loop: one commit per target, resumed after a break; folds; observed usage."""

import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from agrolens.constants import FEATURES, TARGETS
from agrolens.functions.fallback import FallbackText
from agrolens.operators import ml as ML
from agrolens.plans.q_ml import model_table
from agrolens.plans.q_scoring import types_of
from agrolens.session import materialize
from agrolens.sources import files as IO

ARGS = ("sample_id", FEATURES)


@pytest.fixture(scope="module")
def data(spark, sf):
    return materialize(model_table(spark, sf), "test-models")


@pytest.fixture(autouse=True)
def small_forests(monkeypatch):
    monkeypatch.setitem(ML.PROFILES, "quick", {"numTrees": 5, "maxDepth": 4, "minInstancesPerNode": 5})


def test_trains_saves_and_scores(spark, data, tmp_path):
    out = f"file:{tmp_path}/m"
    wanted = ["crop_health_score", "flood_risk_level"]
    assert ML.train_all(spark, data, wanted, out, *ARGS, fit_rows=500) == wanted
    assert ML.train_all(spark, data, [*wanted, "heat_stress_risk"], out, *ARGS, cv=True) == ["heat_stress_risk"]
    records = ML.ledger(spark, out)
    rows = {r["target"]: r for r in ML.metrics_table(records).collect()}
    assert {r["status"] for r in rows.values()} == {"trained"} and 300 < rows["crop_health_score"]["n_fit"] <= 700
    assert rows["heat_stress_risk"]["cv_mean"] is not None and rows["flood_risk_level"]["cv_mean"] is None
    assert ML.importance_table(records).count() == 3 * len(FEATURES)
    for r in rows.values():
        assert r["n_train"] + r["n_test"] == data.count() and abs(r["n_test"] - data.count() * 0.2) <= 2  # rounded per class
    models, reasons = ML.load_models(spark, out, TARGETS)
    assert set(models) == set(rows) and len(reasons) == 37
    fx = FallbackText("spark", data.columns, types_of(data)).exprs()
    scored = ML.score_targets(data, models, reasons, fx, ["sample_id"])
    assert scored.columns == ["sample_id", *fx]
    seen = IO.write_observed(scored, f"file:{tmp_path}/scores", ML.usage_metrics(TARGETS))
    back = spark.read.parquet(f"file:{tmp_path}/scores")
    assert back.count() == data.count() == seen["n_rows"]
    for t in TARGETS:  # what the job observed is what a second scan finds
        n = back.where(f"{t}.is_fallback").count() if t in list(TARGETS)[:3] + wanted else (0 if t in models else seen["n_rows"])
        assert seen[f"fallback_{t}"] == n and seen[f"model_{t}"] == seen["n_rows"] - n
    usage = {r["target"]: r for r in ML.usage_rows(spark, seen, TARGETS, reasons).collect()}
    assert usage["drought_risk_score"]["reason"] == "Model not loaded: not trained" and usage["flood_risk_level"]["reason"] is None
    r = back.where("flood_risk_level.confidence IS NOT NULL").first()["flood_risk_level"]
    assert not r["is_fallback"] and 0 < r["confidence"] <= 1 and abs(r["probability_sum"] - 1) < 1e-9
    # the decoded class and its probability are those of the pipeline itself
    own = ML.decode(models["flood_risk_level"], models["flood_risk_level"].stages[1].transform(data), "flood_risk_level").select(
        "sample_id", F.col("flood_risk_level_pred").alias("p"), F.col("confidence").alias("c"))
    both = back.select("sample_id", "flood_risk_level.*").join(own, "sample_id")
    assert both.where("value <> p OR abs(confidence - c) > 1e-12").count() == 0


def test_a_broken_run_repeats_no_committed_target(spark, data, tmp_path, monkeypatch):
    out = f"file:{tmp_path}/m"
    wanted = ["crop_health_score", "flood_risk_level", "drought_risk_score", "heat_stress_risk", "crop_yield_t_ha"]
    real, fitted = ML.train_target, []

    def until_the_third(made, target, *more):
        if len(fitted) == 3:
            raise KeyboardInterrupt  # the driver is lost
        fitted.append(target)
        return real(made, target, *more)
    monkeypatch.setattr(ML, "train_target", until_the_third)
    with pytest.raises(KeyboardInterrupt):
        ML.train_all(spark, data, wanted, out, *ARGS, fit_rows=300, at_once=1)
    kept = {r["target"]: r["model"] for r in ML.ledger(spark, out).collect()}
    assert set(kept) == set(fitted) == set(wanted[:3])
    monkeypatch.setattr(ML, "train_target", lambda made, target, *more: (fitted.append(target), real(made, target, *more))[1])
    assert ML.train_all(spark, data, wanted, out, *ARGS, fit_rows=300, at_once=2) == wanted[3:]
    assert sorted(fitted) == sorted(wanted)  # none twice
    now = {r["target"]: r["model"] for r in ML.ledger(spark, out).collect()}
    assert set(now) == set(wanted) and all(now[t] == m for t, m in kept.items())


def test_failed_and_small_targets(spark, data, tmp_path, monkeypatch):
    out = f"file:{tmp_path}/t"
    assert ML.train_all(spark, data.limit(10), ["drought_risk_score"], out, *ARGS) == []
    assert ML.ledger(spark, out).first()["status"] == "skipped"
    real = ML.train_target

    def broken(made, target, *more):
        if target == "crop_health_score":
            raise RuntimeError("no luck")
        return real(made, target, *more)
    monkeypatch.setattr(ML, "train_target", broken)
    assert ML.train_all(spark, data, ["crop_health_score", "flood_risk_level"], out, *ARGS, fit_rows=300) == ["flood_risk_level"]
    assert {r["target"]: r["status"] for r in ML.ledger(spark, out).collect()} == {
        "drought_risk_score": "skipped", "crop_health_score": "failed", "flood_risk_level": "trained"}
    monkeypatch.setattr(ML, "train_target", real)
    assert ML.train_all(spark, data, ["crop_health_score", "flood_risk_level"], out, *ARGS, fit_rows=300) == ["crop_health_score"]  # tried again
    files = [p.name for p in (tmp_path / "t" / "ledger").iterdir() if not p.name.startswith((".", "_"))]
    assert sorted(files) == ["crop_health_score.json", "drought_risk_score.json", "flood_risk_level.json"]
    assert json.loads((tmp_path / "t" / "ledger" / "flood_risk_level.json").read_text())["status"] == "trained"


def test_folds_are_exact_and_unseen(spark, data):
    made = ML.prepare(data, ["flood_risk_level", "crop_yield_t_ha"], "sample_id", fit_rows=None)
    for t in ("flood_risk_level", "crop_yield_t_ha"):
        stratum = t if t == "flood_risk_level" else "'all'"
        sizes = {}
        for r in made.rows.groupBy(F.expr(stratum).alias("s"), f"part_{t}").count().collect():
            sizes.setdefault(r["s"], {})[r[f"part_{t}"]] = r["count"]
        for parts in sizes.values():
            n = sum(parts.values())
            ends = [0, *[int(n * i / 5 + 0.5) for i in range(1, 5)], n]
            assert [parts.get(i, 0) for i in range(5)] == [b - a for a, b in zip(ends, ends[1:], strict=False)]
    assert made.pool.count() == made.rows.count()
    _, found, _ = ML.train_target(made, "crop_yield_t_ha", FEATURES, cv=True)
    assert len(found["cv_scores"]) == 5 and found["cv_scores"][0] == pytest.approx(found["r2"]) and all(0 < x <= 1 for x in found["cv_scores"])
    assert found["n_fit"] == found["n_train"]


def test_arrays_score_as_the_model_does(spark, data, tmp_path):
    """Votes, predictions and ties of the saved trees' arrays are those of ``transform``, also for NaN and infinities."""
    made = ML.prepare(data, ["flood_risk_level", "crop_yield_t_ha"], "sample_id", fit_rows=300)
    assert made.pool.rdd.getNumPartitions() == 1 < made.rows.count() / 300  # a fit's jobs have no task for every file
    assert made.held.count() < made.rows.count() / 2
    odd = [float("nan"), float("inf"), -float("inf")]
    models = {t: ML.train_target(made, t, FEATURES)[0] for t in ("flood_risk_level", "crop_yield_t_ha")}
    vector = spark.createDataFrame([(Vectors.dense([odd[(i + j) % 3] if (i + j) % 4 else 10.0 * i for j in range(len(FEATURES))]),) for i in range(20)], ["features"])
    rows = made.rows.select("features").unionByName(vector)
    d = rows
    for t, m in models.items():
        rf = m.stages[-1].copy()
        d = rf.setPredictionCol(f"p_{t}").transform(d) if len(m.stages) == 1 else rf.setPredictionCol("").setProbabilityCol("").setRawPredictionCol(f"p_{t}").transform(d)
    want = d.select(vector_to_array("p_flood_risk_level").cast("string"), F.col("p_crop_yield_t_ha")).collect()
    trees = ML.forest_arrays(spark, models)
    assert set(trees) == set(models) and all(len(x) == 5 for x in trees.values())
    got = ML.with_votes(rows, trees).select(F.col("v_flood_risk_level").cast("string"), "v_crop_yield_t_ha").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(set(got)) > 5


def test_forests_are_fitted_on_the_whole_split(spark, tmp_path):
    """Without a bound that the caller names no row of a training split is left out, however many there are."""
    rows = spark.range(9000).selectExpr(
        "CAST(id AS STRING) AS sample_id", "CAST(id % 97 AS DOUBLE) AS a", "CAST(id % 89 AS DOUBLE) AS b", "1D AS sample_weight",
        "CAST(id % 3 AS INT) AS flood_risk_level", "CASE WHEN id % 10 > 0 THEN id % 97 / 10D END AS crop_yield_t_ha")
    wanted = ["flood_risk_level", "crop_yield_t_ha"]
    assert ML.train_all(spark, ML.assemble(rows, ["a", "b"]), wanted, f"file:{tmp_path}/w", "sample_id", ["a", "b"]) == wanted
    m = {r["target"]: r for r in ML.metrics_table(ML.ledger(spark, f"file:{tmp_path}/w")).collect()}
    assert [(m[t]["n_fit"], m[t]["n_train"], m[t]["n_test"]) for t in wanted] == [(7200, 7200, 1800), (6480, 6480, 1620)]
    made = ML.prepare(ML.assemble(rows, ["a", "b"]), wanted, "sample_id")
    assert made.pool.where("fit_flood_risk_level").count() == 9000 and made.pool.where("fit_crop_yield_t_ha").count() == 8100
