"""What depends on the grid alone is worked out once per grid, not once per month."""

import pytest
from pyspark.sql import functions as F

from agrolens.constants import FEATURES, TARGETS
from agrolens.functions import labels as L
from agrolens.operators import features as FT
from agrolens.operators import ingest as IN
from agrolens.plans import catalog, q_ml, q_quality
from agrolens.sources import fixtures as FX


@pytest.fixture
def small(spark, tmp_path):
    """Two grids with three months each, one month of a null grid and a month without precipitation."""
    rows = [(g, n, 10.0 * n, 900.0 * n, 0.02 * n, 0.01, f"1995-0{m}-03") for g, m, n in
            [(1, 1, 1), (1, 2, 7), (1, 3, 3), (2, 1, 4), (2, 1, 5), (2, 2, 2), (2, 5, 1), (None, 4, 2)]]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, d string") \
        .withColumn("l_shipdate", F.to_timestamp("d")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3), (2, 4), (3, 5)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_labels_once_per_grid(spark, small):
    grids = catalog.labelled_grids(spark, small)
    assert sorted((r.grid_id or 0, len(r.months)) for r in grids.collect()) == [(0, 1), (1, 3), (2, 3)]
    rows, plain = catalog.labelled_rows(spark, small), L.with_labels(catalog.training_rows(spark, small))
    assert rows.columns == plain.columns == [*FT.ROW_IDS, *FEATURES, *TARGETS]
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    assert rows.count() == 7


def test_grid_statistics_are_the_window_ones(spark, small):
    rows = catalog.training_rows(spark, small).select("sample_id", "ndvi_median_mean", "chirps_precipitation_mm_cv", "chirps_precipitation_mm_min")
    window = FT.with_grid_stats(FX.obs_month(spark, small)).select(*rows.columns)
    key = lambda df: sorted(tuple(str(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    assert key(rows) == key(window)


def test_scored_rows_are_written_wide(spark, small):
    sc, sn = q_quality.scored_tables(spark, small)
    files = set(sc.inputFiles()) | set(sn.inputFiles())
    assert spark.read.parquet(*files).count() == 7 and sc.count() == 7 * len(q_quality.CLASS_TARGETS)


def test_sample_weights_read_the_tables_once(spark, small):
    out = q_ml.sample_weights(spark, small)
    assert not any("lineitem" in f for f in out.inputFiles())
    assert out.count() == 7


def test_strict_messages(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), None), (None, None)], "a double, b double")
    out = IN.strict_validate(df, {"x": ["a", "b"], "y": ["a"], "z": ["a", "c"]}).collect()
    assert [r.errors for r in out] == [
        {"z": "z: feature row is missing 1 required features"},
        {"x": "x: feature row contains 1 infinite values", "y": "y: feature row contains 1 infinite values", "z": "z: feature row is missing 1 required features"},
        {"x": "x: model does not support 2 missing values", "y": "y: model does not support 1 missing values", "z": "z: feature row is missing 1 required features"}]
    assert "_v0_tail" not in IN.strict_validate(df, {"x": ["a"]}).columns


def test_each_training_query_fits_its_own_targets(spark, small, monkeypatch):
    fitted = []
    monkeypatch.setattr(q_ml, "prepared_table", lambda *_: None)
    monkeypatch.setattr(q_ml.ML, "train_all", lambda spark, data, targets, *_, **__: fitted.append(list(targets)))
    q_ml.train_classifier(spark, small)
    q_ml.train_regressor(spark, small)
    q_ml.importance(spark, small)
    assert fitted == [q_ml.CLASSES, q_ml.NUMBERS, TARGETS]
