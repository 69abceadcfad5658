"""Steps that were too slow or too large beyond a few million rows."""

import math

from pyspark.sql import functions as F

from agrolens.operators import quality as QA
from agrolens.plans import catalog
from agrolens.streaming import ingest as ST


def test_wide_projections_stay_below_the_compiled_size(spark, sf):
    """A query's generated methods are small enough for HotSpot, also in a session that set nothing."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "65535")
    try:
        catalog.queries()["labels_all"](spark, sf)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "20000")  # the user's choice stays
        catalog.queries()["labels_all"](spark, sf)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.set(key, before)


def test_corr_moves_moments_not_pairs(spark):
    """Nulls and NaN on both sides, a constant column, one row per partition: as the built-in moments give it."""
    rows = [(float(i % 7), None if i % 5 == 0 else i * 1e-3 + 900, 0.1, float(i * i % 11), None if i % 3 == 0 else float(i)) for i in range(60)]
    rows.append((1.0, float("nan"), 0.1, 2.0, 5.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, z double").repartition(9)
    out = QA.feature_target_corr(df, ["a", "b", "c"], ["y", "z"])
    assert "Generate unpivot" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "Expand" not in plan
    got = {(r["feature"], r["target"]): r for r in out.collect()}
    assert len(got) == 6
    for f in "abc":
        for t in "yz":
            d = df.where(F.col(f).isNotNull() & ~F.isnan(f))
            w = d.agg(F.count("*").alias("n"), F.covar_pop(f, t).alias("c"), F.stddev_pop(f).alias("x"), F.stddev_pop(t).alias("y")).first()
            assert got[f, t]["n_valid"] == w["n"]
            if f == "c":
                assert got[f, t]["r"] is None
            else:
                assert math.isclose(got[f, t]["r"], w["c"] / (w["x"] * w["y"]), abs_tol=1e-10)


def test_stream_batches_follow_bytes_not_files(spark, tmp_path):
    """Eight small files make one batch of the scoring stream and one of the strict stream; a smaller bound makes more."""
    rows = spark.range(40).selectExpr("CAST(id AS STRING) AS k", "CAST(id AS DOUBLE) AS a").repartition(8)
    rows.write.parquet(f"{tmp_path}/feed/drop=0")
    doubled = lambda d: d.selectExpr("k", "CAST(a * 2 AS STRING) AS t")
    ST.stream_scoring(spark, f"{tmp_path}/feed/*", rows.schema, f"{tmp_path}/sink", f"{tmp_path}/c1", doubled)
    ST.stream_scoring(spark, f"{tmp_path}/feed/*", rows.schema, f"{tmp_path}/sink2", f"{tmp_path}/c2", doubled, max_bytes_per_trigger=1)
    batches = [len([p for p in (tmp_path / c / "commits").iterdir() if p.name.isdigit()]) for c in ("c1", "c2")]
    assert batches[0] == 1 and batches[1] > 1
    assert spark.read.parquet(f"{tmp_path}/sink").count() == spark.read.parquet(f"{tmp_path}/sink2").count() == 40
    ST.strict_stream(spark, f"{tmp_path}/feed/*", rows.schema, f"{tmp_path}/strict", f"{tmp_path}/c3", {"t": ["a"]}, doubled, "k", max_files_per_trigger=None)
    assert [tuple(r) for r in ST.strict_outcome(spark, f"{tmp_path}/strict").collect()] == [(0, 40, 0, 0)]


def test_ranking_is_compiled(spark):
    """The crops are sorted by a native expression: array_sort would evaluate its 17 structs uncompiled."""
    from agrolens.constants import TARGETS
    from agrolens.functions.composites import CompositeText

    arr = CompositeText("spark", TARGETS, dict.fromkeys(TARGETS, "string")).ranking_array(5)
    row = spark.sql("SELECT " + ", ".join(f"'{'good' if t.endswith('maize') else 'poor'}' AS {t}" if t.startswith("crop_suit") else f"'0.5' AS {t}"
                                          for t in TARGETS)).selectExpr(f"{arr} AS r").first()["r"]
    assert "array_sort" not in arr and [x["crop"] for x in row][:2] == ["maize", "monsoon_rice"] and len(row) == 5


def test_nested_export_is_written_compressed(spark, sf):
    """The documents repeat their names on every row: they lie on disk compressed and are read back whole."""
    from urllib.parse import urlparse

    out = catalog.queries()["nested_export"](spark, sf)
    files = out.inputFiles()
    assert files and all(urlparse(f).path.endswith(".json.gz") for f in files)
    assert out.count() == catalog.queries()["labels_all"](spark, sf).count()
