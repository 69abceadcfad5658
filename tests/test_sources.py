"""File sources and sinks: discovery order (S01), file-name capture (S02),
header trim (S03), relabel stage (S06), region predicate (P10)."""

import pandas as pd

from agrolens.constants import TARGETS
from agrolens.functions import labels as L
from agrolens.operators.rollup import region_filter
from agrolens.sources import files as IO


def _csv(path, frame):
    path.parent.mkdir(parents=True, exist_ok=True)
    frame.to_csv(path, index=False)


def test_region_discovery_prefers_exact_then_prefix_then_folder(spark, tmp_path):
    a, b = tmp_path / "rootA", tmp_path / "rootB"
    _csv(a / "bago_static.csv", pd.DataFrame({" x ": [1]}))
    _csv(b / "bago.csv", pd.DataFrame({"x": [2]}))
    _csv(b / "yangon" / "part1.csv", pd.DataFrame({"x": [3]}))
    assert IO.find_region_files(spark, "bago", [str(a), str(b)])[0].endswith("bago_static.csv")  # first root wins
    assert IO.find_region_files(spark, "bago", [str(b)])[0].endswith("bago.csv")
    assert IO.find_region_files(spark, "yangon", [str(a), str(b)])[0].endswith("part1.csv")
    df = IO.read_region_csv(spark, "bago", [str(a)])
    assert df.columns == ["x"] and df.first()["x"] == "1"        # trimmed header, string values
    assert IO.read_region_csv(spark, "magway", [str(a), str(b)]) is None


def test_dynamic_files_take_year_and_month_from_the_name(spark, tmp_path):
    _csv(tmp_path / "bago_dynamic_2021_03.csv", pd.DataFrame({"grid_id": ["1,2"], "ndvi_median": ["0.5"]}))
    _csv(tmp_path / "sagaing_dynamic_2022_11.csv", pd.DataFrame({"grid_id": ["3,4"], "ndvi_median": ["0.7"]}))
    rows = {r["region"]: (r["data_year"], r["data_month"]) for r in
            IO.read_dynamic(spark, str(tmp_path / "*_dynamic_*.csv")).collect()}
    assert rows == {"bago": (2021, 3), "sagaing": (2022, 11)}


def test_relabel_stage_writes_a_new_stage(spark, sf, tmp_path):
    from agrolens.plans.catalog import training_rows
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    IO.write_partitioned(training_rows(spark, sf).limit(300), src)
    IO.relabel_stage(spark, src, dst, lambda d: L.with_labels(d))
    out = spark.read.parquet(dst)
    assert set(TARGETS) <= set(out.columns) and out.count() == 300


def test_region_predicate_by_flag_name_or_all(spark):
    flags = spark.createDataFrame([(1, 0), (0, 1)], "region_bago int, region_yangon int")
    names = spark.createDataFrame([("Bago",), ("yangon",)], "region string")
    assert region_filter(flags, "bago").count() == 1
    assert region_filter(names, "BAGO").count() == 1
    assert region_filter(spark.createDataFrame([(1,)], "x int"), "bago").count() == 1


def test_published_versions(spark, tmp_path):
    import pytest

    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        IO.read_published(spark, path)
    a, b = spark.range(5), spark.range(9)
    assert IO.publish(a, path, csv_copy=True) == 1
    reader = IO.read_published(spark, path)
    with pytest.raises(Exception, match="lost"):
        IO.publish(b.selectExpr("CASE WHEN id = 8 THEN CAST(raise_error('lost') AS BIGINT) ELSE id END AS id"), path, csv_copy=True)
    assert IO.read_published(spark, path).count() == reader.count() == 5 and IO.published_versions(spark, path) == [1]
    assert IO.publish(b, path, csv_copy=True) == 2
    assert reader.count() == 5 and IO.read_published(spark, path).count() == 9 and IO.read_published(spark, path, 1).count() == 5
    assert sorted(r["id"] for r in IO.read_published(spark, path, csv=True).collect()) == [str(i) for i in range(9)]


def test_skipped_slices_have_a_reason(spark, tmp_path):
    base = f"{tmp_path}"
    spark.range(3).write.parquet(f"{base}/good")
    spark.range(0).coalesce(1).write.parquet(f"{base}/none")
    for name, content in (("text", b"no parquet at all"), ("cut", (next((tmp_path / "good").glob("*.parquet"))).read_bytes()[:-20]), ("zero", b"")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.parquet").write_bytes(content)
    (tmp_path / "bare").mkdir()
    names = ["good", "none", "text", "cut", "zero", "bare", "gone"]
    rows, skipped = IO.read_slices_counted(spark, [f"{base}/{n}" for n in names], ["id long", "other string"])
    assert rows.count() == 3 and rows.columns == ["id", "other"]
    why = {r["slice"].rsplit("/", 1)[1]: r["reason"] for r in skipped.where("slice NOT LIKE '%good'").collect()}
    assert why == {"none": "empty", "text": "unreadable", "cut": "unreadable", "zero": "unreadable", "bare": "no files", "gone": "missing"}
    assert {r["reason"] for r in skipped.where("slice LIKE '%good'").collect()} <= {"empty"}  # part files of empty partitions
    rows, skipped = IO.read_slices_counted(spark, [f"{base}/gone"], ["id long"])
    assert rows.count() == 0 and skipped.first()["reason"] == "missing"
