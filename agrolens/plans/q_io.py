"""Sink/source round trips (S04-S09, S13, S15, S19): write to the shared
scratch folder, read back, compare with the source rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolens.constants import REGIONS, TARGETS
from agrolens.operators import catalog_ops as CO
from agrolens.plans import sqltext as Q
from agrolens.plans.catalog import labelled_rows
from agrolens.plans.registry import register
from agrolens.session import scratch_path
from agrolens.sources import files as IO
from agrolens.sources import fixtures as FX


def _tmp(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("partitioned_roundtrip", Q.with_ctes(
    [("grid_static", None), ("obs", None), ("obs_month", None)],
    "SELECT m.sample_id, m.chirps_precipitation_mm, m.mean_temperature_c, s.region, m.data_year, m.data_month "
    "FROM obs_month m JOIN grid_static s ON m.grid_id = s.grid_id WHERE s.region = 'bago' AND m.data_year = 1996"))
def partitioned_roundtrip(spark, sf):
    """S05 write partitioned by (region, year, month) -> S04/S08 read with
    partition pruning and a pushed-down projection."""
    src = FX.obs_month(spark, sf).join(FX.grid_static(spark, sf).select("grid_id", "region"), on="grid_id")
    path = _tmp(spark, "obs_by_slice")
    IO.write_partitioned(src.select("sample_id", "chirps_precipitation_mm", "mean_temperature_c", "region",
                                    "data_year", "data_month"), path)
    return IO.read_parquet(spark, path, where="region = 'bago' AND data_year = 1996",
                           columns=["sample_id", "chirps_precipitation_mm", "mean_temperature_c", "region",
                                    "data_year", "data_month"])


_CSV_COLS = ["system_index", "region", "elevation_m", "soil_soc_g_kg_0_30cm", "population_density"]


@register("csv_roundtrip", Q.with_ctes(
    [("grid_static", None)],
    "SELECT system_index, region, elevation_m, soil_soc_g_kg_0_30cm, population_density FROM grid_static"))
def csv_roundtrip(spark, sf):
    """S07 CSV sink with padded headers -> S19 untyped read -> S03 header
    trim -> P04 coercion (empty -> NULL)."""
    gs = FX.grid_static(spark, sf).select(*_CSV_COLS)
    padded = gs.toDF(*[f" {c} " for c in gs.columns])
    path = _tmp(spark, "grid_csv")
    padded.write.mode("overwrite").option("header", True).csv(path)
    back = IO.read_csv_strings(spark, path)
    return back.selectExpr("system_index", "region",
                           *[f"nanvl(try_cast({c} AS DOUBLE), CAST(NULL AS DOUBLE)) AS {c}" for c in _CSV_COLS[2:]])


_META = ["sample_id", "region", "latitude", "longitude"]


@register("prediction_export", Q.with_ctes(
    Q.labelled_ctes(), "SELECT sample_id AS meta_sample_id, region AS meta_region, latitude AS meta_latitude, "
                       f"longitude AS meta_longitude, {', '.join(TARGETS)} FROM labelled"))
def prediction_export(spark, sf):
    """S13 (+S09 features dropped): all 40 predictions + meta_* to parquet and back."""
    out = IO.prediction_export(labelled_rows(spark, sf), TARGETS, _META)
    path = _tmp(spark, "predictions")
    IO.write_table(out, path)
    return IO.read_parquet(spark, path, columns=[*[f"meta_{c}" for c in _META], *TARGETS])


@register("run_metadata", Q.with_ctes(
    Q.labelled_ctes(), "SELECT count(*) AS total_rows, count(*) * 40 AS total_predictions, "
                       "'columnar' AS format FROM labelled"))
def run_metadata(spark, sf):
    """One-row run summary next to the columnar export."""
    return IO.run_metadata(labelled_rows(spark, sf), len(TARGETS)).select(
        "total_rows", "total_predictions", "format")


@register("nested_export", Q.with_ctes(
    Q.labelled_ctes(), f"SELECT sample_id, region, latitude, longitude, {', '.join(TARGETS)}, crop_health_score AS crop_health FROM labelled"))
def nested_export(spark, sf):
    """One JSON document per row {meta, predictions, composite_features}
    written and read back, every field."""
    df = labelled_rows(spark, sf)
    nested = IO.nested_rows(df, TARGETS, _META, {"crop_health": "crop_health_score"})
    path = _tmp(spark, "nested_json")
    IO.write_json(nested, path, compression="gzip")  # a row repeats 44 names; a file is read by one task, as it was written
    return spark.read.schema(nested.schema).json(path).select("meta.*", "predictions.*", "composite_features.*")


# ------------------------------------------------------------------ S02 / S09 / S10 / T01 / U01

_OBS_COLS = ["sample_id", "chirps_precipitation_mm", "mean_temperature_c"]


@register("dynamic_scan", Q.with_ctes(
    [("grid_static", None), ("obs", None), ("obs_month", None)],
    "SELECT m.sample_id, m.chirps_precipitation_mm, m.mean_temperature_c, s.region, m.data_year, m.data_month "
    "FROM obs_month m JOIN grid_static s ON m.grid_id = s.grid_id"))
def dynamic_scan(spark, sf):
    """S02 + P03: monthly files ``<region>_dynamic_YYYY_MM.csv`` of all
    regions and months, in one scan; region, year and month come from the file
    name alone."""
    rows = FX.obs_month(spark, sf).join(FX.grid_static(spark, sf).select("grid_id", "region"), on="grid_id")
    base = _tmp(spark, "dynamic")
    named = rows.selectExpr(*_OBS_COLS, "concat(region, '_dynamic_', data_year, '_', lpad(data_month, 2, '0'), '.csv') AS file")
    named.repartition("file").write.partitionBy("file").option("header", True).csv(f"{base}/staged")
    IO.name_by_folder(spark, f"{base}/staged/file=*/part-*", f"{base}/drops")
    out = IO.read_dynamic(spark, f"{base}/drops/*.csv")
    return out.selectExpr(
        "sample_id", "CAST(chirps_precipitation_mm AS DOUBLE) AS chirps_precipitation_mm",
        "CAST(mean_temperature_c AS DOUBLE) AS mean_temperature_c", "region", "data_year", "data_month")


@register("features_export", Q.with_ctes(
    Q.rows_ctes(), "SELECT sample_id, region, elevation_m, chirps_precipitation_mm, crop_area_pct_maize, region_bago FROM rows"))
def features_export(spark, sf):
    """S09 + P18: the labels are dropped by list algebra, the features written
    and read back; no label column is left."""
    lab = labelled_rows(spark, sf)
    path = _tmp(spark, "features")
    IO.export_features(lab, TARGETS, path)
    back = spark.read.parquet(path)
    feats, labels = CO.split_columns(back.columns, TARGETS)
    assert not labels and len(feats) == len(back.columns)
    return back.select("sample_id", "region", "elevation_m", "chirps_precipitation_mm", "crop_area_pct_maize", "region_bago")


@register("head_rows", Q.with_ctes(
    [("grid_static", None)], "SELECT system_index, region, elevation_m FROM grid_static ORDER BY system_index LIMIT 20"))
def head_rows(spark, sf):
    """S10 + T05: the first rows in key order (a top-k, no full sort)."""
    return IO.head(FX.grid_static(spark, sf).select("system_index", "region", "elevation_m"), 20, "system_index")


@register("sorted_sink", Q.with_ctes(
    [("grid_static", None)], "SELECT region, count(*) AS n, true AS sorted FROM grid_static GROUP BY region"))
def sorted_sink(spark, sf):
    """Rows are sorted within each file of the sink; read back, every
    file's keys rise."""
    path = _tmp(spark, "sorted")
    IO.write_table(FX.grid_static(spark, sf).select("system_index", "region"), path, sort_by=["region", "system_index"])
    back = spark.read.parquet(path).select("region", "system_index", F.col("_metadata.file_name").alias("f"),
                                           F.monotonically_increasing_id().alias("at"))
    before = F.lag("system_index").over(Window.partitionBy("f", "region").orderBy("at"))
    return back.withColumn("ok", F.coalesce(before <= F.col("system_index"), F.lit(True))).groupBy("region").agg(
        F.count("*").alias("n"), F.every("ok").alias("sorted"))


@register("union_slices", Q.with_ctes(
    [("grid_static", None)], "SELECT region, count(*) AS n, count(elevation_m) AS n_elevation FROM grid_static "
                             "WHERE region <> 'magway' GROUP BY region"))
def union_slices(spark, sf):
    """Slices with different columns in one scan; an empty, a missing and
    an unreadable slice are skipped."""
    gs = FX.grid_static(spark, sf)
    base = _tmp(spark, "slices")
    paths = []
    for r in REGIONS:
        path = f"{base}/{r}"
        one = gs.where(F.col("region") == r).select("system_index", "region", "elevation_m")
        if r == "magway":  # not parquet: unreadable
            one.select("system_index").write.text(path)
        else:
            one.write.parquet(path)
        paths.append(path)
    gs.where("false").select("system_index", "region", "elevation_m").write.parquet(f"{base}/empty")
    back = IO.read_slices(spark, [*paths, f"{base}/empty"], ["system_index string", "region string", "elevation_m double"])
    return back.groupBy("region").agg(F.count("*").alias("n"), F.count("elevation_m").alias("n_elevation"))


def _slices(spark, sf):
    """Slice folders of every region: one unreadable, one empty, one without files, one missing."""
    gs = FX.grid_static(spark, sf)
    base = _tmp(spark, "slices")
    for r in REGIONS:
        one = gs.where(F.col("region") == r).select("system_index", "region", "elevation_m")
        if r == "magway":
            one.select("system_index").coalesce(1).write.text(f"{base}/{r}")
        else:
            one.write.parquet(f"{base}/{r}")
    gs.where("false").select("system_index", "region", "elevation_m").coalesce(1).write.parquet(f"{base}/empty")
    IO.put_file(spark, f"{base}/bare/_SUCCESS", "")
    return base, [f"{base}/{x}" for x in [*REGIONS, "empty", "bare", "gone"]]


@register("skipped_slices", Q.with_ctes(
    [("grid_static", None)],
    "SELECT region AS slice, 'read' AS outcome, count(*) AS n FROM grid_static WHERE region <> 'magway' GROUP BY region "
    "UNION ALL SELECT * FROM (VALUES ('magway', 'unreadable', 1), ('empty', 'empty', 1), ('bare', 'no files', 1), ('gone', 'missing', 1)) "
    "AS v(slice, outcome, n) WHERE slice <> 'magway' OR EXISTS (SELECT 1 FROM grid_static WHERE region = 'magway')"))
def skipped_slices(spark, sf):
    """U01 with accounting: rows of every slice that was read, and why each
    other slice gave none."""
    base, paths = _slices(spark, sf)
    rows, skipped = IO.read_slices_counted(spark, paths, ["system_index string", "region string", "elevation_m double"])
    read = rows.groupBy(F.col("region").alias("slice"), F.lit("read").alias("outcome")).agg(F.count("*").alias("n"))
    return read.unionByName(skipped.groupBy(F.regexp_extract("slice", "([^/]+)$", 1).alias("slice"), F.col("reason").alias("outcome"))
                            .agg(F.count("*").alias("n")))


@register("published_snapshot", Q.with_ctes(
    [("grid_static", None)],
    "SELECT region, count(*) AS n, count(*) AS n_csv, sum(elevation_m) AS elevation, sum(elevation_m) AS elevation_csv, "
    "CASE WHEN region = 'bago' THEN 0 ELSE count(*) END AS n_during_failure, 2 AS version FROM grid_static GROUP BY region"))
def published_snapshot(spark, sf):
    """Version 1 (without one region) stays readable while a write of
    version 2 fails; the repeated write publishes it, with its CSV copy."""
    gs = FX.grid_static(spark, sf).select("system_index", "region", "elevation_m")
    path = _tmp(spark, "snapshot")
    IO.publish(gs.where("region <> 'bago'"), path, csv_copy=True)
    broken = gs.withColumn("elevation_m", F.expr("CASE WHEN region = 'yangon' THEN CAST(raise_error('lost') AS DOUBLE) ELSE elevation_m END"))
    try:
        IO.publish(broken, path, csv_copy=True)
    except Exception as e:  # noqa: BLE001 - the failure that the query is about
        if "lost" not in str(e):
            raise
    during = IO.read_published(spark, path).groupBy("region").agg(F.count("*").alias("n_during_failure"))
    version = IO.publish(gs, path, csv_copy=True, sort_by=["system_index"])
    now = IO.read_published(spark, path).groupBy("region").agg(F.count("*").alias("n"), F.sum("elevation_m").alias("elevation"))
    copy = IO.read_published(spark, path, csv=True).groupBy("region").agg(
        F.count("*").alias("n_csv"), F.sum(F.col("elevation_m").cast("double")).alias("elevation_csv"))
    return now.join(copy, "region").join(during, "region", "left").select(
        "region", "n", "n_csv", "elevation", "elevation_csv", F.coalesce("n_during_failure", F.lit(0)).alias("n_during_failure"),
        F.lit(version).alias("version"))
