"""File sources and sinks.

Paths are plain strings understood by Hadoop (local, HDFS, object stores).
Discovery (S01) uses the Hadoop FileSystem glob on the driver — metadata
only, no data.  Every sink is a distributed ``DataFrameWriter`` call; there
is no driver-side collect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from agrolens.session import materialize, put_file

PARTITION_COLS = ["region", "data_year", "data_month"]
DYNAMIC_FILE_RE = r"([A-Za-z]+)_dynamic_(\d{4})_(\d{2})\.csv$"


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.globStatus(path)
    return [] if st is None else sorted(s.getPath().toString() for s in st)


def find_region_files(spark: SparkSession, region: str, roots: list[str]) -> list[str]:
    """First hit over the roots of: exact ``<region>.csv``, then the
    prefix glob ``<region>*.csv``, then ``<region>/*.csv``."""
    for root in roots:
        r = root.rstrip("/")
        for pat in (f"{r}/{region}.csv", f"{r}/{region}*.csv", f"{r}/{region}/*.csv"):
            hits = _glob(spark, pat)
            if hits:
                return hits
    return []


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip whitespace around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv_strings(spark: SparkSession, paths, columns: list[str] | None = None) -> DataFrame:
    """Untyped CSV (every value a string, no inference pass)."""
    reader = spark.read.option("header", True)
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return trim_headers(reader.csv(paths))


def read_region_csv(spark: SparkSession, region: str, roots: list[str]) -> DataFrame | None:
    """S01 + S03 + S19: a region's CSV (or None when nothing matches)."""
    files = find_region_files(spark, region, roots)
    return read_csv_strings(spark, files) if files else None


def read_dynamic(spark: SparkSession, pattern: str) -> DataFrame:
    """Monthly files ``<region>_dynamic_YYYY_MM.csv``; region, year and
    month come from the file name (hidden ``_metadata`` column)."""
    df = read_csv_strings(spark, pattern)
    return with_file_lineage(df, F.col("_metadata.file_name"))


def name_by_folder(spark: SparkSession, pattern: str, to: str) -> int:
    """Renames the single part file of every folder ``<column>=<name>`` that ``pattern`` lists to ``<to>/<name>``; returns their number.

    Spark names part files itself; a sink that others read by file name is
    renamed after the write (metadata only).
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(to)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in _glob(spark, pattern)]
    for p in found:
        if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(target, p.getParent().getName().split("=", 1)[1])):
            raise OSError(f"{p} has no folder of its own")
    return len(found)


def with_file_lineage(df: DataFrame, name: Column) -> DataFrame:
    """Region, data_year and data_month from a dynamic file's name."""
    return df.select("*", F.regexp_extract(name, DYNAMIC_FILE_RE, 1).alias("region"),
                     F.regexp_extract(name, DYNAMIC_FILE_RE, 2).cast("int").alias("data_year"),
                     F.regexp_extract(name, DYNAMIC_FILE_RE, 3).cast("int").alias("data_month"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 where: str | None = None) -> DataFrame:
    """S08 + S11 + S04: parquet scan; the projection and the filter reach the
    scan (column pruning, PushedFilters, partition pruning)."""
    df = spark.read.parquet(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def write_partitioned(df: DataFrame, path: str, cols: list[str] | None = None, fmt: str = "parquet") -> None:
    """One directory per (region, year, month); with dynamic partition
    overwrite only the slices present in ``df`` are replaced."""
    cols = cols or PARTITION_COLS
    # rebalance deals rows by slice and lets AQE split a slice that is too large for one task
    w = df.hint("rebalance", *cols).write.mode("overwrite").partitionBy(*cols).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_slices(spark: SparkSession, paths, columns: list[str]) -> DataFrame:
    """U01 at the source: one scan over all slice files (parquet) that skips
    empty and unreadable files, and files gone since they were listed, instead of failing
    (which ones: ``read_slices_counted``); ``columns`` is the
    schema as DDL items, and a column that a slice lacks is NULL there."""
    return (spark.read.schema(", ".join(columns)).option("ignoreCorruptFiles", "true")
            .option("ignoreMissingFiles", "true").parquet(*([paths] if isinstance(paths, str) else paths)))


def slice_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(slice, file): the data files below every slice folder as the file system lists them; a slice without any has a null file."""
    jvm = spark.sparkContext._jvm
    rows = []
    for path in paths:  # metadata only; a few paths of slice folders
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = fs.exists(p)
        names = [s.getPath() for s in fs.listStatus(p)] if there else []
        files = [str(x.toString()) for x in names if not x.getName().startswith(("_", "."))]
        rows += [(path, there, f) for f in files] or [(path, there, None)]
    return spark.createDataFrame(rows, "slice string, there boolean, file string")


def read_slices_counted(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """U01 with accounting: the rows of ``read_slices``, and a row (slice, file, reason) for all that gave none.

    reason: ``missing`` (no such slice), ``no files``, ``empty`` (a Parquet file
    of no rows) or ``unreadable`` (no Parquet file, by its first and last
    bytes).  Files that gave rows are known from the rows' own file path, so
    the accounting is an anti join of listed files.
    """
    listed = materialize(slice_files(spark, paths), "slice-files")
    there = [r["slice"] for r in listed.where("file IS NOT NULL").select("slice").distinct().collect()]  # slice folders: metadata
    rows = read_slices(spark, there, columns) if there else spark.createDataFrame([], ", ".join(columns))
    if not there:
        return rows, listed.select("slice", "file", F.when(~F.col("there"), "missing").otherwise("no files").alias("reason"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    gave = rows.select(bare(F.col("_metadata.file_path")).alias("f")).distinct()
    none = listed.join(gave, bare(F.col("file")) == F.col("f"), "left_anti")
    odd = [r["file"] for r in none.where("file IS NOT NULL").select("file").collect()]  # only files without rows
    if odd:
        magic = F.encode(F.lit("PAR1"), "UTF-8")
        content = spark.read.format("binaryFile").load(odd)
        sound = content.select(bare(F.col("path")).alias("f"), ((F.substring("content", 1, 4) == magic) & (
            F.substring("content", -4, 4) == magic) & (F.col("length") > 8)).alias("sound"))
        none = none.join(sound, bare(F.col("file")) == F.col("f"), "left")
    else:
        none = none.withColumn("sound", F.lit(None).cast("boolean"))
    reason = F.when(~F.col("there"), "missing").when(F.col("file").isNull(), "no files").when(F.col("sound"), "empty").otherwise("unreadable")
    return rows, none.select("slice", "file", reason.alias("reason"))


def relabel_stage(spark: SparkSession, src: str, dst: str, relabel) -> None:
    """Read stage A, apply ``relabel`` (e.g. with_labels), write stage B
    (Spark never overwrites the table it is reading)."""
    if src.rstrip("/") == dst.rstrip("/"):
        raise ValueError("relabel writes a new stage; source and destination must differ")
    write_partitioned(relabel(spark.read.parquet(src)), dst)


def write_table(df: DataFrame, path: str, csv_copy: str | None = None, sort_by: list[str] | None = None) -> None:
    """Parquet + optional CSV copy, replacing what was there;
    T01 sorts within partitions at the sink only.  For a table that is read
    meanwhile see ``publish``."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(path)
    if csv_copy:
        df.write.mode("overwrite").option("header", True).csv(csv_copy)


def published_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the table at ``path`` that were published, rising."""
    return sorted(int(p.rsplit("/", 1)[1]) for p in _glob(spark, f"{path.rstrip('/')}/published/[0-9]*"))


def publish(df: DataFrame, path: str, csv_copy: bool = False, sort_by: list[str] | None = None) -> int:
    """``df`` as the next version of the table at ``path``; returns the version.

    The rows are written to a folder of their own (``csv_copy``: also as CSV);
    only then one small file, put in place by a rename, makes them the current
    version.  Readers see the version before until then, also where the write
    fails; what a failed write leaves is never read.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    done = published_versions(spark, path)
    version = done[-1] + 1 if done else 1
    name = f"{version:010d}-{uuid.uuid4().hex[:12]}"
    rows = df.sortWithinPartitions(*sort_by) if sort_by else df
    rows.write.parquet(f"{base}/parquet/{name}")
    if csv_copy:  # of the rows as written, not computed again
        spark.read.parquet(f"{base}/parquet/{name}").write.option("header", True).csv(f"{base}/csv/{name}")
    put_file(spark, f"{base}/published/{version:010d}", name)
    return version


def read_published(spark: SparkSession, path: str, version: int | None = None, csv: bool = False) -> DataFrame:
    """The current version (or ``version``) of a published table, or its CSV copy (all strings)."""
    done, base = published_versions(spark, path), path.rstrip("/")
    if not done or version not in (None, *done):
        raise FileNotFoundError(f"no published version {version or ''} of {path}")
    name = spark.read.text(f"{base}/published/{version or done[-1]:010d}").first()["value"]  # one line
    return read_csv_strings(spark, f"{base}/csv/{name}") if csv else spark.read.parquet(f"{base}/parquet/{name}")


def export_features(df: DataFrame, labels: list[str], path: str, csv_copy: str | None = None) -> DataFrame:
    """Drop the label columns and export the features."""
    out = df.drop(*[c for c in labels if c in df.columns])
    write_table(out, path, csv_copy)
    return out


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows in key order (deterministic limit)."""
    return df.orderBy(key).limit(n)


def prediction_export(df: DataFrame, targets: list[str], meta: list[str]) -> DataFrame:
    """Wide predictions + ``meta_*`` columns (columnar on disk)."""
    return df.select(*[F.col(c).alias(f"meta_{c}") for c in meta], *targets)


def nested_rows(df: DataFrame, targets: list[str], meta: list[str], composites: dict[str, str]) -> DataFrame:
    """One document per row {meta, predictions, composite_features}."""
    return df.selectExpr(
        "named_struct(" + ", ".join(f"'{m}', {m}" for m in meta) + ") AS meta",
        "named_struct(" + ", ".join(f"'{t}', {t}" for t in targets) + ") AS predictions",
        "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in composites.items()) + ") AS composite_features")


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """S14 / S16 sink: JSON lines."""
    df.write.mode("overwrite").json(path, compression=compression)


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column]) -> dict[str, int]:
    """Writes ``df`` and returns aggregates of its rows that the writing job itself collected:
    no second scan of the table."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def run_metadata(df: DataFrame, n_targets: int, fallback_col: str | None = None) -> DataFrame:
    """One-row run summary (rows, predictions = rows x targets,
    fallback count) — replaces the reference's collect into one document."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    if fallback_col:
        aggs.append(F.count_if(F.col(fallback_col)).alias("fallback_rows"))
    out = df.agg(*aggs).withColumn("total_predictions", F.col("total_rows") * F.lit(n_targets))
    return out.withColumn("format", F.lit("columnar"))
