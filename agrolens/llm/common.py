"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.session import scratch_path

#: Bytes of an Arrow batch between Spark and a Python worker.  10,000 rows (Spark's limit) of whole texts are some 50 MB,
#: which JVM and worker hold several times over and do not give back.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: The six ASCII white-space characters that separate words in every contract.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few megabytes in this session, unless its user has set their size."""
    if spark.conf.get(_BATCH[0], None) is None:
        spark.conf.set(*_BATCH)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def words(text: Column) -> Column:
    """The words of ``text`` (runs of other characters than ``SPACES``); null: none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


_recording: list[list[str]] = []


@contextmanager
def recorded_tables() -> Iterator[list[str]]:
    """The paths of the intermediate tables that operators write meanwhile."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording[:] = [x for x in _recording if x is not paths]


def _new_path(spark: SparkSession, tag: str) -> str:
    path = scratch_path(spark, tag)
    for paths in _recording:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts the lineage, survives lost executors, and later passes read only the
    columns they need.  ``release`` deletes it.
    """
    path = _new_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.table_path = path
    return out


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder (through Hadoop's file system)."""
    for x in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that nothing reads any more."""
    for t in tables:
        drop_paths(t.sparkSession, t.table_path)


def numbered(df: DataFrame, rid: str, name: str) -> DataFrame:
    """``df`` written once to the shared folder with a row number ``rid``.

    The number is fixed by the written table, so later passes over it agree
    also after a lost executor.
    """
    return materialize(df.withColumn(rid, F.monotonically_increasing_id()), name)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once to the shared folder, bucketed by ``key``.

    Later joins on ``key`` then move only their other side.  The table's files
    are external to the catalogue; its entry goes again at once.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(n, key).write.format("parquet").option("path", _new_path(spark, tag))
     .option("compression", "zstd").bucketBy(n, key).saveAsTable(tag))
    out = spark.table(tag)
    out.schema  # resolves the relation before its catalogue entry goes
    spark.sql(f"DROP TABLE {tag}")
    return out
