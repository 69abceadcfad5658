"""Session builder and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for this workload (see README "Scale notes").
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # 75 features + shares + labels > 100 fields: keep whole-stage codegen on.
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # client-side call-site capture costs several driver round trips per Column op
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
#: HotSpot interprets methods above 8,000 bytes of bytecode.  The wide projections fused into one method exceed
#: that; above this limit Spark runs a stage's operators one by one, whose generated methods are split and compiled.
_METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")

#: Rows that lie sorted by their group (``features.grid_rows``) are aggregated in one walk: without it twice, each
#: time sorted anew because an aggregate that collects holds 128 groups in its table at most.
_SORTED_GROUPS = ("spark.sql.execution.replaceHashWithSortAgg", "true")


def compiled(spark: SparkSession) -> SparkSession:
    """``spark`` with the limit above, unless its user has set one, and the setting below it: the
    library's queries run in sessions that ``build_session`` did not make, too."""
    key, limit = _METHOD_LIMIT
    if spark.conf.get(key, None) in (None, "65535"):
        spark.conf.set(key, limit)
    spark.conf.set(*_SORTED_GROUPS)
    return spark


def build_session(master: str | None = None, app: str = "agrolens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings this library relies on.

    On a cluster, ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return compiled(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the session.

    A cluster names it in ``spark.checkpoint.dir``; that value is used as is.
    Only when it is unset (local tests) a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="agrolens-ckpt-", dir=os.environ.get("AGROLENS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables next to the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts the lineage like ``checkpoint()``, survives executor loss, and
    later passes read only the columns they need (columnar).  ``release``
    deletes it."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.table_path = path
    return out


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all: written beside, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{uuid.uuid4().hex}")  # readers skip such names
    fs = to.getFileSystem(conf)
    fs.mkdirs(to.getParent())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(beside, to):
        raise OSError(f"could not commit {path}")


def release(*tables) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
