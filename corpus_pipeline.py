"""The corpus pipeline over ``documents``: each stage applies one operator of ``agrolens.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, and works on all that its predecessor kept.  ``run``
writes each stage's result to the shared folder and rereads it as the next
stage's documents.  All stages but the last return the columns of
``documents``; the last returns the packed pieces.

A stage's result depends on intermediate tables until it is written, so they
go when the next stage starts (unless that stage reads them).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.llm import mixing, outliers, packing, simhash, suffix
from agrolens.llm.common import columns, drop_paths, fresh, materialize, recorded_tables, release, small_batches, words

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[tuple[str, str]] = []  # (application, path) of tables that earlier stages' results were made from


def _stage(run: Stage) -> Stage:
    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        app = spark.sparkContext.applicationId
        small_batches(spark)
        for at, path in list(_left):
            if not any(path.rsplit("/", 1)[-1] in f for f in read):
                if at == app:
                    drop_paths(spark, path)
                _left.remove((at, path))
        with recorded_tables() as paths:
            out = run(spark, docs, sf_dir)
        _left.extend((app, p) for p in paths)
        return out
    return stage


def _recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text as it is now (null text: unchanged)."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language's and source's centre go."""
    marked = outliers.mark_outliers(docs)
    return marked.where("kept").select(*columns(docs))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.simhash_dedup(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut out."""
    return _recounted(suffix.remove_repeats(docs))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating; a document has a row for each copy that the mix takes."""
    size, taken, sources = fresh(docs, "size", "taken", "sources")
    sized = docs.select("*", F.size(words(F.col("text"))).cast("long").alias(size), F.array(F.col("source").cast("string")).alias(sources))
    found = {r["source"]: r["n"] for r in mixing.source_sizes(sized, "source", size)}
    targets = mixing.share_targets(found, mixing.cycle_weights(found), sum(found.values()), 3)
    mixed = mixing.mix(sized, sources, size, targets, ["doc_id", size], taken=taken)
    return _recounted(mixing.repeat_taken(mixed, "text", size, taken)).select(*columns(docs))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, one row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", near_duplicates),
    ("suffix_array", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Fingerprints, the robust estimate, the flow and the packing are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
