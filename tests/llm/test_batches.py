"""Arrow batches between Spark and its Python workers."""

from agrolens.llm.common import _BATCH, small_batches


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    kept = spark.conf.get(_BATCH[0], None)
    spark.conf.unset(_BATCH[0])
    try:
        small_batches(spark)
        texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('abcdefgh', 1000) AS text")
        found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 24_000_000 and max(found) < 5_000_000
        spark.conf.set(_BATCH[0], "9m")  # its user's choice stays
        small_batches(spark)
        assert spark.conf.get(_BATCH[0]) == "9m"
    finally:
        spark.conf.unset(_BATCH[0]) if kept is None else spark.conf.set(_BATCH[0], kept)
