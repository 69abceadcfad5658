"""unseen_labels counts rows of one written table, not three times from the readings."""

from __spark_entry__ import SMOKE_DIR, queries


def test_labels_are_written_once(spark):
    out = queries()["unseen_labels"](spark, SMOKE_DIR)
    assert out.inputFiles() and not any("lineitem" in f for f in out.inputFiles())
