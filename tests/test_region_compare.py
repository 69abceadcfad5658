"""region_compare ranks and averages rows of one written table."""

from __spark_entry__ import SMOKE_DIR, queries


def test_labels_are_written_once(spark):
    out = queries()["region_compare"](spark, SMOKE_DIR)
    assert out.inputFiles() and not any("lineitem" in f for f in out.inputFiles())
