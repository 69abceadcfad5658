"""The monthly view: groups told apart by numbers, rows as by the strings."""

import datetime as dt

from pyspark.sql import functions as F

from agrolens.sources import fixtures as FX

LINES = ("l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
         "l_shipdate timestamp")


def test_months_are_those_of_the_strings(spark, tmp_path):
    day = dt.datetime(1996, 3, 4)
    rows = [(1, 1, 5.0, 900.0, 0.1, 0.02, day), (1, 7, 6.0, 100.0, 0.3, 0.01, dt.datetime(1996, 3, 9)), (1, 1, 5.0, 900.0, 0.1, 0.02, day),
            (1, 2, None, 50.0, 0.0, None, dt.datetime(1997, 3, 4)), (2, 1, 1.0, 1.0, 0.0, 0.0, day), (2, 3, 2.0, 9.0, 0.1, 0.1, None),
            (2, 4, 3.0, 2.0, 0.2, 0.0, None), (None, 1, 3.0, 2.0, 0.2, 0.0, day), (None, 1, 4.0, 2.0, 0.2, 0.0, None)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    months = FX.obs_month(spark, str(tmp_path))
    keys = ["grid_id", "system_index", "year_month"]
    plain = FX.obs(spark, str(tmp_path)).groupBy(*keys).agg(*[F.expr(f"{fn}({c}) AS {c}") for fn, c in FX.OBS_MONTH_AGGS])
    got, want = [sorted(map(repr, d.select(*plain.columns).collect())) for d in (months, plain)]
    assert got == want and len(got) == 6
    first = months.where("grid_id = 1 AND data_year = 1996").first()
    assert (first["sample_id"], first["data_month"], first["chirps_precipitation_mm"]) == ("mm_1__1996-03", 3, 40.0)


def test_no_text_is_hashed_or_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, 1, 5.0, 900.0, 0.1, 0.02, dt.datetime(1996, 3, 4))], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = FX.obs_month(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    grouped, below = plan[plan.index("Aggregate ["):].split("\n", 1)
    assert "_year" in grouped and "concat(" not in below
