"""Operators with distributed algorithms: exact medians, skew-safe ranking,
upsert invariants, partition independence, fallback values, ranking ties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from agrolens.constants import CROPS
from agrolens.functions.composites import CompositeText
from agrolens.functions.fallback import FallbackText
from agrolens.operators import joins as J
from agrolens.operators import ranking as RK
from agrolens.operators.features import grid_stats
from agrolens.operators.quantiles import column_medians, exact_medians
from agrolens.sources import fixtures as FX


def test_exact_medians_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(7)
    parts = [pd.DataFrame({"g": "hot", "v": rng.normal(size=3000)}),           # a third of the rows
             pd.DataFrame({"g": "ties", "v": np.repeat([1.0, 2.0, 2.0, 9.0], 250)}),
             pd.DataFrame({"g": "even", "v": [1.0, 2.0, 4.0, 10.0]}),
             pd.DataFrame({"g": "one", "v": [5.5]}),
             pd.DataFrame({"g": "wide", "v": np.concatenate([rng.exponential(size=4000) * 1e6, [1e-300]])})]
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf)
    for buckets in (16, 1024):  # few buckets force many passes
        got = {r["g"]: r["median"] for r in exact_medians(df, ["g"], "v", buckets=buckets).collect()}
        for g, sub in pdf.groupby("g"):
            assert got[g] == float(np.median(sub["v"].to_numpy())), g


def test_exact_medians_of_extreme_values(spark):
    inf, big = float("inf"), 1.7e308
    groups = {"inf": [1.0, 3.0, inf], "most": [-inf, inf, inf, inf, 2.0], "ends": [-big, big, 1.0, 2.0, 3.0, 4.0], "null": [None, float("nan"), 7.0],
              "tiny": [5e-324, 1e-323, 0.0, -5e-324, 1.0], "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 2**-50, 1.0 - 2**-53],
              "neg": [-1e300, -1e-300, -5.0, -7.0, -1e10, 0.0], "large": [1e15 + i for i in range(40)], "none": [None, None]}
    rows = [(g, v, None if v is None else -v) for g, vs in groups.items() for v in vs * 3]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0)], "g string, v double, w double")
    got = {(r["g"], r["col"]): r["median"] for r in column_medians(df, ["g"], ["v", "w"], buckets=8).collect()}
    for g, vs in groups.items():
        full = sorted(v for v in vs * 3 if v is not None and v == v)
        if not full:
            assert (g, "v") not in got
            continue
        m = (full[(len(full) - 1) // 2] + full[len(full) // 2]) / 2
        assert got[g, "v"] == m and got[g, "w"] == -m, g
    whole = {r["col"]: r["median"] for r in column_medians(df.where("g = 'inf'"), [], ["v"]).collect()}
    assert whole == {"v": 3.0}


def test_regression_metrics_of_any_size(spark):
    from agrolens.operators.quality import reg_metrics
    for size in (4e-6, 1.0, 4e4, 1e6, 1e150):
        y = [float(i) for i in range(1, 9)]
        df = spark.createDataFrame([("t", v, v + size) for v in y] + [("t", None, 1.0)], "target string, y double, yhat double")
        r = reg_metrics(df).first()
        assert r["n_samples"] == 8
        assert np.isclose(r["rmse"], size, rtol=1e-6) and np.isclose(r["mae"], size, rtol=1e-6)
        assert np.isclose(r["r2"], 1 - size ** 2 / np.var(y), rtol=1e-6)
    one = spark.createDataFrame([("t", 2.0, 2.0), ("t", 2.0, 2.0), ("u", 2.0, 3.0), ("u", 2.0, 2.0)], "target string, y double, yhat double")
    assert {r["target"]: r["r2"] for r in reg_metrics(one).collect()} == {"t": 1.0, "u": 0.0}


def test_means_outside_the_exact_range(spark):
    from agrolens.operators.features import exact_avg_sql
    df = spark.createDataFrame([("a", 1e12), ("a", 3e12), ("b", 0.1), ("b", 0.2), ("c", None)], "g string, x double")
    for bounded in (False, True):
        got = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.expr(exact_avg_sql("x", bounded=bounded)).alias("m")).collect()}
        assert got["a"] == 2e12 and abs(got["b"] - 0.15) < 1e-12 and got["c"] is None


def test_upsert_of_repeated_keys_keeps_the_row_count(spark):
    master = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), (None, 3.0, 3)], "k string, x double, z int")
    upd = spark.createDataFrame([("b", 5.0, 7), ("b", 9.0, 1), ("b", 9.0, 4), (None, 8.0, 8), ("z", 1.0, 1)], "k string, x double, z int")
    out = sorted(((r["k"] or "", r["x"], r["z"], r["_updated"]) for r in J.upsert(master, upd, "k").collect()))
    assert out == [("", 3.0, 3, False), ("a", 1.0, 1, False), ("b", 9.0, 4, True)]


def test_rank_within_matches_pandas(spark):
    pdf = pd.DataFrame({"region": ["a"] * 500 + ["b"] * 37, "k": [f"{i:05d}" for i in range(537)]})
    df = spark.createDataFrame(pdf.sample(frac=1.0, random_state=3))
    got = RK.rank_within(df, ["region"], "k", partitions=7).toPandas().sort_values("k")
    exp = pdf.assign(rn=pdf.groupby("region").cumcount() + 1)
    assert got["rn"].tolist() == exp["rn"].tolist()
    assert set(got.loc[got.region == "a", "rn_n"]) == {500}


def test_upsert_keeps_rows_overwrites_nulls_ignores_unknown(spark):
    master = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, x double")
    upd = spark.createDataFrame([("b", None, 1), ("b", 20.0, 2), ("c", None, 1), ("z", 9.0, 1)],
                                "k string, x double, v int")
    out = {r["k"]: (r["x"], r["_updated"]) for r in J.upsert(master, upd, "k", order_col="v").collect()}
    assert out == {"a": (1.0, False), "b": (20.0, True), "c": (None, True)}


def test_grid_stats_do_not_depend_on_partitioning(spark, sf):
    """Means, minima and maxima are bit-identical for any partitioning (exact
    sums); std-derived columns (cv) agree to 1e-12."""
    om = FX.obs_month(spark, sf)
    a = grid_stats(om.repartition(1)).toPandas().sort_values("grid_id").reset_index(drop=True)
    b = grid_stats(om.repartition(7, "year_month")).toPandas().sort_values("grid_id").reset_index(drop=True)
    exact = [c for c in a.columns if not c.endswith("_cv")]
    pd.testing.assert_frame_equal(a[exact], b[exact], check_exact=True)
    cv = [c for c in a.columns if c.endswith("_cv")]
    pd.testing.assert_frame_equal(a[cv], b[cv], check_exact=False, rtol=1e-12, atol=1e-15)


def test_fallback_values_by_hand(spark):
    df = spark.createDataFrame([("test_001", 0.65, 14.2, 6.5)],
                               "system_index string, ndvi_median_mean double, soil_soc_g_kg_0_30cm double, "
                               "soil_ph_h2o_0_30cm double")
    fx = FallbackText("spark", df.columns, {c: "double" for c in df.columns[1:]}).exprs()
    row = df.selectExpr(*[f"{v} AS {t}" for t, (v, _) in fx.items()],
                        *[f"{lab} AS {t}_label" for t, (_, lab) in fx.items()]).first()
    s = 0.65 * 0.4 + min(14.2 / 25.0, 1.0) * 0.3 + min(0.28 / 0.4, 1.0) * 0.3
    assert abs(row["crop_suitability_maize"] - s) < 1e-12 and row["crop_suitability_maize_label"] == "good"
    assert row["irrigation_need"] == 0                      # moisture .28 < .28 false, precip 120 < 100 false
    assert row["heat_stress_risk"] == 0 and row["optimal_planting_month"] == 5
    assert row["phosphorus_requirement_level"] == 1 and row["nitrogen_requirement_level"] == 1
    assert row["current_month_precipitation_mm"] == 0.5    # service name drift -> generic estimator
    assert row["agricultural_gdp_forecast"] == round(1250.0 * (0.65 / 0.5) * (14.2 / 12.0), 2)


def test_recommender_ties_keep_crop_order(spark):
    cols = {f"crop_suitability_{c}": "good" for c in CROPS}
    cols.update({f"crop_area_pct_{c}": 0.0 for c in CROPS})
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(
        f"{k} {'string' if k.startswith('crop_s') else 'double'}" for k in cols))
    C = CompositeText("spark", df.columns, {k: ("string" if k.startswith("crop_s") else "double") for k in cols})
    recs = C.recommender_rows(df, [], None).orderBy("rank").collect()
    assert [x["crop"] for x in recs] == CROPS
    assert [x["suitability_score"] for x in recs][:3] == [75.0, 74.9, 74.8]


def test_every_nth_sample_size(spark):
    df = spark.range(0, 2000).select(F.lit("r").alias("region"), F.format_string("%05d", "id").alias("k"))
    assert RK.every_nth(df, ["region"], "k", 400).count() == 400


def test_stratified_cuts_are_exact(spark):
    from agrolens.operators import ml as ML
    rows = [(f"k{i}", "a" if i % 3 else "b", None if i % 5 else "only") for i in range(997)] + [("z", "single", None)]
    df = spark.createDataFrame(rows, "k string, x string, y string")
    cuts = ML.stratified_cuts(df, {"x": "x", "y": "y"}, "k", (0.2, 0.4, 0.6, 0.8))
    got = df.select("x", "y", ML.part_expr(cuts["x"], "x", "k").alias("p"), ML.part_expr(cuts["y"], "y", "k").alias("q"))
    for col, part in (("x", "p"), ("y", "q")):
        sizes = {(r[col], r[part]): r["count"] for r in got.groupBy(col, part).count().collect()}
        for c in {r[0] for r in sizes if r[0] is not None}:
            n = sum(v for (a, _), v in sizes.items() if a == c)
            ends = [0, *[int(f * n + 0.5) for f in (0.2, 0.4, 0.6, 0.8)], n]
            assert [sizes.get((c, i), 0) for i in range(5)] == [b - a for a, b in zip(ends, ends[1:], strict=False)]
    assert got.where("y IS NULL AND q IS NOT NULL").count() == 0


def test_resolve_targets_keeps_order_without_duplicates():
    from agrolens.operators.catalog_ops import resolve_targets
    out = resolve_targets(["drought_risk_score", "crop_health_score"], ["crop_health", "risk_alerts"])
    assert out[:2] == ["drought_risk_score", "crop_health_score"]
    assert len(out) == len(set(out)) and "flood_risk_level" in out


def test_fingerprint_sees_every_column_and_no_order(spark):
    from agrolens.operators import quality as QA
    rows = [(1, "a", 0.1, True, None, 1.5), (2, "a|b", 1e300, False, "x", float("nan")), (3, None, -0.0, None, "", float("inf")),
            (4, "é", 5e-324, True, "n", -2.0 ** 60), (4, "é", 5e-324, True, "n", -2.0 ** 60)]
    schema = "i int, s string, d double, b boolean, n string, f double"
    of = lambda r: tuple(QA.content_fingerprint(spark.createDataFrame(r, schema)).first())
    base = of(rows)
    assert base[0] == 5 and of(rows[::-1]) == base
    changed = {0: 9, 1: "z", 2: 0.1000000000000000055511151231257827 * (1 + 2 ** -52), 3: False, 4: "", 5: 1.5000000000000002}
    for at, v in changed.items():
        other = [tuple(v if k == at else x for k, x in enumerate(rows[0])), *rows[1:]]
        assert of(other) != base, at
    assert of(rows[:-1]) != base and of([*rows, rows[0]]) != base
    # adjacent texts do not run into one another; doubles of neighbouring exponents and powers of two differ
    assert of([(1, "a|n=sx", 1.0, None, "y", 1.0)]) != of([(1, "a", 1.0, None, "x|y", 1.0)])
    many = [2.0 ** k for k in range(-1074, 1024)] + [2.0 ** k * (1 + 2 ** -52) for k in range(-1000, 1000)] + [2.0 ** k * (2 - 2 ** -52) for k in range(-1000, 1000)]
    d = spark.createDataFrame([(x,) for x in many + [-x for x in many]], "d double")
    assert QA.encoded_rows(d, []).distinct().count() == 2 * len(many)
    import re
    for r, x in zip(QA.encoded_rows(spark.createDataFrame([(x,) for x in many], "d double").coalesce(1), []).collect(), many, strict=True):
        m, e = re.fullmatch(r"d=d(\d+)p(-?\d+)", r["_row"]).groups()
        assert 2 ** 52 <= int(m) < 2 ** 53 and int(m) * 2.0 ** (int(e) - 52 if int(e) > -900 else 0) == (x if int(e) > -900 else int(m))


def test_health_summary_counts_overall(spark):
    from agrolens.operators import quality as QA
    issues = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y"), ("b", "X"), ("unknown", "Z")], "target string, issue string")
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    got = {(r["scope"], r["target"]): tuple(r)[2:] for r in QA.health_summary(issues, targets).collect()}
    assert got == {("target", "a"): (2, "X | Y", 0, 1), ("target", "b"): (1, "X", 0, 1), ("target", "c"): (0, "", 1, 0), ("overall", None): (3, "X | Y", 1, 2)}


def test_approximate_medians_stay_within_their_rank(spark):
    from agrolens.operators import cleaning as CL
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.lognormal(0, 3, 4000), np.full(1000, 7.0)])
    df = spark.createDataFrame([("h", float(v)) for v in values] + [("s", 1.0), ("s", 2.0), ("e", None), ("s", float("nan"))], "g string, v double").repartition(7)
    got = {r["g"]: r["median"] for r in CL.approximate_medians(df, ["g"], ["v"], 100).collect()}
    rank = (values < got["h"]).sum(), (values <= got["h"]).sum()
    assert rank[0] <= 2500 + 51 and rank[1] >= 2500 - 51 and got["s"] in (1.0, 2.0) and "e" not in got
    filled = CL.median_impute(df, ["v"], ["g"], accuracy=100)
    assert filled.where("v IS NULL OR isnan(v)").count() == 1 and filled.count() == df.count()
