import math

import numpy as np
import pytest

from agrolens.llm import topk
from tests.llm.helpers import CLASHES


def brute(rows, k=10, scale=1024, every=100):
    ok = []
    for n, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((n, i, [math.floor(scale * x) for x in v]))
    out = []
    for n, i, v in ok:
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, m) for m, j, w in ok if m != n and len(w) == len(v)]
            out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def key(r):
    return [(x is None, x or 0) for x in r]


def same(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.top_inner(df, **more).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("spread", ["even", "wide", "grouped", "ties"])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    n, d = 900, 12
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if spread == "wide":
        v *= rng.lognormal(0, 2, n)[:, None]
    if spread == "grouped":
        v = v[rng.integers(0, 9, n)] + rng.normal(size=(n, d)) * .05
    if spread == "ties":
        v = rng.integers(-1, 2, (n, d)) / 1024
    same(spark, [(i, x.tolist()) for i, x in enumerate(v)], bucket=64, block=4, stripes=3)


def test_pruning_skips_and_keeps():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(500, 8)) * np.sort(rng.lognormal(0, 1, 500))[::-1][:, None]
    m = np.rint(1024 * m[np.argsort(-np.linalg.norm(m, axis=1))])
    bucket = topk._Bucket(m, list(range(500)), list(range(500)))
    for q in np.rint(1024 * rng.normal(size=(30, 8))):
        score = m @ q
        for least in np.quantile(score, [.1, .5, .9, .99, 1.0]).tolist() + [score.max() * 50]:
            rows = topk._candidates(q, bucket, least, float(np.linalg.norm(q)))
            want = set(np.flatnonzero(score >= least).tolist())
            assert want <= set([] if rows is None else rows.tolist())
        assert len(topk._candidates(q, bucket, float(score.max()), float(np.linalg.norm(q)))) < 500
        assert topk._candidates(q, bucket, score.max() * 50, float(np.linalg.norm(q))) is None


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, [-1.5, .3]), (300, None), (400, []), (500, [nan, 1.0]), (600, [inf, 1.0]),
            (700, [None, 1.0]), (800, [1.0, 2.0, 3.0]), (5, [3.0, 1.0, 1.0]), (None, [9.0, 9.0]), (None, [9.0, 9.0]), (1, [1.0, 2.0]), (900, [2.0])]
    same(spark, rows)
    same(spark, [(i, [1.0, 0.5]) for i in range(0, 400)])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    wide = df.withColumns({c: F.lit(1) for c in [*CLASHES, "norm", "dim", "stripe", "block", "rank", "score"]})
    assert topk.top_inner(wide).count() == topk.top_inner(df).count()
    assert topk.top_inner(df.where("false")).count() == 0 and topk.top_inner(df.where("vec_id = 5")).count() == 0


def test_long_vectors_take_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(120, 2)))]
    rows += [(201 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 2)) * 3e5)]  # scaled beyond 2**28
    small = rows[:120] + [(501, [7e11, 0.0]), (502, [3.0, -6e11])]
    rows += [(300, [2.2e6 + 1 / 1024, -1e6]), (400, [0.0, 2.2e6]), (501, [3.5e6, 0.0]), (502, [3e5, 2.2e6 + 1 / 1024])]  # beyond 2**31
    same(spark, rows, bucket=16, block=2, stripes=3)
    same(spark, small, bucket=16, block=2, stripes=3)


def test_products_are_exact_or_fail(spark):
    m = np.array([[2.0 ** 40 + 1, 3], [2.0 ** 52 + 1, 2.0 ** 52 - 1], [1, 0], [0, 0], [2.0 ** 70, -2.0 ** 70]])
    for q in ([2.0 ** 40 - 1, 5], [2.0 ** 70, 2.0 ** 70], [3, 4], [0, 0]):
        want = [sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in m]
        assert topk._products(m, np.array(q, float)).tolist() == want
    huge = spark.createDataFrame([(0, [1e12, 0.0]), (1, [1e12, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a score exceeds a long"):
        topk.top_inner(huge).collect()


def test_floats_scale_as_doubles(spark):
    rows = spark.createDataFrame([(0, [0.1, 0.7]), (1, [0.3, -0.2]), (2, [0.0009765625, 1.0])], "vec_id long, embedding array<float>")
    vec = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in rows.collect()}
    got = {r.vec_id: r.score for r in topk.top_inner(rows).collect()}
    assert got == {i: sum(a * b for a, b in zip(vec[0], vec[i], strict=True)) for i in (1, 2)}


def test_components_beyond_a_double_once_scaled_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (100, [1e306, 0.0]), (1, [0.5, 0.5]), (2, [-1.7e308, 1.0])]
    got = topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1)]
