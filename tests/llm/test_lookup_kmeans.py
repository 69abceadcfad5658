import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolens.llm import lookup_kmeans as op
from agrolens.llm.vectors import LONG, digits
from tests.llm.helpers import CLASHES

NAN, INF = float("nan"), float("inf")


def brute(rows, dim, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2 ** 40 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))[:k]
    c = [v for _, v in seeds]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    for _ in range(rounds):
        own = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        for j in range(len(c)):
            if some := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    own = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in kept]
    per = [sum(d for d, o in own if o == j) for j in range(len(c))]
    cut = lambda x: x if x < LONG else None
    return [(i, j, cut(d), cut(per[j]), cut(sum(per)), ",".join(map(str, c[j]))) for (i, _), (d, j) in zip(kept, own, strict=True)]


def key(r):
    return [(x is None, x or 0) if not isinstance(x, str) else x for x in r]


def got(df, dim, **more):
    rows = op.clustered(df, dim=dim, **more).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, ",".join(r.centroid)) for r in rows), key=key)


@pytest.mark.parametrize("kind", ["even", "grouped", "ties", "wide"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 6)) / 8
    if kind == "grouped":
        v = v[rng.integers(0, 5, 400)]  # fewer different vectors than centroids: some stay empty
    if kind == "ties":
        v = rng.integers(-1, 2, (400, 6)) / 1024
    if kind == "wide":
        v *= 10.0 ** rng.integers(-3, 9, (400, 1))
    rows = [(i * 3, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert got(df, 6, block=50) == sorted(brute(rows, 6), key=key)


def test_awkward_rows(spark):
    rows = [(1, [0.5, 0.1]), (1, [0.5, 0.1]), (2, [NAN, 1.0]), (3, [INF, 1.0]), (4, [None, 1.0]), (5, None), (6, []), (7, [1.0]), (8, [1.0, 2.0, 3.0]),
            (None, [0.2, -0.7]), (10, [-0.3, 0.0]), (11, [-1e-9, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(brute(rows, 2), key=key)
    assert len(want) == 5 and got(df, 2) == want
    wide = df.withColumns({c: F.lit(1) for c in [*CLASHES, "cluster", "distance", "dim", "units", "inertia", "label"] if c not in df.columns})
    assert got(wide, 2) == want
    assert op.clustered(df.where("false")).count() == 0 and op.clustered(df, dim=5).columns[0] == "vec_id"
    named = df.withColumn("vec_id", F.concat(F.lit("é"), "vec_id"))
    assert {r.vec_id for r in op.clustered(named, dim=2).collect()} == {"é1", None, "é10", "é11"}


def test_components_of_any_size(spark):
    rows = [(1, [3e300, -2e300]), (2, [1e308, 1e308]), (3, [0.25, 0.5]), (4, [2.0 ** 60, 1.0]), (5, [-3e5, 2e5]), (6, [1e6, -1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (2, 8):
        assert got(df, 2, k=k) == sorted(brute(rows, 2, k), key=key)


def test_tables_hold_a_row_for_each_occurring_value():
    m = np.array([[1, 5], [1, 7], [2, 5], [1, 5]]) / 4
    e = op._encode(m)
    sizes, values = np.frombuffer(e["sizes"], "<i4"), (np.frombuffer(e["values"], "<f8") * 4).astype(int)
    assert sizes.tolist() == [2, 2] and values.tolist() == [1, 2, 5, 7]
    centroids = np.array([[0, 0], [2, 6]])
    t = op.tables(values, sizes, centroids)
    assert t.tolist() == [[1, 1], [4, 0], [25, 1], [49, 1]]
    codes = np.frombuffer(e["codes"], "<u2").reshape(2, 4)
    assert op.distances(t, sizes, codes).tolist() == [[26, 2], [50, 2], [29, 1], [26, 2]]


def test_digits_add_up():
    for x in (0, 1, -1, 1 << 40, -(1 << 40) - 7, 3 ** 200, -(5 ** 90)):
        assert sum(part << (40 * place) for place, part in digits(x)) == x
