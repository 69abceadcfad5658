import collections
import itertools
import random

import pytest

from agrolens.llm import mixing, queries
from tests.llm.helpers import CLASHES, awkward_docs, empty_like, words_of


def test_documents_meet_their_targets(spark, sf):
    rows = queries.QUERIES["op1_mixing"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["size"] == len(words_of(docs[r.doc_id].text)) and 0 <= r.taken <= 3 * r["size"]
        s = docs[r.doc_id].source
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    total = sum(sizes.values())
    want, free = {}, dict(sizes)
    while free:  # one source at a time
        left, w = total - sum(want.values()), sum(weights[s] for s in free)
        s = max(free, key=lambda s: left * weights[s] / w - 3 * free[s])
        if left * weights[s] / w <= 3 * free[s]:
            want |= {s: left * weights[s] / w for s in free}
            break
        want[s] = 3.0 * free.pop(s)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
        assert {r.source_size for r in rows if docs[r.doc_id].source == s} == {sizes[s]}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.QUERIES["op1_mixing"](spark, sf).collect()))


def cheapest(supply, member, quota, copies):
    """Least cost of filling the quotas, by trying every integer flow."""
    arcs = [(p, s) for p in range(len(supply)) for s in member[p]]
    best = None
    for f in itertools.product(*[range(min(copies * supply[p], quota[s]) + 1) for p, s in arcs]):
        out, into = collections.Counter(), collections.Counter()
        for (p, s), n in zip(arcs, f, strict=True):
            out[p] += n
            into[s] += n
        if all(out[p] <= copies * supply[p] for p in out) and all(into[s] <= quota[s] for s in into):
            cost = sum(sum(2 * (k // supply[p]) + 1 for k in range(n)) for p, n in out.items())
            best = max(best or (-1, 0), (sum(f), -cost))
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(40):
        supply = [rng.randrange(1, 4) for _ in range(2)]
        member = [rng.sample(range(2), rng.randrange(1, 3)) for _ in supply]
        quota = [rng.randrange(5) for _ in range(2)]
        flow = mixing.min_cost_flow(supply, member, quota, 3)
        out = collections.Counter()
        for (p, s), n in flow.items():
            assert s in member[p] and n > 0
            out[p] += n
        cost = sum(sum(2 * (k // supply[p]) + 1 for k in range(n)) for p, n in out.items())
        assert (sum(flow.values()), -cost) == (cheapest(supply, member, quota, 3) or (0, 0))


def test_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b", "b"] if i % 3 == 1 else [None, "b"], i % 7) for i in range(3000)] + [(5000, None, 4), (5001, [], 4)]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>, n long")
    got = mixing.mix(docs, "s", "n", {"a": 4000, "b": 5000, None: 500}, ["doc_id"]).collect()
    assert sum(r.taken for r in got) == 9500
    assert all(r.taken == 0 for r in got if r.doc_id >= 5000)
    # no second copy anywhere while a pattern still has unused documents for that source
    assert max(r.taken / r.n for r in got if r.n) <= 2
    part = [r for r in got if r.n and r.taken % r.n]
    assert len(part) <= 3


def test_repeats_above_one_copy(spark):
    docs = spark.createDataFrame([(i, ["a"], 10) for i in range(100)], "doc_id long, s array<string>, n long")
    got = mixing.mix(docs, "s", "n", {"a": 2345}, ["doc_id"]).collect()
    assert collections.Counter(r.taken for r in got) == {20: 65, 30: 34, 25: 1}
    assert sum(r.taken for r in mixing.mix(docs, "s", "n", {"a": 99999}, ["doc_id"]).collect()) == 3000
    assert sum(r.taken for r in mixing.mix(docs, "s", "n", {"b": 10}, ["doc_id"]).collect()) == 0


def test_repeated_rows_and_copies(spark):
    docs = spark.createDataFrame([(1, "a  b\nc d ", 4, t) for t in (0, 3, 4, 9)], "doc_id long, text string, size long, taken long")
    got = collections.Counter(r.text for r in mixing.repeat_taken(docs, "text", "size", "taken").collect())
    assert got == {"a  b\nc": 1, "a  b\nc d ": 3, "a": 1}


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = awkward_docs(spark).withColumn("s", F.array("source")).withColumn("size", F.size(F.split("text", " ")).cast("long"))
    out = mixing.mix(docs, "s", "size", {"a": 100, None: 50, "b": 7}, ["doc_id", "text"])
    assert set(CLASHES) <= set(out.columns) and out.count() == docs.count()
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += r.taken
    assert (got["a"], got[None], got["b"], got["c"]) == (100, 50, 7, 0)
    assert mixing.mix(empty_like(docs), "s", "size", {"a": 5}, ["doc_id"]).count() == 0
