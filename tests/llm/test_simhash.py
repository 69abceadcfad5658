import random

import numpy as np
import xxhash

from agrolens.llm import simhash
from agrolens.llm.components import connected_components
from tests.llm.helpers import awkward_docs, empty_like, words_of

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_print(text):
    w = words_of((text or "").translate(str.maketrans(_UP, _UP.lower())))
    g = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    groups = brute_groups(prints, 3)
    least = {}
    for r, g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {r.doc_id: (f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups, strict=True)}


def test_links_span_the_same_components(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:6]:  # chains and crowds, one large enough to be cut into chunks
        for _ in range(300 if b == base[0] else 30):
            x = b
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance, blocks in ((3, 6), (3, 4), (1, 3), (0, 2)):
        links = simhash.fingerprint_links(fps, distance, blocks)
        got = {r.node: r.root for r in connected_components(links).collect()}
        want = brute_groups(prints, distance)
        pairs = {(signed[i], signed[want[i]]) for i in range(len(prints))}
        seen = {}
        for x, g in pairs:
            seen.setdefault(g, set()).add(got.get(x, x))
        assert all(len(v) == 1 for v in seen.values())
        assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == {(f"{brute_print(docs.where('doc_id = 1').first().text):016x}", 1)}
    assert by[2] == {(next(iter(by[1]))[0], 1)}
    zero = "0" * 16
    assert by[3] == by[4] == by[5] == {(zero, 3)} and (zero, 3) in by[None]
    left = simhash.simhash_dedup(docs)
    assert left.columns == docs.columns
    assert [r.doc_id for r in left.collect()].count(1) == 1 and not left.where("doc_id in (2, 4, 5)").count()
    assert simhash.simhash_components(empty_like(docs)).count() == simhash.simhash_dedup(empty_like(docs)).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 5 + [(None, "x y z")] * 3, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.simhash_dedup(docs).collect()) == [(0, "x y z"), (1, "a b c d")]


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 900)] + [(1000, 1000), (1001, 1002), (1002, 1001), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(101)} == {0} and {got[i] for i in range(500, 900)} == {500} and got[1002] == 1001 and 1000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
