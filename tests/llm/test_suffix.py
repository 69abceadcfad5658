import collections
import random

import pytest

from agrolens.llm import suffix
from tests.llm.helpers import awkward_docs, empty_like, words_of


def brute(rows, least):
    """(doc_id, start, words, again words) of maximal covered runs, and the words left per row."""
    texts = [(i, words_of(t)) for i, t in rows]
    count, first = collections.Counter(), {}
    for k, (_, w) in enumerate(texts):
        for s in range(len(w) - least + 1):
            count[g := tuple(w[s:s + least])] += 1
            first.setdefault(g, (k, s))
    out, left = [], []
    for k, (i, w) in enumerate(texts):
        rep, again = [False] * len(w), [False] * len(w)
        for s in range(len(w) - least + 1):
            g = tuple(w[s:s + least])
            if count[g] > 1:
                rep[s:s + least] = [True] * least
                if first[g] != (k, s):
                    again[s:s + least] = [True] * least
        s = 0
        while s < len(w):
            e = s
            while e < len(w) and rep[e]:
                e += 1
            if e > s:
                out.append((i, s, e - s, sum(again[s:e])))
            s = max(e, s + 1)
        left.append([x for x, y in zip(w, again, strict=True) if not y])
    return out, left


def key(row):
    return [(x is None, x or 0) for x in row]


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    want, left = brute(docs.select("doc_id", "text").collect(), 50)
    assert sorted(map(tuple, suffix.repeated_passages(docs).collect()), key=key) == sorted(want, key=key)
    cut = {r.doc_id: words_of(r.text) for r in suffix.remove_repeats(docs).collect()}
    for r, w in zip(docs.select("doc_id", "text").collect(), left, strict=True):
        assert cut.get(r.doc_id, []) == w


@pytest.mark.parametrize("least", [4, 7, 10])
def test_small_alphabets(spark, least):
    """Few words make overlapping, periodic and nested repeats."""
    rng = random.Random(least)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want, left = brute(rows, least)
    assert sorted(map(tuple, suffix.repeated_passages(docs, least=least).collect())) == sorted(want)
    cut = {r.doc_id: words_of(r.text) for r in suffix.remove_repeats(docs, least=least).collect()}
    assert all(cut.get(i, []) == w for (i, _), w in zip(rows, left, strict=True))


def test_white_space_around_cuts_stays(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{passage}"), (2, f"left\n\n{passage}\n\nright"), (3, passage)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.text for r in suffix.remove_repeats(docs).collect()}
    assert got == {1: passage, 2: "left\n\nright"}  # nothing is left of 3


def test_awkward_rows(spark):
    docs = awkward_docs(spark).coalesce(1)
    want, left = brute(docs.select("doc_id", "text").collect(), 50)
    assert sorted(map(tuple, suffix.repeated_passages(docs).collect()), key=key) == sorted(want, key=key)
    out = suffix.remove_repeats(docs)
    assert out.columns == docs.columns
    kept = sorted(" ".join(words_of(r.text)) for r in out.collect())
    had = [r.text for r in docs.select("text").collect()]
    assert kept == sorted(" ".join(w) for w, t in zip(left, had, strict=True) if w or not words_of(t))
    assert suffix.repeated_passages(empty_like(docs)).count() == suffix.remove_repeats(empty_like(docs)).count() == 0
