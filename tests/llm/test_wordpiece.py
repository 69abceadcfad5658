import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from agrolens.llm import queries, wordpiece
from tests.llm.helpers import awkward_docs, empty_like


def greedy(word, initial, continuing):
    n = at = 0
    while at < len(word):
        some = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in some), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


_piece = st.lists(st.sampled_from(b"abc"), min_size=1, max_size=6).map(bytes)


@settings(max_examples=300, deadline=None)
@given(st.sets(_piece, max_size=12), st.sets(_piece, max_size=12), st.lists(st.lists(st.sampled_from(b"abcd"), min_size=1, max_size=15).map(bytes), max_size=10))
def test_counts_are_greedy(initial, continuing, found):
    a = wordpiece.Automaton(initial, continuing)
    b = wordpiece.Automaton.__new__(wordpiece.Automaton)
    b.__setstate__(a.__getstate__())
    for w in found:
        assert a.count(w) == b.count(w) == greedy(w, initial, continuing)


def test_documents_match_brute_force(spark, sf):
    initial, continuing = map(set, wordpiece.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_wordpiece"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(w), sum(greedy(x, initial, continuing) for x in w))


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    vocabulary = ([b"o", b"on"], [b"n", b"e"])
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in wordpiece.token_counts(docs, vocabulary).collect())
    want = []
    for r in docs.collect():
        w = (r.text or "").encode().split()
        want.append((r.doc_id or 0, len(w), sum(greedy(x, set(vocabulary[0]), set(vocabulary[1])) for x in w)))
    assert got == sorted(want)
    assert wordpiece.token_counts(empty_like(docs), vocabulary).count() == 0
    assert all(r.n_tokens == r.n_words for r in wordpiece.token_counts(docs, ([], [])).collect())
