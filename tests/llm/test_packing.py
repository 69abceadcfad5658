import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from agrolens.llm import packing, queries
from tests.llm.helpers import awkward_docs, empty_like, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window=2048):
    """Every id of every document row lies in exactly one piece; sequences have no gaps."""
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in docs:
        want[i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    full = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
        full += at == window
    got = collections.Counter()
    for i, some in pieces.items():
        # equal ids: put pieces together by their place; repeated rows have every place as often
        by = collections.defaultdict(list)
        for r in some:
            by[r.start].append(r)
        chains = [(i, bytes(r.ids), r.doc_tokens) for r in by[0]]
        grown = True
        while grown:
            grown = False
            for k, (_, data, n) in enumerate(chains):
                for r in by.get(len(data) // 4, []) if len(data) < 4 * n else []:
                    if r.doc_tokens == n and any(w[0] == i and w[1].startswith(data + bytes(r.ids)) for w in want):
                        by[r.start].remove(r)
                        chains[k] = (i, data + bytes(r.ids), n)
                        grown = True
                        break
        for _, data, n in chains:
            assert len(data) == 4 * n
            got[i, data] += 1
    assert got == want
    return full, len(sequences)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    full, sequences = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert full >= sequences - 1
    query = queries.QUERIES["op4_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in query) == sorted((r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows)


def test_neighbours_share_words():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * k, 100 * k + 60, 150).astype("<u4") for k in range(5)]
    tokens = [np.concatenate([rng.permutation(topics[i % 5])[:90], [1]]).astype("<u4") for i in range(100)]
    windows = list(packing.fill_windows(tokens, 910))
    pure = sum(len({d % 5 for d, _, _ in w}) == 1 for w in windows)
    assert pure >= len(windows) - 1


def test_scores_are_bm25():
    tokens = [np.array(t, "<u4") for t in ([1, 2, 2, 3], [2, 3, 4], [5, 1], [1], [9], [9], [9, 3])]
    got = packing._Index(tokens).scores(0)
    n, mean = 7, 2.0
    for d, t in enumerate(tokens):
        want = 0.0
        for q in (1, 2, 3):
            tf, df = int((t == q).sum()), sum(q in x for x in tokens)
            want += np.log1p((n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(t) / mean))
        assert abs(got[d] - want) < 1e-9


def bm25(tokens):
    """Scores of all pairs, term by term."""
    n, mean = len(tokens), np.mean([len(t) for t in tokens])
    counts = [collections.Counter(t.tolist()) for t in tokens]
    df = collections.Counter(q for c in counts for q in c)
    out = np.zeros((n, n))
    for s in range(n):
        for d in range(n):
            for q in sorted(counts[s].keys() & counts[d].keys()):
                tf = counts[d][q]
                out[s, d] += np.log1p((n - df[q] + .5) / (df[q] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(tokens[d]) / mean))
    return out


def slow_fill(tokens, window):
    """Windows filled by the rule as stated, a document at a time."""
    score, used, out, carry = bm25(tokens), [0] * len(tokens), [], None
    texts = [t.tobytes() for t in tokens]
    while carry is not None or 0 in used:
        seed = carry if carry is not None else used.index(0)
        n = min(window, len(tokens[seed]) - used[seed])
        pieces, room = [(seed, used[seed], n)], window - n
        used[seed] += n
        carry = seed if used[seed] < len(tokens[seed]) else None
        here = {texts[seed]}
        while room:
            free = [d for d in range(len(tokens)) if not used[d]]
            if not free:
                break
            other = [d for d in free if texts[d] not in here] or free
            d = max(other, key=lambda d: (round(score[seed, d], 9), -d))
            n = min(room, len(tokens[d]))
            pieces.append((d, 0, n))
            here.add(texts[d])
            used[d], room = n, room - n
            if n < len(tokens[d]):
                carry = d
        out.append(pieces)
    return out


def test_fill_as_brute_force():
    for k in range(6):
        rng = np.random.default_rng(k)
        tokens = [rng.zipf(1.4, rng.integers(1, 60)).clip(max=300).astype("<u4") for _ in range(90)]
        tokens += [tokens[i] for i in rng.integers(0, 6, 30)]  # copies
        assert list(packing.fill_windows(tokens, 100)) == slow_fill(tokens, 100)


def test_scores_in_few_blocks():
    rng = np.random.default_rng(3)
    tokens = [rng.zipf(1.3, rng.integers(1, 80)).clip(max=500).astype("<u4") for _ in range(60)]
    want = bm25(tokens)
    for cells in (1, 600, 1 << 23):
        index = packing._Index(tokens, cells=cells)
        for s in rng.permutation(60):
            assert np.allclose(index.scores(s), want[s], atol=1e-9)


def dealt(spark, docs, shard_bytes):
    ids = packing.encode_docs(docs, PATH, "doc_id", "text")
    ranks, position = packing.term_ranks(ids)
    return packing.deal(packing.with_places(ids, ranks), position, shard_bytes).select("id", "shard", "size", "first", "second").collect()


def recall(spark, n, shard_bytes):
    """Share of the best five neighbours in the whole corpus that lie in the document's shard, and a shard's share of it."""
    topics = [[f"{prose(1000 + k, 1)}{chr(97 + k % 26)}{j}" for j in range(40)] for k in range(n // 20)]
    rng = np.random.default_rng(5)
    common = [f"the{j}" for j in range(50)]
    texts = [" ".join([*rng.choice(topics[i % len(topics)], 60), *rng.choice(common, 60)]) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shard = {r.id: r.shard for r in dealt(spark, docs, shard_bytes)}
    encoder = packing.Encoder(PATH)
    index = packing._Index([np.frombuffer(encoder.encode(t.encode()), "<u4") for t in texts])
    hits = 0
    for i in range(0, n, 5):
        score = index.scores(i)
        score[i] = -1
        hits += sum(shard[i] == shard[j] for j in np.argsort(-score)[:5].tolist())
    return hits / n, 1 / len(set(shard.values()))


def test_neighbours_meet_in_a_shard(spark):
    """By content neighbours meet far more often than by chance, also when the corpus has more shards."""
    for n in (400, 1600):
        got, chance = recall(spark, n, 16_000)
        print(n, got, chance)
        assert got > 0.2 and got > 4 * chance


def test_copies_fill_many_shards(spark):
    """A third of all rows being one document neither makes one shard large nor loses a row."""
    rows = [(i, prose(7, 100) if i % 3 == 0 else None if i % 50 == 1 else prose(100 + i, 100)) for i in range(900)]
    got = dealt(spark, spark.createDataFrame(rows, "doc_id long, text string"), 10_000)
    assert sorted(r.id for r in got) == list(range(900))
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert len({r.shard for r in got if r.id % 3 == 0}) >= 10
    assert max(size.values()) < 3 * 10_000
    assert len(size) < 3 * sum(size.values()) / 10_000


def test_short_documents_bound_a_shard(spark):
    """Empty texts count, too: no shard holds more than shard_bytes / DOC_BYTES of them, or nearly so."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 2 = 0, NULL, '') AS text")
    got = collections.Counter(r.shard for r in dealt(spark, docs, 100 * packing.DOC_BYTES))
    assert sum(got.values()) == 3000 and max(got.values()) < 200


def test_equal_documents_share_no_window():
    a, b = np.arange(100, dtype="<u4"), np.arange(200, 290, dtype="<u4")
    windows = list(packing.fill_windows([a, a, a, b, b, b], 190))
    assert all(sorted(d // 3 for d, _, _ in w) == [0, 1] for w in windows)


def test_encoder_memory_limit(monkeypatch):
    monkeypatch.setattr(packing, "_WORDS", 50)
    e, t = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    letters = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180)]))
    rng = np.random.default_rng(2)
    for k in range(60):
        text = " ".join("".join(rng.choice(list(letters), 5)) + rng.choice(["", ".", ",", "!?", "...", "....", "'s", "e\u0301"]) for _ in range(30))
        text += prose(k, 40, 60) + " it's <|endoftext|> naïve\u3000x\x1cy"
        assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(packing.pack(docs, PATH).collect(), rows)
    check(packing.pack(docs, PATH, window=64, shard_bytes=2000).collect(), rows, 64)
    assert packing.pack(empty_like(docs), PATH).count() == 0
