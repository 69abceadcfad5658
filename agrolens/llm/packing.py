"""Operator 4: packing by lexical retrieval.

Documents are dealt to shards of about ``shard_bytes`` of text by content, so
that lexical neighbours meet: a document's key is the winner of a weighted
min-hash race over its terms (each term's fixed random draw divided by its
inverse document frequency over all documents), so two documents share their
key with the probability of their weighted Jaccard similarity.  Documents of
one key lie together; keys follow one another until a shard is full, those
whose terms keep like company side by side (a tree of splits along the main
direction of the terms' average document, in a random projection).  A key
larger than a shard has shards of its own, dealt by the race's second place,
and copies that share both places and exceed a shard are salted over several.
With more documents a shard holds fewer keys, so neighbours become closer.

A shard holds a BM25 inverted index over its documents' token ids (postings
sorted by term, weights computed once; terms in many of its documents as
matrix rows).  A seed document opens a window; the index scores the shard's
unused documents against all of the seed's terms, and the best fill the window
in turn.  The last one is cut where the window ends and its rest seeds the
next window, so every window but a shard's last is full.

The token ids are computed once and written to the shared folder.  The driver
sees one row per term of the vocabulary: document frequencies and key sizes.
"""

from __future__ import annotations

import codecs
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.llm.common import materialize, small_batches

#: What a document counts in a shard beside its text's bytes; bounds a shard's number of documents.
DOC_BYTES = 256
_DIMS = 16
_END = (1).to_bytes(4, "little")
_WORDS = 600_000
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=?@\\[-`{}~]{0,8})")


class Encoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes, every word encoded once.

    The tokenizer splits at white space and drops it, so a text's ids are the
    ids of its words; the words of the last texts are kept in two generations
    of bounded size.  A word of plain letters, with or without punctuation
    after it, is what the tokenizer's normalisation and splitting leave as one
    or two parts, which go to its model directly; any other word takes the
    whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = (b for b in range(256) if b not in plain)
        shown = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.alphabet = "".join(shown[b] for b in range(256))
        self.tails: dict[str, bytes] = {}

    def _part(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            if m := _PLAIN.fullmatch(text):
                body, tail = m.groups()
                body = body.lower()
                ids = self._part(body if body.isascii() else codecs.charmap_decode(body.encode(), "strict", self.alphabet)[0])
                if tail:
                    if tail not in self.tails:
                        self.tails[tail] = self._part(tail)
                    ids += self.tails[tail]
            else:
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def encode(self, data: bytes | None) -> bytes:
        out = b"".join(map(self.__getitem__, (data or b"").split()))
        if len(self) > _WORDS:
            self.old = dict(self)
            self.clear()
            self.tails.clear()
        return out


def _encoder(path: str) -> Encoder:
    """The worker process's encoder; it outlives a task where Spark reuses the process."""
    kept = sys.modules.setdefault("_agrolens_worker", types.ModuleType("_agrolens_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class _Index:
    """BM25 over the shard's documents; terms are token ids.

    Terms in an eighth of the documents or more are rows of a matrix, the
    others lists of postings.  The matrix's part of the scores is a product
    for a block of seeds at a time while the scores of all pairs have at most
    ``cells`` cells; else the seed's rows are added.
    """

    def __init__(self, tokens: list[np.ndarray], k1: float = 1.2, b: float = 0.75, cells: int = 1 << 23):
        self.n = n = len(tokens)
        length = np.array([len(t) for t in tokens])
        key, tf = np.unique(np.repeat(np.arange(n), length) << 32 | np.concatenate(tokens).astype(np.int64), return_counts=True)
        doc, term = key >> 32, key & 0xFFFFFFFF
        order = np.argsort(term, kind="stable")
        doc, tf = doc[order], tf[order]
        found, df = np.unique(term[order], return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / max(length.mean(), 1)))
        many = df * 8 >= n
        wide = np.repeat(many, df)
        self.matrix = np.zeros((int(many.sum()), n))
        self.matrix[np.repeat(np.cumsum(many) - 1, df)[wide], doc[wide]] = weight[wide]
        self.doc, self.weight = doc[~wide], weight[~wide]
        self.begin = np.append(0, np.cumsum(df[~many]))
        # each document's terms with postings, as places in ``begin``
        place = np.repeat(np.arange(len(self.begin) - 1), df[~many])
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms = np.split(place[by_doc], np.searchsorted(self.doc[by_doc], np.arange(1, n)))
        self.block, self.blocks = 256 if n * n <= cells else 0, {}

    def _common(self, seed: int) -> np.ndarray:
        if not self.block:
            out = np.zeros(self.n)
            for row in np.flatnonzero(self.matrix[:, seed]).tolist():
                out += self.matrix[row]
            return out
        at = seed // self.block
        if at not in self.blocks:
            some = self.matrix[:, at * self.block:(at + 1) * self.block] > 0
            self.blocks[at] = some.T.astype(np.float64) @ self.matrix
        return self.blocks[at][seed - at * self.block]

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        if not len(t):
            return self._common(seed)
        at = [slice(a, z) for a, z in zip(self.begin[t].tolist(), self.begin[t + 1].tolist(), strict=True)]
        rare = np.bincount(np.concatenate([self.doc[s] for s in at]), np.concatenate([self.weight[s] for s in at]), self.n)
        return self._common(seed) + rare


def fill_windows(tokens: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); every token lies in exactly one.

    ``tokens``: the ids of each document, none empty.  Seeds come in the given
    order.  Equal documents share a window only when nothing else is left.
    """
    known: dict[bytes, int] = {}
    twin = np.array([known.setdefault(t.tobytes(), len(known)) for t in tokens], np.int64)
    length = np.array([len(t) for t in tokens], np.int64)
    used = np.zeros(len(tokens), np.int64)
    # equal documents are used in their order: the first unused one stands for all
    order = np.argsort(twin, kind="stable")
    behind = np.full(len(tokens), -1)
    behind[order[:-1]] = np.where(twin[order[:-1]] == twin[order[1:]], order[1:], -1)
    head = order[np.searchsorted(twin[order], np.arange(len(known)))]
    index, after, carry = None, 0, None

    def take(d: int, n: int) -> tuple[int, int, int]:
        piece = (d, int(used[d]), n)
        if not used[d]:
            head[twin[d]] = behind[d]
        used[d] += n
        return piece

    while True:
        if carry is None:
            while after < len(tokens) and used[after]:
                after += 1
            if after == len(tokens):
                return
            seed = after
        else:
            seed = carry
        n = min(window, int(length[seed] - used[seed]))
        out, room = [take(seed, n)], window - n
        carry = seed if used[seed] < length[seed] else None
        if room:
            index = index or _Index(tokens)
            score = index.scores(seed)
            for twins in (False, True):
                if twins:
                    free = np.flatnonzero(used == 0)
                else:
                    free = head[(head >= 0) & (np.arange(len(head)) != twin[seed])]
                    if len(free) > room:  # a document has at least one token
                        least = np.partition(score[free], len(free) - room)[len(free) - room]
                        free = free[score[free] >= least]
                    free = np.sort(free)
                for d in free[np.argsort(-score[free], kind="stable")].tolist():
                    n = min(room, int(length[d]))
                    out.append(take(d, n))
                    room -= n
                    if not room:
                        carry = d if n < length[d] else None
                        break
                if not room:
                    break
        yield out


_IDS = "id {kind}, r long, size long, short boolean, ids binary"
_PLACES = "first int, second int"


def _tokens(table: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """The documents' token ids; those below 65,536 are stored in two bytes."""
    return [np.frombuffer(x, "<u2" if short else "<u4").astype("<u4", copy=False)
            for x, short in zip(table.column("ids").to_pylist(), table.column("short").to_pylist(), strict=True)]


def encode_docs(docs: DataFrame, tokenizer: str, doc_id: str, text: str) -> DataFrame:
    """One written row per document: id, r (row number), size (bytes of text and DOC_BYTES), short, ids (with id 1 last)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("r"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, long = _encoder(tokenizer), pa.int64()
        for b in batches:
            texts = b.column("t").cast(pa.binary()).to_pylist()
            ids = [np.frombuffer(encoder.encode(t) + _END, "<u4") for t in texts]
            short = [bool(x.max() < 1 << 16) for x in ids]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("r"), pa.array([len(t or b"") + DOC_BYTES for t in texts], long), pa.array(short, pa.bool_()),
                pa.array([(x.astype("<u2") if s else x).tobytes() for x, s in zip(ids, short, strict=True)], pa.binary())],
                ["id", "r", "size", "short", "ids"])

    return materialize(rows.mapInArrow(run, _IDS.format(kind=kind)), "pack-ids")


def term_ranks(ids: DataFrame, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Each term's place in the race by token id, and each place's position in the order of keys.

    First in the race is the term with the least draw / idf; a term of one
    document comes last, as it brings no neighbour.  Document frequencies and
    average documents count all documents, in whole numbers, so that reruns
    agree; one row per term of the vocabulary comes to the driver.
    """
    sums = [f"s{k}" for k in range(_DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << 16
        draws = np.random.default_rng(seed).standard_normal((size, _DIMS))
        last, df, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, _DIMS), np.int64)
        for b in batches:
            for t in _tokens(b):
                if t.max() >= size:
                    more = 2 * int(t.max()) - size
                    size += more
                    draws = np.random.default_rng(seed).standard_normal((size, _DIMS))  # begins with the same rows
                    last, df, total = np.pad(last, (0, more)), np.pad(df, (0, more)), np.pad(total, ((0, more), (0, 0)))
                t, at = t.astype(np.intp), np.arange(len(t))
                last[t] = at  # of equal ids one stays
                t = t.compress(last.take(t) == at)
                df[t] += 1
                total[t] += np.rint(np.add.reduce(draws.take(t, axis=0), axis=0) / len(t) * (1 << 20)).astype(np.int64)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (found, df[found], *total[found].T)], ["term", "df", *sums])

    found = ids.select("ids", "short").mapInArrow(run, "term long, df long, " + ", ".join(f"{c} long" for c in sums)) \
        .groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", *sums)]).toArrow().sort_by("term")
    term, df, *total = (found.column(c).to_numpy() for c in found.column_names)
    n = ids.count()
    size = int(term.max(initial=0)) + 1
    race = np.full(size, np.inf)
    draw = np.random.default_rng(seed).exponential(size=size)[term]
    race[term] = np.where(df > 1, draw / np.log1p((n - df + 0.5) / (df + 0.5)), np.inf)
    ranks = np.empty(size, np.int32)
    ranks[np.argsort(race, kind="stable")] = np.arange(size)
    position = np.arange(size)
    if len(term):
        position[ranks[term[_neighbourly(np.stack(total, 1) / df[:, None])]]] = np.arange(len(term))
    return ranks, position


def _neighbourly(points: np.ndarray) -> np.ndarray:
    """An order of the points in which near ones are near: halves along the main direction, again and again."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        some = stack.pop()
        if len(some) < 4:
            out.append(some)
            continue
        x = points[some] - points[some].mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        some = some[np.argsort(along, kind="stable")]
        stack += [some[len(some) // 2:], some[:len(some) // 2]]
    return np.concatenate(out)


def with_places(ids: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``ids`` with the ranks of each document's first and second term in the race (no second: -1)."""
    names = ids.columns
    none = len(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = _tokens(b)
            if not tokens:
                continue
            rank = ranks[np.concatenate(tokens)]
            length = np.array([len(t) for t in tokens])
            starts = np.cumsum(length) - length
            first = np.minimum.reduceat(rank, starts)
            second = np.minimum.reduceat(np.where(rank == np.repeat(first, length), none, rank), starts)
            second[second == none] = -1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], [*names, "first", "second"])

    return ids.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids.schema) + ", " + _PLACES)


def deal(placed: DataFrame, position: np.ndarray, shard_bytes: int) -> DataFrame:
    """``placed`` with its ``shard``; shards hold about ``shard_bytes``.

    Keys (first places) follow one another by ``position`` until a shard is full.  A larger
    key has as many shards as it fills, chosen by the second place; documents
    that share both places and fill more than one are dealt over as many by
    their row number.
    """
    spark = placed.sparkSession
    keys = placed.groupBy("first").agg(F.sum("size").alias("n")).collect()  # at most one row per term
    keys.sort(key=lambda k: (position[k["first"]], k["first"]))
    plan, shard, room = [], -1, 0
    for first, n in keys:
        if n > shard_bytes:
            parts = -(-n // shard_bytes)
            plan.append((first, shard + 1, parts))
            shard, room = shard + parts, 0
        else:
            if n > room:
                shard, room = shard + 1, shard_bytes
            plan.append((first, shard, 1))
            room -= n
    plan = spark.createDataFrame(plan, "first int, base long, parts long")
    out = placed.join(F.broadcast(plan), "first")
    if any(n > shard_bytes for _, n in keys):
        large = placed.join(F.broadcast(plan.where("parts > 1")), "first")
        hot = large.groupBy("first", "second").agg(F.ceil(F.sum("size") / F.lit(shard_bytes)).alias("salts")).where("salts > 1")
        hot = materialize(hot, "pack-hot")  # at most a row per shard; Spark sees its size and chooses the join
        out = out.join(hot, ["first", "second"], "left")
        salt = F.coalesce(F.pmod(F.xxhash64("r"), F.col("salts")), F.lit(0))
        out = out.withColumn("base", F.col("base") + F.pmod(F.pmod(F.xxhash64("second"), F.col("parts")) + salt, F.col("parts")))
    return out.withColumn("shard", F.col("base"))


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 2048,
         shard_bytes: int = 4 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.

    A document is the ids of its text by the ``tokenizer`` file (one that drops
    white space), then id 1.  Pieces of a sequence follow one another without
    gaps from offset 0; a sequence has at most ``window`` ids, and only the
    last of a shard has fewer.  Null and empty texts are the single id 1;
    repeated rows and null ids are documents like others; ties in score go by
    row number; other columns are not read; an empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    ids = encode_docs(docs, tokenizer, doc_id, text)
    kind = ids.schema["id"].dataType.simpleString()
    ranks, position = term_ranks(ids)
    dealt = deal(with_places(ids, ranks), position, shard_bytes).select("shard", "id", "r", "short", "ids")

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("r")
        tokens = _tokens(shard)
        base, out = shard.column("shard")[0].as_py() << 32, []
        for i, pieces in enumerate(fill_windows(tokens, window)):
            at = 0
            for d, s, n in pieces:
                out.append((d, s, n, tokens[d][s:s + n].tobytes(), len(tokens[d]), base + i, at))
                at += n
        cols = list(zip(*out, strict=True))
        long = pa.int64()
        return pa.table({
            "id": shard.column("id").take(pa.array(cols[0], long)), "start": pa.array(cols[1], long),
            "length": pa.array(cols[2], long), "ids": pa.array(cols[3], pa.binary()), "doc_tokens": pa.array(cols[4], long),
            "sequence_id": pa.array(cols[5], long), "offset": pa.array(cols[6], long)})

    out = dealt.groupBy("shard").applyInArrow(
        run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", doc_id)
