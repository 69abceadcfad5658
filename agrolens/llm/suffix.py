"""Operator 7: repeated passages by a sparse suffix array.

A passage is repeated when a window of ``least`` words occurs at two or more
places of the corpus (two documents, or twice in one).  The result covers
exactly the words of all such windows.

1. Of every W = least // 2 + 1 consecutive word positions the one whose next
   R = least - W + 1 words hash lowest is retained (a minimiser: the choice
   depends on these words only, so equal windows retain the same position).
   About 2 in W suffixes stay.
2. The retained suffixes are sorted over the cluster by (their first R words,
   all words from W - 1 before to ``least`` after, document, position) - each
   block of words by its hash - and neighbours are compared.  A suffix whose
   neighbour before has the same two blocks repeats it wholly; a suffix that
   only shares the first R words with a neighbour is to be extended.
3. Those go back to their text.  The match is extended left and right: each
   window of ``least`` words around the suffix is compared with those around
   the others.  One suffix stands for all that repeat it wholly, so a passage
   in a third of all documents is extended only where its surroundings differ.

The sort is a range partitioning that may split a run of equal suffixes; the
runs at a partition's edges are always extended, so nothing is lost there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.llm.common import bucketed, fresh, materialize, release

_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CACHE = 1 << 20


class _Hashes(dict):
    """Word -> 64-bit hash; starts anew at a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


class _Rolling:
    """Hashes of any word range of a text, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        self.seen = _Hashes()
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up))
            steps = [np.full(m, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.cumprod(x, dtype=np.uint64) for x in steps)

    def load(self, data: bytes | None) -> int:
        """Takes a text; returns its number of words."""
        w = (data or b"").split()
        self._powers(len(w))
        h = np.fromiter(map(self.seen.__getitem__, w), np.uint64, len(w))
        self.sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(h * self.up[:len(w)], dtype=np.uint64, out=self.sums[1:])
        return len(w)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a..b-1, for arrays of a and b."""
        x = (self.sums[b] - self.sums[a]) * self.down[a]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x


def _minimisers(roll: _Rolling, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Retained positions and the hashes of their next R words."""
    w = least // 2 + 1
    r = least - w + 1
    at = np.arange(n - r + 1)
    g = roll.of(at, at + r)
    low = np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1)
    low = np.unique(low)
    return low, g[low]


def _retain(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, w = _Rolling(), least // 2 + 1
        for b in batches:
            ids, rows = b.column(0).to_numpy(), []
            for i, t in zip(ids, b.column(1).cast(pa.binary()), strict=True):
                n = roll.load(t.as_py())
                if n < least:
                    continue
                p, k = _minimisers(roll, n, least)
                a, z = np.maximum(p - (w - 1), 0), np.minimum(p + least, n)
                f = roll.of(a, z) ^ ((p - a) * 1009 + (z - p)).astype(np.uint64)
                rows.append((np.full(len(p), i, np.int64), p.astype(np.int32), k.view(np.int64), f.view(np.int64)))
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["r", "p", "k", "f"])
    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the neighbours of one sorted partition.

    kind 0: repeats the suffix before it wholly; 1: the first of a run of
    whole repeats; 2: to be extended; 3: both 1 and 2.  Classes (equal k) at
    the partition's edges always have 2.
    """
    def solve(r, p, k, f, open_first, open_last):
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        cls = np.cumsum(first) - 1
        runs = np.bincount(cls[head], minlength=cls[-1] + 1)
        extend = runs > 1
        extend[0] |= open_first
        extend[-1] |= open_last
        at = np.flatnonzero(head)
        long = np.zeros(len(k), bool)
        long[at] = np.diff(np.append(at, len(k))) > 1
        kind = np.where(head, 1 * long + 2 * extend[cls], 0).astype(np.int8)
        stay = ~head | (kind > 0)
        return pa.record_batch([pa.array(x[stay]) for x in (r, p, kind)], ["r", "p", "kind"])

    held, begun = None, False
    for b in batches:
        cols = [b.column(x).to_numpy() for x in ("r", "p", "k", "f")]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.argmax(cols[2] == cols[2][-1]))  # sorted: the last class starts here
        held = [c[cut:] for c in cols]
        if cut:
            yield solve(*(c[:cut] for c in cols), not begun, False)
            begun = True
    if held is not None:
        yield solve(*held, not begun, True)


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, w, half = _Rolling(), least // 2 + 1, least // 2
        for b in batches:
            rows = []
            for i, t, ps in zip(b.column(0).to_numpy(), b.column(1).cast(pa.binary()), b.column(2), strict=True):
                n, p = roll.load(t.as_py()), np.unique(ps.values.to_numpy())
                s = np.unique((p[:, None] - np.arange(w)).ravel())
                s = s[(s >= 0) & (s + least <= n)].astype(np.int64)
                x, y = roll.of(s, s + half), roll.of(s + half, s + least)
                rows.append((np.full(len(s), i, np.int64), s.astype(np.int32), x.view(np.int64), y.view(np.int64)))
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["r", "s", "x", "y"])
    return run


def _spans(rows: DataFrame, rid: str, text: str, least: int) -> DataFrame:
    """(r, a, z, again): word ranges covered by repeated windows; again: an earlier copy exists."""
    if least < 4:
        raise ValueError("least must be 4 words or more")
    w = least // 2 + 1
    kept = rows.select(F.col(rid).alias("r"), F.col(text).cast("string").alias("t")).mapInArrow(
        _retain(least), "r long, p int, k long, f long")
    kept = materialize(kept, "suffixes")
    found = materialize(
        kept.repartitionByRange("k", "f", "r", "p").sortWithinPartitions("k", "f", "r", "p")
        .mapInArrow(_neighbours, "r long, p int, kind byte"), "suffix-matches")
    release(kept)
    whole = found.where("kind <> 2").select(
        "r", F.greatest(F.col("p") - (w - 1), F.lit(0)).alias("a"), (F.col("p") + least).alias("z"), (F.col("kind") == 0).alias("again"))
    open_ = found.where("kind >= 2").groupBy("r").agg(F.collect_list("p").alias("ps"))
    windows = materialize(
        rows.select(F.col(rid).alias("r"), F.col(text).cast("string").alias("t")).join(open_, "r").mapInArrow(
            _windows(least), "r long, s int, x long, y long"), "suffix-windows")
    twice = windows.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(F.struct("r", "s")).alias("first")).where("n > 1")
    part = windows.join(twice, ["x", "y"]).select(
        "r", F.col("s").alias("a"), (F.col("s") + least).alias("z"), (F.struct("r", "s") != F.col("first")).alias("again"))
    return whole.unionByName(part)


def _merged(a: np.ndarray, z: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges as disjoint, not touching ranges in order."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > z[:-1]
    end = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1) if len(a) else np.zeros(0, int)
    return list(zip(a[new].tolist(), z[end].tolist(), strict=True))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, n, spans in zip(*(b.column(x).to_pylist() for x in (0, 1, 2)), strict=True):
            a, z, again = (np.array([s[x] for s in spans], int) for x in ("a", "z", "again"))
            z, cut = np.minimum(z, n), np.zeros(n + 1, int)
            np.add.at(cut, a[again == 1], 1)
            np.add.at(cut, z[again == 1], -1)
            gone = np.concatenate([[0], np.cumsum(np.cumsum(cut)[:n] > 0)])
            out += [(i, s, e - s, int(gone[e] - gone[s])) for s, e in _merged(a, z)]
        yield pa.record_batch([pa.array([x[c] for x in out], t) for c, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["r", "start_word", "n_words", "again_words"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """One row per maximal run of words covered by repeated windows of ``least`` words.

    doc_id; start_word (from 0) and n_words of the run; again_words, how many
    of them lie in a window that occurred before (in table order), i.e. what
    ``remove_repeats`` takes out.  Words are runs of other characters than the
    six ASCII spaces.  Null, empty and shorter texts have no row; repeated rows
    repeat each other; a null id keeps its rows.  Other columns are not read.
    """
    (rid,) = fresh(docs, "rid")
    rows = bucketed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).withColumn(
        rid, F.monotonically_increasing_id()), rid, "suffix_docs")
    spans = _spans(rows, rid, "t", least).groupBy("r").agg(F.collect_list(F.struct("a", "z", "again")).alias("spans"))
    sized = rows.join(spans.withColumnRenamed("r", rid), rid).select(
        F.col(rid).alias("r"), F.size(F.expr("filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')")).alias("n"), "spans")
    found = sized.mapInArrow(_report, "r long, start_word long, n_words long, again_words long")
    return rows.select(F.col(rid).alias("r"), F.col("id").alias(doc_id)).join(found, "r").drop("r")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            at = [m.start() for m in _WORD.finditer(t)]
            n, left, parts = len(at), 0, []
            a, z = (np.array([s[x] for s in spans], int) for x in ("a", "z"))
            for s, e in _merged(a, np.minimum(z, n)):
                parts.append(t[left:at[s]])
                left = at[e] if e < n else len(t)
            out.append(b"".join([*parts, t[left:]]).decode())
        yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["r", "cut"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """``docs`` with every later copy of a repeated window cut out of its text.

    The first occurrence in table order stays.  A document of which no word is
    left goes; documents without repeats, null and empty texts are unchanged.
    All columns return as they are but for ``text``.
    """
    rid, cut, had = fresh(docs, "rid", "cut", "had")
    rows = bucketed(docs.withColumn(rid, F.monotonically_increasing_id()), rid, "suffix_docs")
    spans = _spans(rows, rid, text, least).where("again").groupBy("r").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    done = rows.select(F.col(rid).alias("r"), F.col(text).cast("string").alias("t")).join(spans, "r").mapInArrow(
        _cut, "r long, cut string").select(F.col("r").alias(rid), F.col("cut").alias(cut), F.lit(True).alias(had))
    new = F.when(F.col(had), F.col(cut)).otherwise(F.col(text))
    return rows.join(done, rid, "left").where(F.col(had).isNull() | F.col(cut).rlike("[^\\x20\\x09-\\x0D]")).select(
        *[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
