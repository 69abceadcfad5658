"""Operator 12: vector codes with memoised grid cells.

Product quantisation in exact integers: a vector floor(scale * x) is cut into
equal parts and each part coded by the nearest entry of its position's codebook.

The search is memoised by grid cell.  A part's coarse cell is its components
divided by a width (a power of two near an eighth of the codebook's spread); the
cell's box gives each entry a least and a greatest distance.  An entry whose
least distance exceeds another entry's greatest is nearest to no point of the
box.  The rest is kept per hashed cell, so only the first part that falls into a
cell looks at the whole codebook; all its parts evaluate only the kept entries,
exactly.  An entry as near as the best is never ruled out, so ties stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolens.llm.common import materialize, release
from agrolens.llm.vectors import DIGITS, LONG, clean, digit_rows, in_blocks, largest, total, whole

_ENCODED = pa.schema([("m", pa.binary())])
#: Cells that one codebook's memo holds; beyond it the memo starts anew (the result does not depend on it).
CELLS = 1 << 14
#: Cells whose boxes are measured at once, and (row, entry) pairs evaluated at once.
_AT_ONCE, _PAIRS = 2048, 1 << 20


def _encode(m: np.ndarray) -> dict:
    return {"m": m.astype("<f8").tobytes()}


def _hashed(cells: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of ``cells``."""
    h = np.zeros(len(cells), np.uint64)
    for j in range(cells.shape[1]):
        h = (h ^ cells[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Memo:
    """Nearest entries of one codebook (entries x components), memoised by cell."""

    def __init__(self, book: np.ndarray):
        self.book = book
        spread = max(1, int((book.max(axis=0) - book.min(axis=0)).max()) // 8)
        self.shift = spread.bit_length() - 1
        self.kept: dict[bytes | tuple, np.ndarray] = {}
        self.evaluated = self.measured = 0

    def _survivors(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that no other entry beats all over its box."""
        out, width = [], 1 << self.shift
        for at in range(0, len(cells), _AT_ONCE):
            least = most = 0
            for j in range(self.book.shape[1]):  # a component's few different cells are measured once
                side, which = np.unique(cells[at:at + _AT_ONCE, j], return_inverse=True)
                low, book = (side * width)[:, None], self.book[:, j][None]
                high = low + (width - 1)
                outside = np.maximum(np.maximum(low - book, book - high), 0)
                far = np.maximum(abs(book - low), abs(book - high))
                least, most = least + (outside * outside)[which], most + (far * far)[which]
            keep = (least <= most.min(axis=1)[:, None]).astype(bool)
            row, entry = np.nonzero(keep)
            out += np.split(entry, np.flatnonzero(np.diff(row)) + 1)
        self.measured += len(cells)
        return out

    def _entries(self, cells: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The kept entries of the different cells, and each row's number among these."""
        if cells.dtype == object:
            keys = [tuple(x) for x in cells.tolist()]
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            row = np.array([number[k] for k in keys])
            names, first = list(number), np.array([keys.index(k) for k in number]) if len(number) < 64 else np.unique(row, return_index=True)[1]
        else:
            _, first, row = np.unique(_hashed(cells), return_index=True, return_inverse=True)
            clash = np.flatnonzero((cells != cells[first][row]).any(axis=1))  # another cell of the same hash gets its own number
            extra: dict[bytes, int] = {}
            for i in clash.tolist():
                row[i] = extra.setdefault(cells[i].tobytes(), len(first) + len(extra))
            if extra:
                first = np.concatenate([first, [next(i for i in clash.tolist() if row[i] == x) for x in extra.values()]])
            names = [x.tobytes() for x in cells[first]]
        new = [i for i, n in enumerate(names) if n not in self.kept]
        if new:
            if len(self.kept) + len(new) > CELLS:
                self.kept = {}
                new = list(range(len(names)))
            self.kept.update(zip([names[i] for i in new], self._survivors(cells[first[new]]), strict=True))
        return [self.kept[n] for n in names], row

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (ties: lower index) and squared distance of each part."""
        entries, cell = self._entries(parts >> self.shift)
        size = np.array([len(x) for x in entries])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        flat = np.concatenate(entries)
        code, far = np.empty(len(parts), np.int64), np.empty(len(parts), parts.dtype)
        step = max(1, _PAIRS // int(size.max()))
        for at in range(0, len(parts), step):
            some = cell[at:at + step]
            n = size[some]
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            entry = flat[np.arange(n.sum()) - np.repeat(start - first[some], n)]
            d = ((np.repeat(parts[at:at + step], n, axis=0) - self.book[entry]) ** 2).sum(axis=1)
            best = np.minimum.reduceat(d, start)
            hit = np.flatnonzero(d == np.repeat(best, n))
            hit = hit[np.unique(np.repeat(np.arange(len(some)), n)[hit], return_index=True)[1]]
            code[at:at + step], far[at:at + step] = entry[hit], best
            self.evaluated += len(entry)
        return code, far


class _Coder:
    """A task's memos; ``books``: {dim: parts x entries x components}."""

    def __init__(self, books: dict[int, np.ndarray], scale: int):
        self.books, self.scale, self.memos = books, scale, {}

    def code(self, b: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Dimension, and per part and vector of a block: components, codes and distances."""
        dim, n = b.column("dim")[i].as_py(), b.column("n")[i].as_py()
        books = self.books[dim]
        parts = whole(np.frombuffer(b.column("m")[i].as_buffer(), "<f8"), self.scale).reshape(n, len(books), -1).transpose(1, 0, 2)
        # beyond half a long's root even boxes could overflow
        reach = 8 * (largest(parts) + largest(books) + 1)
        kind = np.int64 if dim * reach * reach < LONG else object
        parts = parts.astype(kind)
        codes, far = np.empty((len(books), n), np.int64), np.empty((len(books), n), kind)
        for p in range(len(books)):
            memo = self.memos.get((dim, p, kind))
            if memo is None:
                memo = self.memos[dim, p, kind] = Memo(books[p].astype(kind))
            codes[p], far[p] = memo.nearest(np.ascontiguousarray(parts[p]))
        return dim, parts, codes, far


def _summed(books: dict[int, np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books, scale)
        sums = {}
        for b in batches:
            for i in range(b.num_rows):
                dim, parts, codes, _ = coder.code(b, i)
                count, entries, width = books[dim].shape
                if dim not in sums:
                    sums[dim] = np.zeros((count, entries, width + 1), object)
                fits = parts.dtype != object and parts.shape[1] * largest(parts) < 2 ** 53
                for p in range(count):
                    sums[dim][p, :, width] += np.bincount(codes[p], minlength=entries)
                    for j in range(width):
                        if fits:
                            sums[dim][p, :, j] += np.bincount(codes[p], parts[p][:, j], entries).astype(np.int64)
                        else:
                            np.add.at(sums[dim][p, :, j], codes[p], parts[p][:, j].astype(object))
        yield digit_rows(sums)
    return run


def _coded(books: dict[int, np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books, scale)
        for b in batches:
            for i in range(b.num_rows):
                dim, _, codes, far = coder.code(b, i)
                digits = max(2, len(f"{books[dim].shape[1] - 1:x}"))
                hexes = [f"{x:0{digits}x}" for x in range(books[dim].shape[1])]
                text = ["".join(hexes[x] for x in row) for row in codes.T.tolist()]
                error = [x if x < LONG else None for x in far.astype(object).sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([b.column("id")[i].values, b.column("m0")[i].values, pa.array([dim] * len(text), pa.int32()),
                                                  pa.array(text), pa.array(error, pa.int64())], ["id", "label", "dim", "code", "error"])
    return run


@dataclass
class Codes:
    """``coded``: (vec_id, label, dim, code, error).  ``books``: {dim: final codebooks as
    parts x entries x components of whole numbers}."""
    coded: DataFrame
    books: dict[int, list]


def cell_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16,
               entries: int = 64, rounds: int = 2, scale: int = 256, block: int = 8192) -> Codes:
    """Codes of all vectors of finite components, and the codebooks behind them.

    Each part position's codebook starts as that part of the ``entries`` vectors
    with the smallest ids, ascending (null ids last, equal ids by components;
    all vectors where there are fewer).  Each round assigns every part to its
    nearest entry (ties: lower index) and replaces an entry that has parts by
    their componentwise floor(sum / count).  Then parts are assigned again.

    Vectors that are null or empty, hold null, NaN or infinite components, or
    whose length ``parts`` does not divide are dropped.  Vectors of different
    lengths have codebooks of their own.  Repeated rows count each time.
    Components may be of any size; an error beyond a long is null.  An empty
    table gives an empty result and no codebook.  Other columns are not read.
    """
    rows = clean(vectors, vec_id, embedding, scale, label)
    rows = rows.where(rows.dim % parts == 0)
    kind, tag = (rows.schema[c].dataType.simpleString() for c in ("id", "m0"))
    first = Window.partitionBy("dim").orderBy(F.asc_nulls_last("id"), "units")  # cut to `entries` rows before the exchange
    starts: dict[int, list] = {}
    for r in rows.select("id", "dim", "units").withColumn("place", F.row_number().over(first)).where(F.col("place") <= entries).orderBy("dim", "place").collect():
        starts.setdefault(r["dim"], []).append(r["units"])
    if not starts:
        return Codes(vectors.sparkSession.createDataFrame([], f"vec_id {kind}, label {tag}, dim int, code string, error long"), {})
    books = {dim: whole(np.array(v), scale).reshape(len(v), parts, -1).transpose(1, 0, 2) for dim, v in starts.items()}
    blocks = materialize(rows.mapInArrow(in_blocks(block, _encode, _ENCODED), f"dim int, n int, id array<{kind}>, m0 array<{tag}>, m binary"), "code-blocks")
    for _ in range(rounds):
        sums = total(blocks.mapInArrow(_summed(books, scale), DIGITS))
        books = {dim: _moved(old, sums.get(dim, {})) for dim, old in books.items()}
    coded = materialize(blocks.mapInArrow(_coded(books, scale), f"id {kind}, label {tag}, dim int, code string, error long"), "codes")
    release(blocks)
    return Codes(coded.withColumnRenamed("id", "vec_id"), {dim: m.tolist() for dim, m in books.items()})


def _moved(old: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """Entries that have parts become their floor(sum / count)."""
    count, entries, width = old.shape
    out = old.astype(object)
    for p in range(count):
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            if n := sums.get(at + width, 0):
                out[p, e] = [sums.get(at + j, 0) // n for j in range(width)]
    return out if largest(out) >= 1 << 62 else out.astype(np.int64)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors summed over equal labels (nulls together); null where that, or one of them, exceeds a long."""
    s = F.sum(F.col("error").cast("decimal(38,0)"))
    per = coded.groupBy(F.col("label").alias("same")).agg(
        F.when((F.count_if(F.col("error").isNull()) == 0) & (s <= F.lit(LONG - 1)), s.cast("long")).alias("label_error"))
    return coded.join(per, F.col("label").eqNullSafe(F.col("same"))).drop("same")
