"""Vectors as whole numbers: reading, blocks and exact sums (operators 11 and 12).

A component x stands for the integer floor(scale * x).  Blocks hold it as the
double floor(scale * x) / scale ("unit"), which is exact and finite for every
finite x, however large.  Tasks compute in 64-bit integers where a bound shows
that nothing overflows, and in Python integers elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums travel as digits of this many bits, so any sum of any number of tasks is exact.
_DIGIT = 40
LONG = 1 << 63


def _clean(scale: int) -> Callable:
    """(id, ..., vector) rows to (id, ..., dim, units), without null, empty and non-finite vectors."""
    whole = 2.0 ** 53 / scale  # from here on scale * x has no fraction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.num_columns - 1)
            offset = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False)  # a null component is NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            dim = np.diff(offset)
            keep = col.is_valid().to_numpy(zero_copy_only=False) & (dim > 0) & (bad[offset[1:]] == bad[offset[:-1]])
            near = np.abs(flat) < whole
            units = np.where(near, np.floor(np.where(near, flat, 0) * scale) / scale, flat)
            lists = pa.ListArray.from_arrays(col.offsets, pa.array(units, pa.float64()))
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(dim, pa.int32()), lists],
                                             [*b.schema.names[:-1], "dim", "units"])
            yield out.filter(pa.array(keep))
    return run


def clean(vectors: DataFrame, vec_id: str, embedding: str, scale: int, *more: str) -> DataFrame:
    """(id, m0, m1, ..., dim, units) of the vectors that hold finite components only.

    ``scale`` is a power of two; ``more`` are further columns, kept as m0, m1, ...
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(more)],
                          F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_clean(scale), f"{kept}, dim int, units array<double>")


def in_blocks(size: int, encode: Callable[[np.ndarray], dict], rest: pa.Schema) -> Callable:
    """Consecutive rows of ``clean`` with one dimension as rows (dim, n, id list, m0 list, ..., what ``encode`` makes of the matrix)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        names: list[str] = []
        types: list[pa.DataType] = []

        def done(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            made = encode(np.concatenate([p[1] for p in parts]))
            cols = [pa.chunked_array([p[0].column(i) for p in parts]).combine_chunks() for i in range(len(names))]
            n = len(cols[0])
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in cols]
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([n], pa.int32()), *lists, *[pa.array([made[f.name]], f.type) for f in rest]],
                ["dim", "n", *names, *rest.names])

        for b in batches:
            names, types = b.schema.names[:-2], b.schema.types[:-2]
            dims = b.column(b.num_columns - 2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == dim))
                for at in range(0, some.num_rows, size):
                    part = some.slice(at, size)
                    m = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                    if dim in held and sum(len(x[1]) for x in held[dim]) + len(m) > size:
                        yield done(dim)
                    held.setdefault(dim, []).append((part.select(names), m))
            while sum(x[1].size for parts in held.values() for x in parts) > 64 * size * 16:  # many dimensions at once: the largest goes
                yield done(max(held, key=lambda d: sum(x[1].size for x in held[d])))
        for dim in list(held):
            yield done(dim)
    return run


def whole(units: np.ndarray, scale: int) -> np.ndarray:
    """The integers scale * units: int64, or Python integers where one does not fit 2**62."""
    if np.abs(units).max(initial=0) < 2.0 ** 62 / scale:
        return (units * scale).astype(np.int64)
    flat = [int(x * scale) if abs(x) < 2.0 ** 52 else int(x) * scale for x in units.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(units.shape)


def largest(m: np.ndarray) -> int:
    """Largest absolute value of integers of either kind."""
    return max((abs(int(m.max())), abs(int(m.min())))) if m.size else 0


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number; digits have its sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(int(value)), 0
    while rest:
        if part := rest & ((1 << _DIGIT) - 1):
            yield place, sign * part
        rest >>= _DIGIT
        place += 1


DIGITS = "dim int, at long, place int, part long"


def digit_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows ``DIGITS`` of one array of whole numbers per dimension; ``at`` is the place in the flat array."""
    rows = [(dim, at, place, part) for dim, m in sums.items() for at, v in enumerate(m.ravel().tolist()) if v for place, part in digits(v)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                                      ["dim", "at", "place", "part"])


def total(rows: DataFrame) -> dict[int, dict[int, int]]:
    """{dim: {at: sum}} of ``DIGITS`` rows: Spark adds up the digits; the driver gets a number for each place of the model."""
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("dim", "at", "place").agg(F.sum("part").alias("part")).collect():
        sums = out.setdefault(r["dim"], {})
        sums[r["at"]] = sums.get(r["at"], 0) + (r["part"] << (_DIGIT * r["place"]))
    return out
