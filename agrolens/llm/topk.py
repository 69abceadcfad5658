"""Operator 8: exact top-k inner products by norm-bucketed retrieval (after LEMP).

All vectors are ordered by length over the cluster and cut into buckets of
``bucket`` vectors; the queries are cut into blocks.  A task takes one block
and one stripe of buckets (dealt by a hash, longest first) and keeps each query's k
best so far.  The k-th best score and a bucket's greatest length give the
query's local cosine threshold for that bucket:

- above 1: no vector of this or a shorter bucket can enter; the query is done;
- high: coordinate pruning - a vector that close to the query must have its
  unit value, at the query's largest coordinates, in a narrow range, which the
  bucket's sorted lists give;
- low: length pruning - only the bucket's vectors that are long enough.

What remains is verified by integer products, so the result is exact.  Last,
the stripes' few best rows per query are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolens.llm.common import materialize


_SLACK = 1e-9
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATES_FROM = 0.5


def _lengths(m: np.ndarray) -> np.ndarray:
    """Lengths of the rows; squares do not overflow."""
    top = np.abs(m).max(axis=1, initial=0)
    unit = m / np.where(top > 0, top, 1)[:, None]
    return np.sqrt((unit * unit).sum(axis=1)) * top


def _matrix(data: bytes, dim: int, n: int) -> np.ndarray:
    """``n`` packed rows as doubles: 32-bit integers, or doubles that hold whole numbers where one does not fit."""
    return np.frombuffer(data, "<i4" if len(data) == 4 * dim * n else "<f8").reshape(n, dim).astype(np.float64)


def _products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows with ``q``: int64, or Python integers where one may not fit."""
    bound = len(q) * np.abs(m).max(axis=1, initial=0) * np.abs(q).max(initial=0)
    if bound.max(initial=0) < 2.0 ** 53:
        return (m @ q).astype(np.int64)
    long = bound < 2.0 ** 62
    whole = [int(x) for x in q.tolist()]
    out = np.zeros(len(m), np.int64 if long.all() else object)
    if long.any():
        # where a component of q is beyond a long, rows within the bound are zero throughout
        out[long] = m[long].astype(np.int64) @ np.array([x if abs(x) < 1 << 62 else 0 for x in whole], np.int64)
    for i in np.flatnonzero(~long):
        out[i] = sum(int(a) * b for a, b in zip(m[i].tolist(), whole, strict=True))
    return out


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2).cast(pa.list_(pa.float64()))
            offset = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)  # a null component is NaN
            there = col.is_valid().to_numpy(zero_copy_only=False)
            keep, dims, norms, data = [], [], [], []
            for i in np.flatnonzero(there):
                v = flat[offset[i]:offset[i + 1]]
                if not len(v) or not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                if not np.isfinite(v).all():
                    continue  # scaled, it is no finite component either
                keep.append(i)
                dims.append(len(v))
                norms.append(float(_lengths(v[None])[0]))
                data.append(v.astype("<i4" if np.abs(v).max() < 2.0 ** 31 else "<f8").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()),
                                   pa.array(data, pa.binary())], ["r", "id", "dim", "norm", "v"])
    return run


def _packed(size: int, kind: pa.DataType):
    """Consecutive rows of one dimension as one row: ids, row numbers and the matrix."""
    def pack(rows: list) -> dict:
        dim, m = rows[0][2], [x[4] for x in rows]
        if any(len(x) > 4 * dim for x in m):
            m = [_matrix(x, dim, 1).astype("<f8").tobytes() for x in m]
        return {"dim": dim, "longest": rows[0][3], "r": [x[0] for x in rows], "id": [x[1] for x in rows], "m": b"".join(m)}

    schema = pa.schema([("dim", pa.int32()), ("longest", pa.float64()), ("r", pa.list_(pa.int64())), ("id", pa.list_(kind)), ("m", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (len(held) == size or held[0][2] != row[2]):
                    yield pa.RecordBatch.from_pylist([pack(held)], schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([pack(held)], schema)
    return run


class _Bucket:
    """Vectors by falling length, with sorted lists of unit values per coordinate (made when first asked for)."""

    def __init__(self, m: np.ndarray, r: list, ids: list):
        self.m, self.r, self.ids = m, np.array(r, np.int64), ids
        self.length = _lengths(m.astype(np.float64))
        self.unit = m / np.maximum(self.length, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, f: int, low: float, high: float) -> np.ndarray:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        order, value = self.lists[f]
        return order[np.searchsorted(value, low, "left"):np.searchsorted(value, high, "right")]


def _candidates(q: np.ndarray, bucket: _Bucket, least: float, length: float) -> np.ndarray | None:
    """Rows that may reach the score ``least``; None: neither these nor shorter ones."""
    longest = float(bucket.length[0])
    if least > 0 and length * longest * (1 + _SLACK) < least:
        return None
    if least <= 0 or not length or not longest:
        return np.arange(len(bucket.m))
    t = min(1.0, least / (length * longest))
    if t < COORDINATES_FROM:
        return np.arange(np.searchsorted(-bucket.length, -least / length * (1 - _SLACK), "right"))
    unit = q / length
    two = np.argsort(-np.abs(unit), kind="stable")[:2]
    best = None
    for f in two.tolist():
        a, b = np.arccos(np.clip(unit[f], -1, 1)), np.arccos(t)
        rows = bucket.near(f, np.cos(min(np.pi, a + b)) - 1e-7, np.cos(max(0.0, a - b)) + 1e-7)
        if best is None or len(rows) < len(best):
            best = rows
    return best


def _best(k: int):
    """Joined rows (block, stripe, query block, bucket), longest bucket first, to each query's k best."""
    def order(found: list) -> list:
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2]))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, state = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = [(qr, qi, s, c, r) for (_, qr, qi, _), best in zip(queries, state, strict=True) for s, c, r in best[0]]
            if any(not -1 << 63 <= x[2] < 1 << 63 for x in rows):
                raise OverflowError("a score exceeds a long")
            types = (pa.int64(), kind, pa.int64(), kind, pa.int64())
            yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["qr", "q", "score", "c", "cr"])

        for b in batches:
            kind = b.schema.field("ids").type.value_type
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("block", "stripe", "dim", "qr", "qids", "qm", "r", "ids", "m")}
                if at != (row["block"], row["stripe"]):
                    if at is not None:
                        yield from done()
                    at = row["block"], row["stripe"]
                    m = _matrix(row["qm"], row["dim"], len(row["qr"]))
                    queries = list(zip(m, row["qr"], row["qids"], _lengths(m).tolist(), strict=True))
                    state = [[[], True] for _ in queries]  # best rows; whether shorter buckets matter
                m = _matrix(row["m"], row["dim"], len(row["r"]))
                bucket = _Bucket(m, row["r"], row["ids"])
                for (x, qr, _, length), best in zip(queries, state, strict=True):
                    if not best[1]:
                        continue
                    full = len(best[0]) == k
                    rows = _candidates(x, bucket, float(best[0][-1][0]) if full else -np.inf, length)
                    if rows is None:
                        best[1] = False
                        continue
                    rows = rows[bucket.r[rows] != qr]
                    score = _products(m[rows], x)
                    if full:
                        stay = score >= best[0][-1][0]
                    elif len(score) > k:
                        stay = score >= np.partition(score, len(score) - k)[len(score) - k]
                    else:
                        stay = np.ones(len(score), bool)
                    if stay.any():
                        some = rows[stay]
                        new = [(s, bucket.ids[j], r) for s, j, r in zip(score[stay].tolist(), some.tolist(), bucket.r[some].tolist(), strict=True)]
                        best[0] = order(best[0] + new)
        if at is not None:
            yield from done()
    return run


def top_inner(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", queries: str = "vec_id % 100 = 0", k: int = 10,
              scale: int = 1024, bucket: int = 2048, block: int = 8192, stripes: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product.

    Components are floor(scale * x).  ``queries``: SQL condition on ``vec_id``
    (a column of that name) that marks the query rows.  Ties go to the smaller
    id (null last).  Vectors that are null, empty or hold null or non-finite
    components (as they are, or as doubles once scaled) take no part; vectors
    of different dimensions do not meet.  Products are exact whatever their
    size; a score among the best beyond a long raises an error.  Repeated rows are candidates of their
    own; a query leaves out only its own row.  Other columns are not read.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("r"), F.col(vec_id).alias("id"),
                          F.col(embedding).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    ints = materialize(rows.mapInArrow(_scaled(scale), f"r long, id {kind}, dim int, norm double, v binary"), "vectors")
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    packed = f"dim int, longest double, r array<bigint>, id array<{kind}>, m binary"

    def cut(part: DataFrame, size: int, name: str) -> DataFrame:
        ranged = part.repartitionByRange("dim", F.desc("norm"), "r").sortWithinPartitions("dim", F.desc("norm"), "r")
        return materialize(ranged.mapInArrow(_packed(size, arrow_kind), packed), name)

    buckets = cut(ints, bucket, "buckets")
    # dealt by a hash, so every stripe holds buckets of all lengths
    buckets = buckets.withColumn("stripe", F.pmod(F.xxhash64("longest", F.element_at("r", 1)), F.lit(stripes)).cast("int"))
    asked = ints.withColumnRenamed("id", "vec_id").where(queries).withColumnRenamed("vec_id", "id")
    blocks = cut(asked, block, "query-blocks").select(
        F.element_at("r", 1).alias("block"), "dim", F.col("r").alias("qr"), F.col("id").alias("qids"), F.col("m").alias("qm"))
    # every block meets every stripe of its dimension, stripe by stripe
    blocks = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    work = blocks.join(buckets.select("dim", "stripe", "longest", "r", F.col("id").alias("ids"), "m"), ["dim", "stripe"])
    best = work.repartition("block", "stripe").sortWithinPartitions("block", "stripe", F.desc("longest")).mapInArrow(
        _best(k), f"qr long, q {kind}, score long, c {kind}, cr long")
    place = Window.partitionBy("qr").orderBy(F.desc("score"), F.asc_nulls_last("c"), "cr")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", F.col("c").alias("vec_id"), "score")
