"""Operator 11: centroid clustering with scalar lookup tables.

Vectors are integers floor(scale * x).  They are written once in blocks: per
dimension the block's occurring values, and each vector's position among them.
In a round a task tabulates, for every dimension, occurring value and centroid,
the squared difference; a distance is then a gather from each dimension's table
and a sum.  Values are tabulated per block, so tables stay small however many
different values the corpus has, and a value that repeats is squared once.

New centroids are exact floor(sum / count): tasks count (cluster, value) pairs
from the same positions, Spark adds up the sums, and the driver sees only
clusters x dimensions numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.llm.common import materialize, release
from agrolens.llm.vectors import DIGITS, LONG, clean, digit_rows, in_blocks, largest, total, whole

_ENCODED = pa.schema([("sizes", pa.binary()), ("values", pa.binary()), ("codes", pa.binary())])


def _encode(m: np.ndarray) -> dict:
    """Per dimension the occurring units, their number, and each vector's position among them."""
    found = [np.unique(m[:, d], return_inverse=True) for d in range(m.shape[1])]
    return {"sizes": np.array([len(v) for v, _ in found], "<i4").tobytes(), "values": np.concatenate([v for v, _ in found]).astype("<f8").tobytes(),
            "codes": np.stack([c for _, c in found]).astype("<u2").tobytes()}


def tables(values: np.ndarray, sizes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(value, cluster): squared differences of all dimensions' values, one dimension after the other.

    64-bit integers where even a sum over all dimensions fits, else Python integers.
    """
    span = largest(values) + largest(centroids)
    kind = np.int64 if len(sizes) * span * span < LONG else object
    per_value = np.repeat(centroids.T.astype(kind), sizes, axis=0)
    return (values.astype(kind)[:, None] - per_value) ** 2


def distances(table: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(vector, cluster) squared distances: a gather for each dimension, summed."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = table[codes[0]]
    for d in range(1, len(sizes)):
        out += table[first[d]:first[d + 1]][codes[d]]
    return out


class _Block:
    """One row of the block table, numbers unpacked."""

    def __init__(self, b: pa.RecordBatch, i: int, scale: int):
        get = lambda name: b.column(name)[i].as_buffer()
        self.n, self.ids = b.column("n")[i].as_py(), b.column("id")[i].values
        self.sizes = np.frombuffer(get("sizes"), "<i4")
        self.values = whole(np.frombuffer(get("values"), "<f8"), scale)
        self.codes = np.frombuffer(get("codes"), "<u2").reshape(len(self.sizes), self.n)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster (ties: smaller number) and squared distance of each vector."""
        found = distances(tables(self.values, self.sizes, centroids), self.sizes, self.codes)
        best = found.argmin(axis=1)
        return best, found[np.arange(self.n), best]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """(cluster, dimension + 1): component sums, and the number of vectors last."""
        out, first = np.zeros((k, len(self.sizes) + 1), object), 0
        kind = np.int64 if self.n * largest(self.values) < LONG else object
        for d, size in enumerate(self.sizes.tolist()):
            n = np.bincount(cluster * size + self.codes[d], minlength=k * size).reshape(k, size)
            out[:, d] = n.astype(kind) @ self.values[first:first + size].astype(kind)
            first += size
        out[:, -1] = np.bincount(cluster, minlength=k)
        return out


def _summed(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        sums = np.zeros((k, dim + 1), object)
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(b, i, scale)
                sums += block.sums(block.nearest(centroids)[0], k)
        yield digit_rows({dim: sums})
    return run


def _assigned(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(b, i, scale)
                best, far = block.nearest(centroids)
                far = [x if x < LONG else None for x in far.tolist()]
                yield pa.RecordBatch.from_arrays([block.ids, pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])
    return run


@dataclass
class Clustering:
    """``assigned``: (vec_id, cluster, distance).  ``clusters``: (cluster, size, cluster_inertia,
    inertia, centroid), a row for each centroid, its components as decimal text."""
    assigned: DataFrame
    clusters: DataFrame


def lookup_kmeans(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10,
                  seed: int = 3, scale: int = 1024, block: int = 8192) -> Clustering:
    """Lloyd's rounds over all vectors of ``dim`` finite components, in exact integers.

    Centroids start as the ``k`` vectors with the smallest lowercase-hex sha256
    of ``<seed>:<vec_id>`` (null ids last, equal ids by components; all vectors
    where there are fewer than ``k``).  Each round assigns every vector to the
    nearest centroid (ties: smaller number) and replaces every centroid that has
    vectors by their componentwise floor(sum / count).  Then vectors are assigned
    once more.  Vectors that are null, hold null, NaN or infinite components, or
    have another number of components take no part.  Repeated rows count each
    time.  Components may be of any size; a distance or inertia beyond a long is
    null.  An empty table gives empty results.  Other columns are not read.
    """
    if block > 1 << 16:
        raise ValueError("a block holds at most 65,536 vectors")
    spark = vectors.sparkSession
    rows = clean(vectors, vec_id, embedding, scale)
    rows = rows.where(rows.dim == dim)
    kind = rows.schema["id"].dataType.simpleString()
    starts = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)), "units").limit(k).collect()
    empty = Clustering(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"),
                       spark.createDataFrame([], "cluster int, size long, cluster_inertia long, inertia long, centroid array<string>"))
    if not starts:
        return empty
    centroids = whole(np.array([r["units"] for r in starts]), scale)
    blocks = materialize(rows.mapInArrow(in_blocks(block, _encode, _ENCODED),
                                         f"dim int, n int, id array<{kind}>, sizes binary, values binary, codes binary"), "kmeans-blocks")
    for _ in range(rounds):
        sums = total(blocks.mapInArrow(_summed(centroids, scale), DIGITS))[dim]
        new = [[sums.get(c * (dim + 1) + j, 0) for j in range(dim + 1)] for c in range(len(centroids))]
        moved = [[s // x[-1] for s in x[:-1]] if x[-1] else old for x, old in zip(new, centroids.tolist(), strict=True)]
        centroids = _integers(moved)
    assigned = materialize(blocks.mapInArrow(_assigned(centroids, scale), f"id {kind}, cluster int, distance long"), "kmeans-assigned")
    release(blocks)
    per = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("long")).collect()}
    inertia = [None if (r := per.get(c)) and r["long"] else int(r["s"]) if r else 0 for c in range(len(centroids))]
    all_of = None if None in inertia else sum(inertia)
    in_long = lambda x: x if x is not None and x < LONG else None
    table = [(c, per[c]["n"] if c in per else 0, in_long(inertia[c]), in_long(all_of), [str(x) for x in v]) for c, v in enumerate(centroids.tolist())]
    return Clustering(assigned.withColumnRenamed("id", "vec_id"), spark.createDataFrame(table, empty.clusters.schema))


def _integers(rows: list[list[int]]) -> np.ndarray:
    big = any(not -(1 << 62) < x < 1 << 62 for r in rows for x in r)
    return np.array(rows, object if big else np.int64)


def clustered(vectors: DataFrame, **more) -> DataFrame:
    """``lookup_kmeans`` as one table: (vec_id, cluster, distance, cluster_inertia, inertia, centroid)."""
    found = lookup_kmeans(vectors, **more)
    return found.assigned.join(F.broadcast(found.clusters.drop("size")), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
