"""Operator 5: SimHash near-duplicates by pigeonhole blocks.

A fingerprint has one bit per bit of the shingle hashes: 1 where over half of
the document's hashes have it.  Two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` of ``blocks`` bit
blocks, so they share the masked value of one of the C(blocks, distance)
block choices.  Distinct fingerprints are joined on those values and the
Hamming distance is verified.

Scale: copies collapse to one fingerprint first.  A block value held by n
fingerprints is cut into about n/128 chunks and every pair of chunks is one
group of work, so no group is unbounded and no link is lost; a group returns a
spanning forest of its links (no pair lists), which keeps the components.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.llm.common import columns, fresh, materialize, numbered
from agrolens.llm.components import connected_components

SEED = 42
_CHUNK = 1 << 15


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text (A-Z lower-cased); no word: 0."""
    w = (data or b"").lower().split()  # bytes: ASCII letters and the six ASCII spaces only
    if not w:
        return 0
    x = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        grams = iter([b" ".join(w)])
        n = 1
    else:
        n = len(w) - shingle + 1
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter((x(g, SEED) for _, g in zip(range(min(_CHUNK, n - at)), grams)), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in text), np.uint64, len(text))
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["r", "fp"])
    return run


def with_fingerprint(rows: DataFrame, rid: str, text: str, shingle: int) -> DataFrame:
    """(r, fp) of each row; fp is the fingerprint's 64 bits as a signed long."""
    return rows.select(F.col(rid).cast("long").alias("r"), F.col(text).cast("string").alias("t")) \
        .mapInArrow(_fingerprints(shingle), "r long, fp long")


def _forest(a: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (root, member) that span the same components as all close pairs of ``a``."""
    left, out = np.sort(a), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = deque([root])
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.popleft()) <= distance
            if near.any():
                hit, left = left[near], left[~near]
                todo.extend(hit)
                out.extend((root, x) for x in hit)
    return out


def _links(distance: int):
    names = ["c", "k", "i", "j"]

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        fp = cols[4].view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        two = start[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            if found := _forest(fp[s:s + n], distance):
                f = np.array(found, np.uint64)
                a.append(f[:, 0])
                b.append(f[:, 1])
        return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last, maybe unfinished group
        for batch in batches:
            cols = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (*names, "fp")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.all([c == c[-1] for c in cols[:4]], axis=0)
            cut = int(np.argmax(last))
            held = [c[cut:] for c in cols]
            if cut:
                yield solve([c[:cut] for c in cols])
        if held is not None:
            yield solve(held)
    return run


def fingerprint_links(fps: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long) at ``distance`` or fewer bits.

    The links span the components of all such pairs.  Null fingerprints are ignored.
    """
    if not 0 <= distance < blocks <= 64:
        raise ValueError("0 <= distance < blocks <= 64 is needed")
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    masks = [sum(block[i] for i in keep) for keep in combinations(range(blocks), blocks - distance)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.where("fp is not null").select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k"))
        for i, m in enumerate(masks)])).alias("b")).select("fp", "b.c", "b.k")
    shared = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    # chunks of about 128; from 8192 members on 64 chunks, and never above about 16,384 a chunk
    held = keyed.join(shared, ["c", "k"]).select(
        "c", "k", "fp", F.expr("greatest(least(ceil(n / 128), 64), ceil(n / 16384))").cast("int").alias("m"))
    held = held.withColumn("own", F.expr("pmod(xxhash64(fp), m)").cast("int"))
    work = held.select("c", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")).select(
        "c", "k", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "fp")
    work = work.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j", "fp")
    return work.mapInArrow(_links(distance), "a long, b long")


def _clusters(prints: DataFrame, doc_id: str, distance: int, blocks: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint of the written table ``prints``."""
    fps = prints.select("fp").distinct()
    roots = connected_components(fingerprint_links(fps, distance, blocks))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                       distance: int = 3, blocks: int = 6) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per document row.

    fingerprint: 16 lower-case hex digits; component_id: the smallest doc_id
    reachable over links of at most ``distance`` bits, own included.  A null
    or wordless text has fingerprint zero and links like any other.  Null ids
    keep their row; they are smallest for nobody (a component of null ids only
    has a null id).  Repeated rows each return.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in t), np.uint64, len(t))
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    prints = materialize(rows.mapInArrow(run, f"id {kind}, fp long"), "simhash")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = _clusters(prints, doc_id, distance, blocks)
    byfp = least.join(roots, "fp")
    component = byfp.groupBy("root").agg(F.min("least").alias("component_id"))
    found = byfp.join(component, "root").select("fp", "component_id")
    return prints.join(found, "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                  distance: int = 3, blocks: int = 6) -> DataFrame:
    """``docs`` with exactly one row of each group of near-duplicates.

    The row with the smallest id stays (a null id comes last; of repeated rows
    with that id, one).  All columns of ``docs`` return, whatever their names.
    """
    (rid,) = fresh(docs, "rid")
    rows = numbered(docs, rid, "simhash-docs")
    prints = materialize(with_fingerprint(rows, rid, text, shingle), "simhash")
    roots = _clusters(prints, doc_id, distance, blocks)
    ids = rows.select(F.col(rid).alias("r"), F.col(doc_id).alias("id"))
    first = prints.join(ids, "r").groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "r")).alias("f"))
    stay = first.join(roots, "fp").groupBy("root").agg(F.min("f").alias("f")).select(F.col("f.r").alias(rid))
    return rows.join(stay, rid, "left_semi").select(*columns(docs))
