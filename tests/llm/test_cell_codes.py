import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolens.llm import cell_codes as op
from agrolens.llm.vectors import LONG
from tests.llm.helpers import CLASHES

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds=2, scale=256):
    """{(id, label, code, error)}, books per dimension."""
    out, books = [], {}
    kept = [(i, [math.floor(scale * x) if abs(x) < 2 ** 40 else int(x) * scale for x in v], lab) for i, v, lab in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    for dim in {len(v) for _, v, _ in kept}:
        some = [r for r in kept if len(r[1]) == dim]
        w = dim // parts
        cut = lambda v, p: v[p * w:(p + 1) * w]  # noqa: B023, E731
        first = sorted(some, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        book = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
        near = lambda v, p: min((far(cut(v, p), e), j) for j, e in enumerate(book[p]))  # noqa: B023, E731
        for _ in range(rounds):
            own = [[near(v, p)[1] for p in range(parts)] for _, v, _ in some]
            for p in range(parts):
                for j in range(len(book[p])):
                    mine = [cut(v, p) for (_, v, _), o in zip(some, own, strict=True) if o[p] == j]
                    if mine:
                        book[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        for i, v, lab in some:
            found = [near(v, p) for p in range(parts)]
            error = sum(d for d, _ in found)
            out.append((i, lab, "".join(f"{j:02x}" for _, j in found), error if error < LONG else None))
        books[dim] = book
    return out, books


def key(r):
    return [(x is None, x or 0) if not isinstance(x, str) else x for x in r]


def same(df, rows, parts, entries, **more):
    found = op.cell_codes(df, parts=parts, entries=entries, **more)
    want, books = brute(rows, parts, entries)
    got = [(r.vec_id, r.label, r.code, r.error) for r in found.coded.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {d: [[list(e) for e in p] for p in b] for d, b in found.books.items()} == books
    return found, want


@pytest.mark.parametrize("kind", ["even", "grouped", "ties", "wide", "negative"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 12)) / 4
    if kind == "grouped":
        v = v[rng.integers(0, 20, 300)] + rng.normal(size=(300, 12)) / 900
    if kind == "ties":
        v = rng.integers(-2, 3, (300, 12)) / 256
    if kind == "wide":
        v *= 10.0 ** rng.integers(-3, 10, (300, 1))
    if kind == "negative":
        v = -np.abs(v) - 3
    rows = [(i, x.tolist(), None if i % 7 == 0 else i % 3) for i, x in enumerate(v)]
    found, want = same(spark.createDataFrame(rows, SCHEMA).repartition(3), rows, 4, 16, block=40)
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + (LONG if e is None else e)
    assert {(r.label, r.label_error) for r in op.with_label_error(found.coded).collect()} == {(k, v if v < LONG else None) for k, v in sums.items()}


def test_awkward_rows(spark):
    rows = [(1, [0.5, 0.1], 1), (1, [0.5, 0.1], 1), (2, [NAN, 1.0], 1), (3, [INF, 1.0], 1), (4, [None, 1.0], 1), (5, None, 1), (6, [], None), (7, [1.0], 2),
            (8, [1.0, 2.0, 3.0, 4.0], 2), (None, [0.2, -0.7], None), (10, [-0.3, 0.0], None), (11, [-1e-9, 1e-9], 3), (12, [1.0, 2.0, 3.0, 4.5], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    found, want = same(df, rows, 2, 3)
    assert len(want) == 7
    wide = df.withColumns({c: F.lit(1) for c in [*CLASHES, "code", "error", "dim", "units", "m0", "same"] if c not in df.columns})
    assert sorted(map(tuple, op.cell_codes(wide, parts=2, entries=3).coded.collect()), key=key) == sorted(map(tuple, found.coded.collect()), key=key)
    none = op.cell_codes(df.where("false"))
    assert none.coded.count() == 0 and none.books == {} and op.with_label_error(none.coded).count() == 0


def test_components_of_any_size(spark):
    rows = [(1, [3e300, -2e300], 1), (2, [1e308, 1e308], 1), (3, [0.25, 0.5], 2), (4, [2.0 ** 60, 1.0], 2), (5, [-3e5, 2e5], 2), (6, [1e6, -1e6], 2)]
    found, _ = same(spark.createDataFrame(rows, SCHEMA), rows, 2, 2)
    assert {(r.label, r.label_error is None) for r in op.with_label_error(found.coded).collect()} == {(1, True), (2, True)}


@pytest.mark.parametrize("kind", [np.int64, object])
def test_memo_is_exact_and_evaluates_less(kind):
    rng = np.random.default_rng(3)
    book = rng.normal(0, 32, (64, 4)).astype(int)
    book[10] = book[3]  # equal entries: the lower index wins
    parts = rng.normal(0, 32, (6000, 4)).astype(int)
    memo = op.Memo(book.astype(kind))
    d = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    for at in (0, 3000):
        code, far = memo.nearest(parts[at:at + 3000].astype(kind))
        assert code.tolist() == d[at:at + 3000].argmin(axis=1).tolist() and far.tolist() == d[at:at + 3000].min(axis=1).tolist()
    assert memo.evaluated < 6000 * 64 / 3
    seen = memo.measured
    memo.nearest(parts.astype(kind))
    assert memo.measured == seen  # every cell is known


def test_clashing_hashes_and_a_full_memo(monkeypatch):
    rng = np.random.default_rng(4)
    book, parts = rng.integers(-99, 99, (20, 3)), rng.integers(-150, 150, (500, 3))
    want = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    monkeypatch.setattr(op, "_hashed", lambda cells: (cells[:, 0] & 1).astype(np.uint64))
    assert op.Memo(book).nearest(parts)[0].tolist() == want
    monkeypatch.setattr(op, "CELLS", 10)
    memo = op.Memo(book)
    for at in range(0, 500, 50):
        assert memo.nearest(parts[at:at + 50])[0].tolist() == want[at:at + 50]
