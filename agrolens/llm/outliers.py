"""Operator 3 [native]: quality rules with robust multivariate outliers.

Per document the base statistics are computed inside the row by DataFrame
functions (no shuffle, whole texts).  Documents that pass the base rules give
a vector of four transformed statistics; per language and source a
minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps, and a document is rejected when its robust Mahalanobis
distance exceeds the chi-square cut.

The estimate starts at four places (STARTS) and repeats: take the
(n + DIM + 1) / 2 nearest of n documents, estimate again.  So few break down
only when nearly half of a group is junk.  The start whose core ends with the
least determinant stands, and all documents near that core give the final
estimate.  The nearest are found from counts per distance bin and every bin
carries the moments of its documents, so one step of all starts is one
partially aggregated pass over the narrow statistics, however large a group
is; nothing is gathered per group but its (bounded) bins.  Vectors are held as
whole units of 1e-4, so sums do not depend on their order (below 2**53).

The same passes also estimate every language over all its sources, and all
documents; these judge the documents of groups too small for an estimate of
their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolens.llm.common import fresh, materialize, words

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIM = 4
_UNIT = 1e4
#: Least standard deviation of each coordinate: a statistic that is constant
#: in a group's core (no symbols, no repeated line) still tolerates a little.
#: At the cut for 0.9999 (4.85) each can reject alone: words longer or shorter
#: by a third, 0.22 symbols per word, 54% of all lines repeated, 42% of all
#: words repeated.
FLOOR = (0.06, 0.04, 0.16, 0.11)
#: Centre and spread of each start: medians with quartile ranges, medians with
#: median deviations, and either quartile with the floors.
STARTS = (("m", "iqr"), ("m", "mad"), ("a", None), ("z", None))
#: Documents within this quantile of the core's distances give the final estimate.
NEAR = 0.975
#: Fewest documents that give an estimate.
LEAST = 8
#: Level (0: language and source, 1: language, 2: all documents), language, source.
_GROUP = ["g0", "g1", "g2"]


def _chi2_even(x: float, dof: int) -> float:
    """Chi-square distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def _chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_even(mid, dof) < p else (low, mid)
    return low


def with_statistics(docs: DataFrame, text: str = "text", n_lines: str | None = None) -> DataFrame:
    """``docs`` with the five base statistics (longs) as columns; same-named columns are replaced.

    ``n_lines``: name of a column for the number of lines that are not blank.
    Null and empty texts have none of anything.
    """
    w, ln, gram, dup = fresh(docs, "w", "ln", "gram", "dup")
    keep = [c for c in docs.columns if c.lower() not in STATS]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    q = [F.col(f"`{c}`") for c in keep]
    d = docs.select(*q, t.alias(ln), words(t).alias(w))
    # hashes decide cheaply that no window repeats; texts decide where one may
    d = d.select(*q, ln, w, F.expr(
        f"CASE WHEN size({w}) < 4 THEN array() ELSE transform(sequence(0, size({w}) - 3), "
        f"i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])) END").alias(gram))
    d = d.select(*q, ln, w, F.expr(
        f"CASE WHEN size(array_distinct({gram})) = size({gram}) THEN NULL ELSE "
        f"sort_array(transform(sequence(0, size({w}) - 3), i -> struct({w}[i] AS a, {w}[i + 1] AS b, {w}[i + 2] AS c, i AS p))) "
        f"END").alias(dup))
    same = f"{dup}[i].a = {dup}[j].a AND {dup}[i].b = {dup}[j].b AND {dup}[i].c = {dup}[j].c"
    hit = (f"sort_array(transform(filter(sequence(0, size({dup}) - 1), i -> "
           f"(i > 0 AND {same.replace('[j]', '[i - 1]')}) OR (i < size({dup}) - 1 AND {same.replace('[j]', '[i + 1]')})), "
           f"i -> {dup}[i].p))")
    d = d.select(*q, ln, w, F.expr(f"CASE WHEN {dup} IS NULL THEN array() ELSE {hit} END").alias(dup))
    lines = F.filter(F.split(F.col(ln), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(*q, F.col(w), F.col(dup), F.col(ln), lines.alias(gram))
    return d.select(
        *q,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(ln) - F.length(F.translate(F.col(ln), "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(gram) - F.size(F.array_distinct(F.col(gram)))).cast("long").alias("n_dup_lines"),
        # each hit covers three words, fewer where the next hit starts earlier
        F.when(F.size(dup) == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(
            F.zip_with(F.slice(F.col(dup), 2, F.size(dup)), F.slice(F.col(dup), 1, F.greatest(F.size(dup) - 1, F.lit(1))),
                       lambda b, a: F.least(F.coalesce(b - a, F.lit(0)), F.lit(3))),
            F.lit(0), lambda s, x: s + x)).cast("long").alias("n_repeat_words"),
        *([F.size(gram).cast("long").alias(n_lines)] if n_lines else []))


def base_failed() -> Column:
    """The base rules on the statistics' columns."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(n_lines: str) -> list[Column]:
    """Transformed statistics in whole units of 1/_UNIT; shares (of lines, of words) as -log(1 - share)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(F.col("n_symbols") / n),
         -F.log1p(-F.col("n_dup_lines") / F.greatest(F.col(n_lines), F.lit(1))), -F.log1p(-F.col("n_repeat_words") / n)]
    return [F.rint(c * _UNIT) for c in x]


def _distance2(m: list[Column], low: list[list[Column]], x: list[Column]) -> Column:
    """Squared distance by forward substitution with the Cholesky factor."""
    z: list[Column] = []
    for i in range(DIM):
        s = x[i] - m[i]
        for j in range(i):
            s = s - low[i][j] * z[j]
        z.append(s / low[i][i])
    total = z[0] * z[0]
    for c in z[1:]:
        total = total + c * c
    return total


def _names(p: str) -> list[str]:
    return [f"{p}{i}" for i in range(DIM)]


def _tri(p: str) -> list[str]:
    return [f"{p}{i}{j}" for i in range(DIM) for j in range(i + 1)]


def _factored(means: DataFrame, *keys: str) -> DataFrame:
    """(keys, m*, s*) to the Cholesky factor l* of s*, one column after the other."""
    d = means
    for i in range(DIM):
        for j in range(i + 1):
            e = F.col(f"s{i}{j}")
            for k in range(j):
                e = e - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            e = F.sqrt(F.greatest(e, F.lit(1e-12))) if i == j else e / F.col(f"l{j}{j}")
            d = d.withColumn(f"l{i}{j}", e)
    return d.select(*keys, *_names("m"), *_tri("l"))


def _same_group(a: DataFrame, b: DataFrame, there: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(_GROUP, there, strict=True):
        on = on & a[x].eqNullSafe(b[y])
    return on


def _scored(vectors: DataFrame, model: DataFrame) -> DataFrame:
    d2 = _distance2([F.col(c) for c in _names("m")],
                    [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(DIM)], [F.col(c) for c in _names("x")])
    there = [f"of_{g}" for g in _GROUP]
    m = model.withColumnsRenamed(dict(zip(_GROUP, there, strict=True)))
    return vectors.join(m, _same_group(vectors, m, there)).withColumn("d2", d2)


def _start(vectors: DataFrame) -> DataFrame:
    """Centres and spreads of the STARTS (numbered by ``start``) from counts on a grid of 0.01."""
    cells = vectors.select(*_GROUP, F.posexplode(F.array(*[F.floor(F.col(c) / (_UNIT / 100)) for c in _names("x")])).alias("c", "v")) \
        .groupBy(*_GROUP, "c", "v").agg(F.count("*").alias("n"))
    cells = materialize(cells, "cells")
    by = Window.partitionBy(*_GROUP, "c")

    def quantiles(d: DataFrame, at: str, **wanted: float) -> DataFrame:
        d = d.withColumn("t", F.sum("n").over(by)).withColumn(
            "u", F.sum("n").over(by.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        return d.groupBy(*_GROUP, "c").agg(*[F.min(F.when(F.col("u") >= F.lit(p) * F.col("t"), F.col(at))).alias(n) for n, p in wanted.items()])

    one = quantiles(cells, "v", a=.25, m=.5, z=.75)
    middle = F.sum(F.when(F.col("half"), F.col("v"))).over(by)
    # the median's cell is the first that reaches half of all
    half = cells.withColumn("u", F.sum("n").over(by.orderBy("v"))).withColumn("t", F.sum("n").over(by)).withColumn(
        "half", (2 * F.col("u") >= F.col("t")) & (2 * (F.col("u") - F.col("n")) < F.col("t")))
    off = half.withColumn("off", F.abs(F.col("v") - middle)).select(*_GROUP, "c", "off", "n")
    wide = quantiles(off, "off", mad=.5).withColumnsRenamed({g: f"of_{g}" for g in _GROUP} | {"c": "of_c"})
    one = one.join(wide, _same_group(one, wide, [f"of_{g}" for g in _GROUP]) & (one["c"] == wide["of_c"]))
    unit = _UNIT / 100
    spread = {"iqr": (F.col("z") - F.col("a")) * unit / 1.349, "mad": F.col("mad") * unit * 1.4826, None: F.lit(0.0)}
    one = one.select(*_GROUP, "c", F.posexplode(F.array(*[
        F.struct(((F.col(centre) + 0.5) * unit).alias("m"), spread[sd].alias("sd")) for centre, sd in STARTS])).alias("start", "at"))
    cols = []
    for i in range(DIM):
        pick = lambda e, i=i: F.max(F.when(F.col("c") == i, e))
        sd = F.greatest(F.col("at.sd"), F.lit(FLOOR[i] * _UNIT))
        cols += [pick(F.col("at.m")).alias(f"m{i}"), pick(sd * sd).alias(f"s{i}{i}")]
        cols += [pick(F.lit(0.0)).alias(f"s{i}{j}") for j in range(i)]
    return _factored(one.groupBy(*_GROUP, "start").agg(*cols), *_GROUP, "start")


def _sums() -> list[Column]:
    """Count and moments of the vectors."""
    x = _names("x")
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"t{i}") for i, c in enumerate(x)],
            *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)]]


def _estimate(sums: DataFrame, share: float, core: bool, *keys: str) -> DataFrame:
    """Centre and factored scatter from the moments of the nearest ``share``.

    A core's scatter has the floors added, so that two lumps on a line are
    seldom its least determinant; elsewhere a variance is at least the floor.
    """
    consistency = share / _chi2_even(_chi2_quantile(share, DIM), DIM + 2)
    mean = sums.select(*keys, F.col("n").cast("double").alias("n"), *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(DIM)], *_tri("q"))
    cov = {(i, j): (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency for i in range(DIM) for j in range(i + 1)}
    return _factored(mean.select(*keys, *_names("m"), *[_floored(c, i, j, core).alias(f"s{i}{j}") for (i, j), c in cov.items()]), *keys)


def _floored(c: Column, i: int, j: int, core: bool) -> Column:
    """An element of the scatter: a variance is at least FLOOR squared; a quarter of that is added against singular scatter."""
    least = (FLOOR[i] * _UNIT) ** 2
    return c if i != j else c + least if core else c + F.greatest(least - c, F.lit(least / 4))


def _concentrated(vectors: DataFrame, model: DataFrame, support: float) -> DataFrame:
    """One concentration step of every start: moments of the nearest documents of each group."""
    keys = [*_GROUP, "start"]
    binned = _scored(vectors, model).withColumn("b", F.floor(32 * F.log1p("d2")).cast("int"))
    bins = binned.groupBy(*keys, "b").agg(*_sums())
    by = Window.partitionBy(*keys)
    near = bins.withColumn("all", F.sum("n").over(by)).withColumn(
        "before", F.coalesce(F.sum("n").over(by.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .where(F.col("before") < F.greatest(F.ceil(F.lit(support) * F.col("all")), F.floor((F.col("all") + DIM + 1) / 2)))
    tot = near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", *_names("t"), *_tri("q"))])
    return _estimate(tot, support, True, *keys)


def _best(model: DataFrame) -> DataFrame:
    """Of each group's starts the one with the least determinant (of equals the first)."""
    size = F.lit(0.0)
    for i in range(DIM):
        size = size + F.log(f"l{i}{i}")
    parts = [*_names("m"), *_tri("l")]
    best = model.groupBy(*_GROUP).agg(F.min(F.struct(F.round(size, 9).alias("size"), "start", *parts)).alias("best"))
    return best.select(*_GROUP, *[F.col(f"best.{c}").alias(c) for c in parts])


def _reweighted(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """The estimate from all documents near the core."""
    near = _scored(vectors, model).where(F.col("d2") <= _chi2_quantile(NEAR, DIM))
    return _estimate(near.groupBy(*_GROUP).agg(*_sums()), NEAR, False, *_GROUP)


def _models(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """(g1, g2, mcd) for each language and source: the estimate of its own, its language's or that of all, the first of LEAST documents."""
    size = vectors.groupBy(*_GROUP).agg(F.count("*").alias("members")).where(F.col("members") >= LEAST)
    there = [f"of_{g}" for g in _GROUP]
    size = size.withColumnsRenamed(dict(zip(_GROUP, there, strict=True)))
    known = materialize(model.join(size, _same_group(model, size, there)).select(
        *_GROUP, F.struct(*_names("m"), *_tri("l")).alias("fit")), "mcd")
    out = vectors.where("g0 = 0").select("g1", "g2").distinct()
    on = ["g1", "g2"]
    for level in range(3):
        one = known.where(F.col("g0") == level).select(*[F.col(g).alias(f"of_{g}") for g in on], F.col("fit").alias(f"fit{level}"))
        same = F.lit(True)
        for g in on:
            same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
        out = out.join(one if on else F.broadcast(one), same, "left").drop(*[f"of_{g}" for g in on])  # all documents: one row
        on = on[:-1]
    return out.select("g1", "g2", F.coalesce("fit0", "fit1", "fit2").alias("fit")).where("fit IS NOT NULL").select(
        F.struct("g1", "g2", "fit.*").alias("mcd"))


def mark_outliers(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", support: float = 0.5,
                  steps: int = 4, confidence: float = 0.9999, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) with the base statistics, base_failed, distance2 and kept.

    kept is false if base_failed, else whether the squared robust distance
    (distance2) is at most the chi-square quantile ``confidence``.  ``support``:
    share of the core, which has (n + DIM + 1) / 2 of n documents at least.  A null
    language or source forms a group of its own.  Groups of fewer than
    eight passing documents are judged by their language's estimate over all
    sources, or by that of all documents if the language has fewer than eight
    too; a whole table of fewer than eight is not judged (kept, distance2 null).
    Null or empty texts fail the base rules; an empty table gives an empty result.
    Input columns named like a result column are replaced.
    """
    out = [*STATS, "base_failed", "distance2", "kept"]
    cols = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in out]
    g1, g2, n_lines, *vec = fresh(docs, "g1", "g2", "n_lines", *_names("x"))
    d = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{lang}`").cast("string").alias(g1),
                    F.col(f"`{source}`").cast("string").alias(g2), F.col(f"`{text}`").alias(fresh(docs, "body")[0]))
    d = with_statistics(d, d.columns[-1], n_lines).drop(d.columns[-1])
    d = d.withColumn("base_failed", base_failed())
    d = materialize(d.select("*", *[c.alias(v) for c, v in zip(_vector(n_lines), vec, strict=True)]), "quality")
    none = F.lit(None).cast("string")
    levels = [(F.lit(0), F.col(g1), F.col(g2)), (F.lit(1), F.col(g1), none), (F.lit(2), none, none)]
    vectors = d.where("NOT base_failed").select(
        F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(x, _GROUP, strict=True)]) for x in levels])).alias("g"),
        *[F.col(v).alias(x) for v, x in zip(vec, _names("x"), strict=True)]).select("g.*", *_names("x"))
    model = materialize(_start(vectors), "mcd")
    for _ in range(steps):
        model = materialize(_concentrated(vectors, model, support), "mcd")
    model = materialize(_reweighted(vectors, materialize(_best(model), "mcd")), "mcd")
    (mcd,) = fresh(d, "mcd")
    model = materialize(_models(vectors, model), "mcd").select(F.col("mcd").alias(mcd))
    part = lambda n: F.col(f"{mcd}.{n}")
    joined = d.join(model, F.col(g1).eqNullSafe(part("g1")) & F.col(g2).eqNullSafe(part("g2")) & ~F.col("base_failed"), "left")
    d2 = _distance2([part(c) for c in _names("m")], [[part(f"l{i}{j}") for j in range(i + 1)] for i in range(DIM)],
                    [F.col(v) for v in vec])
    return joined.withColumn("distance2", d2).select(
        *[F.col(f"`{c}`") for c in cols], *STATS, "base_failed", "distance2",
        (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= _chi2_quantile(confidence, DIM))).alias("kept"))
