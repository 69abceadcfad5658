"""Operator 1: mixing sources to target weights by a minimum-cost flow.

Documents may belong to several sources.  They are aggregated by membership
pattern (the set of their sources); a pattern offers its summed size once for
each allowed copy, each further copy at a higher price (convex costs), and a
source wants its quota.  The cheapest flow from patterns to quotas says how
many tokens of each pattern go to each source; only this aggregate, one row
per pattern, is solved on the driver.

Documents are then selected by a seeded order.  A pattern's documents lie one
after the other on a line of the pattern's size, copy after copy; the flow
takes the line's first part, source after source.  So one copy of every
document is used before any second one, and at most one document per pattern
and source is taken in part.  A document's place on the line is needed
exactly only where a boundary falls: sums per slice of the order (two levels
of 256) tell which slices a boundary cuts, and only their documents are
numbered, so a pattern with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolens.llm.common import SPACES, columns, fresh, materialize

#: Bound on the number of membership patterns and sources that the driver solves for.
MAX_PATTERNS = 100_000
_SLICES = 256


def share_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Targets by weight of ``total``; none above ``most`` times its source's size.

    What a stopped source leaves is shared by weight among the others until
    none is above its limit.
    """
    target = {s: 0.0 for s in sizes}
    free, left = set(sizes), float(total)
    while free:
        w = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / w > most * sizes[s]} if w else set()
        if not full:
            for s in free:
                target[s] = left * weights[s] / w if w else 0.0
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        free -= full
    return target


def min_cost_flow(supply: list[int], member: list[Iterable[int]], quota: list[int], copies: int) -> dict[tuple[int, int], int]:
    """Tokens from pattern p to source s, {(p, s): n}.

    Pattern p gives at most ``copies`` times supply[p]; its c-th copy costs
    2c - 1 a token.  Every quota is filled as far as the patterns allow, at the
    least total cost (successive shortest paths; the graph is the aggregate's).
    """
    patterns, sources = len(supply), len(quota)
    sink = patterns + sources + 1
    to, cap, cost, out = [], [], [], defaultdict(list)

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, n, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(n)
            cost.append(v)

    for p in range(patterns):
        if supply[p] > 0:
            for c in range(copies):
                arc(0, p + 1, supply[p], 2 * c + 1)
            for s in sorted(set(member[p])):
                arc(p + 1, patterns + 1 + s, copies * supply[p], 0)
    for s in range(sources):
        arc(patterns + 1 + s, sink, quota[s], 0)
    price = defaultdict(int)
    while True:
        dist, via, heap, done = {0: 0}, {}, [(0, 0)], set()
        while heap:
            d, x = heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                if cap[e] > 0 and to[e] not in done:
                    n = d + cost[e] + price[x] - price[to[e]]
                    if n < dist.get(to[e], 1 << 62):
                        dist[to[e]], via[to[e]] = n, e
                        heappush(heap, (n, to[e]))
        if sink not in done:
            break
        far = dist[sink]
        for x in range(sink + 1):
            price[x] += min(dist.get(x, far), far)
        path, x = [], sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow = {}
    for p in range(patterns):
        for e in out[p + 1]:
            if not e & 1 and cap[e ^ 1]:
                flow[p, to[e] - patterns - 1] = cap[e ^ 1]
    return flow


def mix(docs: DataFrame, sources: str, size: str, targets: dict, key: list[str], copies: int = 3, seed: int = 42,
        taken: str = "taken") -> DataFrame:
    """``docs`` with the column ``taken``: tokens that the mix takes of each document, repeats counted.

    ``sources``: array of the sources a document belongs to (nulls and an
    empty or null array are allowed; such a document feeds nobody but a
    target named None, when its array holds null).  ``size``: long; null or
    below 1 counts 0 and takes 0.  ``targets``: source -> tokens; targets
    beyond ``copies`` times what reaches a source are met as far as possible.
    ``key``: columns that order documents together with the seed; rows alike
    in them share their place (either of equal rows may be taken first).
    An input column named like ``taken`` is replaced.  Reruns agree.
    """
    spark = docs.sparkSession
    docs = docs.drop(taken)
    n, u, pat, b1, b2, at, place, cut, q, open_ = fresh(docs, "n", "u", "pat", "b1", "b2", "at", "place", "cut", "q", "open")
    d = docs.select(
        "*", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias(n),
        F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]).alias(u),
        F.to_json(F.struct(F.sort_array(F.array_distinct(F.coalesce(F.col(sources), F.array().cast("array<string>")))).alias("s")),
                  {"ignoreNullFields": "false"}).alias(pat))
    d = materialize(d.withColumns({b1: F.expr(f"cast((({u}) >> 56) & 255 AS int)"), b2: F.expr(f"cast((({u}) >> 48) & 255 AS int)")}), "mix")

    found = d.groupBy(pat).agg(F.sum(n).alias("n"), F.first(F.from_json(F.col(pat), "s array<string>")["s"]).alias("s")).where("n > 0") \
        .orderBy(pat).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    place_of = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([r["n"] for r in found], [[place_of[s] for s in r["s"] if s in place_of] for r in found],
                         [round(targets[s]) for s in names], copies)
    # a pattern's flow is q whole copies and the line's first `cut` tokens once more
    total = [sum(flow.get((p, s), 0) for s in range(len(names))) for p in range(len(found))]
    plan = spark.createDataFrame(
        [(r[pat], *divmod(total[p], r["n"])) for p, r in enumerate(found)], f"{pat} string, {q} long, {cut} long")

    def slices(rows: DataFrame, by: list[str], last: str, base: str | None) -> DataFrame:
        """Start ``at`` and size ``w`` of each slice ``last`` of the order, within ``by``."""
        s = rows.groupBy(*by, last, *([base] if base else [])).agg(F.sum(n).alias("w"))
        w = Window.partitionBy(*by).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
        return s.withColumn(at, F.coalesce(F.sum("w").over(w), F.lit(0)) + (F.col(base) if base else F.lit(0)))

    inside = (F.col(at) < F.col(cut)) & (F.col(cut) < F.col(at) + F.col("w"))
    one = slices(d, [pat], b1, None).join(F.broadcast(plan), pat).withColumn(open_, inside)
    one = materialize(one.select(pat, b1, at, open_), "mix-slices")
    marked = d.join(one, [pat, b1], "left").withColumnRenamed(at, place)  # no slice: size 0 in the whole pattern
    shut = marked.where(F.col(open_).isNull() | ~F.col(open_)).drop(open_)
    rest = marked.where(open_).drop(open_)
    two = slices(rest, [pat, b1], b2, place).join(F.broadcast(plan), pat).withColumn(open_, inside)
    two = materialize(two.select(pat, b1, b2, at, open_), "mix-slices")
    rest = rest.drop(place).join(two, [pat, b1, b2]).withColumnRenamed(at, place)
    shut = shut.unionByName(rest.where(~F.col(open_)).drop(open_))
    order = Window.partitionBy(pat, b1, b2).orderBy(u, *[F.col(f"`{k}`") for k in key], n) \
        .rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.where(open_).drop(open_).withColumn(place, F.col(place) + F.coalesce(F.sum(n).over(order), F.lit(0)))
    placed = shut.unionByName(rest).join(F.broadcast(plan), pat, "left")
    part = F.least(F.greatest(F.col(cut) - F.col(place), F.lit(0)), F.col(n))
    return placed.withColumn(taken, F.coalesce(F.col(q) * F.col(n) + part, F.lit(0)).cast("long")).select(*columns(docs), taken)


def source_sizes(docs: DataFrame, source: str, size: str) -> list:
    """One row (source, n) per source; their number is bounded by MAX_PATTERNS."""
    found = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    return found


def cycle_weights(names: Iterable, cycle: tuple[int, ...] = (1, 2, 3)) -> dict:
    """Weights of ``cycle``, repeating, for the names by code point (null last)."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}


def repeat_taken(mixed: DataFrame, text: str, size: str, taken: str) -> DataFrame:
    """One row per copy that the mix takes; ``size`` and ``taken`` (in words of ``text``) go.

    A document taken for q whole copies and r words more gives q rows as they
    are and one whose text ends after its r-th word.
    """
    copy, head, rest = fresh(mixed, "copy", "head", "rest")
    d = mixed.where((F.col(taken) > 0) & (F.col(size) > 0)).withColumn(
        copy, F.explode(F.sequence(F.lit(0), F.ceil(F.col(taken) / F.col(size)).cast("int") - 1)))
    left = F.col(taken) - F.col(copy) * F.col(size)
    d = d.withColumn(rest, F.when(left < F.col(size), left).cast("int")).withColumn(head, F.ltrim(F.col(text), F.lit(SPACES)))
    # split in rest + 1 parts: the last is all that follows the rest-th word
    after = F.length(F.expr(f"element_at(split(`{head}`, '[\\\\x20\\\\x09-\\\\x0D]+', `{rest}` + 1), `{rest}` + 1)"))
    part = F.rtrim(F.left(F.col(head), F.length(head) - after), F.lit(SPACES))
    return d.withColumn(text, F.when(F.col(rest).isNull(), F.col(text)).otherwise(part)).drop(copy, head, rest, size, taken)
