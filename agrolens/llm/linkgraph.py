"""Operator 10: URL rules and link-graph propagation.

Rules (action, host, path) fit their host and all its subdomains where the
url's path starts with the rule's; the longest wins.  Hosts of pages and link
targets that rules allow or block are the seeds.  Trust is a personalised
PageRank from the allowed seeds along the links between hosts; distrust runs
from the blocked seeds against the links, so a host that links to blocked
hosts collects it.

Both are held against the same walk from all hosts alike.  PageRank is taken in
its linear form (a host puts in 1 - damping of its seed, hosts without links
pass nothing on), so ranks of seeds add up and trust and distrust are parts of
a host's rank.  A host that rules judge has the share of its urls that they
allow or block as trust and distrust; it passes these on and collects nothing.
Any other host has the seeds' share of the rank that links bring it.  That does
not shrink however many hosts link to a blocked one: a host that links to
nothing else has a distrust of 1.  Where no rule fits a page, its host is
blocked if its distrust reaches ``threshold`` and exceeds its trust.

Links are counted per pair of hosts before anything is joined.  Mass is held
in whole units of 1e-9 seeds: sums do not depend on their order and reruns
agree.  Every step is one join and one partially aggregated sum over host
pairs; the small tables go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolens.llm.common import fresh, materialize

UNIT = 1_000_000_000
DAMPING = 0.85
STEPS = 12
#: Share of a host's rank that must come from blocked seeds.
THRESHOLD = 0.5
#: Attribute values of ``href`` in anchor and area tags.
LINK = r"<[aA](?:[rR][eE][aA])?[ \t\r\n\f/][^>]*?[hH][rR][eE][fF][ \t\r\n\f]*=[ \t\r\n\f]*[\"']?[ \t\r\n\f]*([^\"'> \t\r\n\f]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url; both empty without ``://`` and for null."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), _UPPER, _LOWER), F.regexp_extract(u, pattern, 2)


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, rules) for the distinct ``hosts`` that rules fit; rules: longest first.

    Joined on the host's suffixes of at most as many labels as a rule has, so a
    long list of rules is no scan and a host of very many labels no long array.
    """
    spark = hosts.sparkSession
    most = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    table = spark.createDataFrame(sorted({(h.lower(), p, a) for a, h, p in rules}), "rule_host string, path string, action string")
    suffix = hosts.select("host", F.split("host", "\\.").alias("l")).select(
        "host", F.explode(F.expr(f"transform(sequence(greatest(1, size(l) - {most - 1}), size(l)), i -> array_join(slice(l, i, {most}), '.'))")).alias("rule_host"))
    rule = F.concat("rule_host", "path")
    return suffix.join(table, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(F.struct(
        (-F.length(rule)).alias("short"), (F.col("action") == "allow").alias("mild"), rule.alias("rule"), "path", "action"))).alias("rules"))


def _judged(rows: DataFrame, rules: DataFrame, host: str, path: str, best: str) -> DataFrame:
    """``rows`` with the struct ``best`` of the longest rule that fits, or null."""
    r, h = fresh(rows, "rules", "host_of_rule")
    known = rules.select(F.col("host").alias(h), F.col("rules").alias(r))
    return rows.join(known, F.col(host) == F.col(h), "left").withColumn(
        best, F.expr(f"filter({r}, x -> startswith({path}, x.path))")).withColumn(best, F.try_element_at(F.col(best), F.lit(1))).drop(r, h)


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(way, host, mass, rank) in units after ``steps`` steps, rank without what the host puts in if it is no seed.

    ``edges``: (way, src, dst, share), the shares of a source summing to 1 at most per way;
    ``seeds``: (way, host, mass, known), a row for every host that takes part.
    mass: of the walk from the seeds; rank: of that from every host alike.
    """
    part = lambda c: F.floor((1 - damping) * c).cast("long")
    start = seeds.select("way", "host", part(F.col("mass")).alias("mass"), part(F.lit(UNIT)).alias("rank"))
    now = seeds.select("way", "host", "mass", F.lit(UNIT).cast("long").alias("rank"))
    for k in range(steps):
        moved = now.join(edges.withColumnRenamed("src", "host"), ["way", "host"]).select(
            "way", F.col("dst").alias("host"), *[F.floor(damping * F.col(c) * F.col("share")).cast("long").alias(c) for c in ("mass", "rank")])
        now = start.unionByName(moved).groupBy("way", "host").agg(F.sum("mass").alias("mass"), F.sum("rank").alias("rank"))
        if k % 3 == 2 or k == steps - 1:
            now = materialize(now, "rank")
    put = seeds.select("way", "host", F.when(F.col("known"), 0).otherwise(part(F.lit(UNIT))).alias("put"))
    return now.join(put, ["way", "host"]).select("way", "host", "mass", (F.col("rank") - F.col("put")).alias("rank"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html",
          steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    trust and distrust are shares of the host's rank (0 where nothing
    arrives).  Null or malformed urls have empty host and path, fit no rule and
    are allowed; null html has no links; repeated rows each return; an empty
    rule list or table is allowed.  Of rules of one length block comes before
    allow.  Other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), *[c.alias(n) for c, n in zip(url_parts(F.col(url)), ("host", "path"), strict=True)])
    href = F.col("href")
    found = pages.select(url_parts(F.col(url))[0].alias("src"), F.explode(F.regexp_extract_all(
        F.coalesce(F.col(html).cast("string"), F.lit("")), F.lit(LINK), 1)).alias("href"))
    full = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href)).otherwise(href)
    links = found.where(F.contains(href, F.lit("//"))).select("src", *[c.alias(n) for c, n in zip(url_parts(full), ("dst", "path"), strict=True)]) \
        .where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst", "path").agg(F.count("*").alias("n"))
    links = materialize(links, "links")
    seen = rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    seen = seen.unionByName(links.groupBy(F.col("dst").alias("host"), "path").agg(F.sum("n").alias("n")))
    seen = materialize(seen, "urls")
    fits = materialize(host_rules(seen.select("host").distinct(), rules), "host-rules")

    n, action = F.col("n"), F.col("best.action")
    ruled = _judged(seen, fits, "host", "path", "best").groupBy("host").agg(
        F.sum(F.when(action == "allow", n).otherwise(0)).alias("a"), F.sum(F.when(action == "block", n).otherwise(0)).alias("b"), F.sum("n").alias("n"))
    ruled = ruled.where("a + b > 0").select("host", *[F.floor(UNIT * F.col(x).cast("double") / n).cast("long").alias(x) for x in "ab"])
    ruled = materialize(ruled, "known-hosts")
    pairs = links.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    both = pairs.select(F.expr("stack(2, 'out', src, dst, n, 'in', dst, src, n) AS (way, src, dst, n)"))
    total = both.groupBy("way", "src").agg(F.sum("n").alias("all"))
    edges = both.join(total, ["way", "src"]).join(ruled.select(F.col("host").alias("dst")), "dst", "left_anti")
    edges = materialize(edges.select("way", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "host-edges")
    known = ruled.select(F.expr("stack(2, 'out', host, a, true, 'in', host, b, true) AS (way, host, mass, known)"))
    there = edges.select("way", F.explode(F.array("src", "dst")).alias("host"), F.lit(0).cast("long").alias("mass"), F.lit(False).alias("known"))
    seeds = known.unionByName(there).groupBy("way", "host").agg(F.max("mass").alias("mass"), F.max("known").alias("known"))
    found = propagate(edges, materialize(seeds, "seeds"), steps, damping)
    found = found.select("way", "host", F.when(F.col("rank") > 0, F.col("mass") / F.col("rank")).otherwise(0.0).alias("part"))
    rank = found.groupBy("host").agg(F.max(F.when(F.col("way") == "out", F.col("part"))).alias("trust"),
                                     F.max(F.when(F.col("way") == "in", F.col("part"))).alias("distrust"))

    out = _judged(rows, fits, "host", "path", "best").join(rank, "host", "left")
    out = out.select("page_id", "host", "path", "best", *[F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    own = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select(F.col("page_id").alias(page_id), "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce(F.col("best.action"), own).alias("verdict"), "trust", "distrust")


def judge_sql(rules: Sequence[tuple[str, str, str]], steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``judge`` over the table ``pages``, written apart from the Spark plan."""
    cases = "\n".join(
        f"    WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'action': '{a}'}}"
        for a, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])))

    def parts(u: str) -> str:
        return (f"translate(regexp_extract({u}, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}')",
                f"regexp_extract({u}, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 2)")

    h, p = parts("coalesce(url, '')")
    lh, lp = parts("CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END")
    link = LINK.replace("'", "''")
    sql = f"""WITH pg AS (SELECT page_id, {h} AS host, {p} AS path, coalesce(html, '') AS html FROM pages),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS href FROM pg),
lk AS (SELECT src, {lh} AS dst, {lp} AS path FROM found WHERE contains(href, '//')),
links AS (SELECT src, dst, path, count(*) AS n FROM lk WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
seen AS (SELECT host, path, count(*) AS n FROM pg WHERE host <> '' GROUP BY ALL
         UNION ALL SELECT dst, path, sum(n) FROM links GROUP BY ALL),
ruled AS (SELECT host, n, CASE
{cases}
    ELSE NULL END AS best FROM seen),
known AS MATERIALIZED (SELECT host, CAST(floor({UNIT}::DOUBLE * coalesce(sum(n) FILTER (best.action = 'allow'), 0) / sum(n)) AS BIGINT) AS a,
    CAST(floor({UNIT}::DOUBLE * coalesce(sum(n) FILTER (best.action = 'block'), 0) / sum(n)) AS BIGINT) AS b
    FROM ruled GROUP BY host HAVING count(best) > 0),
pairs AS (SELECT src, dst, sum(n) AS n FROM links GROUP BY ALL),
way AS (SELECT 'out' AS way, src, dst, n FROM pairs UNION ALL SELECT 'in', dst, src, n FROM pairs),
shares AS (SELECT way, src, dst, n::DOUBLE / (sum(n) OVER (PARTITION BY way, src))::DOUBLE AS share FROM way),
edges AS MATERIALIZED (SELECT * FROM shares WHERE dst NOT IN (SELECT host FROM known)),
seeds AS MATERIALIZED (SELECT way, host, max(mass) AS mass, bool_or(known) AS known FROM (
    SELECT 'out' AS way, host, a AS mass, true AS known FROM known UNION ALL SELECT 'in', host, b, true FROM known
    UNION ALL SELECT way, src, 0, false FROM edges UNION ALL SELECT way, dst, 0, false FROM edges) GROUP BY way, host),
start AS MATERIALIZED (SELECT way, host, known, CAST(floor({1 - damping!r}::DOUBLE * mass) AS BIGINT) AS own,
    CAST(floor({1 - damping!r}::DOUBLE * {UNIT}) AS BIGINT) AS put FROM seeds),
r0 AS (SELECT way, host, mass, {UNIT}::BIGINT AS rank FROM seeds)"""
    for k in range(steps):
        sql += f""",
r{k + 1} AS MATERIALIZED (SELECT way, host, CAST(sum(mass) AS BIGINT) AS mass, CAST(sum(rank) AS BIGINT) AS rank FROM (
    SELECT way, host, own AS mass, put AS rank FROM start
    UNION ALL SELECT e.way, e.dst, CAST(floor({damping!r}::DOUBLE * r.mass * e.share) AS BIGINT), CAST(floor({damping!r}::DOUBLE * r.rank * e.share) AS BIGINT)
    FROM r{k} r JOIN edges e ON r.way = e.way AND r.host = e.src) GROUP BY ALL)"""
    return sql + f""",
part AS (SELECT way, host, CASE WHEN rank > 0 THEN mass / rank ELSE 0.0 END::DOUBLE AS part FROM (
    SELECT way, host, mass, rank - CASE WHEN known THEN 0 ELSE put END AS rank FROM r{steps} JOIN start USING (way, host))),
rank AS (SELECT host, max(part) FILTER (way = 'out') AS trust, max(part) FILTER (way = 'in') AS distrust FROM part GROUP BY host),
judged AS (SELECT page_id, host, path, CASE
{cases}
    ELSE NULL END AS best FROM pg)
SELECT page_id, j.host, path, best.rule AS rule, coalesce(best.action,
    CASE WHEN coalesce(distrust, 0) >= {threshold} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(trust, 0.0::DOUBLE) AS trust, coalesce(distrust, 0.0::DOUBLE) AS distrust
FROM judged j LEFT JOIN rank ON j.host = rank.host"""
