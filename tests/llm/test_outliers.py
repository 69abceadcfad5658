import collections

import numpy as np

from agrolens.llm import outliers
from tests.llm.helpers import awkward_docs, empty_like, prose, words_of


def statistics(text):
    t, w = text or "", words_of(text)
    lines = [x for x in t.split("\n") if words_of(x)]
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def estimate(x, support=0.5, steps=4):
    """Centre and scatter of one group by numpy: four starts, concentration by bins, least determinant, one reweighting."""
    unit, n = 1e4, len(x)
    floor2 = (np.array(outliers.FLOOR) * unit) ** 2
    cell = np.floor(x / 100)
    quantile = lambda v, p: np.sort(v, axis=0)[max(int(np.ceil(p * n)) - 1, 0)]
    a, m, z = (quantile(cell, p) for p in (.25, .5, .75))
    starts = [(m, (z - a) * 100 / 1.349), (m, quantile(np.abs(cell - m), .5) * 100 * 1.4826), (a, 0 * a), (z, 0 * z)]

    def moments(y, share):
        mean = y.mean(axis=0)
        consistency = share / outliers._chi2_even(outliers._chi2_quantile(share, 4), 6)
        return mean, (y.T @ y / len(y) - np.outer(mean, mean)) * consistency

    def distance(mean, scatter):
        w = np.linalg.solve(np.linalg.cholesky(scatter), (x - mean).T)
        return (w * w).sum(axis=0)
    found = []
    for k, (centre, sd) in enumerate(starts):
        mean, scatter = (centre + .5) * 100, np.diag(np.maximum(sd ** 2, floor2))
        for _ in range(steps):
            b = np.floor(32 * np.log1p(distance(mean, scatter)))
            want = max(np.ceil(support * n), (n + 5) // 2)
            top = next(v for v in np.unique(b) if (b <= v).sum() >= want)
            mean, scatter = moments(x[b <= top], support)
            scatter = scatter + np.diag(floor2)
        found.append((round(float(np.log(np.diag(np.linalg.cholesky(scatter))).sum()), 9), k, mean, scatter))
    _, _, mean, scatter = min(found, key=lambda f: f[:2])
    near = x[distance(mean, scatter) <= outliers._chi2_quantile(outliers.NEAR, 4)]
    if not len(near):
        return None
    mean, scatter = moments(near, outliers.NEAR)
    return mean, scatter + np.diag(np.maximum(floor2 - np.diag(scatter), floor2 / 4))


def brute(rows, confidence=0.9999):
    """(statistics, base_failed, kept, distance2) of every row, from the estimate of its group, its language's or that of all."""
    stats = [statistics(r.text) for r in rows]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    lines = [max(sum(bool(words_of(x)) for x in (r.text or "").split("\n")), 1) for r in rows]
    x = {k: np.rint(1e4 * np.array([np.log(max(s[1], 1) / s[0]), np.log1p(s[2] / s[0]), -np.log1p(-s[3] / lines[k]), -np.log1p(-s[4] / s[0])]))
         for k, s in enumerate(stats) if not failed[k]}
    levels = [collections.defaultdict(list) for _ in range(3)]
    for k in x:
        for level, group in enumerate(((rows[k].lang, rows[k].source), rows[k].lang, None)):
            levels[level][group].append(k)
    fits = [{g: estimate(np.array([x[k] for k in at])) for g, at in level.items() if len(at) >= outliers.LEAST} for level in levels]
    kept, far = [not f for f in failed], [None] * len(rows)
    for k in x:
        fit = fits[0].get((rows[k].lang, rows[k].source)) or fits[1].get(rows[k].lang) or fits[2].get(None)
        if fit:
            w = np.linalg.solve(np.linalg.cholesky(fit[1]), x[k] - fit[0])
            far[k] = float(w @ w)
            kept[k] = far[k] <= outliers._chi2_quantile(confidence, 4)
    return stats, failed, kept, far


def same_as_brute(docs):
    rows = docs.collect()
    got = {r.doc_id: r for r in outliers.mark_outliers(docs).collect()}
    assert len(got) == len(rows)
    rejected = 0
    for r, s, f, k, d in zip(rows, *brute(rows), strict=True):
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == s
        assert (g.base_failed, g.kept) == (f, k)
        assert (g.distance2 is None) == (d is None) and (d is None or abs(g.distance2 - d) <= 1e-6 * (1 + d))
        rejected += not f and not k
    return rejected


def test_documents_match_brute_force(spark):
    assert same_as_brute(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) > 10


def test_contaminated_sets_match_brute_force(spark):
    """Groups with a third or more of junk, without spread, with two lumps, and too small for an estimate of their own."""
    rng = np.random.default_rng(6)
    rows = []

    def add(lang, source, n, make):
        rows.extend([(len(rows) + i, make(i), lang, source) for i in range(n)])
    marks = lambda text, share: " ".join(w + "#" * int(rng.random() < share) for w in text.split())
    for source, bad in (("a", 30), ("b", 44), ("c", 5)):
        add("en", source, 100 - bad, lambda i: marks(prose(i, 80 + i), .02))
        add("en", source, bad, lambda i: marks(prose(900 + i, 120), .7))
    add("de", "copies", 40, lambda i: prose(5, 100))
    add("de", "copies", 21, lambda i: "\n".join([prose(7, 12)] * 3 + [prose(50 + i, 60)]))
    for i in range(30):
        add("de", f"host{i}", 1 + i % 3, lambda k, i=i: marks(prose(300 + 10 * i + k, 70 + i), .9 if i % 9 == 0 else .01))
    add("fr", "few", 3, lambda i: prose(700 + i, 90))
    add(None, None, 2, lambda i: prose(800 + i, 90))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert same_as_brute(docs) > 80


def test_good_labels_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    marked = outliers.mark_outliers(docs, keep=["doc_id"]).join(good, "doc_id")
    assert marked.where("NOT base_failed AND NOT kept").count() == 0


def test_contaminated_group(spark):
    rows = [(i, prose(i, 200), "en", "s") for i in range(60)] + [(100 + i, prose(i, 100) + " ###" * 60, "en", "s") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in outliers.mark_outliers(docs).where("kept").collect()}
    assert kept == set(range(60))


def test_third_of_a_group_is_junk(spark):
    """Copies of one junk document, and different ones, up to 44% of their group; junk has 1.1 symbols per word."""
    junk = lambda i: " ".join(w + "#" * (2 if k % 10 == 0 else 1) for k, w in enumerate(prose(i, 150).split()))
    rows = []
    for source, bad, copies in [("a", 34, True), ("b", 34, False), ("c", 44, True), ("d", 44, False), ("e", 30, True)]:
        rows += [(k, prose(k, 100 + k), "en", source) for k in range(100 - bad)]
        rows += [(1000 + k, junk(1000 if copies else 1000 + k), "en", source) for k in range(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(r.kept == (r.doc_id < 1000) for r in outliers.mark_outliers(docs).collect())


def test_small_groups_are_judged_by_the_pool(spark):
    """A source of its own per document: the language judges; a language of one document: all documents do."""
    junk = lambda i: prose(i, 100) + " ###" * 60
    rows = [(i, prose(i, 200), "en", f"host{i}") for i in range(60)] + [(100 + i, junk(i), "en", f"spam{i}") for i in range(15)]
    rows += [(200, prose(200, 200), "fr", "a"), (201, junk(201), "fr", "b"), (202, prose(202, 200), None, None), (203, junk(203), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.mark_outliers(docs).collect()}
    assert {i for i, r in got.items() if r.kept} == {*range(60), 200, 202} and all(r.distance2 is not None for r in got.values())
    few = docs.where("doc_id < 5")
    assert all(r.kept and r.distance2 is None for r in outliers.mark_outliers(few).collect())


def test_query_and_pipeline_judge_small_groups(spark):
    import corpus_pipeline
    from agrolens.llm.queries import QUERIES

    root = "/root/testdata/sf0.01"
    got = QUERIES["op3_mcd_outliers"](spark, root)
    assert got.where("NOT base_failed AND distance2 IS NULL").count() == 0
    good = spark.read.parquet(f"{root}/labels.parquet").where("quality = 1").select("doc_id")
    assert got.join(good, "doc_id").where("NOT base_failed AND NOT kept").count() == 0
    staged = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    assert sorted(r.doc_id for r in staged.collect()) == sorted(r.doc_id for r in got.where("kept").collect())


def test_each_statistic_rejects_alone(spark):
    """One planted document per coordinate beside the clean labelled ones, each with that coordinate off and the others at rest."""
    root = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{root}/documents.parquet").where("lang = 'en'").join(
        spark.read.parquet(f"{root}/labels.parquet").where("quality = 1"), "doc_id").select("doc_id", "text").collect()
    clean = max((r.text for r in good), key=lambda t: (statistics(t)[3:] == (0, 0), len(t))).split()[:200]
    assert statistics(" ".join(clean))[2:] == (0, 0, 0)
    plant = {
        -1: " ".join(w + w[: len(w) // 2 + 1] for w in clean),  # half as long again
        -2: " ".join(clean) + " " + "<| " * 40,  # 0.33 symbols per word
        -3: "\n".join(x for k in range(10) for x in ["Menu", " ".join(clean[20 * k:20 * k + 20]), "Menu"]),  # 19 of 30 lines
        -4: " ".join(clean[:110]) + " " + " ".join(" ".join(clean[:8] + clean[110 + k:111 + k]) for k in range(10))}  # 88 of 200 words
    rows = [(r.doc_id, r.text, "en", "s") for r in good] + [(i, t, "en", "s") for i, t in plant.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.mark_outliers(docs, keep=["doc_id"]).collect()}
    assert {r.doc_id for r in got.values() if not r.kept and not r.base_failed} == set(plant)
    assert not any(got[i].base_failed for i in plant)


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    out = outliers.mark_outliers(docs)
    assert set(docs.columns) - {"kept"} <= set(out.columns)
    got = sorted(((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()))
    assert got == sorted((r.doc_id or 0, *statistics(r.text)) for r in docs.collect())
    assert outliers.mark_outliers(empty_like(docs)).count() == 0
