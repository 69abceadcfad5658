import collections

import corpus_pipeline
from agrolens.llm import outliers, simhash, suffix
from agrolens.session import materialize
from tests.llm.helpers import awkward_docs, empty_like, words_of


def test_stages_of_awkward_rows(spark, sf):
    """Each stage alone takes every awkward row and keeps the columns."""
    for extra in (False, True):
        docs = awkward_docs(spark, extra)
        for name, stage in corpus_pipeline.STAGES:
            for d in (docs, empty_like(docs)):
                out = stage(spark, d, sf)
                n = out.count()
                assert name == "packing" or out.columns == docs.columns
                assert n or not d.count() or name == "quality_rules"


def test_run_applies_every_decision(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = d = materialize(stage(spark, d, sf), "test-stage")
    good = {r.doc_id for r in outliers.mark_outliers(docs).where("kept").collect()}
    assert {r.doc_id for r in kept["quality_rules"].collect()} == good
    groups = {r.doc_id: r.component_id for r in simhash.simhash_components(kept["quality_rules"]).collect()}
    assert {r.doc_id for r in kept["simhash_dedup"].collect()} == set(groups.values())
    assert suffix.repeated_passages(kept["simhash_dedup"]).where("again_words > 0").count()
    before = {r.doc_id: r for r in kept["simhash_dedup"].collect()}
    after = {r.doc_id: r for r in kept["suffix_array"].collect()}
    touched = {i for i in after if after[i].text != before[i].text}
    assert touched and all(after[i].n_chars == len(after[i].text) for i in after)
    mixed = kept["source_mix"].collect()
    sizes, got = collections.Counter(), collections.Counter()
    for r in after.values():
        sizes[r.source] += len(words_of(r.text))
    for r in mixed:
        got[r.source] += len(words_of(r.text))
        assert r.text == after[r.doc_id].text or after[r.doc_id].text.startswith(r.text)
    total = sum(sizes.values())
    assert abs(sum(got.values()) - total) <= len(sizes)
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    for s in sizes:
        if got[s] < 3 * sizes[s] - 1:
            assert got[s] >= total * weights[s] / sum(weights.values()) - 1
    copies = collections.Counter(r.doc_id for r in mixed)
    assert collections.Counter(r.doc_id for r in kept["packing"].where("start = 0").collect()) == copies
    assert names == ["quality_rules", "simhash_dedup", "suffix_array", "source_mix", "packing"]
    run = corpus_pipeline.run(spark, sf)
    assert run.columns == kept["packing"].columns and run.agg({"length": "sum"}).first()[0] == kept["packing"].agg({"length": "sum"}).first()[0]
