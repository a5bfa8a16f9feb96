from __future__ import annotations

import corpus_pipeline as cp
from compare import differences

from veilframe.llm import jaccard, langid, lines, packing, rules
from veilframe.llm.oracles import QUALITY_RULES

from .test_jaccard import brute as components
from .test_lines import brute as clean_texts
from .test_packing import whole


def test_stages_one_by_one(spark, vocab):
    """Each stage against brute force on what its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language", "quality", "near_copies", "repeats", "packing"]
    kept = cp.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns
    pred = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in pred.items() if r.lang_pred != "und" and r.score >= 0.3}
    good = cp.STAGES[1][1](spark, kept, sf)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in rules.judge(kept).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    single = cp.STAGES[2][1](spark, good, sf)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in components(rows) if d == c)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    cleaned = cp.STAGES[3][1](spark, single, sf)
    want = {d: v[0] for (d, _), v in clean_texts(rows).items()}
    got = {r.doc_id: r for r in cleaned.collect()}
    assert {i: r.text for i, r in got.items()} == {d: want.get(d, t) for d, t in rows}
    assert cleaned.columns == docs.columns and all(r.n_chars == len(r.text) for r in got.values())
    whole(cp.STAGES[4][1](spark, cleaned, sf), [(i, r.text) for i, r in got.items()], vocab)


def test_run_gives_the_rows_of_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for step in (langid.filter_known, rules.accepted, jaccard.one_of_each, lines.deduplicated):
        d = step(d)
    want = packing.pieces(d, cp.word_vocabulary(), with_ids=False)
    assert sorted(cp.pipeline(spark, sf).collect()) == sorted(want.collect())


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    after = {r.doc_id for r in cp.STAGES[1][1](spark, cp.STAGES[0][1](spark, docs, sf), sf).collect()}
    assert len(good & after) / len(good) > 0.95
    assert differences(rules.judge(docs), sf, QUALITY_RULES) == ""
