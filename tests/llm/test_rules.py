from __future__ import annotations

import re

from compare import differences

from veilframe.llm import rules
from veilframe.llm.oracles import QUALITY_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def key(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_counts_by_brute_force(small, edges):
    for d in (small, edges):
        want = sorted(((r.doc_id or -9,) + base(r.text)) for r in d.select("doc_id", "text").collect())
        got = sorted(((r.doc_id or -9,) + key(r)) for r in rules.judge(d).collect())
        assert got == want


def test_same_as_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        assert differences(rules.judge(spark.read.parquet(f"{d}/documents.parquet")), d, QUALITY_RULES) == ""


def test_verdicts(spark, edges, nothing):
    r = {x.doc_id: x for x in rules.judge(edges).collect()}
    assert not r[4].kept and not r[12].kept and r[4].char_distance is None
    assert rules.judge(nothing).count() == 0
    got = rules.accepted(edges)
    assert got.columns == edges.columns and {(r._row_key, r.row_key, r.kept) for r in got.collect()} == {("own _row_key", "own row_key", "own kept")}
    assert 4 not in {x.doc_id for x in got.collect()} and rules.accepted(nothing).count() == 0


def test_divergence_rejects_junk_and_keeps_clean(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    r = [x for x in rules.judge(d).collect() if x.doc_id in labels and not x.base_failed]
    good = [x.kept for x in r if labels[x.doc_id]]
    assert sum(good) / len(good) > 0.97
    assert any(not x.kept for x in r if not labels[x.doc_id])


def test_rare_and_missing_languages_are_compared_with_all(spark, tmp_path):
    """By SQL and by what goes: digits and symbols among prose, without a language or in one of few documents."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = " ".join(f"{i * 7919 % 1000003}=#{i}" for i in range(60))
    prose = d.filter("lang = 'en'").orderBy("doc_id").first().text
    rows = [(10**6 + k, t, lang) for k, (t, lang) in enumerate((t, lang) for t in (junk, prose) for lang in (None, "xx"))]
    made = d.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    made.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = rules.judge(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert differences(got, str(tmp_path), QUALITY_RULES) == ""
    r = {x.doc_id: x for x in got.collect()}
    assert [r[10**6 + k].kept for k in range(4)] == [False, False, True, True] and all(r[10**6 + k].word_distance is None for k in range(4))


def test_native(small):
    plan = rules.judge(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
