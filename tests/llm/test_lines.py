from __future__ import annotations

import random
import re

import pytest
from compare import differences
from pyspark.sql import functions as F

from veilframe.llm import lines, queries
from veilframe.llm.oracles import UNIT_DEDUP

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def weight(word: str) -> int:
    return sum(b * i for i, b in enumerate(word.encode(), 1)) * 2654435769 % 2**32


def naive_units(text: str, size: int):
    """(kind, normal form, start, end) by the words of the docstring, without the code under test."""
    at = 0
    for line in text.split("\n"):
        found = list(WORD.finditer(line))
        if found:
            yield 0, " ".join(m[0].translate(LOWER) for m in found), at + found[0].start(), at + found[-1].end()
        at += len(line) + 1
    found = list(WORD.finditer(text))
    ws = [m[0].translate(LOWER) for m in found]
    begins = set()
    for s in range(len(ws) - size + 1):
        part = [weight(w) for w in ws[s : s + size]]
        begins.add(s + part.index(min(part)))
    for k in sorted(begins):
        if k + size <= len(ws):
            yield 1, " ".join(ws[k : k + size]), found[k].start(), found[k + size - 1].end()


def brute(rows, size=lines.UnitParams().window_words):
    """{(doc_id, text): (clean text, [(start, length, kept doc, kept start)])}; rows that share a doc_id are ranked by ``rows``' order."""
    kept, cut = {}, {}
    for key in rows:
        if key[0] is not None and key[1]:
            cut.setdefault(key, list(naive_units(key[1], size)))
    for place, ((doc, text), us) in enumerate(sorted(cut.items(), key=lambda x: x[0][0])):
        for kind, normal, a, z in us:
            kept.setdefault((kind, normal), (doc, text, a, z))
    out = {}
    for (doc, text), us in cut.items():
        gone = [False] * len(text)
        later = []
        for kind, normal, a, z in us:
            d, t, ka, kz = kept[kind, normal]
            if (d, t, ka) != (doc, text, a):
                a = max(a, kz) if (d, t) == (doc, text) else a
                if a < z:
                    later.append((a, a - z, d, ka))
                    gone[a:z] = [True] * (z - a)
        spans = []
        for a, minus, d, ka in sorted(later):
            if spans and a < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], a - minus)
            else:
                spans.append([a, a - minus, d, ka])
        clean = "".join(c for c, g in zip(text, gone, strict=True) if not g)
        out[doc, text] = (clean if not spans or WORD.search(clean) else "", [(a, z - a, d, k) for a, z, d, k in spans])
    return out


def check(df, params=lines.UnitParams()):
    """Every row of ``df`` (distinct ids or equal texts behind them) against brute force."""
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").withColumn("k", F.xxhash64("text")).orderBy("doc_id", "k").collect()]
    want = brute(rows, params.window_words)
    got = lines.dedup(df, params).withColumn("k", F.xxhash64("text"))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "", [tuple(x) for x in r.removed], r.n_removed) for r in got.collect()), key=repr)
    full = [(d, t, *want.get((d, t), (t, []))) for d, t in rows]
    assert got == sorted(((d is None, d or 0, c is None, c or "", s, sum(x[1] for x in s)) for d, _, c, s in full), key=repr)
    return want


def test_by_brute_force(small):
    assert any(s for _, s in check(small).values())


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(queries.op10_unit_dedup(spark, sf), sf, UNIT_DEDUP) == ""


@pytest.mark.parametrize("size", [3, 16])
def test_edges_by_brute_force(edges, nothing, size):
    """Nulls, empty, blank and very long texts, repeated rows, shared ids, clashing columns."""
    params = lines.UnitParams(window_words=size)
    check(edges, params)
    own = {c: f"own {c}" for c in edges.columns[5:]}
    for r in lines.deduplicated(edges, params).collect():
        assert {c: r[c] for c in own} == own
    out = lines.deduplicated(edges)
    assert out.schema.names == edges.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in edges.schema]
    assert lines.dedup(nothing).count() == 0 and lines.deduplicated(nothing).columns == nothing.columns


def test_random_texts_by_brute_force(spark):
    """Few words, so that everything repeats, across rows, inside of them and over itself."""
    rng = random.Random(4)
    vocabulary = ["a", "b", "B", "é", "日本", "word", "the", "x.y"]
    gap = lambda: rng.choice([" ", "  ", "\n", "\t", " \n\n "])
    rows = [(rng.randrange(40), "".join(rng.choice(vocabulary[: rng.randint(1, 8)]) + gap() for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows = sorted({d: t for d, t in rows}.items())
    for size in (2, 5, 16):
        check(spark.createDataFrame(rows, "doc_id long, text string"), lines.UnitParams(window_words=size, passes=3))


def test_a_repeated_line_goes_alone():
    """However short, between unique text."""
    rng = random.Random(11)
    for line in ("Nicht aulich für sch erüver enau sch der.", "Page header", "Les.", "すべての権利を留保します。"):
        rows = [(i, f"{words(rng, 30)}.\n{line}\n{words(rng, 40)}.\nown{i}") for i in range(1, 5)]
        out = brute(rows)
        assert out[rows[0]] == (rows[0][1], [])
        for row in rows[1:]:
            assert out[row] == (row[1].replace(line, ""), [(row[1].index(line), len(line), 1, rows[0][1].index(line))])


def test_text_between_repeats_stays(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 18) for _ in range(3))
    rows = [(i, f"{a}. {f}. {b}. No.\n{c}\n{f}") for i, f in enumerate(["Own one", "Secret is 42", "Q"], 7)]
    for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = rows[r.doc_id - 7][1].split("\n")[2]
        assert r.text.count(own) == 2 and (c in r.text) == (r.doc_id == 7)


def test_every_passage_of_over_50_words_is_found():
    """Without punctuation and with it, spliced anywhere into other text."""
    least, total, n = 1.0, 0.0, 0
    for seed in range(200):
        rng = random.Random(seed)
        for size in (51, 60, 80):
            passage = " ".join(w + "." * (rng.random() < 0.1) for w in words(rng, size).split())
            rows = [(i, f"{words(rng, rng.randint(1, 40))} {passage} {words(rng, rng.randint(1, 40))}") for i in (1, 2)]
            spans = brute(rows)[rows[1]][1]
            where = rows[1][1].index(passage)
            assert spans and all(where <= a and a + k <= where + len(passage) and d == 1 for a, k, d, _ in spans)
            share = sum(k for _, k, _, _ in spans) / len(passage)
            least, total, n = min(least, share), total + share, n + 1
    assert total / n > 0.75 and least > 0.25


def test_rows_that_share_an_id_have_their_own_repeats(spark):
    """(1, A), (5, A), (5, B): B is unique and stays, whatever is cut from its neighbour."""
    rng = random.Random(13)
    a, b = f"{words(rng, 40)}\n{words(rng, 30)}", words(rng, 90)
    out = lines.dedup(spark.createDataFrame([(1, a), (5, a), (5, b), (None, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(0, a), (1, a), (5, ""), (5, b)])
