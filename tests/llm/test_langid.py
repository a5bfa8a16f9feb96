from __future__ import annotations

import math
import zlib

import pytest
from pyspark.sql import functions as F

from veilframe.llm import langid


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)
    assert sum(x.lang_pred == x.lang for x in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in r)


def test_held_out_labels_are_never_seen(small):
    a = langid.identify(small)
    b = langid.identify(small.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert sorted(a.collect()) == sorted(b.collect())


def test_edges(edges, edge_rows, nothing, small):
    r = langid.identify(edges).collect()
    assert len(r) == len(edge_rows)
    blank = {x.doc_id: (x.lang_pred, x.score) for x in r}
    assert blank[4] == blank[5] == blank[6] == ("und", 0.0)
    assert {x.lang_pred for x in r} <= {"en", "de", "fr", "es", "ja", "und"}
    assert langid.identify(nothing).count() == 0
    unlabelled = langid.identify(small.withColumn("lang", F.lit(None).cast("string")))
    assert {x.lang_pred for x in unlabelled.collect()} == {"und"}


def test_filter_keeps_columns_and_clean_rows(small, edges):
    assert langid.filter_known(small).count() == small.count()
    kept = langid.filter_known(edges)
    assert kept.columns == edges.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {("own score", "own lang_pred")}
    assert not {4, 5, 6} & {r.doc_id for r in kept.collect()}


def bucket(a: int, b: int, c: int | None = None) -> int:
    """Bucket of a bigram or trigram of code points, in plain integers."""
    m = 2**32
    h = (a * 0x9E3779B1 + b * 0x85EBCA77) % m
    if c is None:
        return ((h ^ h >> 15) * 0x27D4EB2F % m) >> 32 - langid.BITS
    h = (h + c * 0xC2B2AE3D) % m
    return ((h ^ h >> 13) * 0x165667B1 % m) >> 32 - langid.BITS


def grams(text):
    codes = [ord(c) if c.isalpha() else 32 for c in (text or "").replace("\0", " ").lower()]
    padded = [32, *codes, 32]
    return [g for i, c in enumerate(codes, 1) if c != 32 for g in (bucket(padded[i - 1], c), bucket(padded[i - 1], c, padded[i + 1]))]


def test_by_brute_force(small):
    """Naive Bayes by dictionaries over the same hashed n-grams, on every training row."""
    rows = [(r.doc_id, r.text, r.lang) for r in small.select("doc_id", "text", "lang").collect()]
    counts = {}
    for doc, text, lang in rows:
        if lang is not None and zlib.crc32(str(doc).encode()) % 5:
            for g in grams(text):
                own = counts.setdefault(lang, {})
                own[g] = own.get(g, 0) + 1
    p, size = langid.LangIdParams(), 1 << langid.BITS
    total = {k: sum(v.values()) + p.smoothing * size for k, v in counts.items()}
    for r in langid.identify(small).collect():
        g = grams(next(t for d, t, _ in rows if d == r.doc_id))
        if not g:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {k: sum(math.log((v.get(x, 0) + p.smoothing) / total[k]) for x in g) for k, v in counts.items()}
        best = max(sorted(logs), key=logs.get)
        score = 1 / sum(math.exp((x - logs[best]) / len(g) * min(len(g), p.sharpness)) for x in logs.values())
        assert r.lang_pred == best and abs(r.score - score) < 1e-4


def test_too_many_labels_are_an_error(small):
    with pytest.raises(ValueError):
        langid.identify(small, langid.LangIdParams(max_classes=3))
