from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilframe.llm import sites

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_better_than_the_base_rate(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    even = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    odd = {r.doc_id: r.quality for r in labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1).collect()}
    r = [x for x in sites.classify(d, even, F.col("source"), F.concat_ws("/", "source", "lang")).collect() if x.doc_id in odd]
    good, bad = [x.kept for x in r if odd[x.doc_id]], [x.kept for x in r if not odd[x.doc_id]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.4


def test_sparse_sites_shrink(spark):
    rng = random.Random(1)
    rows, labels, i = [], [], 0
    for host, n, rate in [("big", 400, 0.9), ("poor", 300, 0.1), ("mid", 300, 0.5), ("tiny", 1, 0.0), ("none", 0, 0.0)]:
        for k in range(max(n, 3)):
            rows.append((i, "same words in each text", host, f"{host}/{k % 2}"))
            if k < n:
                labels.append((i, int(rng.random() < rate)))
            i += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    r = {x.host: x for x in sites.classify(d, y, F.col("host"), F.col("path")).join(d.select("doc_id", "host"), "doc_id").collect()}
    overall = np.mean([v for _, v in labels])
    assert abs(r["big"].host_mean - 0.9) < 0.05 and abs(r["poor"].host_mean - 0.1) < 0.06
    assert r["tiny"].host_mean > 0.15 and abs(r["none"].host_mean - overall) < 0.02
    assert r["none"].path_mean == r["none"].host_mean and abs(r["big"].log_odds) < 1e-9


def test_held_out_documents_are_ranked_well(spark):
    """Area under the curve on the fold that teaches nothing, with both kinds of evidence and with words alone."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect()}
    for params, least in ((sites.SiteParams(hold_out=True), 0.95), (sites.SiteParams(hold_out=True, evidence=0.0), 0.85)):
        r = sites.classify(d, labels, F.col("source"), F.concat_ws("/", "source", "lang"), params).collect()
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)
        good = [x.quality for x in r if x.held_out and y.get(x.doc_id) == 1]
        bad = [x.quality for x in r if x.held_out and y.get(x.doc_id) == 0]
        wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
        assert wins / (len(good) * len(bad)) > least
    flipped = labels.withColumn("quality", F.when(sites.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = sites.classify(d, flipped, F.col("source"), F.concat_ws("/", "source", "lang"), sites.SiteParams(hold_out=True, evidence=0.0))
    assert {(x.doc_id, round(x.quality, 9)) for x in again.collect()} == {(x.doc_id, round(x.quality, 9)) for x in r}


def brute(rows, labels, p):
    """{doc_id: (host mean, path mean, log odds, quality)} by dictionaries; ``rows``: doc_id, text, host, path."""
    y = {}
    for doc, q in labels:
        y.setdefault(doc, []).append(q)
    y = {k: sum(v) / len(v) for k, v in y.items()}
    logit = lambda x: math.log(x / (1 - x))
    words = {}

    def bag(text):
        found = {w.translate(LOWER) for w in WORD.findall(text)}
        for w in found - set(words):
            words[w] = int(sites.buckets(pa.array([w], pa.large_string()))[0][0])
        return {words[w] for w in found}

    taught = [r for r in rows if r[0] in y]
    n, g = Counter(), Counter()
    bins = {k: [Counter(), Counter()] for k in range(len(sites.MEASURES))}
    for doc, text, _, _ in taught:
        for b in bag(text):
            n[b] += 1
            g[b] += y[doc]
        for k, v in enumerate(sites.measure(text.encode())):
            bins[k][0][v] += y[doc]
            bins[k][1][v] += 1 - y[doc]
    base = sum(g.values()) / sum(n.values())
    paths = {}
    for doc, _, host, path in taught:
        a = paths.setdefault((host, path), [0, 0])
        a[0] += 1
        a[1] += y[doc]
    hosts = {}
    for (host, _), (a, b) in paths.items():
        h = hosts.setdefault(host, [0, 0])
        h[0] += a
        h[1] += b
    p0 = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)

    def strength(groups):
        """groups: (n, k, rate of the level above)."""
        size = sum(a for a, _, _ in groups)
        within = sum(a * r * (1 - r) for a, _, r in groups)
        spread = sum(a * a * (b / a - r) ** 2 for a, b, r in groups)
        pairs = sum(a * a for a, _, _ in groups) - size
        between = (spread - within) / pairs if pairs else 0
        return min(p.most, max(p.least, within / size / between - 1)) if between > 0 else p.most

    m = strength([(a, b, p0) for a, b in hosts.values()])
    host_mean = {h: (b + m * p0) / (a + m) for h, (a, b) in hosts.items()}
    m = strength([(a, b, host_mean[h]) for (h, _), (a, b) in paths.items()])
    path_mean = {k: (b + m * host_mean[k[0]]) / (a + m) for k, (a, b) in paths.items()}
    out = {}
    for doc, text, host, path in rows:
        odds = 0.0
        for k, v in enumerate(sites.measure(text.encode())):
            kinds = len(bins[k][0])
            if v in bins[k][0]:
                odds += math.log((bins[k][0][v] + p.smoothing) / (sum(bins[k][0].values()) + p.smoothing * kinds)) - math.log((bins[k][1][v] + p.smoothing) / (sum(bins[k][1].values()) + p.smoothing * kinds))
        own = bag(text)
        each = [logit((g[b] + p.pseudo_texts * base) / (n[b] + p.pseudo_texts)) - logit(base) for b in own]
        odds = odds * p.evidence + (sum(each) / len(own) * min(len(own), p.word_weight) if own else 0.0)
        h = host_mean.get(host, p0)
        q = path_mean.get((host, path), h)
        out[doc] = (h, q, odds, 1 / (1 + math.exp(-logit(q) - odds)))
    return out


def test_by_brute_force(spark, small):
    d = small.select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    labels = labels.unionByName(labels.filter("doc_id % 3 = 0").withColumn("quality", F.lit(0)))
    p = sites.SiteParams(word_weight=7.0, evidence=0.5)
    want = brute([(r.doc_id, r.text or "", r.host, r.path) for r in d.collect()], [tuple(r) for r in labels.collect()], p)
    for r in sites.classify(d, labels, F.col("host"), F.col("path"), p).collect():
        assert np.allclose((r.host_mean, r.path_mean, r.log_odds, r.quality), want[r.doc_id], rtol=1e-4, atol=1e-5), r


def test_edges(spark, edges, nothing, edge_rows):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (12, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    r = sites.classify(edges, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(r) == len(edge_rows) and all(0 < x.quality < 1 for x in r)
    bare = sites.classify(edges, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert {x.quality for x in bare} == {0.5} and len(bare) == len(edge_rows)
    assert sites.classify(nothing, labels, F.col("source"), F.col("lang")).count() == 0
