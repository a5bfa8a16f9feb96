"""Quality by hierarchical empirical Bayes (operator 1).

A document's own evidence is a naive-Bayes log odds of its words, hashed to buckets, and of a few binned text measures.
Both are learned from labelled documents: words on a bounded sample of them (``train_rows``), measures by grouped
aggregation over all.  Labels also go up the site hierarchy: paths (sections) to hosts to the whole corpus.
Beta priors between levels get their strength from the spread of the rates below them (method of moments on grouped
sums), so a host with few labels stays near the global rate and a path with few labels near its host's.  The posterior
of a document is its path's mean as prior odds times its tempered evidence.

Only narrow measures are joined or shuffled; sums are pre-aggregated before each shuffle.  Host and path means are
resolved in one table of sites, which is joined once, by broadcast where its counted rows allow that.

With ``hold_out``, documents whose crc32(doc_id as text) is divisible by 5 teach nothing and are marked.

Defined results: a null text is empty; null hosts and paths are a site of their own; a site without labels has its
parent's mean; without any label all means are one half and evidence is zero; contradictory or repeated labels of a
document count as their mean; a label that is null doesn't count.  Rows keep their number, those that share a doc_id share its labels.
Other columns, also with clashing names, don't enter.  Very long texts are one slice each (some 35 times their bytes of memory).  A posterior
equal to ``threshold`` is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import MADE, drop_staged, slices, staged, texts
from veilframe.llm.lines import words_of

BUCKETS = 1 << 16
MEASURES = ["symbols", "capitals", "digits", "spaces", "packed", "length"]


@dataclass(frozen=True)
class SiteParams:
    """``evidence`` tempers the log odds of the measures, which depend on each other; ``word_weight`` words count at most.

    ``least`` and ``most`` bound prior strengths, ``pseudo_texts`` shrink a word's share of good texts toward that of all, ``train_rows`` is about
    how many labelled documents teach words, ``broadcast_sites`` the most rows of a broadcast.
    """

    evidence: float = 1.0
    word_weight: float = 30.0
    pseudo_texts: float = 100.0
    train_rows: int = 20_000
    broadcast_sites: int = 200_000
    hold_out: bool = False
    smoothing: float = 1.0
    least: float = 2.0
    most: float = 1000.0
    threshold: float = 0.5


def measure(raw: bytes) -> tuple[int, ...]:
    """Bins of the share of symbols, capitals, digits and white space, of the packed size, and of the length."""
    n = len(raw)
    if not n:
        return (0,) * len(MEASURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum() - c[44] - c[46]
    shares = [symbols / n, c[65:91].sum() / n, c[48:58].sum() / n, (c[32] + c[9:14].sum()) / n]
    return (*(min(15, int(40 * s)) for s in shares), min(15, int(20 * len(zlib.compress(raw, 1)) / n)), n.bit_length())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def buckets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each distinct word, index of its text): a word that a text repeats counts once."""
    words = words_of(text)
    both = np.unique(words.owner << 16 | (words.hashes[:, 0] >> np.uint64(48)).astype(np.int64))
    return both & BUCKETS - 1, both >> 16


def word_odds(docs: DataFrame, truth: DataFrame, params: SiteParams) -> np.ndarray:
    """Log odds of a good text with a word of each bucket, over those of any text; shrunk, so 0 where nothing was learned."""
    share = params.train_rows / max(1, truth.count())
    few = truth.filter(F.pmod(F.xxhash64("label_doc", F.lit(13)), F.lit(1 << 30)) < min(1.0, share) * (1 << 30))

    def count(batches):
        total = np.zeros((2, BUCKETS))
        for b in slices(batches, limit=2 << 20):
            bucket, owner = buckets(texts(b))
            y = b.column("y").to_numpy()[owner]
            total += [np.bincount(bucket, y, BUCKETS), np.bincount(bucket, 1 - y, BUCKETS)]
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "good", "bad"])

    # a bounded number of ids, by the share above
    d = docs.select(F.col("doc_id").cast("long").alias("label_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "label_doc").select("text", "y")
    got = d.mapInArrow(count, "bucket int, good double, bad double").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    n = np.zeros((2, BUCKETS))
    n[:, got.column("bucket").to_numpy()] = [got.column("good").to_numpy(), got.column("bad").to_numpy()]
    if not n.sum(1).all():  # nothing to tell apart
        return np.zeros(BUCKETS)
    good = n[0].sum() / n.sum()
    share = (n[0] + params.pseudo_texts * good) / (n.sum(0) + params.pseudo_texts)
    return np.log(share / (1 - share)) - np.log(good / (1 - good))


def measured(docs: DataFrame, host: Column, path: Column, odds: np.ndarray, params: SiteParams) -> DataFrame:
    """doc_id, host, path, bins array<int>, word_odds of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(odds.astype(np.float32))

    def run(batches):
        for b in slices(batches, limit=2 << 20):
            text = texts(b)
            bins = [x for t in text.cast(pa.large_binary()).to_pylist() for x in measure(t)]
            at = pa.array(np.arange(b.num_rows + 1) * len(MEASURES), pa.int32())
            bucket, owner = buckets(text)
            n = np.bincount(owner, minlength=b.num_rows)
            mean = np.bincount(owner, sent.value[bucket], b.num_rows) / np.maximum(n, 1)
            columns = [b.column("doc_id"), b.column("host"), b.column("path"), pa.ListArray.from_arrays(at, pa.array(bins, pa.int32())), pa.array(mean * np.minimum(n, params.word_weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "path", "bins", "word_odds"])

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(host).alias("host"), text(path).alias("path"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, host string, path string, bins array<int>, word_odds double")


def evidence_table(labelled: DataFrame, params: SiteParams) -> DataFrame:
    """measure, bin, odds: log P(bin | good) / P(bin | bad); at most a few dozen rows for each measure."""
    e = labelled.select("y", F.posexplode("bins").alias("measure", "bin"))
    counts = e.groupBy("measure", "bin").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    total = counts.groupBy("measure").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("bins")).withColumnRenamed("measure", "m")
    s = params.smoothing
    odds = F.log((F.col("good") + s) / (F.col("all_good") + s * F.col("bins"))) - F.log((F.col("bad") + s) / (F.col("all_bad") + s * F.col("bins")))
    return counts.join(total, F.col("measure") == F.col("m")).select("measure", "bin", odds.alias("odds"))


def strength(groups: DataFrame, rate: str, params: SiteParams) -> Column:
    """Prior strength from grouped sums of (n, k) around ``rate``: within-group variance over that between groups."""
    p, n = F.col(rate), F.col("n")
    within = F.sum(n * p * (1 - p))
    spread = F.sum(n * n * (F.col("k") / n - p) ** 2)
    between = (spread - within) / (F.sum(n * n) - F.sum(n))
    m = F.sum(n * p * (1 - p)) / F.sum(n) / between - 1
    return F.when(between > 0, F.greatest(F.lit(params.least), F.least(F.lit(params.most), m))).otherwise(F.lit(params.most))


def site_means(d: DataFrame, labelled: DataFrame, params: SiteParams) -> DataFrame:
    """host, path, host_mean, path_mean of each site of ``d``, each level shrunk toward the one above."""
    paths = staged(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # a smoothed rate: one pseudo-label of each kind, so that it is never 0 or 1
    p0 = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p0")).first().p0
    hosts = hosts.withColumn("p0", F.lit(p0))
    m = hosts.agg(strength(hosts, "p0", params).alias("m")).first().m
    hosts = hosts.select("host", ((F.col("k") + m * F.col("p0")) / (F.col("n") + m)).alias("host_mean"))
    paths = paths.join(hosts, "host")
    m = paths.agg(strength(paths, "host_mean", params).alias("m")).first().m
    paths = paths.select("host", "path", ((F.col("k") + m * F.col("host_mean")) / (F.col("n") + m)).alias("path_mean"))
    sites = d.groupBy("host", "path").count().drop("count").join(hosts, "host", "left").join(paths, ["host", "path"], "left")
    host_mean = F.coalesce("host_mean", F.lit(p0))
    return sites.select("host", "path", host_mean.alias("host_mean"), F.coalesce("path_mean", host_mean).alias("path_mean"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, params: SiteParams = SiteParams()) -> DataFrame:
    """doc_id, held_out, host_mean, path_mean, log_odds, quality (posterior), kept of each row of ``docs``.

    ``labels`` has doc_id and quality (0 or 1).
    """
    before = len(MADE)
    truth = labels.select(F.col("doc_id").cast("long").alias("label_doc"), F.col("quality").cast("double").alias("y")).filter("y IS NOT NULL AND label_doc IS NOT NULL")
    if params.hold_out:
        truth = truth.filter(~held_out(F.col("label_doc")))
    truth = staged(truth.groupBy("label_doc").agg(F.avg("y").alias("y")), "truth")
    d = staged(measured(docs, host, path, word_odds(docs, truth, params), params), "measures")
    labelled = staged(d.join(truth, F.col("doc_id") == F.col("label_doc")).drop("label_doc"), "labelled")
    sites = staged(site_means(d, labelled, params), "sites")
    got = evidence_table(labelled, params).collect()  # bounded by measures x bins
    table = np.zeros((len(MEASURES), 64))
    for r in got:
        table[r["measure"], r["bin"]] = r["odds"]
    rows = F.array(*[F.array(*map(F.lit, row)) for row in table.tolist()])
    odds = F.aggregate(F.zip_with(rows, "bins", lambda row, b: F.get(row, b)), F.lit(0.0), lambda a, x: a + x)
    d = d.select("doc_id", "host", "path", (odds * params.evidence + F.col("word_odds")).alias("log_odds"))
    d = d.join(F.broadcast(sites) if sites.count() <= params.broadcast_sites else sites, ["host", "path"])
    drop_staged(docs.sparkSession, MADE[before:], d)
    z = F.log(F.col("path_mean") / (1 - F.col("path_mean"))) + F.col("log_odds")
    d = d.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("held_out", held_out(F.col("doc_id")) & F.lit(params.hold_out))
    return d.select("doc_id", "held_out", "host_mean", "path_mean", "log_odds", "quality", (F.col("quality") >= params.threshold).alias("kept"))
