"""Language identification (operator 7): multinomial naive Bayes over hashed character n-grams.

Training counts bigrams and trigrams of a bounded, hash-picked sample of labelled documents with a grouped
aggregation on the executors; the driver receives one matrix of classes x buckets and broadcasts its logarithms.
Scoring turns a slice of texts into one array of code points, hashes all n-grams at once and sums the rows of the
sparse incidence with ``reduceat``.

Defined results: a null text or one without letters is ``und`` with score 0; without any labelled training row every
document is ``und``; ties go to the language that sorts first; null labels teach nothing.  Rows keep their number, repeated rows and rows that
share a doc_id included.  Texts are scored whole, a very long one as a slice of its own (some 45 times its bytes of memory).  ``identify`` reads no
other columns, ``predict`` replaces those of the names it makes, ``filter_known`` returns all with their values.  An
empty table gives an empty result.  More than ``max_classes`` labels, for which the matrix has no room, are an error.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import free_name, only, slices, texts

BITS = 15


@dataclass(frozen=True)
class LangIdParams:
    """Training is bounded: about ``sample_per_class`` documents of each language.  ``max_classes`` of them take 128 MB."""

    sample_per_class: int = 1500
    max_classes: int = 1024
    smoothing: float = 0.5
    sharpness: float = 30.0


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ngrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): hashed lower-case bigrams and trigrams around each letter; anything else is a space."""
    joined = "\x00".join(text.to_pylist()).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0) if len(text) > 1 else np.zeros(0, np.int64)
    is_letter = letters()[codes]
    c = np.where(is_letter, codes, np.uint32(32))
    before = np.concatenate(([np.uint32(32)], c[:-1])) if len(c) else c
    after = np.concatenate((c[1:], [np.uint32(32)])) if len(c) else c
    two = before * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA77)
    three = two + after * np.uint32(0xC2B2AE3D)
    two ^= two >> np.uint32(15)
    three ^= three >> np.uint32(13)
    at = np.flatnonzero(is_letter)
    grams = np.empty(2 * len(at), np.int32)
    grams[0::2] = (two[at] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    grams[1::2] = (three[at] * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
    bounds = np.concatenate(([0], np.searchsorted(at, ends), [len(at)])) * 2
    return grams, bounds


def split_nul(text: pa.Array) -> pa.Array:
    """Texts without NUL characters, which separate texts here."""
    import pyarrow.compute as pc

    return pc.replace_substring(text, "\x00", " ")


def train(docs: DataFrame, label: str = "lang", params: LangIdParams = LangIdParams()) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [languages, 2 ** BITS]) from all rows of ``docs`` with a label and a text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")).filter("label IS NOT NULL AND text IS NOT NULL")
    classes = sorted((r[0], r[1]) for r in rows.groupBy("label").count().limit(params.max_classes + 1).collect())
    if len(classes) > params.max_classes:
        raise ValueError(f"more than {params.max_classes} labels: {label} doesn't look like a language")
    if not classes:
        return [], np.zeros((0, 1 << BITS))
    share = F.create_map(*[F.lit(x) for name, n in classes for x in (name, min(1.0, params.sample_per_class / n))])
    picked = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) < F.element_at(share, F.col("label")) * float(1 << 30)
    names = [name for name, _ in classes]
    place = {name: i for i, name in enumerate(names)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in slices(batches, limit=2 << 20):
            grams, at = ngrams(split_nul(texts(b)))
            label = np.array([place[x] for x in b.column("label").to_pylist()])
            key = np.repeat(label, np.diff(at)) << BITS | grams
            got, n = np.unique(key, return_counts=True)
            for k in np.unique(got >> BITS).tolist():
                mine = got >> BITS == k
                np.add.at(total.setdefault(k, np.zeros(1 << BITS, np.int64)), got[mine] & (1 << BITS) - 1, n[mine])
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(v[at])], ["k", "bucket", "n"])

    got = rows.filter(picked).repartition(8).mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), 1 << BITS))
    counts[got.column("k").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    counts += params.smoothing
    return names, np.log(counts / counts.sum(1, keepdims=True))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], params: LangIdParams = LangIdParams(), made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, and those that ``made`` names, language and score, which replace columns of their name."""
    names, logs = model
    sent = docs.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    keep = [f for f in docs.schema.fields if f.name not in made]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches):
        table = sent.value
        for b in slices(batches, limit=2 << 20):
            grams, at = ngrams(split_nul(texts(b)))
            n = np.diff(at)
            some = n > 0
            pred = np.full(len(n), "und", object)
            score = np.zeros(len(n))
            if some.any() and len(names):
                total = np.stack([np.add.reduceat(row[grams], at[:-1][some], dtype=np.float64) for row in table])
                best = total.argmax(0)
                # the mean n-gram decides how sure, with no more weight than ``sharpness`` n-grams have
                mean = (total - total.max(0)) / n[some] * np.minimum(n[some], params.sharpness)
                score[some] = 1 / np.exp(mean).sum(0)
                pred[some] = np.array(names, object)[best]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(pred, pa.string()), pa.array(score)], [*(f.name for f in keep), *made])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, f"{schema}, `{made[0]}` string, `{made[1]}` double")


def identify(docs: DataFrame, params: LangIdParams = LangIdParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learned outside the held-out fold, predicted from text alone."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), "lang", params)
    return predict(only(docs, doc_id="long", text="string"), model, params).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def filter_known(docs: DataFrame, min_score: float = 0.3, params: LangIdParams = LangIdParams()) -> DataFrame:
    """The rows of ``docs`` whose text is in a language of the corpus with at least ``min_score``; same columns."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), "lang", params)
    pred, score = made = free_name(docs, "lang_pred"), free_name(docs, "score")
    known = predict(docs, model, params, made).filter((F.col(pred) != "und") & (F.col(score) >= min_score))
    return known.select(*[F.col(f"`{c}`") for c in docs.columns])
