"""Substring dedup by hashing units (operator 10).

Each line is a unit.  So that a repeated passage is found too where it doesn't fill whole lines, each text also has
windows of ``window_words`` words as units, which begin at the local minima of its word weights: the (first) smallest
of each ``window_words`` neighbours.  The choice depends on the words of the window alone, so a passage has the same
windows wherever it stands, and one of 2 * window_words - 1 words has one at least.

Units are normalised (A-Z in lower case, one space between words ``[^\\x20\\x09-\\x0D]+``) and hashed to 128 bits, lines
and windows apart.  A grouped minimum keeps each digest's earliest occurrence, ranked by (doc_id, hash of the text, place); all later ones
are cut out, whatever their length.  Only what such a unit covers is ever cut, so no word goes that isn't somewhere
earlier, and a window that overlaps its own earlier occurrence loses only what lies beyond it.
Offsets are code points of the original text and come with the place of the kept occurrence.

Defined results: null and empty texts stay as they are; a text that loses all its words becomes empty; rows with equal
doc_id and text have equal results, of rows that share a doc_id alone each has its own repeats; rows without a doc_id stay as they
are and keep nothing from others.  A text is cut as a whole, however long it is (some 35 times its bytes of memory).  Columns of ``docs`` named
``removed`` or ``n_removed`` give way to those of ``dedup``; ``deduplicated`` returns all columns with their values.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import MADE, drop_staged, free_name, mix64, only, slices, staged, texts

REMOVED = "array<struct<start: bigint, length: bigint, kept_doc: bigint, kept_start: bigint>>"
UNIT_TYPES = {"h1": "long", "h2": "long", "doc_id": "long", "text_key": "long", "start": "int", "length": "int"}


@dataclass(frozen=True)
class UnitParams:
    """Digests are compared in ``passes`` parts, one after the other, which bounds the disk that their shuffles take."""

    window_words: int = 16
    passes: int = 4


@dataclass
class Words:
    """The words of an array of texts, in order: their text's index, code points there, line, weight and two hashes."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    weight: np.ndarray
    hashes: np.ndarray


def words_of(text: pa.Array) -> Words:
    """All words, from the bytes of the texts at once.

    A word's weight is 2654435769 times the sum of (its lower-case bytes times their places, from 1), modulo 2 ** 32.
    """
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    if blank.all():
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, np.zeros((0, 2), np.uint64))
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[ends] = True
    at = np.flatnonzero(edge)
    full = ~blank[at[:-1]]
    begin, after = at[:-1][full], at[1:][full]
    owner = np.searchsorted(ends, begin, "right") - 1
    line = np.cumsum(raw == 10, dtype=np.int32)[begin] + owner
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)))
    first = chars[ends[owner]]
    start, end = chars[begin] - first, chars[after] - first
    del chars, edge, at, full
    # blanks count as zero bytes behind their word
    lower = np.where(blank, 0, raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0)))[begin[0] :]
    sizes = np.diff(np.append(begin, len(raw)))
    place = np.arange(len(lower), dtype=np.int32) - np.repeat((begin - begin[0]).astype(np.int32), sizes)
    heads = begin - begin[0]
    weight = np.add.reduceat(lower * (place + np.int64(1)), heads) * 2654435769 % (1 << 32)
    hashes = np.empty((len(begin), 2), np.uint64)
    for k in range(2):
        hashes[:, k] = mix64(np.add.reduceat(lower * factors(int(sizes.max()), 2 + k)[place], heads) ^ (after - begin).astype(np.uint64))
    return Words(owner, start, end, line, weight, hashes)


def factors(n: int, kind: int) -> np.ndarray:
    """Odd multipliers of the places 0, ..., n - 1 in a sum that hashes a sequence."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(kind << 40)) | np.uint64(1)


def digest(words: np.ndarray, heads: np.ndarray, sizes: np.ndarray, kind: int) -> list[np.ndarray]:
    """128 bits, as two columns, for the words heads[i], ..., heads[i] + sizes[i] - 1 (rows of hashes), end to end."""
    place = np.arange(len(words)) - np.repeat(heads, sizes)
    out = []
    for k in range(2):
        total = np.add.reduceat(words[:, k] * factors(int(sizes.max()), 4 + 2 * kind + k)[place], heads) if len(heads) else np.zeros(0, np.uint64)
        out.append(mix64(total ^ sizes.astype(np.uint64)).view(np.int64))
    return out


def anchors(weight: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Words where a window begins: the first smallest of ``size`` neighbours in one text, with as many words left."""
    if len(weight) < size:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(weight, size).argmin(1)[whole] + whole
    found = least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least
    found = found[found + size <= len(owner)]
    return found[owner[found] == owner[found + size - 1]]


def units_of(text: pa.Array, params: UnitParams) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(index of the text, digest columns, start, length) of each unit of an array of texts."""
    words, w = words_of(text), params.window_words
    n = len(words.owner)
    heads = np.flatnonzero(np.concatenate(([True], words.line[1:] != words.line[:-1]))[:n])
    sizes = np.diff(np.append(heads, n))
    at = anchors(words.weight, words.owner, w)
    members = words.hashes[(at[:, None] + np.arange(w)).ravel()]
    of_lines = digest(words.hashes, heads, sizes, 0)
    of_windows = digest(members, np.arange(len(at)) * w, np.full(len(at), w), 1)
    begin, last = np.concatenate((heads, at)), np.concatenate((heads + sizes, at + w)) - 1
    hashes = [np.concatenate(x) for x in zip(of_lines, of_windows, strict=True)]
    return words.owner[begin], hashes, words.start[begin], words.end[last] - words.start[begin]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key of the rows that have an id."""
    return only(docs, doc_id="long", text="string").withColumn("text_key", F.xxhash64("text")).filter("doc_id IS NOT NULL")


def units(docs: DataFrame, params: UnitParams = UnitParams()) -> DataFrame:
    """h1, h2 (digest), doc_id, text_key, start, length: a row for each unit of each text."""

    def run(batches):
        for b in slices(batches, limit=2 << 20):
            text, (h1, h2), start, length = units_of(texts(b), params)
            row = pa.array(text)
            columns = [pa.array(h1), pa.array(h2), b.column("doc_id").take(row), b.column("text_key").take(row), pa.array(start, pa.int32()), pa.array(length, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, list(UNIT_TYPES))

    return keyed(docs).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in UNIT_TYPES.items()))


def repeats(docs: DataFrame, params: UnitParams = UnitParams()) -> DataFrame:
    """doc_id, text_key, found: what is to be cut of a text, unit by unit, each with the place of its first occurrence."""
    u = staged(units(docs, params).withColumn("pass", F.pmod("h1", F.lit(params.passes)).cast("int")), "units", by="pass")
    path = MADE[-1:]
    later = []
    for k in range(params.passes):
        part = u.filter(F.col("pass") == k).drop("pass")
        later.append(released(later_ones(part, released(earliest(part), "earliest")), "repeats"))
        drop_staged(docs.sparkSession, MADE[-2:-1])
    drop_staged(docs.sparkSession, path)
    found = functools.reduce(DataFrame.unionByName, later)
    return found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length", "kept_doc", "kept_start")).alias("found"))


def earliest(u: DataFrame) -> DataFrame:
    """h1, h2, kept (the first occurrence) of the digests that occur more than once; aggregated before the shuffle too."""
    rank = F.struct("doc_id", "text_key", "start", "length")
    return u.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(rank).alias("kept")).filter("n > 1").drop("n")


def later_ones(u: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id, text_key, start, length, kept_doc, kept_start of each unit that has an earlier occurrence.

    ``first`` is a table, so that both sides of the join are plain shuffles, whose hot digests AQE splits.
    """
    d = u.join(first, ["h1", "h2"]).filter("doc_id <> kept.doc_id OR text_key <> kept.text_key OR start <> kept.start")
    # a window may overlap its earlier occurrence in the same text, which stays whole
    own = "CASE WHEN doc_id = kept.doc_id AND text_key = kept.text_key THEN kept.start + kept.length ELSE 0 END"
    d = d.withColumn("begin", F.expr(f"greatest(start, {own})"))
    return d.selectExpr("doc_id", "text_key", "begin AS start", "start + length - begin AS length", "kept.doc_id AS kept_doc", "kept.start AS kept_start").filter("length > 0")


def released(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged, its shuffle files deleted at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return staged(df, name)
    finally:
        conf.set(key, before)


def merged(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """(start, end, kept doc, kept start) of the stretches that overlapping cuts make; each has the kept place of its first."""
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (x["start"], -x["length"], x["kept_doc"], x["kept_start"])):
        end = x["start"] + x["length"]
        if out and x["start"] < out[-1][1]:
            a, z, d, s = out[-1]
            out[-1] = (a, max(z, end), d, s)
        else:
            out.append((x["start"], end, x["kept_doc"], x["kept_start"]))
    return out


def without(text: str, cuts: list[tuple[int, int, int, int]]) -> str:
    """The text without the stretches; empty where no word is left of it."""
    parts, at = [], 0
    for a, z, _, _ in cuts:
        parts.append(text[at:a])
        at = z
    left = "".join([*parts, text[at:]])
    return left if left.strip(" \t\n\x0b\x0c\r") else ""


def cleaned(docs: DataFrame, params: UnitParams, removed: str, n_removed: str) -> DataFrame:
    """``docs`` with the repeats out of ``text``, and the two named columns behind its own."""
    key, doc, found = (free_name(docs, x) for x in ("found_key", "found_doc", "found"))
    r = repeats(docs, params).toDF(doc, key, found)
    keep = docs.schema.fields
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    d = docs.join(r, same, "left").drop(doc, key)
    schema = ", ".join([*(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in keep), f"`{removed}` {REMOVED}, `{n_removed}` bigint"])
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "kept_doc", "kept_start")]))

    def run(batches):
        for b in slices(batches):
            text, spans, total = [], [], []
            for t, f in zip(b.column("text").to_pylist(), b.column(found).to_pylist(), strict=True):
                cuts = merged(f) if f else []
                text.append(without(t, cuts) if cuts else t)
                spans.append([{"start": a, "length": z - a, "kept_doc": d, "kept_start": s} for a, z, d, s in cuts])
                total.append(sum(z - a for a, z, _, _ in cuts))
            columns = [pa.array(text, pa.string()) if f.name == "text" else b.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array(total, pa.int64())], [*(f.name for f in keep), removed, n_removed])

    return d.mapInArrow(run, schema)


def dedup(docs: DataFrame, params: UnitParams = UnitParams()) -> DataFrame:
    """All columns of ``docs`` with the repeats out of ``text``, and removed (stretches), n_removed (characters)."""
    return cleaned(docs.drop("removed", "n_removed"), params, "removed", "n_removed")


def deduplicated(docs: DataFrame, params: UnitParams = UnitParams()) -> DataFrame:
    """``docs`` with the repeats out of ``text`` and ``n_chars``, where it has one, in step; same columns."""
    spans, count = (free_name(docs, x) for x in ("removed", "n_removed"))
    out = cleaned(docs, params, spans, count)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
