"""Packing along a space-filling curve (operator 3).

Each document's token counts are feature-hashed with signs and projected to four coordinates; their place on a Hilbert
curve is the sort key, with some bits of a hash of the doc_id below it, so that equal documents can lie in different
ranges.  Documents go to key ranges (bounds from a bounded sample, which balance the ranges and change no result),
are sorted there, and the ranges' token totals give every document its place in one stream along the curve.  Sequences
are stretches of that stream, so neighbours on the curve share them and only the last one is padded.

Defined results: a null or empty text has the closing id alone; repeated rows and rows that share a doc_id are packed
one by one; an empty table gives no pieces; rows without a doc_id are packed as the others.  Ties of key, doc_id and
length are in any order, and rows that are equal in doc_id and text lie in one range.  A very long text is encoded as a whole and cut over
as many sequences as it takes.  Other columns, also with clashing names, don't enter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.bpe import vocabulary
from veilframe.llm.common import mix64, only, ranges, slices, staged, texts

DIMS, BITS, TIE_BITS = 4, 12, 15


@dataclass(frozen=True)
class PackParams:
    """A range aims at ``range_tokens`` tokens; its bounds come from ``sample_per_range`` documents a range."""

    length: int = 2048
    end_id: int = 1
    hashed: int = 256
    range_tokens: int = 8 << 20
    max_ranges: int = 20_000
    sample_per_range: int = 64
    spread: float = 0.5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below 2 ** bits), by Gray-code rotations."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1 << level)
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, np.int64((1 << level) - 1), 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> level) & 1
    return out


def projection(size: int, hashed: int) -> np.ndarray:
    """Coordinates of each token id: its signed bucket's row of a fixed random projection."""
    h = mix64(np.arange(1, size + 1, dtype=np.uint64))
    rows = np.random.default_rng(20_240_613).normal(size=(hashed, DIMS))
    return rows[(h % np.uint64(hashed)).astype(np.int64)] * np.where(h >> np.uint64(63), 1.0, -1.0)[:, None]


def curve_keys(sums: np.ndarray, tokens: np.ndarray, doc: np.ndarray, params: PackParams) -> np.ndarray:
    """Sort keys from the projected token sums of documents."""
    mean = sums / np.maximum(tokens, 1)[:, None]
    cells = np.clip((mean / params.spread + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    tie = mix64(doc.view(np.uint64) + np.uint64(1)) >> np.uint64(64 - TIE_BITS)
    return hilbert_index(cells, BITS) << TIE_BITS | tie.astype(np.int64)


def tokenized(docs: DataFrame, vocab_path: str, params: PackParams, bounds: np.ndarray | None = None) -> DataFrame:
    """pid, key, doc_id, n, ids (little-endian, 16 bits each where the vocabulary allows that)."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        bpe = vocabulary(vocab_path)
        kind = np.uint16 if len(bpe.strings) <= 1 << 16 else np.uint32
        table = projection(len(bpe.strings), params.hashed)
        edges = sent.value
        for b in slices(batches):
            codes, at, ids, first, size = bpe.encode(texts(b))
            full = size[codes] > 0
            tokens = np.concatenate(([0], np.cumsum(size[codes])))[at]
            n = np.diff(tokens)
            chunk = np.zeros((len(size), DIMS))
            some = np.flatnonzero(size)
            if len(some):
                ends = np.cumsum(size[some])
                chunk[some] = np.add.reduceat(table[ids[ranges(first[some], size[some])]], ends - size[some])
            sums = np.zeros((len(n), DIMS))
            has = np.flatnonzero(n)
            if len(has):
                begin = np.concatenate(([0], np.cumsum(full)))[at[:-1][has]]
                kept = codes[full]
                for k in range(DIMS):
                    sums[has, k] = np.add.reduceat(chunk[:, k][kept], begin)
            doc = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            key = curve_keys(sums, n, doc, params)
            flat = ids.astype(kind)[ranges(first[codes[full]], size[codes[full]])] if len(ids) else np.zeros(0, kind)
            stream = np.full(len(flat) + len(n), params.end_id, kind)
            stream[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
            ends = np.concatenate(([0], np.cumsum(n + 1))) * stream.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(stream)]).cast(pa.binary())
            pid = np.zeros(len(n), np.int32) if edges is None else np.searchsorted(edges, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(key), b.column("doc_id"), pa.array(n + 1), raw], ["pid", "key", "doc_id", "n", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "pid int, key long, doc_id long, n long, ids binary")


def range_bounds(docs: DataFrame, vocab_path: str, params: PackParams) -> tuple[int, np.ndarray]:
    """(ranges, bounds) with about equal tokens in a range, from a random sample of about so many rows.

    Bounds only balance the ranges: the order of all documents is the same with any."""
    spark = docs.sparkSession
    rows = docs.count()
    if not rows:
        return 1, np.zeros(0, np.int64)

    def sample(most: int) -> tuple[np.ndarray, np.ndarray]:
        part = docs if rows <= most else docs.filter(F.rand(5) < most / rows)
        got = tokenized(part, vocab_path, params).select("key", "n").toArrow()
        return got.column("key").to_numpy(), got.column("n").to_numpy()

    key, n = sample(1024)
    total = float(n.sum()) / max(1, len(n)) * rows
    count = int(min(params.max_ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // params.range_tokens))))
    if count * params.sample_per_range > 1024:
        key, n = sample(count * params.sample_per_range)
    if not len(key):
        return 1, np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    share = np.cumsum(n[order])
    at = np.searchsorted(share, share[-1] * np.arange(1, count) / count)
    return count, key[order][np.minimum(at, len(order) - 1)]


def pieces(docs: DataFrame, vocab_path: str, params: PackParams = PackParams(), with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids array<int> where asked for."""
    count, bounds = range_bounds(docs, vocab_path, params)
    dealt = tokenized(docs, vocab_path, params, bounds).repartitionById(count, F.col("pid")).sortWithinPartitions("pid", "key", "doc_id", "n")

    def placed(batches):
        pid, at = None, 0
        for b in batches:
            p, n = b.column("pid").to_numpy(), b.column("n").to_numpy()
            start = np.empty(len(n), np.int64)
            for one in np.unique(p):
                mine = p == one
                at = at if one == pid else 0
                start[mine] = at + np.cumsum(n[mine]) - n[mine]
                at, pid = at + int(n[mine].sum()), one
            yield pa.RecordBatch.from_arrays([b.column("pid"), pa.array(start), b.column("doc_id"), b.column("n"), b.column("ids")], ["pid", "at", "doc_id", "n", "ids"])

    stream = staged(dealt.mapInArrow(placed, "pid int, at long, doc_id long, n long, ids binary"), "packed", "zstd")
    # one row for each range: at most max_ranges of them
    w = Window.partitionBy(F.lit(0)).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = stream.groupBy("pid").agg(F.sum("n").alias("tokens"))
    base = totals.select("pid", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("base"))
    stream = stream.join(F.broadcast(base), "pid").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    wide = len(vocabulary(vocab_path).strings) > 1 << 16
    length = params.length
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def cut(batches):
        for b in slices(batches, "ids"):
            at, n = b.column("at").to_numpy(), b.column("n").to_numpy()
            held = at // length
            many = (at + n - 1) // length - held + 1
            row = np.repeat(np.arange(len(n)), many)
            sequence = ranges(held, many)
            begin = np.maximum(at[row], sequence * length)
            size = np.minimum(at[row] + n[row], (sequence + 1) * length) - begin
            start = begin - at[row]
            raw = b.column("ids")
            own = [np.frombuffer(x.as_buffer(), np.uint32 if wide else np.uint16).astype("<u4") for x in raw]
            parts = [own[r][s : s + k] for r, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            crc = [zlib.crc32(p.tobytes()) for p in parts]
            columns = [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin % length)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    return stream.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
