"""What the operators of this subpackage share: staged tables, bounded Arrow slices, word codes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step holds at a time.  A single longer text is a slice of its own.
SLICE_BYTES = 8 << 20


#: Paths of the staged tables that are still there, oldest first.
MADE: list[str] = []


def drop_staged(spark: SparkSession, paths: list[str], needed: DataFrame | None = None) -> list[str]:
    """Delete staged tables, but those that ``needed`` reads; returns the paths that are left."""
    read = needed.inputFiles() if needed is not None and paths else []
    left = []
    for path in paths:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in read):
            left.append(path)
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        MADE.remove(path)
    return left


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session (tests) gets a temporary folder; on a cluster a machine-local
    folder would lose data, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="veilframe-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame, name: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: cuts lineage, survives lost executors.

    With ``by``, its rows lie in folders by that column, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilframe/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", codec)
    (out.partitionBy(by) if by else out).parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB: those of the default size take hundreds of MB beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with the given types; other columns, also such with clashing names, stay out."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@functools.lru_cache(1)
def _trim():
    """The C library's way to give freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Return memory that this worker no longer uses; a pool that keeps its peak would add up beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Arrow batches cut so that ``column`` of each piece has at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
            give_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts with null as empty, in an array that starts at offset 0."""
    return pc.fill_null(batch.column(column), "").cast(pa.large_string())


def word_codes(text: pa.Array, lower_ascii: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, starts, dictionary): words ``[^\\x20\\x09-\\x0D]+`` of each text as indices into the dictionary.

    ``starts`` has one entry more than there are texts: words of text i are codes[starts[i]:starts[i + 1]].
    """
    for c in "\t\n\x0b\x0c\r":
        text = pc.replace_substring(text, c, " ")
    if lower_ascii:
        text = pc.ascii_lower(text)
    parts = pc.split_pattern(text, " ")
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(full)))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    words = flat.filter(pa.array(full)).dictionary_encode()
    return words.indices.to_numpy(), starts.astype(np.int64), words.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i], ..., starts[i] + lengths[i] - 1 for each i."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    out = np.ones(total, np.int64)
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(v, seed) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))
