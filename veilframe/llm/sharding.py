"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 5).

The ring has 2 ** 16 places; a document's place is the head of a 64-bit hash of its doc_id and text, and each shard holds
``vnodes`` places.  Documents are placed in ring order: a document goes to the next virtual node clockwise whose shard
has room and past full shards otherwise.  As documents between two places are interchangeable but for their order, one
count for each place (a fixed number of rows) decides everything: the driver walks the ring once over these counts and
writes, for each place, which ranks go to which shard from which slot on.  With no slack the capacities are the floor
and ceiling of the mean, so counts differ by one at most (law ``rows``); with slack, fewer documents move on growth.

A place with many more rows than the mean (repeated rows have one place) is ranked in parts, dealt by where the row
stands in a staged table, so that no task ranks it alone; there are at most 2 ** 15 such parts.

Defined results: a null text has size 1 and the checksum of the empty text; a null doc_id has a place as any other;
repeated rows have slots of their own, as have those that share a doc_id; ties are dealt in any order; texts are only measured and hashed, however long;
other columns, also with clashing names, don't enter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import mix64, only, staged

PLACES = 1 << 16


@dataclass(frozen=True)
class RingParams:
    """Places of over ``part_rows`` rows and four times the mean are ranked in parts."""

    shards: int = 16
    vnodes: int = 128
    slack: float = 0.0
    part_rows: int = 100_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, owners) of the virtual nodes, clockwise.  A place that is taken goes to the shard that came first."""
    ids = np.arange(shards * vnodes, dtype=np.uint64)
    place = (mix64(ids + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    places, first = np.unique(place, return_index=True)
    return places, first // vnodes


def capacities(total: int, params: RingParams) -> np.ndarray:
    """Most rows of each shard."""
    if params.slack:
        return np.full(params.shards, int(np.ceil((1 + params.slack) * total / params.shards)), np.int64)
    return total // params.shards + (np.arange(params.shards) < total % params.shards)


def walk(counts: np.ndarray, params: RingParams, place: np.ndarray | None = None, part: np.ndarray | None = None) -> pd.DataFrame:
    """place, part, from_rank, to_rank, shard, base: ranks (from 0, end excluded) of each place and their shard's first slot.

    ``counts`` are those of the places 0, 1, ..., or of the given places and parts, in ring order.
    """
    places, owners = ring(params.shards, params.vnodes)
    room, load = capacities(int(counts.sum()), params), np.zeros(params.shards, np.int64)
    place = np.arange(len(counts)) if place is None else place
    part = np.zeros(len(counts), np.int64) if part is None else part
    out = []
    for i in np.flatnonzero(counts).tolist():
        left, rank = int(counts[i]), 0
        node = int(np.searchsorted(places, place[i]))
        while left:
            shard = int(owners[node % len(owners)])
            take = min(left, int(room[shard] - load[shard]))
            if take:
                out.append((int(place[i]), int(part[i]), rank, rank + take, shard, int(load[shard])))
                load[shard] += take
                rank, left = rank + take, left - take
            node += 1
    return pd.DataFrame(out, columns=["place", "part", "from_rank", "to_rank", "shard", "base"]).astype("int64")


def in_parts(placed: DataFrame, params: RingParams) -> DataFrame:
    """``placed`` with the part of its place that each row is ranked in."""
    spark = placed.sparkSession
    got = placed.groupBy("place").count().toArrow()  # at most PLACES rows
    n = got.column("count").to_numpy()
    most = max(params.part_rows, 4 * int(n.sum()) // PLACES)
    hot = n > most
    if not hot.any():
        return placed.withColumn("part", F.lit(0))
    parts = pd.DataFrame({"place": got.column("place").to_numpy()[hot], "parts": -(-n[hot] // most)}).astype("int64")
    parts = spark.createDataFrame(parts, "place long, parts long").withColumn("place", F.col("place").cast("int"))
    d = placed.join(F.broadcast(parts), "place", "left")
    return d.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("row", F.col("parts"))).cast("int")).drop("parts")


def assign(docs: DataFrame, params: RingParams = RingParams()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.xxhash64("doc_id", F.col("text"), F.lit(3))
    d = only(docs, doc_id="long", text="string").select(
        "doc_id", key.alias("key"), F.shiftrightunsigned(key, 48).cast("int").alias("place"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    # a table, so that a row stands at the same place whenever it is read
    d = staged(d, "ring").withColumn("row", F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    d = in_parts(d, params).drop("row")
    got = d.groupBy("place", "part").count().orderBy("place", "part").toArrow()  # at most 1.5 times PLACES rows
    columns = [got.column(c).to_numpy() for c in ("count", "place", "part")]
    plan = spark.createDataFrame(walk(columns[0], params, *columns[1:]), "place long, part long, from_rank long, to_rank long, shard long, base long")
    plan = plan.withColumn("place", F.col("place").cast("int")).withColumn("part", F.col("part").cast("int"))
    w = Window.partitionBy("place", "part").orderBy("key", "doc_id", "size", "text_crc32")
    d = d.withColumn("rank", F.row_number().over(w) - 1)
    # at most a row for each place and each full shard that its overflow passes
    d = d.join(F.broadcast(plan), ["place", "part"]).filter("rank >= from_rank AND rank < to_rank")
    return d.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("from_rank")).alias("slot"))
