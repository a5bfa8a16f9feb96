"""Arrow batches of a bounded number of bytes, for steps in Python that hold pixels or whole files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of binary values that a step holds at a time; a single larger value is a piece of its own.
PIECE_BYTES = 16 << 20


def bounded(spark: SparkSession) -> None:
    """Batches between the JVM and Python of about a piece's size, for all later queries of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES, rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of a binary column of each piece have at most ``limit`` bytes, or are one; ``rows`` at most."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))), at + rows)
            yield b.slice(at, to - at)
            at = to
