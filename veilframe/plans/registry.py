"""Registration of named queries with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name; without SQL it is tested against brute force."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str, piece: int = 4 << 20) -> DataFrame:
    """``df`` dealt by ``keys``, in as many partitions as the session shuffles to, and one for each ``piece`` bytes of files at least.

    For narrow rows that explode into many: a file of few row groups is read by few tasks, and a shuffle without a number
    is merged again by its bytes, not by the work on it.  The number grows with the input, so no task does.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // piece), 100_000)), *keys)


#: SQL of a remapped UID from SQL of its key|scope|uid text.
def sql_uid(seed: str) -> str:
    part = lambda at: f"lpad(CAST(CAST('0x' || substr(sha256({seed}), {at}, 15) AS BIGINT) AS VARCHAR), 19, '0')"
    return f"('2.25.1' || {part(1)} || {part(16)})"
