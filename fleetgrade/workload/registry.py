"""Registry of the queries: a Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgrade.session import broadcast_by_measure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Timestamps of the tables carry no zone; read them all as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, per_task: int = 16384, least: int = 1024) -> DataFrame:
    """Rows of which texts are built, in as many tasks as their number asks for.

    What is built of a row is far larger than the row: neither the bytes of a table nor Spark's estimates tell the work.
    """
    spark = rows.sparkSession
    broadcast_by_measure(spark)
    n = rows.count()
    tasks = max(-(-n // per_task), min(spark.sparkContext.defaultParallelism, -(-n // least)), 1)
    return rows.repartition(tasks)
