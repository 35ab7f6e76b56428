"""Helpers of the llm operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.session import cut, ensure_checkpoint_dir  # noqa: F401

BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small_batches(spark: SparkSession, records: int = 10_000, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch of whole texts holds, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches, one after the other: never more than a batch is in memory."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def unit_hash(*parts: str | Column) -> Column:
    """A number in (0, 1) fixed by the parts, the same in every engine: 52 bits of an MD5."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(str(p)), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def within(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A broadcast of a materialised table if it has few rows; else the table, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
