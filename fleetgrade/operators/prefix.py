"""Ranks and running values inside groups of any size.

A plain window sorts a whole group in one task, which fails when one group
holds a third of the rows. Here every group is cut into chunks of an integer
position. A chunk is summarised first (partial aggregation), the few chunk
summaries are scanned per group, and each row only meets its own chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
# For positions that leave room for a thousand rows a line: about as many lines as CHUNK has rows.
LINE_CHUNK = CHUNK * 1000


def _chunked(df: DataFrame, position: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)).cast("long"))


def _with_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join: a group key may be null."""
    on = [df[k].eqNullSafe(offsets[k]) for k in [*keys, "_chunk"]]
    joined = df.join(offsets, on, "left")
    for k in [*keys, "_chunk"]:
        joined = joined.drop(offsets[k])
    return joined


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, Column],
    tie: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Add inclusive running sums of ``values`` (name → expression) along ``position``."""
    base = _chunked(df, position, chunk)
    for name, value in values.items():
        base = base.withColumn(f"_v_{name}", value)
    totals = base.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(position, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = _with_offsets(base, offsets, keys)
    for n in values:
        out = out.withColumn(n, F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}"))
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def occurrence(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie: Sequence[str] = (),
    name: str = "occurrence",
    chunk: int = CHUNK,
) -> DataFrame:
    """Number the rows of each group 1, 2, … along ``position`` (ties by ``tie``)."""
    return running_sums(df, keys, position, {name: F.lit(1)}, tie, chunk)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, Column],
    tie: Sequence[str] = (),
    chunk: int = CHUNK,
    inclusive: bool = True,
) -> DataFrame:
    """Add the last non-null value seen so far along ``position`` for each expression."""
    base = _chunked(df, position, chunk)
    for name, value in values.items():
        base = base.withColumn(f"_v_{name}", value)
    place = F.struct(position, *tie)
    last_in_chunk = base.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_t_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last_in_chunk.select(
        *keys,
        "_chunk",
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_o_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(position, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    out = _with_offsets(base, offsets, keys)
    for n in values:
        out = out.withColumn(
            n, F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_o_{n}"))
        )
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def next_value(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, Column],
    chunk: int = CHUNK,
) -> DataFrame:
    """First non-null value strictly after each row: the mirror of ``carry_last``."""
    flipped = df.withColumn("_mirror", -F.col(position))
    return carry_last(flipped, keys, "_mirror", values, chunk=chunk, inclusive=False).drop("_mirror")
