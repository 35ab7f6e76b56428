"""Results of a stream without those that a newer generation of their file supersedes: keyed state with expiry.

The state of a path is the newest generation seen and when it goes; rows of results pass through and are not kept. A row older
than the newest generation is dropped, in whatever micro-batch it comes; rows of the newest pass. The state of a
path goes once the watermark is ``keep`` past its latest row; until then, and for rows that the watermark
calls late anyway, nothing superseded passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Calls of Python per micro-batch at most. Part of the state's layout: a checkpoint goes on only with the number it began with.
BUCKETS = 1 << 13


def drop_superseded_stream(
    results: DataFrame, key: str = "path", generation: str = "generation", time: str = "modified", keep: str = "1 hour", delay: str = "10 minutes",
    buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of a stream that no earlier row supersedes; rows without a generation or time are dropped.

    What passed before its successor came is superseded later: a reader takes the newest generation of each path, as :func:`upsert` does.
    The states of many paths travel with their rows in one batch, and the paths of a bucket are one state and one call: a call costs
    milliseconds, a path in it microseconds. Each path has its own newest generation and its own time to go.
    """
    whole = results.filter(results[generation].isNotNull() & results[time].isNotNull()).withWatermark(time, delay)
    columns = whole.columns
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    # Long numbers travel as texts: in pandas a null beside them, now of any path of the bucket, makes them floats.
    longs = {f.name for f in whole.schema if isinstance(f.dataType, T.LongType) and f.name != generation}
    named = key if isinstance(whole.schema[key].dataType, T.StringType) else "_key"
    sent = whole.select(*[F.col(c).cast("string").alias(c) if c in longs else F.col(c) for c in columns], F.unix_millis(time).alias("_ms"))
    if named != key:
        sent = sent.withColumn(named, F.to_json(F.struct(key)))
    sent = sent.withColumn("_bucket", F.pmod(F.xxhash64(named), F.lit(buckets)).cast("int"))

    def newest(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = {p: (best, until) for p, best, until in zip(*state.get, strict=True)} if state.exists else {}
        came: dict[str | None, tuple[int, int]] = {}
        if not state.hasTimedOut:
            parts = list(rows)
            batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            paths, generations = batch[named].tolist(), batch[generation].tolist()
            for path, number, ms in zip(paths, generations, batch["_ms"].tolist(), strict=True):
                # Spark refuses times behind the watermark; such a path goes with the next step of the watermark.
                best, until = came.get(path) or known.get(path) or (number, now + 1)
                came[path] = (max(best, number), max(until, ms + keep_ms, now + 1))
        # What the watermark has passed goes, unless it was seen again in this very batch.
        left = {p: s for p, s in known.items() if s[1] >= now} | came
        if not left:
            state.remove()
            return
        state.update((list(left), [best for best, _ in left.values()], [until for _, until in left.values()]))
        state.setTimeoutTimestamp(min(until for _, until in left.values()))
        if came:
            yield batch.loc[[number == came[path][0] for path, number in zip(paths, generations, strict=True)], columns]

    kept = sent.groupBy("_bucket").applyInPandasWithState(
        newest, sent.select(columns).schema, "paths array<string>, newest array<bigint>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(*[F.col(c).cast("bigint").alias(c) if c in longs else F.col(c) for c in columns])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
