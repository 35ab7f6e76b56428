"""Exact k-means over integer vectors with heap-ordered bounds.

A vector keeps its cluster as long as the gap between its distances to the second nearest and to its own centroid
outlives the movement of the centroids. A round that moves centroid j by m(j) shrinks the gaps of cluster c by m(c) plus the
largest m(j) of another j at most; every cluster sums this up as its drift. A vector enters the heap of its
cluster under its gap plus the drift so far, one number that never changes afterwards. Each round only pops, from every heap,
what the drift has reached, measures those against all centroids, and pushes them again.

Vectors are packed into blocks of ``BLOCK``, dealt once by block number and cached in that order. A round joins the blocks with
their heaps (12 bytes per vector, cut in the checkpoint folder), so vectors are shuffled once in all. Blocks report
how many vectors and which sums each cluster won or lost; sums are exact integers, and the new centroids are all that
passes through the driver. Distances are compared as exact squared integers; bounds are doubles with ``SLACK`` to
the safe side, so they cost a rescan at most, never a result. A lost executor's blocks are dealt again from the checkpoint.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are not kept and give no
row; components beyond ``LARGEST`` in size, whose squared distances no long holds, count as ``LARGEST``; equal
distances go to the smaller number; repeated rows are rows of their own; ids are hashed in decimal, a null id
comes last among the starting vectors and is carried along; ties of the hash go by the vector; fewer kept vectors than
clusters make as many clusters; an empty table gives no rows; other columns are not read. A sum of
distances beyond a long is given as the largest long.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut, small_batches, table

BLOCK = 4096
LARGEST = 1 << 27
EXACT = 1 << 21  # below it squared distances of up to 1,024 components are exact in doubles
SLACK = 1e-3
MOST = (1 << 63) - 1


def usable(vector: str | Column, size: int | None = None) -> Column:
    """Whether a vector is there, has this length, and every component is finite."""
    v = F.col(f"`{vector}`") if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(v) == size if size is not None else F.size(v) > 0), F.lit(False))


def packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest form that holds them: one byte for the width, then the numbers."""
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpacked(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(-1, columns).astype(np.int64)


def scaled(batch: pa.RecordBatch, column: str, columns: int, scale: float, largest: int = LARGEST) -> np.ndarray:
    """floor(scale * component) of every vector of a batch, at most ``largest`` in size."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, columns)
    return np.clip(np.floor(values * scale), -largest, largest).astype(np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of every vector to every centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and x.shape[1] <= 1024:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


class Heaps:
    """The heaps of one block: (gap plus drift at the time, row) of its vectors, by cluster."""

    def __init__(self, heaps: list[list[tuple[float, int]]], rows: int):
        self.heaps, self.rows = heaps, rows

    @classmethod
    def read(cls, raw: bytes | None, clusters: int, rows: int) -> Heaps:
        if raw is None:
            return cls([[] for _ in range(clusters)], rows)
        counts = np.frombuffer(raw, "<i4", clusters)
        row = np.frombuffer(raw, "<i4", rows, 4 * clusters)
        key = np.frombuffer(raw, "<f8", rows, 4 * (clusters + rows))
        ends = np.cumsum(counts)
        return cls([[*zip(key[e - n:e].tolist(), row[e - n:e].tolist(), strict=True)] for e, n in zip(ends, counts, strict=True)], rows)

    def write(self) -> bytes:
        flat = [entry for heap in self.heaps for entry in heap]
        parts = np.array([len(h) for h in self.heaps], "<i4"), np.array([r for _, r in flat], "<i4"), np.array([k for k, _ in flat], "<f8")
        return b"".join(p.tobytes() for p in parts)

    def clusters(self) -> np.ndarray:
        of = np.empty(self.rows, np.int64)
        for c, heap in enumerate(self.heaps):
            of[[r for _, r in heap]] = c
        return of

    def advance(self, x: np.ndarray, centroids: np.ndarray, drift: np.ndarray, first: bool) -> tuple[np.ndarray, int]:
        """Rescan what expired; (won minus lost vectors and sums by cluster, number rescanned)."""
        rows, old = ([*range(self.rows)], []) if first else ([], [])
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                rows.append(heapq.heappop(heap)[1])
                old.append(c)
        rows, old = np.array(rows, np.int64), np.array(old, np.int64)
        change = np.zeros((len(centroids), x.shape[1] + 1), np.int64)
        if not len(rows):
            return change, 0
        away = squared(x[rows], centroids)
        new = away.argmin(1)
        own = away[np.arange(len(rows)), new]
        away[np.arange(len(rows)), new] = MOST
        second = np.sqrt(away.min(1)) if len(centroids) > 1 else np.full(len(rows), np.inf)
        keys = second - np.sqrt(own) + drift[new] - SLACK
        for c, entry in zip(new.tolist(), zip(keys.tolist(), rows.tolist(), strict=True), strict=True):
            heapq.heappush(self.heaps[c], entry)
        whole = np.column_stack([np.ones(len(rows), np.int64), x[rows]])
        moved = slice(None) if first else new != old
        np.add.at(change, new[moved], whole[moved])
        if not first:
            np.subtract.at(change, old[moved], whole[moved])
        return change, len(rows)


def starting(kept: DataFrame, clusters: int, seed: int, columns: int, scale: float) -> np.ndarray:
    """The integer vectors of the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "embedding").limit(clusters).collect()
    values = np.array([r.embedding for r in first], np.float64).reshape(-1, columns)
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What a round takes from the gaps of each cluster at most."""
    far = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64))
    others = np.array([max(np.delete(far, c), default=0.0) for c in range(len(far))])
    return far + others


def _joined(blocks: DataFrame, heaps: DataFrame | None) -> DataFrame:
    if heaps is None:
        return blocks.withColumn("heaps", F.lit(None).cast("binary"))
    return blocks.join(heaps.select("block", "heaps"), "block")


def _round(joined: DataFrame, centroids: np.ndarray, drift: np.ndarray, first: bool) -> DataFrame:
    """(block, heaps, change, scanned) after one assignment."""
    columns = centroids.shape[1]

    def run(batches):
        for batch in batches:
            out = []
            for raw, heaps in zip(batch.column("x"), batch.column("heaps"), strict=True):
                x = unpacked(raw.as_py(), columns)
                state = Heaps.read(heaps.as_py(), len(centroids), len(x))
                change, scanned = state.advance(x, centroids, drift, first)
                out.append((state.write(), change.ravel(), scanned))
            parts = [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("block"), *parts], ["block", "heaps", "change", "scanned"])

    return joined.mapInArrow(run, "block long, heaps binary, change array<long>, scanned long")


def _total(state: DataFrame, clusters: int, columns: int) -> list[list[int]]:
    """Sum of the blocks' changes: (1 + columns) exact integers per cluster."""
    summed = state.select(F.posexplode("change").alias("at", "n")).filter("n <> 0").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    flat = [0] * (clusters * (columns + 1))
    for r in summed.collect():
        flat[r["at"]] = int(r["n"])
    return [flat[c * (columns + 1):(c + 1) * (columns + 1)] for c in range(clusters)]


def _answers(joined: DataFrame, centroids: np.ndarray) -> DataFrame:
    columns = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for ids, raw, heaps in zip(batch.column("vec_ids"), batch.column("x"), batch.column("heaps"), strict=True):
                x = unpacked(raw.as_py(), columns)
                of = Heaps.read(heaps.as_py(), len(centroids), len(x)).clusters()
                away = ((x - centroids[of]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values.cast(pa.int64()), pa.array(of.astype(np.int32)), pa.array(away)], ["vec_id", "cluster", "distance"])

    return joined.mapInArrow(run, "vec_id long, cluster int, distance long")


def _text(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _literal(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def centroid_clusters(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, columns: int = 64, seed: int = 3, scale: float = 1024.0,
    id_col: str = "vec_id", vector_col: str = "embedding", scans: list[int] | None = None,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``scans`` takes the number of vectors measured against all centroids in each assignment, if given.
    """
    spark = vectors.sparkSession
    small_batches(spark, BLOCK)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    kept = rows.filter(usable("embedding", columns))
    centroids = starting(kept, clusters, seed, columns, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                raw = packed(scaled(batch, "embedding", columns, scale))
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([raw], pa.binary())], ["vec_ids", "x"])

    blocks = cut(kept.mapInArrow(pack, "vec_ids array<long>, x binary").withColumn("block", F.monotonically_increasing_id()))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").persist()

    whole = [[0] * (columns + 1) for _ in centroids]
    drift, heaps = np.zeros(len(centroids)), None
    for number in range(rounds + 1):
        heaps = cut(_round(_joined(blocks, heaps), centroids, drift, number == 0))
        if scans is not None:
            scans.append(heaps.agg(F.sum("scanned")).first()[0])
        if number == rounds:
            break
        whole = [[a + b for a, b in zip(w, t, strict=True)] for w, t in zip(whole, _total(heaps, len(centroids), columns), strict=True)]
        new = np.array([[s // w[0] for s in w[1:]] if w[0] else c.tolist() for w, c in zip(whole, centroids, strict=True)], np.int64)
        drift, centroids = drift + moves(centroids, new), new

    found = cut(_answers(_joined(blocks, heaps), centroids))
    blocks.unpersist()
    summed = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    inertia = reduce(lambda a, r: {**a, r.cluster: int(r.n)}, summed, {})
    own = _literal([min(inertia.get(c, 0), MOST) for c in range(len(centroids))], "long")
    names = _literal([_text(c) for c in centroids], "string")
    return found.select(
        "vec_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"), F.lit(min(sum(inertia.values()), MOST)).cast("long").alias("inertia"),
        names[F.col("cluster")].alias("centroid_sha256"),
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """The rounds as a chain of tables: a<i> assigns, c<i+1> has the centroids after it."""
    assign = """a{i} AS MATERIALIZED (
  SELECT r, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, v.x, c{i}.c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r, x)"""
    mean = """m{j} AS (SELECT c, pos, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY c, pos),
c{j} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(any_value(k.x), any_value(c{i}.x)) AS x FROM c{i}
  LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM m{j} GROUP BY c) k ON k.c = c{i}.c GROUP BY c{i}.c)"""
    chain = [f"{assign.format(i=i)},\n{mean.format(i=i, j=i + 1)}" for i in range(rounds)]
    return ",\n".join([*chain, assign.format(i=rounds)])


QUERIES = {"op11_clusters": op11_clusters}
ORACLES = {
    "op11_clusters": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), x) <= 8),
{_rounds_sql(10)},
k AS (SELECT c, sha256(array_to_string(x, ',')) AS sha FROM c10)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  k.sha AS centroid_sha256
FROM a10 a JOIN v ON v.r = a.r JOIN k ON k.c = a.c""",
}
