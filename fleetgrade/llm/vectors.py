"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

On unit vectors a cosine of at least c is a distance of at most ``sqrt(2 - 2c)``. Each of L tables
quantises k Gaussian projections into steps of ``WIDTH``; vectors with equal steps
meet in a bucket and are compared in double precision. With ``p(d)`` the chance that one projection
agrees at distance d, k is the least number for which unrelated vectors (right angles) fill a
bucket with ``FILL`` at most, and L the least for which a pair right at the threshold is
missed in every table with a chance of at most ``MISS``; closer pairs are missed less.
Both follow from the number of vectors alone.

Equal vectors are one class with a count. A pair is counted in the first table in which it
meets, found by hashing its two vectors again, so nothing is made distinct and no pair
leaves a task: tasks give partial link counts per class and the links that join two parts.
Buckets of more than ``BLOCK`` classes are cut into blocks; every two blocks meet in a task of their own.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length never link; a null id has no component and is
not compared; repeated ids are separate rows of one name, each counted; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut, rows_of, small_batches, table, within
from fleetgrade.llm.components import components

WIDTH = 2.0
FILL = 32
MISS = 0.002
BLOCK = 1024
HITS = 200_000


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that a projection puts two points at this distance into one step."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(vectors: int, cosine: float) -> tuple[int, int]:
    """(projections per table, tables) for so many vectors."""
    k = max(4, math.ceil(math.log(max(vectors / FILL, 1)) / -math.log(agreement(math.sqrt(2)))))
    near = agreement(math.sqrt(max(2 - 2 * cosine, 1e-6))) ** k
    return k, math.ceil(math.log(MISS) / math.log1p(-min(near, 1 - 1e-9)))


_drawn: dict = {}


def _projections(size: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and mixers, the same in every task."""
    key = (size, k, tables)
    if key not in _drawn:
        rng = np.random.default_rng(key)
        _drawn.clear()
        _drawn[key] = rng.normal(size=(size, tables * k)), rng.uniform(0, WIDTH, tables * k), rng.integers(1, 1 << 62, (tables, k), np.int64) | 1
    return _drawn[key]


def bucket_keys(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """One bucket key per row and table."""
    directions, shift, mixer = _projections(unit.shape[1], k, tables)
    steps = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    with np.errstate(over="ignore"):
        keys = (steps * mixer).sum(2) + np.arange(tables) * np.int64(0x1E3779B97F4A7C15) + np.int64(unit.shape[1])
        return keys ^ (keys >> 31)


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, np.float64)
    return v / np.linalg.norm(v)


def usable(vector: list | None) -> np.ndarray | None:
    """The vector in double precision, scaled to its largest component, or None if it links with nothing."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def classes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, cid, raw): the class of each vector by its content, null if it links with nothing."""

    def run(batches):
        for batch in batches:
            raws = []
            for vec_id, vector in rows_of([batch], "vec_id", "embedding"):
                v = usable(vector) if vec_id is not None else None
                raws.append(None if v is None else (v / np.abs(v).max() + 0.0).tobytes())
            names = [r and int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.int64()), pa.array(raws, pa.binary())], ["vec_id", "cid", "raw"])

    return vectors.mapInArrow(run, "vec_id long, cid long, raw binary")


def _spread(k: int, tables: int):
    """Each class once per table: (bucket, t, cid, n, raw)."""

    def run(batches):
        for cid, n, raw in rows_of(batches, "cid", "n", "raw"):
            keys = bucket_keys(_unit(raw)[None], k, tables)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(tables, dtype=np.int32)), pa.array(np.full(tables, cid)), pa.array(np.full(tables, n)), pa.array([raw] * tables, pa.binary())], ["bucket", "t", "cid", "n", "raw"])

    return run


def _meetings(batches: Iterator) -> Iterator[list[tuple]]:
    """Rows of each (bucket, t, i, j): two blocks at most."""
    held, key = [], None
    for row in rows_of(batches, "bucket", "t", "i", "j", "b", "cid", "n", "raw"):
        if row[:4] != key:
            if len(held) > 1:
                yield held
            held, key = [], row[:4]
        held.append(row)
    if len(held) > 1:
        yield held


def _compare(cosine: float, k: int, tables: int):
    """Links within a bucket: (a, b, n) is a joining link if b is given, else n more links of class a."""

    def run(batches):
        for rows in _meetings(batches):
            _, t, i, j = rows[0][:4]
            by_size: dict[int, list] = {}
            for row in rows:
                by_size.setdefault(len(row[7]), []).append(row)
            for same in by_size.values():
                unit = np.stack([_unit(r[7]) for r in same])
                block, cid, many = (np.array([r[c] for r in same]) for c in (4, 5, 6))
                left, right = (np.arange(len(same)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
                x, y = np.nonzero(unit[left] @ unit[right].T >= cosine)
                x, y = left[x], right[y]
                if i == j:
                    x, y = x[x < y], y[x < y]
                if not len(x):
                    continue
                keys = bucket_keys(unit, k, tables)[:, :t]
                fresh = np.concatenate([~(keys[x[a:a + HITS]] == keys[y[a:a + HITS]]).any(1) for a in range(0, len(x), HITS)])
                x, y = x[fresh], y[fresh]
                if not len(x):
                    continue
                more = np.bincount(x, weights=many[y], minlength=len(same)) + np.bincount(y, weights=many[x], minlength=len(same))
                at = np.flatnonzero(more)
                out = [(int(cid[a]), None, int(more[a])) for a in at]
                out += [(int(cid[a]), int(cid[b]), 0) for a, b in _forest(x, y, len(same))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])

    return run


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that span what all links span: every point to the smallest label reached so far, until nothing moves."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return [(a, int(b)) for a, b in enumerate(label) if a != b]
        label = new


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession, 1000)
    named = classes_of(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")))
    classes = named.filter("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.min("raw").alias("raw"))
    classes = cut(classes)
    k, tables = plan_tables(classes.count(), cosine)
    entries = classes.select("cid", "n", "raw").mapInArrow(_spread(k, tables), "bucket long, t int, cid long, n long, raw binary")

    full = entries.groupBy("bucket", "t").agg(F.count(F.lit(1)).alias("many"))
    large = cut(full.filter(F.col("many") > BLOCK).select("bucket", "t", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")))
    cutting = entries.join(within(large), ["bucket", "t"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cutting = cutting.withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cutting = cutting.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("o", "blocks")
    dealt = cutting.repartition("bucket", "t", "i", "j").sortWithinPartitions("bucket", "t", "i", "j", "cid")
    found = cut(dealt.mapInArrow(_compare(cosine, k, tables), "a long, b long, n long"))

    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    joined = components(found.filter("b is not null").select("a", "b"))
    part = classes.select("cid", "n", "first").join(joined, F.col("cid") == F.col("node"), "left").join(counts, F.col("cid") == F.col("a"), "left")
    part = cut(part.select("cid", "first", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("part")))
    answer = part.join(part.groupBy("part").agg(F.min("first").alias("component_id")), "part").select("cid", "n_links", "component_id")
    met = named.select("vec_id", "cid").join(answer, "cid", "left")
    met = met.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return met.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_vector_dedup": op3_vector_dedup}
ORACLES = {
    "op3_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
k AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT k.node AS vec_id, (SELECT count(*) FROM e WHERE e.a = k.node) AS n_links, component_id, node = component_id AS kept FROM k""",
}
