"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

With X the n centred rows of the fit list, the bidiagonalisation alternates ``u = Xv`` and ``v = Xᵀu`` and keeps both families
orthogonal by full reorthogonalisation; X then reads ``U B Vᵀ`` with a small bidiagonal B, whose singular values and right vectors
give deviations and components. n grows with the data, so no u is ever stored: each is ``Xw`` for a known short w.
One pass over the blocks makes both products for the next step, ``y = Xp`` and ``s = Xᵀy``; the inner products
of y with all former u are then ``wᵀs``, and taking them out of p, s and the length of y reorthogonalises u without
a further pass. Only vectors as long as an embedding pass through the driver.

When a step finds nothing new, the space is invariant and a fresh direction orthogonal to all v goes on, so repeated
eigenvalues are all found. Steps end when the wanted residuals vanish and what B leaves of the whole variance is less than the
least wanted eigenvalue (then nothing unseen can be larger), at the latest after as many steps as dimensions. A last pair of passes
turns the components inside their space to their exact axes and measures the whitened covariance.

Vectors are integers ``floor(64 c) + 1000000``; equal ones count once in the fit. The offset is left out of the arithmetic,
rows are centred before they are multiplied, and deviations are computed in integers.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, give no rows; entries beyond 2^40 in size
count as 2^40; each length of vector is a fit of its own; directions without variance have no
component, so a table of equal vectors, like an empty one, gives no rows; repeated rows and null ids are carried along; a
squared deviation beyond a long is given as the largest long; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.clusters import MOST, packed, unpacked, usable
from fleetgrade.llm.common import cut, small_batches, table

BLOCK = 4096
SCALE = 64
TASK = 1 << 20
LARGEST = 1 << 40
TINY = 1e-11
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: str) -> Column:
    """floor(64 c) of every entry, without the offset."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("long"))


@dataclass
class Fit:
    """Number of vectors, integer sums without the offset, components (one per column), eigenvalues, shares, and how far from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _blocks(distinct: DataFrame, size: int) -> DataFrame:
    """(n, sums, x): packed blocks of the fit list."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                sums = pa.array([x.sum(0)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), sums, pa.array([packed(x)], pa.binary())], ["n", "sums", "x"])

    return distinct.mapInArrow(pack, "n long, sums array<long>, x binary")


def _summed(blocks: DataFrame, size: int, length: int, one) -> np.ndarray:
    """Sum over all blocks of ``one(x)``, an array of this length: added up in every task, then one row per task in the JVM."""

    def run(batches):
        total = np.zeros(length)
        for batch in batches:
            for raw in batch.column("x"):
                total += one(unpacked(raw.as_py(), size))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["part"])

    parts = blocks.select("x").mapInArrow(run, "part array<double>")
    return np.array([v or 0.0 for v in parts.agg(*(F.sum(F.col("part")[i]) for i in range(length))).first()])


class Bidiagonal:
    """The bidiagonalisation so far; ``products(p)`` gives Xᵀ(Xp) and the squared length of Xp."""

    def __init__(self, size: int, total: float, products, seed: int = 1):
        self.size, self.total, self.products = size, total, products
        self.rng = np.random.default_rng(seed)
        self.v, self.w, self.z, self.alpha, self.beta = [], [], [], [], []
        self.v.append(self._fresh())

    def _fresh(self) -> np.ndarray:
        """A unit vector orthogonal to all v."""
        while True:
            f = self._apart(self.rng.normal(size=self.size))
            length = np.linalg.norm(f)
            if length > 1e-6:
                return self._apart(f / length) / np.linalg.norm(self._apart(f / length))

    def _apart(self, f: np.ndarray) -> np.ndarray:
        for _ in range(2 if self.v else 0):
            f = f - np.array(self.v).T @ (np.array(self.v) @ f)
        return f

    def step(self) -> None:
        """One u and, while there is room, the next v."""
        tiny = TINY * np.sqrt(self.total)
        p = self.v[-1].copy()
        if self.beta and self.beta[-1]:
            p -= self.beta[-1] * self.w[-1]
        s, square = self.products(p)
        for w, z in zip(self.w, self.z, strict=True):
            h = w @ s
            p, s, square = p - h * w, s - h * z, square - h * h
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= tiny:
            alpha, w, z = 0.0, np.zeros(self.size), np.zeros(self.size)
        else:
            w, z = p / alpha, s / alpha
        self.alpha.append(alpha)
        self.w.append(w)
        self.z.append(z)
        if len(self.v) == self.size:
            self.beta.append(0.0)
            return
        rest = self._apart(z - alpha * self.v[-1])
        beta = np.linalg.norm(rest)
        self.beta.append(beta if beta > tiny else 0.0)
        self.v.append(rest / beta if beta > tiny else self._fresh())

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(deviations, right vectors as columns, residuals) of the small matrix."""
        m = len(self.alpha)
        b = np.diag(self.alpha) + np.diag(self.beta[:m - 1], 1)
        left, sigma, right = np.linalg.svd(b)
        return sigma, np.array(self.v[:m]).T @ right.T, self.beta[m - 1] * np.abs(left[m - 1])

    def enough(self, wanted: int) -> bool:
        m = len(self.alpha)
        if m == self.size:
            return True
        if m <= wanted:
            return False
        sigma, _, residual = self.triples()
        left = self.total - sum(a * a for a in self.alpha) - sum(b * b for b in self.beta)
        return left < sigma[wanted - 1] ** 2 and residual[:wanted].max() <= 1e-13 * sigma[0]


def fit(vectors: DataFrame, size: int, most: int = 16) -> Fit | None:
    """The whitening of a column ``x`` of integer vectors of one length; None if they have no variance."""
    blocks = cut(_blocks(vectors.select("x").distinct(), size))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    if n < 2:
        return None
    added = blocks.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    sums = [int(r["v"]) for r in sorted(added, key=lambda r: r["at"])]
    # A pass reads the blocks once per step: tasks of about TASK numbers, whatever number of partitions made them.
    blocks = blocks.coalesce(max(1, -(-n * size // TASK)))
    mean = np.array([s / n for s in sums])
    total = float(_summed(blocks, size, 1, lambda x: ((x - mean) ** 2).sum())[0])
    if not total:
        return None

    def products(p):
        def one(x):
            y = (centred := x - mean) @ p
            return np.append(y @ centred, y @ y)

        both = _summed(blocks, size, size + 1, one)
        return both[:-1], both[-1]

    wanted = min(most, size, n - 1)
    found = Bidiagonal(size, total, products)
    found.step()
    while not found.enough(wanted):
        found.step()
    sigma, right, _ = found.triples()
    right = np.linalg.qr(right[:, :wanted][:, sigma[:wanted] > TINY * 10 * np.sqrt(total)])[0]
    k = right.shape[1]

    def spread(axes):
        """Covariance of the rows along these axes."""
        def one(x):
            y = (x - mean) @ axes
            return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

        both = _summed(blocks, size, k * k + k, one) / n
        return both[:k * k].reshape(k, k) - np.outer(both[k * k:], both[k * k:])

    values, turn = np.linalg.eigh(spread(right))
    values, axes = values[::-1], right @ turn[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    error = float(np.abs(spread(axes / np.sqrt(values)) - np.eye(k)).max())
    return Fit(n, sums, axes, values, values / (total / n), error)


def apply(rows: DataFrame, found: Fit) -> DataFrame:
    """(vec_id, x) to one row per vector and component."""
    size, k = found.components.shape
    n, sums, mean, turned = found.n, np.array(found.sums, object), found.mean, found.components / np.sqrt(found.values)

    def deviation(x: np.ndarray) -> list[int]:
        most = max(int(np.abs(x).max(initial=0)), max(map(abs, found.sums)) // n + 1)
        if size * (2 * n * most) ** 2 <= MOST:
            return ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
        return [min(int(d), MOST) for d in ((n * x.astype(object) - sums) ** 2).sum(1)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                white = (x - mean) @ turned
                ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
                away = pa.array(np.repeat(np.array(deviation(x), np.int64), k))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), away, pa.array(white.ravel())], ["vec_id", "component", "deviation", "whitened"])

    share = F.array(*(F.lit(float(e)) for e in found.explained))
    out = rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, deviation long, whitened double")
    return out.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("component") - 1].alias("explained"),
        F.lit(found.error).alias("identity_error"),
    )


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    small_batches(spark, BLOCK)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding")).filter(usable("embedding"))
    rows = rows.select("vec_id", whole("embedding").alias("x"))
    sizes = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    parts = []
    for size in sizes:
        own = rows.filter(F.size("x") == size) if len(sizes) > 1 else rows
        found = fit(own, size, most)
        parts += [apply(own, found)] if found else []
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
