"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed words and word beginnings; each model also
reads the probabilities of the categories before it. In training these are out-of-fold
predictions, made by models that have not seen the row, as they will be in use.

The tables mark one category, ``toxic``. Two more are derived from it, by the terms that mark it in the
training rows (features far more frequent in toxic rows): ``repeated`` (toxic with several such terms) and
``dense`` (toxic with many of them for its length). The chain runs repeated, dense, toxic; a table
with more label columns is chained by :func:`train` as it is.

A text is read whole where it lies, as the set of its features. Models are fitted by numpy on at most
``MAX_ROWS`` labelled rows (chosen by a hash of the id) and hold features of at least ``LEAST`` training rows, so their size is
bounded by these parameters.

Defined cases: null and empty texts have no features and score by the biases, which no training row moves above
the threshold; without rows of both kinds a category's probability is its share (0 without rows); a null id is
scored, never trained on; repeated ids are as many training rows as they have rows; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import documents, rows_of, small_batches, table, text_of

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
MAX_ROWS = 6000
LEAST = 5
FOLDS = 3
STEPS = 80
RATE = 0.3
SHRINK = 2e-4
CHAIN = ("repeated", "dense", "toxic")
MEMO = 1 << 18
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&@~^_=+/\\-"


class _Features(dict):
    """Features of the words met lately: the word itself and its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        bare = word.strip(_EDGES)
        keys = [bare] if bare else []
        keys += (f"{bare[:n]}*" for n in PREFIXES if len(bare) > n)
        found = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys)
        self[word] = found
        return found


_features = _Features()


def features(text: str) -> np.ndarray:
    """The distinct features of a text, sorted."""
    if len(_features) > MEMO:
        _features.clear()
    found: set[int] = set()
    for f in map(_features.__getitem__, set(text.lower().split())):
        found.update(f)
    return np.array(sorted(found), np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Training rows as one sparse matrix over the features that are frequent enough."""

    def __init__(self, sets: list[np.ndarray], known: np.ndarray):
        at = [np.searchsorted(known, s) for s in sets]
        at = [a[(a < len(known)) & (known[np.minimum(a, len(known) - 1)] == s)] if len(known) else a[:0] for a, s in zip(at, sets, strict=True)]
        self.row = np.repeat(np.arange(len(sets)), [len(a) for a in at])
        self.feature = np.concatenate([np.empty(0, np.int64), *at])
        self.n, self.width = len(sets), len(known)

    def pick(self, rows: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        inside = new[self.row] >= 0
        out.row, out.feature, out.n, out.width = new[self.row[inside]], self.feature[inside], len(rows), self.width
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.feature], minlength=self.n)


def fit(rows: Rows, before: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression with a lasso, by Adagrad over all rows: (bias, feature weights, weights of earlier categories)."""
    w, u = np.zeros(rows.width), np.zeros(before.shape[1])
    good = float(y.sum())
    if good in (0.0, float(len(y))):
        share = good / len(y) if len(y) else 0.0
        return float(np.log((share + 1e-4) / (1 - share + 1e-4))), w, u
    bias, seen, seen_w, seen_u = float(np.log(good / (len(y) - good))), 1e-8, np.full(rows.width, 1e-8), np.full(len(u), 1e-8)
    start = bias
    # Rare positives count as much as the others together, softened by a root.
    weight = np.where(y == 1, np.sqrt((len(y) - good) / good), 1.0)
    weight /= weight.sum()
    for _ in range(STEPS):
        slip = (_sigmoid(bias + rows.times(w) + before @ u) - y) * weight
        down = np.bincount(rows.feature, weights=slip[rows.row], minlength=rows.width)
        down_b, down_u = slip.sum(), before.T @ slip
        seen, seen_w, seen_u = seen + down_b**2, seen_w + down**2, seen_u + down_u**2
        bias = min(bias - RATE * down_b / np.sqrt(seen), start)
        u -= RATE * down_u / np.sqrt(seen_u)
        w -= RATE * down / np.sqrt(seen_w)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK / np.sqrt(seen_w), 0)
    return bias, w, u


def train_chain(sets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, float]:
    """(known features, models in chain order, out-of-fold probabilities, threshold of the last category)."""
    every = np.concatenate([np.empty(0, np.int64), *sets])
    known, many = np.unique(every, return_counts=True)
    known = known[many >= LEAST]
    rows, fold = Rows(sets, known), np.arange(len(sets)) % FOLDS
    held = np.zeros((len(sets), 0))
    models = []
    for c in range(labels.shape[1]):
        y, out = labels[:, c].astype(float), np.zeros(len(sets))
        for k in range(FOLDS if len(sets) >= FOLDS else 0):
            mine, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            b, w, u = fit(rows.pick(mine), held[mine], y[mine])
            out[other] = _sigmoid(b + rows.pick(other).times(w) + held[other] @ u)
        models.append(fit(rows, held, y))
        held = np.column_stack([held, out])
    return known, models, held, _threshold(held[:, -1], labels[:, -1]) if len(sets) else 0.5


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F1 on out-of-fold predictions, in the middle of the gap it stands in."""
    grid = np.linspace(0.05, 0.8, 76)
    f1 = np.array([2 * ((p >= t) & (y == 1)).sum() / max(((p >= t).sum() + (y == 1).sum()), 1) for t in grid])
    return float(grid[f1 >= f1.max() - 1e-9].mean())


def derived_labels(sets: list[np.ndarray], words: np.ndarray, toxic: np.ndarray, terms: int = 3, per_hundred: float = 2.0) -> np.ndarray:
    """(repeated, dense, toxic) of each row."""
    every = np.concatenate([np.empty(0, np.int64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys, at = np.unique(every, return_inverse=True)
    bad = np.bincount(at, weights=toxic[owner].astype(float), minlength=len(keys)) if len(keys) else np.empty(0)
    good = np.bincount(at, minlength=len(keys)) - bad
    marks = (bad >= LEAST) & (bad / max(toxic.sum(), 1) > 5 * (good + 1) / max((1 - toxic).sum(), 1))
    found = np.bincount(owner, weights=marks[at].astype(float), minlength=len(sets)) if len(keys) else np.zeros(len(sets))
    return np.column_stack([toxic & (found >= terms), toxic & (found * 100 >= per_hundred * words), toxic]).astype(int)


def train(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("toxic",), max_rows: int = MAX_ROWS):
    """Fit the chain. ``docs`` needs doc_id and text; ``labels`` doc_id and the columns; one column is extended to ``CHAIN``."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", *columns).filter(F.col("doc_id").isNotNull()).dropna(subset=list(columns))
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id")), "doc_id", *columns).limit(max_rows)
    picked = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for row in rows_of(batches, "doc_id", "text", *columns):
            yield pa.RecordBatch.from_arrays([pa.array([str(row[0])]), pa.array([features(row[1]).astype(np.int32).tobytes()], pa.binary()), pa.array([len(row[1].split())], pa.int64()), pa.array([[int(v) for v in row[2:]]], pa.list_(pa.int32()))], ["k", "f", "words", "y"])

    got = picked.mapInArrow(extract, "k string, f binary, words long, y array<int>").collect()
    got = sorted(got, key=lambda r: (zlib.crc32(r["k"].encode()), r["k"], bytes(r["f"]), r["y"]))[:max_rows]
    sets = [np.frombuffer(r["f"], np.int32).astype(np.int64) for r in got]
    y = np.array([r["y"] for r in got], int).reshape(len(got), len(columns))
    if len(columns) == 1:
        y = derived_labels(sets, np.array([r["words"] for r in got]), y[:, 0])
    return train_chain(sets, y)


def score(docs: DataFrame, chain, names: tuple[str, ...] = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of every category, in chain order."""
    small_batches(docs.sparkSession)
    known, models = chain[:2]
    used = np.flatnonzero(np.any([w != 0 for _, w, _ in models], axis=0)) if len(known) else np.empty(0, int)
    shared = docs.sparkSession.sparkContext.broadcast((known[used], [(b, w[used], u) for b, w, u in models]))

    def run(batches):
        keys, linear = shared.value
        for batch in batches:
            out = []
            for (text,) in rows_of([batch], "text"):
                f = features(text)
                at = np.minimum(np.searchsorted(keys, f), max(len(keys) - 1, 0))
                at = at[keys[at] == f] if len(keys) else at[:0]
                p: list[float] = []
                for b, w, u in linear:
                    p.append(float(_sigmoid(b + w[at].sum() + np.dot(u, p))))
                out.append(p)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *names])

    picked = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in names))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).withColumn("is_toxic", F.col("toxic") >= F.lit(chain[3]))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
