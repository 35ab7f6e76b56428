"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise part is evaluated in time linear in the features of a text by the
identity ``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Every text is read whole, once, where it lies: features are a few thousand numbers
at most (``WORD_BUCKETS`` + statistics), so memory per row is bounded whatever
the text's length. The model is fitted by numpy on at most ``max_rows`` labelled rows
(default ``MAX_ROWS``, chosen by a hash of the id) and is a table of fixed size.

Defined cases: null and empty texts have no words and are scored by their statistics
alone; a null ``n_chars`` is the training mean; without labels of both classes the score is the
share of good labels (0.5 without any label); a null id is scored, never trained on;
an empty table gives no rows. Labels are joined by id, so repeated ids are as many
training rows as they have rows. Other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import astuple, dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import documents, rows_of, small_batches, table, text_of

WORD_BUCKETS = 1 << 12
FACTORS = 8
MAX_ROWS = 6000
EPOCHS = 6
CUT = 0.3
STATS = (
    "log_words", "word_length", "long_words", "upper", "digits", "marks", "bars", "exclaims", "distinct_words", "top_word", "repeats", "log_lines",
    "repeated_lines", "line_words", "capital_words", "marked_words", "no_letters", "log_chars", "log_n_chars",
)
MEMO_WORDS = 1 << 19
_FACTS = 8  # bucket, letters, upper-case letters, digits, capital, marked end, no letter, long


class _Words(dict):
    """Facts of the words met lately, by row of a table; emptied when it is full, so memory is bounded by the longest text."""

    def __init__(self):
        super().__init__()
        self.facts = np.zeros((1024, _FACTS), np.float32)  # small, as it travels with the tasks; doubled when full

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        bucket = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        if word.isalpha() and word.islower():
            self.facts[k] = (bucket, len(word), 0, 0, 0, 0, 0, len(word) > 12)
        else:
            self.facts[k] = (
                bucket, len(word), sum(map(str.isupper, word)), sum(map(str.isdigit, word)), word[0].isupper(),
                not word[-1].isalnum() and word[-1] not in ".,;:?", not any(map(str.isalpha, word)), len(word) > 12,
            )
        self[word] = k
        return k

    def of(self, counts: Counter) -> np.ndarray:
        if len(self) >= MEMO_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))  # may grow the table
        return self.facts[at]


_words = _Words()


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words with unit length in sum, then the raw statistics."""
    words = text.split()
    counts = Counter(words)
    facts, many = _words.of(counts), np.fromiter(counts.values(), np.float64, len(counts))
    n, size, kinds = max(len(words), 1), max(len(text), 1), max(len(counts), 1)
    held = np.bincount(facts[:, 0].astype(np.int64), weights=many, minlength=WORD_BUCKETS)
    at = np.flatnonzero(held).astype(np.int32)
    value = np.sqrt(held[at] / max(held.sum(), 1)).astype(np.float32)
    letters, upper, digits, _, _, _, long = many @ facts[:, 1:]
    capital, marked, bare = facts[:, 4:7].sum(0)
    lines = [x for x in text.split("\n") if x]
    marks = sum(text.count(m) for m in "#$%&*@^~_=+<>{}[]\\/")
    stats = np.array([
        math.log1p(len(words)), letters / n, long / n, upper / size, digits / size, marks / size, text.count("|") / n, text.count("!") / n,
        len(counts) / n, many.max(initial=0) / n, sum(map(eq, words, islice(words, 1, None))) / n, math.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1), math.log1p(len(words) / max(len(lines), 1)), capital / kinds, marked / kinds, bare / kinds,
        math.log1p(len(text)), math.log1p(n_chars) if n_chars is not None and n_chars >= 0 else math.nan,
    ], np.float32)
    return np.concatenate([at, WORD_BUCKETS + np.arange(len(STATS), dtype=np.int32)]), np.concatenate([value, stats])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Statistics in units of their spread, unknown ones at the mean, held within 4."""
        out, stat = value.astype(np.float64), at >= WORD_BUCKETS
        k = at[stat] - WORD_BUCKETS
        out[stat] = np.clip(np.nan_to_num((value[stat] - self.mean[k]) / self.spread[k]), -4, 4) / 4
        return out

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        inner = x @ self.factor[at]
        return float(self.bias + x @ self.weight[at] + 0.5 * (inner @ inner - (x**2) @ (self.factor[at] ** 2).sum(1)))

    def score(self, text: str, n_chars: int | None) -> float:
        at, value = features(text, n_chars)
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, self.scaled(at, value)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7, rate: float = 0.08, shrink: float = 1e-5) -> Machine:
    """Adagrad on the log loss, one row at a time in a seeded order."""
    n = WORD_BUCKETS + len(STATS)
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(n, np.float64), rng.normal(0, 0.02, (n, FACTORS)), np.zeros(len(STATS)), np.ones(len(STATS)))
    good = sum(y for *_, y in rows)
    if not rows or good in (0, len(rows)):
        share = good / len(rows) if rows else 0.5
        model.bias, model.factor[:] = float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0
        return model
    stats = np.array([value[-len(STATS):] for _, value, _ in rows], np.float64)
    model.mean = np.nan_to_num(np.nanmean(np.where(np.isnan(stats).all(0), 0, stats), 0))
    model.spread = np.nan_to_num(np.nanstd(np.where(np.isnan(stats).all(0), 0, stats), 0)) + 1e-6
    ready = [(at, model.scaled(at, value), y) for at, value, y in rows]
    model.bias = float(np.log(good / (len(rows) - good)))
    seen, seen_w, seen_v = 1e-6, np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(ready)):
            at, x, y = ready[k]
            slip = 1 / (1 + np.exp(-np.clip(model.raw(at, x), -30, 30))) - y
            v = model.factor[at]
            down_w = slip * x + shrink * model.weight[at]
            down_v = slip * (x[:, None] * (x @ v) - v * (x**2)[:, None]) + shrink * v
            seen += slip**2
            seen_w[at] += down_w**2
            seen_v[at] += down_v**2
            model.bias -= rate * slip / np.sqrt(seen)
            model.weight[at] -= rate * down_w / np.sqrt(seen_w[at])
            model.factor[at] -= rate * down_v / np.sqrt(seen_v[at])
    return model


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold. ``docs`` needs doc_id, text, n_chars; ``labels`` doc_id, quality."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id")), "doc_id", "y").limit(max_rows)
    # Its bound is max_rows, whatever the size of the tables.
    picked = docs.select("doc_id", text_of("text").alias("text"), "n_chars").join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for text, n_chars, y, key in rows_of(batches, "text", "n_chars", "y", "doc_id"):
            at, value = features(text, n_chars)
            yield pa.RecordBatch.from_pylist([{"k": str(key), "at": at.tobytes(), "x": value.tobytes(), "y": y}], schema=pa.schema([("k", pa.string()), ("at", pa.binary()), ("x", pa.binary()), ("y", pa.int32())]))

    got = picked.withColumn("y", F.col("y").cast("int")).mapInArrow(extract, "k string, at binary, x binary, y int").collect()
    got = sorted(got, key=lambda r: (zlib.crc32(r["k"].encode()), r["k"], bytes(r["x"])))[:max_rows]
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), r["y"]) for r in got], epochs)


def score(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """``docs`` (its columns text and n_chars are read) with a score column appended."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches):
        machine = Machine(*shared.value)
        for batch in batches:
            scores = [machine.score(text or "", n_chars) for text, n_chars in rows_of([batch], "text", "n_chars")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema)
    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, f"{fields}, `{name}` double")


def keep_good(docs: DataFrame, model: Machine, cut: float = CUT) -> DataFrame:
    """The documents with a score of at least ``cut``, columns as they came."""
    name = "__quality"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).filter(F.col(name) >= cut).drop(name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
