"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

    score(text) = sum_t log P(token_t | the WINDOW tokens before and after it)

Every word of the corpus is a token with a probability of its own. The network predicts the most frequent words, counted over all
documents, and ``TAILS`` groups of the other words by the hash of their last letters; a word of a group has the group's probability times
its counted share in the group, so the probabilities of all words of the corpus sum to those of the network's outputs. The counts of the words are a
partitioned table that grows with the corpus. Texts meet it in buckets of about ``BUCKET_WORDS`` words: each bucket asks for the
shares of its distinct words once. As context, the words of a group look alike. The network sums one embedding per context place and token, applies tanh, and
predicts a token by its class and its place in the class (a softmax of two levels), so a prediction costs the
root of the vocabulary.

Training reads every document. In each of ``ROUNDS`` rounds the documents of one hash class are
learned where they lie: every task runs Adagrad in numpy on its own documents from the common parameters and
hands back its parameters, weighed by its tokens; chunks of parameters are averaged
in two grouped steps, so what is gathered grows with the number of tasks and no task or
driver holds more than the model times a bounded number. The network has a fixed size; scoring broadcasts it and joins the table of words.

Defined cases: null and empty texts have no tokens and score 0; a null id is scored like any other and learned in the first
round; texts of one word are predicted from padding alone; an empty table trains nothing and gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut, documents, rows_of, small_batches, text_of

CLASSES = 32
PER_CLASS = 32
TAILS = 64
WINDOW = 2
WIDTH = 24
ROUNDS = 2
RATE = 0.15
BATCH = 4096
ROWS = 256
STRIDE = 2 * BATCH
FLUSH = 400_000
CHUNKS = 16
BUCKET_WORDS = 3_000_000
MOST_ENDS = 1 << 16
VOCABULARY = CLASSES * PER_CLASS
PLACES = (-2, -1, 1, 2)
SHAPES = {
    "places": (len(PLACES), VOCABULARY + 1, WIDTH), "hidden": (WIDTH,), "class_w": (WIDTH, CLASSES), "class_b": (CLASSES,),
    "word_w": (CLASSES, WIDTH, PER_CLASS), "word_b": (CLASSES, PER_CLASS),
}
Parameters = dict[str, np.ndarray]


def counts(docs: DataFrame) -> DataFrame:
    """(w, n): every word of all documents."""

    def count(batches):
        many: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(many), pa.string()), pa.array(many.values(), pa.int64())], ["w", "n"])
            many.clear()

        for (text,) in rows_of(batches, "text"):
            many.update(text.lower().split())
            if len(many) > FLUSH:
                yield from out()
        yield from out()

    return docs.select(text_of("text").alias("text")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, words: int = VOCABULARY - TAILS) -> dict[str, int]:
    top = counted.orderBy(F.desc("n"), "w").limit(words).collect()
    # Neighbours in frequency are dealt over the classes.
    return {r["w"]: TAILS + i for i, r in enumerate(top)}


def vocabulary(docs: DataFrame, words: int = VOCABULARY - TAILS) -> dict[str, int]:
    """The most frequent words, of all documents, to their tokens."""
    return most_frequent(counts(docs), words)


def shares(counted: DataFrame, words: dict[str, int]) -> DataFrame:
    """(w, tail, share): the words that are not in the vocabulary, their groups, and the logarithm of each one's share in its group."""
    spark = counted.sparkSession
    rare = counted.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "w string")), "w", "left_anti")
    rare = rare.withColumn("tail", F.pmod(F.crc32(F.encode(F.right("w", F.lit(3)), "utf-8")), F.lit(TAILS)).cast("int"))
    sums = {r["tail"]: r["n"] for r in rare.groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    whole = F.array(*[F.lit(float(sums.get(i, 0))) for i in range(TAILS)])
    return rare.select("w", "tail", (F.log(F.col("n").cast("double")) - F.log(F.get(whole, F.col("tail")))).alias("share"))


class Ends(dict):
    """Group of a word by its last letters; the letters met are remembered."""

    def __missing__(self, end: str) -> int:
        token = zlib.crc32(end.encode("utf-8", "surrogatepass")) % TAILS
        if len(self) < MOST_ENDS:
            self[end] = token
        return token


class Tokens(dict):
    """Token of a word: its own, or that of its last letters."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.ends, self.least = Ends(), min(known.values(), default=1)

    def __missing__(self, word: str) -> int:
        return self.ends[word[-3:]]

    def of(self, text: str) -> np.ndarray:
        words, ends, get = text.lower().split(), self.ends, self.get
        if not self.least:  # a token 0 would read as none
            return np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return np.fromiter([get(w) or ends[w[-3:]] for w in words], np.int32, len(words))


def fresh(seed: int = 5) -> Parameters:
    rng = np.random.default_rng(seed)
    scale = {"places": 0.1, "class_w": 0.2, "word_w": 0.2}
    return {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def contexts(tokens: np.ndarray) -> np.ndarray:
    """The tokens around each token; the pad token beyond the ends."""
    wide = np.full(len(tokens) + 2 * WINDOW, VOCABULARY, np.int32)
    wide[WINDOW:len(tokens) + WINDOW] = tokens
    return np.stack([wide[WINDOW + p:WINDOW + p + len(tokens)] for p in PLACES], axis=1)


def _blocks(a: int, b: int) -> Iterator[slice]:
    """Blocks of ``ROWS`` rows: products of them are small enough for the cache and for one thread, as a task has one core."""
    return (slice(i, min(i + ROWS, b)) for i in range(a, b, ROWS))


def _hidden(p: Parameters, context: np.ndarray) -> np.ndarray:
    h = p["places"][0].take(context[:, 0], axis=0)
    for i in range(1, len(PLACES)):
        h += p["places"][i].take(context[:, i], axis=0)
    h += p["hidden"]
    return np.tanh(h, out=h)


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by class, and (class, start, end) of each class in it."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    ends = np.bincount(classes, minlength=CLASSES).cumsum().tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def _scores(h: np.ndarray, parts: list[tuple[int, int, int]], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A column of scores per row of ``h``, by the weights of the part that the row lies in."""
    # Rows of a power of two in length would share the same few places of the cache.
    out = np.empty((b.shape[1], len(h) + 16), h.dtype)[:, :len(h)]
    for c, start, end in parts:
        for at in _blocks(start, end):
            np.matmul(w[c].T, h[at].T, out=out[:, at])
        out[:, start:end] += b[c][:, None]
    return out


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each column at one place; ``x`` is overwritten."""
    x -= x.max(0)
    own = x[at, np.arange(len(at))]
    return own - np.log(np.exp(x, out=x).sum(0))


def _slip(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax of each column less one at the place that was meant, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    x[at, np.arange(len(at))] -= 1
    return x


def _backwards(h: np.ndarray, parts: list[tuple[int, int, int]], w: np.ndarray, slip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means over the rows of the gradients of weights and biases, and the gradient of each row."""
    n, back = len(h), np.empty_like(h)
    down_w, down_b = np.zeros_like(w), np.zeros((len(w), len(slip)), w.dtype)
    for c, start, end in parts:
        for at in _blocks(start, end):
            down_w[c] += (slip[:, at] @ h[at]).T
            np.matmul(slip[:, at].T, w[c].T, out=back[at])
        down_b[c] = slip[:, start:end].sum(1)
    down_w /= n
    down_b /= n
    return down_w, down_b, back


def log_probabilities(p: Parameters, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P of each target: class, then word within the class."""
    h = _hidden(p, context)
    classes, word = target % CLASSES, target // CLASSES
    out = _log_of(_scores(h, [(0, 0, len(h))], p["class_w"][None], p["class_b"][None]), classes)
    order, parts = _by_class(classes)
    out[order] += _log_of(_scores(h.take(order, axis=0), parts, p["word_w"], p["word_b"]), word[order])
    return out


def learn(p: Parameters, seen: Parameters, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
    """One step of Adagrad on the mean negative log-likelihood of a batch, in place."""
    n = len(target)
    h = _hidden(p, context)
    classes, word = target % CLASSES, target // CLASSES
    whole, class_w, down = [(0, 0, n)], p["class_w"][None], {}
    slip = _slip(_scores(h, whole, class_w, p["class_b"][None]), classes)
    (down["class_w"],), (down["class_b"],), back = _backwards(h, whole, class_w, slip)
    order, parts = _by_class(classes)
    sorted_h = h.take(order, axis=0)
    slip = _slip(_scores(sorted_h, parts, p["word_w"], p["word_b"]), word[order])
    down["word_w"], down["word_b"], deep = _backwards(sorted_h, parts, p["word_w"], slip)
    place = np.empty_like(order)
    place[order] = np.arange(n)
    back += deep.take(place, axis=0)
    back *= (1 - h * h) / n
    down["hidden"] = back.sum(0)
    # Two numbers are added at once, as the parts of a complex one.
    pair = np.result_type(back.dtype, np.complex64)
    down["places"] = np.zeros_like(p["places"])
    for i in range(len(PLACES)):
        at = context[:, i, None] * np.intp(WIDTH // 2) + np.arange(WIDTH // 2)
        np.add.at(down["places"][i].reshape(-1).view(pair), at.reshape(-1), back.reshape(-1).view(pair))
    for k, g in down.items():
        root = g * g
        seen[k] += root
        np.sqrt(seen[k], out=root)
        g *= rate
        g /= root
        p[k] -= g


def pack(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> Parameters:
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1]
    return {k: x.reshape(s).copy() for (k, s), x in zip(SHAPES.items(), np.split(flat, cuts), strict=True)}


def _average(key, rows):
    """Weighted mean of one chunk of parameters."""
    weight, total = 0.0, 0.0
    for n, part in zip(rows.column("n").to_pylist(), rows.column("part"), strict=True):
        weight += n
        total = total + n * np.frombuffer(part.as_buffer(), np.float64)
    return pa.table({"chunk": rows.column("chunk")[:1], "n": pa.array([weight]), "part": pa.array([(total / weight).tobytes()], pa.binary())})


def train(docs: DataFrame, words: dict[str, int], rounds: int = ROUNDS, rate: float = RATE) -> Parameters:
    """Learn from every document, a hash class per round."""
    spark = docs.sparkSession
    state = pack(fresh())
    part_kind = "chunk int, n double, part binary"
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((words, state))

        def run(batches, shared=shared):
            known, start = shared.value
            tokens, p = Tokens(known), unpack(start)
            seen = {k: np.full_like(v, 1e-4) for k, v in p.items()}
            total, held, waiting = 0, [], 0

            def step():
                nonlocal total
                context, target = np.concatenate([contexts(t) for t in held]), np.concatenate(held)
                for a in range(0, len(target), BATCH):
                    learn(p, seen, context[a:a + BATCH], target[a:a + BATCH], rate)
                total += len(target)

            for (text,) in rows_of(batches, "text"):
                t = tokens.of(text)
                if len(t):
                    held.append(t)
                    waiting += len(t)
                if waiting >= 4 * BATCH:
                    step()
                    held, waiting = [], 0
            if held:
                step()
            if total:
                parts = np.array_split(pack(p).astype(np.float64), CHUNKS)
                salt = zlib.crc32(parts[0].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int64()), pa.array([float(total)] * CHUNKS), pa.array([x.tobytes() for x in parts], pa.binary())],
                    ["chunk", "salt", "n", "part"])

        mine = docs.filter(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)), F.lit(0)) == r) if rounds > 1 else docs
        trained = mine.select(text_of("text").alias("text")).mapInArrow(run, "chunk int, salt long, n double, part binary")
        some = trained.withColumn("salt", F.col("salt") % 64).groupBy("chunk", "salt").applyInArrow(_average, part_kind)
        done = {x["chunk"]: np.frombuffer(x["part"], np.float64) for x in some.groupBy("chunk").applyInArrow(_average, part_kind).collect()}
        if done:
            state = np.concatenate([done[c] for c in range(CHUNKS)]).astype(np.float32)
    return unpack(state)


def _sums(p: Parameters, read: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its number of tokens and the sum of their log-probabilities."""
    around, every = np.concatenate([contexts(t) for t in read]), np.concatenate(read)
    each = [log_probabilities(p, around[a:a + STRIDE], every[a:a + STRIDE]) for a in range(0, len(every), STRIDE)]
    # Texts are scored together; a text's sum is the difference of two running sums.
    running = np.concatenate([[0.0], *each]).cumsum(dtype=np.float64)
    ends = np.cumsum([len(t) for t in read])
    starts = ends - [len(t) for t in read]
    return ends - starts, running[ends] - running[starts]


def score(docs: DataFrame, words: dict[str, int], p: Parameters) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood, of what the network predicts: words of the vocabulary, groups of the others."""
    shared = docs.sparkSession.sparkContext.broadcast((words, p))

    def run(batches):
        known, parameters = shared.value
        tokens = Tokens(known)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, total = _sums(parameters, [tokens.of(text) for (text,) in rows_of([batch], "text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])

    picked = docs.select("doc_id", text_of("text").alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_tokens long, log_likelihood double")


def score_words(docs: DataFrame, words: dict[str, int], p: Parameters, share: DataFrame, buckets: int) -> DataFrame:
    """As ``score``, of the words themselves: the words of a group have their ``share`` in it besides."""
    shared = docs.sparkSession.sparkContext.broadcast((words, p))
    picked = docs.select("doc_id", text_of("text").alias("text"))
    # One shuffle of texts serves both sides.
    dealt = picked.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")).repartition("bucket")

    def ask(batches):
        known, asked, held = frozenset(shared.value[0]), {}, 0

        def out():
            for bucket, some in asked.items():
                some -= known
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(some), pa.int32()), pa.array(list(some), pa.string())], ["home", "w"])
            asked.clear()

        for bucket, text in rows_of(batches, "bucket", "text"):
            some = asked.setdefault(bucket, set())
            held -= len(some)
            some.update(text.lower().split())
            held += len(some)
            if held > FLUSH:
                yield from out()
                held = 0
        yield from out()

    def run(key, texts, found):
        known, parameters = shared.value
        # A word is looked up once: its number leads to its token and its share.
        number = dict(zip(chain(known, found.column("w").to_numpy().tolist()), range(len(known) + found.num_rows), strict=True)).__getitem__
        token_of = np.concatenate([np.fromiter(known.values(), np.int32, len(known)), found.column("tail").to_numpy()])
        share_of = np.concatenate([np.zeros(len(known)), found.column("share").to_numpy()])
        counted, totals = [], []
        for batch in texts.to_batches(max_chunksize=1024):
            if not batch.num_rows:
                continue
            read = [np.fromiter(map(number, t), np.int32, len(t)) for t in (text.lower().split() for text in batch.column("text").to_pylist())]
            n, total = _sums(parameters, [token_of[t] for t in read])
            counted.append(n)
            totals.append(total + [share_of[t].sum() for t in read])
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(np.concatenate(counted), pa.int64()), "log_likelihood": pa.array(np.concatenate(totals), pa.float64())})

    answers = dealt.mapInArrow(ask, "home int, w string").join(share, "w")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bucket").cogroup(answers.groupBy("home")).applyInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the documents and score them: doc_id, n_tokens, log_likelihood, per_token."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = cut(counts(docs))
    words = most_frequent(counted)
    buckets = max(1, -(-(counted.agg(F.sum("n").alias("n")).first()["n"] or 0) // BUCKET_WORDS))
    scored = score_words(docs, words, train(docs, words, rounds), shares(counted, words), buckets)
    return scored.withColumn("per_token", F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1).cast("long")))


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(documents(spark, sf_dir))


QUERIES = {"op7_masked_lm": op7_masked_lm}
ORACLES: dict[str, str] = {}
