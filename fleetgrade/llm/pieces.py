"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised as the model asks (a marker in front, spaces as markers) and cut into words
before each run of markers and around line ends; no piece of the vocabulary crosses such a cut, so
the best path of a text is that of its words, one after the other. Per distinct word of the corpus:

1. explode its substrings of at most the longest piece's length;
2. equi-join them to the piece table (its size is that of the vocabulary, checked before it is broadcast);
   characters that are no piece get an edge of their own, spelled in byte pieces;
3. group the edges by word, where the words already are;
4. fold Viterbi over the edges of the words of an Arrow batch, all words one position further at a time: best score of
   every position, ties to the longer piece, then back along the best edges.

A word of more than ``LONGEST`` characters (a run without spaces or line ends) is not shipped: it is encoded whole where its
text lies, by the same recurrence over the same table, in time and memory linear in its length.

Texts meet the encodings of their words in buckets of about ``BUCKET_BYTES`` of text: each bucket asks
for its distinct words once, and one Arrow kernel strings the answers together. Texts and answers travel in compressed
Arrow blocks, one per task and bucket. Words that many buckets would ask for, the most frequent of a bounded sample of the texts, have their
encodings sent to all tasks instead; the sample decides by which way an answer comes, not what it says. Scores come
from the piece table. The path is that of the library's unigram model over the same table; a file
trained by merges has an order of merges besides, which a sum of scores does not follow (README).

Decoding looks ids up in one broadcast array and joins their bytes; it is exact for every text
without the marker character itself, which reads as a space.

Defined cases: null and empty texts have no ids and decode to the empty string; a null id is carried along;
repeated rows give repeated rows; an empty table gives none; ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import documents, small_batches, text_of

MARK = "▁"
LONGEST = 256
BUCKET_BYTES = 16 << 20
FREQUENT = 1 << 18  # words at most that are encoded once for all buckets
SAMPLE_BYTES = 48 << 20  # of text, in which they are counted
PACKED = 16 << 20  # bytes of rows that a task packs at once
BATCH = 2 << 20  # bytes of an Arrow batch: of a task, two workers and the JVM hold some at once
LEVEL = 4  # of compression
MOST_PIECES = 1_000_000
SPREAD = 4  # partitions of words per bucket: the edges of one are sorted in memory
START = 1 << 9  # above every place in a word that is not long
EDGE = 1 << 31
PARTS = 8  # groups of words per such partition, by a hash: a bucket asks for a group in one row
WORDS = f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The vocabulary of a model file: pieces that a text can hold, their ids and scores, and the byte pieces."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: dict[int, int], unknown: int, size: int):
        if len(pieces) > MOST_PIECES:
            raise ValueError("the piece table is too large to broadcast")
        if any("\n" in p and len(p) > 1 or MARK in p.lstrip(MARK) for p, *_ in pieces):
            raise ValueError("a piece crosses the cut between words")
        self.pieces, self.byte_ids, self.unknown, self.size = pieces, byte_ids, unknown, size
        self.longest = max((len(p) for p, *_ in pieces), default=1)
        self.unknown_score = min((s for *_, s in pieces), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def known(self) -> dict[str, tuple[float, int]]:
        return {p: (score, i) for p, i, score in self.pieces}

    def path(self, word: str) -> list[int]:
        """The ids of a long word: the best score of every position, ties to the longer piece, then back along the best edges."""
        n = len(word)
        score, start, ids = array("d", [0.0]) * (n + 1), array("q", [0]) * (n + 1), array("q", [-1]) * (n + 1)
        get, unknown = self.known.get, (self.unknown_score, -1)
        for e in range(1, n + 1):
            best = None
            for s in range(max(0, e - self.longest), e):
                edge = get(word[s:e]) or (unknown if e - s == 1 else None)
                if edge and (best is None or score[s] + edge[0] > best):
                    best = score[s] + edge[0]
                    start[e], ids[e] = s, edge[1]
            score[e] = best
        out, e = [], n
        while e:
            if ids[e] >= 0:
                out.append(ids[e])
            elif len(self.byte_ids) < 256:
                out.append(self.unknown)
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[start[e]:e].encode()))
            e = start[e]
        return out[::-1]

    @classmethod
    def read(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        return cls([(model.id_to_piece(i), i, model.get_score(i)) for i in plain], byte_ids, model.unk_id(), len(every))


def _parts(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """The words of a text in order, a line's at a time: (at most one or two words as they are, words without the marker they start with)."""
    if not text:
        return
    if "  " in text or text[0] == " " or MARK in text:
        for word in re.findall(WORDS, MARK + text.replace(" ", MARK)):
            yield ([], [word[1:]]) if word[0] == MARK else ([word], [])
        return
    first, *lines = text.split("\n")
    yield [], first.split(" ")
    for line in lines:
        start, *others = line.split(" ")
        yield (["\n", start] if start else ["\n"]), others


class Numbers(dict):
    """Numbers of the words of a bucket; a long word gets a number below zero in the batch that holds it."""

    def __init__(self, mark: str, long: list[str]):
        super().__init__()
        self.mark, self.long = mark, long

    def __missing__(self, word: str) -> int:
        if len(self.mark + word) <= LONGEST:
            raise KeyError(word)
        self.long.append(self.mark + word)
        return -len(self.long)


def packed(rows: DataFrame, by: str) -> DataFrame:
    """Rows to (``by``, block): the other columns of the rows of a task with one number ``by``, as one compressed Arrow stream."""

    def run(batches):
        held, size = [], 0

        def out():
            every = pa.Table.from_batches(held)
            keys = every.column(by).to_numpy()
            order = np.argsort(keys, kind="stable")
            every, keys = every.drop_columns(by).take(order).combine_chunks(), keys[order]
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL), use_threads=False)
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, every.schema, options=options) as stream:
                    stream.write_table(every.slice(start, end - start))
                yield pa.RecordBatch.from_arrays([pa.array([keys[start]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], [by, "block"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > PACKED:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()
        held.clear()
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"{by} int, block binary")


def _unpacked(blocks: pa.ChunkedArray) -> Iterator[pa.Table]:
    options = pa.ipc.IpcReadOptions(use_threads=False)
    return (pa.ipc.open_stream(block.as_buffer(), options=options).read_all() for block in blocks)


def lattice(words: DataFrame, table: Pieces, keys: tuple[str, ...] = ()) -> DataFrame:
    """(word, …) to (word, edges, …): every piece in the word, by end and start, as one number: end, start, and the id plus one, or 0 for an unknown character.

    ``keys`` name columns that follow from the word and by which the words are dealt, so that their edges stay where they are.
    """
    rest = [c for c in words.columns if c not in ("word", *keys)]
    ends = words.select("word", *keys, *rest, F.explode(F.expr("sequence(1, length(word))")).alias("e"))
    spans = ends.select("word", *keys, *rest, "e", F.explode(F.expr(f"sequence(greatest(0, e - {table.longest}), e - 1)")).alias("s"))
    parts = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)"))
    columns = [pa.array([p for p, *_ in table.pieces], pa.string()), pa.array([i for _, i, _ in table.pieces], pa.int32())]
    rows = words.sparkSession.createDataFrame(pa.Table.from_arrays(columns, ["known", "id"]))
    # Found by a number, which is cheaper than by a text; the texts are compared besides.
    met = parts.withColumn("key", F.xxhash64("piece")).join(F.broadcast(rows.withColumn("key", F.xxhash64("known"))), "key", "left").filter("piece = known or e - s = 1")
    edge = F.expr(f"cast(e * {START} + s as bigint) * {EDGE} + if(piece <=> known, id + 1, 0)")
    # Other columns of a word ride on its first edge.
    met = met.select("word", *keys, edge.alias("edge"), *(F.when(F.col("e") == 1, F.col(c)).alias(c) for c in rest))
    return met.groupBy(*keys, "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *(F.first(c, ignorenulls=True).alias(c) for c in rest))


def best_paths(words: pa.Array, edges: pa.Array, scores: np.ndarray, byte_ids: dict[int, int], unknown: int) -> pa.Array:
    """The ids along the best path of each word; ``edges`` are ordered by end and start, ``scores`` by id, an unknown character's last."""
    flat, many = edges.flatten().to_numpy(), edges.value_lengths().to_numpy()
    places, piece = flat // EDGE, flat % EDGE - 1
    e, s = places // START, places % START
    size = e[many.cumsum() - 1].astype(np.int64)
    base = np.concatenate([[0], (size + 1).cumsum()])[:-1]
    # Edges by end, then by word, then the longer first.
    order = np.argsort(e.astype(np.uint16), kind="stable")
    own = np.repeat(base, many)[order]
    into, start, gain = own + e[order], own + s[order], scores[piece[order]]
    best, edge = np.zeros(int((size + 1).sum())), np.zeros(int((size + 1).sum()), np.int64)
    ends = np.bincount(e)[1:].cumsum()
    for a, b in zip([0, *ends], ends):
        total = best[start[a:b]] + gain[a:b]
        heads = np.flatnonzero(np.diff(into[a:b], prepend=-1))
        top = np.maximum.reduceat(total, heads)
        group = np.repeat(np.arange(len(heads)), np.diff(heads, append=b - a))
        ties = np.flatnonzero(total == top[group])
        chosen = ties[np.flatnonzero(np.diff(group[ties], prepend=-1))]
        best[into[a:b][heads]], edge[into[a:b][heads]] = top, a + chosen
    word, at, steps = np.arange(len(many)), base + size, []
    while len(word):
        took = edge[at]
        steps.append((word, took))
        at = start[took]
        more = at > base[word]
        word, at = word[more], at[more]
    word, took = (np.concatenate(x)[::-1] for x in zip(*steps))
    forth = np.argsort(word, kind="stable")
    word, took = word[forth], order[took[forth]]
    ids = piece[took]
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        letters = [words[int(w)].as_py()[int(i)] for w, i in zip(word[lost], s[took[lost]], strict=True)]
        spelled = [[byte_ids[b] for b in c.encode()] if len(byte_ids) == 256 else [unknown] for c in letters]
        times = np.ones(len(ids), np.int64)
        times[lost] = [len(x) for x in spelled]
        strange = np.repeat(ids < 0, times)
        word, ids = np.repeat(word, times), np.repeat(ids, times)
        ids[strange] = [i for x in spelled for i in x]
    ends = np.concatenate([[0], np.bincount(word, minlength=len(many)).cumsum()])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode_words(words: DataFrame, table: Pieces, keys: tuple[str, ...] = ()) -> DataFrame:
    """(word, …) of distinct, not empty words to (word, ids, …)."""
    byte_ids, unknown = table.byte_ids, table.unknown
    scores = np.full(max([table.size, *(i + 1 for _, i, _ in table.pieces)]) + 1, table.unknown_score)
    scores[[i for _, i, _ in table.pieces]] = [score for *_, score in table.pieces]

    def run(words: pa.Array, edges: pa.Array) -> pa.Array:
        return best_paths(words, edges, scores, byte_ids, unknown) if len(words) else pa.array([], pa.list_(pa.int32()))

    return lattice(words, table, keys).select("word", F.arrow_udf(run, "array<int>")("word", "edges").alias("ids"), *(c for c in words.columns if c not in ("word", *keys)))


def frequent_words(texts: DataFrame, size: int) -> DataFrame:
    """(word): the most frequent words of about ``SAMPLE_BYTES`` of the texts."""

    def count(batches):
        many: Counter = Counter()
        for text in chain.from_iterable(b.column("text").to_pylist() for b in batches):
            for as_is, others in _parts(text):
                many.update(as_is)
                many.update(MARK + m for m in others)
            if len(many) > FREQUENT:
                yield _counted(many)
                many.clear()
        yield _counted(many)

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, size // SAMPLE_BYTES))) == 0).select("text")
    counted = some.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") > 1) & (F.length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")


def _counted(many: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(many), pa.string()), pa.array(many.values(), pa.int64())], ["word", "n"])


def encode(docs: DataFrame, table: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, ids."""
    picked = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    small_batches(docs.sparkSession, size=BATCH)
    size = picked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    dealt = packed(picked.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")), "bucket").repartition("bucket").sortWithinPartitions("bucket")

    lists, parts = pa.list_(pa.int32()), PARTS * SPREAD * buckets
    found = encode_words(frequent_words(picked, size).repartition(SPREAD, "word"), table).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((table, found.cast(pa.schema([("word", pa.string()), ("ids", lists)]))))

    def ask(batches):
        plain, marked, last = set(), set(), None
        known = shared.value[1].column("word").to_pylist()
        known_plain, known_marked = frozenset(w for w in known if w[0] != MARK), frozenset(w[1:] for w in known if w[0] == MARK)
        del known

        def out():
            dealt_to = {}
            for w in chain(plain - known_plain, (MARK + m for m in marked - known_marked)):
                if len(w) <= LONGEST:
                    dealt_to.setdefault(crc32(w.encode()) % parts, []).append(w)
            # No word holds a space.
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(dealt_to), pa.int32()), pa.array(list(dealt_to), pa.int32()), pa.array(map(" ".join, dealt_to.values()), pa.string())], ["home", "part", "words"])
            plain.clear()
            marked.clear()

        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), _unpacked(batch.column("block")), strict=True):
                if bucket != last:
                    yield from out()
                    last = bucket
                for text in rows.column("text").to_pylist():
                    for as_is, others in _parts(text):
                        plain.update(as_is)
                        marked.update(others)
        yield from out()

    asked = dealt.mapInArrow(ask, "home int, part int, words string").repartition(SPREAD * buckets, "part")
    asked = asked.select("home", "part", F.explode(F.split("words", " ")).alias("word")).groupBy("part", "word").agg(F.collect_list("home").alias("homes"))
    answers = packed(encode_words(asked, table, ("part",)).select(F.explode("homes").alias("home"), "word", "ids"), "home")

    def string(texts, found):
        pieces, common = shared.value
        long: list[str] = []
        plain, marked, ids, at = Numbers("", long), Numbers(MARK, long), [], 0
        for some in chain([common], found):
            for i, w in enumerate(some.column("word").to_pylist(), at):
                if w[0] == MARK:
                    marked[w[1:]] = i
                else:
                    plain[w] = i
            at += some.num_rows
            ids.extend(c.cast(lists) for c in some.column("ids").chunks)
        ids = pa.concat_arrays(ids)
        as_is, after = plain.__getitem__, marked.__getitem__

        def numbers(text):
            out = []
            for first, others in _parts(text):
                out.extend(map(as_is, first))
                out.extend(map(after, others))
            return np.fromiter(out, np.int64, len(out))

        for batch in chain.from_iterable(t.to_batches(max_chunksize=512) for t in texts):
            rows, every = [numbers(t) for t in batch.column("text").to_pylist()], ids
            flat = np.concatenate(rows)
            if long:
                every = pa.concat_arrays([ids, pa.array([pieces.path(w) for w in long], lists)])
                flat = np.where(flat < 0, len(ids) - 1 - flat, flat)
                long.clear()
            taken = every.take(pa.array(flat))
            ends = np.concatenate([[0], taken.value_lengths().to_numpy().cumsum()])[np.cumsum([0, *map(len, rows)])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.flatten())], ["doc_id", "text", "ids"])

    def one(key, texts, found):
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(list(string(_unpacked(texts.column("block")), _unpacked(found.column("block")))))

    kind = picked.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bucket").cogroup(answers.groupBy("home")).applyInArrow(one, f"doc_id {kind}, text string, ids array<int>")


def decode(ids: str | Column, table: Pieces, spark: SparkSession | None = None) -> Column:
    """The text of an array of ids: the pieces' bytes joined in Arrow batches, so the table stays out of the plan."""
    spelled = [b""] * table.size
    for piece, i, _ in table.pieces:
        spelled[i] = piece.encode()
    for byte, i in table.byte_ids.items():
        spelled[i] = bytes([byte])
    sent = (spark or SparkSession.getActiveSession()).sparkContext.broadcast(pa.array([*(b.replace(MARK.encode(), b" ") for b in spelled), b""], pa.large_binary()))

    def run(every: pa.Array) -> pa.Array:
        known = sent.value
        ids = every.flatten().fill_null(-1).to_numpy()
        ends = np.concatenate([[0], every.value_lengths().fill_null(0).to_numpy().cumsum()])
        parts = known.take(pa.array(np.where((ids < 0) | (ids >= len(known)), len(known) - 1, ids)))
        # The pieces lie one after the other, so a text is all bytes between two of them.
        _, cuts, data = parts.buffers()
        cuts = np.frombuffer(cuts, np.int64)[parts.offset:][ends] if len(parts) else np.zeros(len(ends), np.int64)
        texts = pa.Array.from_buffers(pa.large_binary(), len(every), [None, pa.py_buffer(cuts.tobytes()), data])
        try:
            texts = texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.large_string())
        texts = pc.replace_substring(texts, MARK, " ")  # one that was spelled in bytes
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        return pc.if_else(every.is_valid(), texts, None).cast(pa.string())

    return F.arrow_udf(run, "string")(F.col(ids) if isinstance(ids, str) else ids)


def default_table() -> Pieces:
    """The vocabulary file of the machine; the path is a parameter of :meth:`Pieces.read`."""
    import public_tokenizers

    return Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))


def encoded(docs: DataFrame, table: Pieces | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back."""
    table = table or default_table()
    return encode(docs, table).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (decode("ids", table) == F.col("text")).alias("restored"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


QUERIES = {"op4_sentence_pieces": op4_sentence_pieces}
ORACLES: dict[str, str] = {}
