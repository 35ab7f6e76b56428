"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is cut into added tokens and words by the pattern of the tokenizer file; merges never cross
such a cut. Within a word the encoding is not built merge by merge. Three facts make it one pass:

1. *Matches.* An automaton over the tokens, read forwards, gives at every byte all tokens that end there, longest first.
2. *Pairs.* Two neighbouring tokens are compatible if encoding their joined bytes gives the two back. Going back in the order of
   merges from both sides of the border, the pair is incompatible when a merge across it comes before the merge that
   takes one of its sides away. The answer is kept per pair.
3. *Prefixes.* A sequence of tokens is the encoding of its bytes exactly if its neighbours are compatible. So every prefix
   has one last token: the match whose predecessor, the last token of the shorter prefix, is compatible with it.

The last tokens of all prefixes are stored and followed back from the end. Time is linear in the length of a word,
however long. Words met lately keep their ids; the memory of all caches is bounded and only saves time.

Ids are unsigned 32-bit numbers, little-endian, in one binary value per document. Decoding joins the bytes of the tokens.
Bytes that are no UTF-8 read as U+FFFD, ids outside the table as nothing.

Defined cases: null and empty texts have no ids and decode to the empty string; a null id is carried along; repeated
rows give repeated rows; an empty table gives none; other columns are not read. Very long texts are cut
into words a piece at a time, so only their ids are held whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import documents, rows_of, small_batches, text_of

# Fixed value: how byte-level tokenizers of this format cut words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 20
MEMO = 1 << 20
MOST_TOKENS = 1_000_000
NEVER = 1 << 40
_words = regex.compile(PATTERN)
# The last space of a run begins a word of its own, whatever stands before it: a text can be cut there.
_border = re.compile(r" (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level file: itself if printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """A tokenizer file: bytes of every token, merges in their order, added tokens."""

    def __init__(self, spelled: dict[int, bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        if len(spelled) > MOST_TOKENS:
            raise ValueError("the token table is too large to broadcast")
        self.spelled, self.merges, self.added = spelled, merges, added
        self.key = hashlib.sha256(repr((sorted(spelled.items()), merges, sorted(added.items()))).encode()).hexdigest()

    @classmethod
    def read(cls, path: str) -> Table:
        """A file of the tokenizers library that holds a byte-level BPE with the usual word pattern."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or whole["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        letters, ids = byte_letters(), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        spelled = {i: bytes(letters[c] for c in word) for word, i in ids.items() if word not in added}
        return cls(spelled | {i: c.encode() for c, i in added.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in merges], added)


class _Memo(dict):
    """Packed ids of the pieces or words met lately; long ones are not kept."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        found = self.encode(piece)
        if len(piece) < 64:
            self[piece] = found
        return found


class Machine:
    """What a task needs to encode: automaton of the tokens, parts of every token, merges by pair."""

    def __init__(self, table: Table):
        added = set(table.added.values())
        self.merge = {(a, b): (i, t) for i, (a, b, t) in reversed([*enumerate(table.merges)])}
        self.rank = {t: -1 for t in table.spelled}
        self.left, self.right = {}, {}
        for a, b, t in reversed(table.merges):
            rank = self.merge[a, b][0]
            self.rank[t], self.left[t], self.right[t] = rank, a, b
        self.size = {t: len(s) for t, s in table.spelled.items()}
        whole = {t: s for t, s in table.spelled.items() if t not in added and (len(s) == 1 or t in self.left and self.stands(t))}
        self._automaton(whole)
        self.pairs: list[dict] = [{} for _ in range(max(self.rank, default=-1) + 1)]
        self.words, self.pieces = _Memo(self._word), _Memo(self._piece)
        self.added = table.added
        by_length = sorted(table.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None

    def _automaton(self, tokens: dict[int, bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        own: list[tuple] = [()]
        for t, spelled in tokens.items():
            state = 0
            for byte in spelled:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    own.append(())
                state = children[state][byte]
            own[state] = (t,)
        fall, order = [0] * len(children), [0]
        for state in order:
            for byte, child in children[state].items():
                if state:
                    back = fall[state]
                    while back and byte not in children[back]:
                        back = fall[back]
                    fall[child] = children[back].get(byte, 0)
                    own[child] += own[fall[child]]
                order.append(child)
        self.ends = [tuple((t, self.size[t]) for t in ts) for ts in own]
        self.steps, self.fall = children, fall

    def _step(self, state: int, byte: int) -> int:
        """The state after a byte, along the fall-back links; kept beside the children."""
        back = state
        while back and byte not in self.steps[back]:
            back = self.fall[back]
        found = self.steps[state][byte] = self.steps[back].get(byte, 0)
        return found

    def compatible(self, a: int, b: int, until_a: int = NEVER, until_b: int = NEVER) -> bool:
        """Whether no merge crosses the border of a and b before what they are part of from these ranks on is made.

        Of equal merges the one further left comes first: a merge across the border comes after one of
        the same rank inside a, and before one of the same rank inside b.
        """
        rank, merge = self.rank, self.merge
        while True:
            across = merge.get((a, b))
            if across and across[0] < until_a and across[0] <= until_b:
                return False
            if rank[a] > rank[b]:
                until_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                until_b, b = rank[b], self.left[b]
            else:
                return True

    def stands(self, token: int) -> bool:
        """Whether the bytes of a token encode to the token itself."""
        todo = [token]
        while todo:
            t = todo.pop()
            if self.rank[t] >= 0:
                if not self.compatible(self.left[t], self.right[t], self.rank[t], self.rank[t] - 1):
                    return False
                todo += self.left[t], self.right[t]
        return True

    def word(self, word: bytes) -> list[int]:
        """Ids of one word: the last token of every prefix, then back from the end."""
        steps, ends, pairs = self.steps, self.ends, self.pairs
        last, state, at = [(-1, 0)], 0, 0
        for byte in word:
            at += 1
            after = steps[state].get(byte)
            state = self._step(state, byte) if after is None else after
            for match in ends[state]:
                before = last[at - match[1]][0]
                if before < 0:
                    break
                fits = pairs[before].get(match[0])
                if fits is None:
                    fits = pairs[before][match[0]] = self.compatible(before, match[0])
                if fits:
                    break
            else:
                raise ValueError("a byte of the text is in no token")
            last.append(match)
        ids = []
        while at:
            ids.append(last[at][0])
            at -= last[at][1]
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        return np.array(self.word(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece and the space before it."""
        if piece.isascii() and piece.isalpha():
            return self._word(" " + piece)
        return b"".join(map(self.words.__getitem__, _words.findall(" " + piece)))

    def _plain(self, text: str) -> Iterator[bytes]:
        start = 0
        while start < len(text):
            border = _border.search(text, start + PIECE) if start + PIECE < len(text) else None
            end = border.start() if border else len(text)
            first, *rest = _border.split(text if end - start == len(text) else text[start:end])
            yield b"".join(map(self.words.__getitem__, _words.findall(first)))
            yield b"".join(map(self.pieces.__getitem__, rest))
            start = end

    def text(self, text: str) -> bytes:
        """Packed ids of a text; added tokens in it count as such."""
        if not self.cut or not any(a in text for a in self.added):
            return b"".join(self._plain(text))
        parts = self.cut.split(text)
        return b"".join(self.added[p].to_bytes(4, "little") if i % 2 else b"".join(self._plain(p)) for i, p in enumerate(parts))


class Speller:
    """Bytes of ids."""

    def __init__(self, table: Table):
        most = max(table.spelled, default=-1) + 1
        self.spelled = [table.spelled.get(i, b"") for i in range(most)]

    def text(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        inside = numbers[numbers < len(self.spelled)].tolist()
        return b"".join(map(self.spelled.__getitem__, inside)).decode("utf-8", "replace")


_made: dict = {}


def _of(kind: type, table: Table):
    """One machine per table and worker, kept between tasks."""
    if (kind, table.key) not in _made:
        _made.clear() if len(_made) > 4 else None
        _made[kind, table.key] = kind(table)
    return _made[kind, table.key]


def encode(docs: DataFrame, table: Table, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        machine = _of(Machine, sent.value)
        for batch in batches:
            ids = [machine.text(text) for (text,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, table: Table) -> DataFrame:
    """Adds ``text`` to the rows of :func:`encode`."""
    sent = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        speller = _of(Speller, sent.value)
        for batch in batches:
            texts = [speller.text(ids or b"") for (ids,) in rows_of([batch], "ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def default_table() -> Table:
    import public_tokenizers

    return Table.read(public_tokenizers.path("byte_bpe_50k.json"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = default_table()
    both = decode(encode(documents(spark, sf_dir), table), table)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op13_bpe": op13_bpe}
ORACLES: dict[str, str] = {}
