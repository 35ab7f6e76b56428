"""Byte-pair encoding against the tokenizers library and against merging by hand."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetgrade.llm import bpe


@pytest.fixture(scope="module")
def table():
    return bpe.default_table()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def texts():
    rng = random.Random(3)
    bits = ["a", "b", "e", "t", "h", "in", "er", " ", "  ", "\n", "1", "23", "'s", "'RE", "'re", "é", "你", "𝔘", "<|endoftext|>", "<|endof", "--", "==", "\t", " ", "\x1c", " ", "ſ"]
    yield from ["", " ", "a", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|> "]
    yield from ("".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500))
    yield from ("".join(rng.choice("theanis ") for _ in range(200)) for _ in range(200))
    yield from (unit * n for unit in ("a", "ab", " ", "\n ", "0") for n in (*range(40), 3000))
    yield "".join(rng.choice("abcdeht") for _ in range(30_000))


def test_ids_and_texts_are_the_library_s(spark, table, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 1000)
    every = list(texts())
    got = bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), table), table).collect()
    want = library.encode_batch(every, add_special_tokens=False)
    for r in got:
        assert ids(r.ids) == want[r.doc_id].ids and r.n_tokens == len(want[r.doc_id].ids)
        assert r.text == library.decode(want[r.doc_id].ids, skip_special_tokens=False)


def test_every_code_point(table, library):
    machine = bpe.Machine(table)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = ["".join(f"x{p}1 {p}{p}  {p}\n" for p in points[i:i + 500]) for i in range(0, len(points), 500)]
    assert all(ids(machine.text(t)) == w.ids for t, w in zip(every, library.encode_batch(every, add_special_tokens=False), strict=True))


def _merged(word, merges):
    """Merge by merge: the lowest rank, leftmost, until nothing merges."""
    parts = list(word)
    while True:
        best = min(((merges[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in merges), default=None)
        if best is None:
            return parts
        parts[best[1]:best[1] + 2] = [best[0][1]]


def test_random_tables_against_merging(spark):
    rng = random.Random(11)
    for _ in range(60):
        spelled = {i: bytes([97 + i]) for i in range(3)}
        merges = []
        while len(spelled) < 14:
            a, b = rng.choice(list(spelled)), rng.choice(list(spelled))
            if spelled[a] + spelled[b] not in spelled.values():
                merges.append((a, b, len(spelled)))
                spelled[len(spelled)] = spelled[a] + spelled[b]
        machine, by_pair = bpe.Machine(bpe.Table(spelled, merges, {})), {(a, b): (i, t) for i, (a, b, t) in enumerate(merges)}
        for length in range(8):
            for word in itertools.product(range(3), repeat=length):
                assert machine.word(bytes(97 + w for w in word)) == _merged(word, by_pair)


def test_edges(spark, table):
    rows = [(1, None, "a", 1), (None, "x y", None, None), (2, "", "b", 2), (2, "Hello  world", "b", 2), (2, "Hello  world", "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(df, table), table)
    assert sorted(((r.doc_id, r.n_tokens, r.text) for r in got.collect()), key=repr) == sorted([(1, 0, ""), (None, 2, "x y"), (2, 0, ""), (2, 3, "Hello  world"), (2, 3, "Hello  world")], key=repr)
    assert bpe.encode(df.limit(0), table).collect() == []
    odd = spark.createDataFrame([(1, 2, np.array([256, 999_999, 187], "<u4").tobytes()), (2, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert sorted(r.text for r in bpe.decode(odd, table).collect()) == ["", " t�"]


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = bpe.op13_bpe(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        want = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.Table.read(public_tokenizers.path("word_bpe_49k.json"))
