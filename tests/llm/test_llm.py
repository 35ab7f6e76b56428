"""Small cases of the llm operators against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetgrade.llm import components, exact_dedup, jaccard, line_templates, masked_lm, mixing, personal, pieces, quality, toxicity, vectors

TEXTS = [
    "alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", "Alpha beta", "", None, " ", "one", "été\n你好 𝔘 x", "a b c d e f g h " * 500,
    "a b c d e f g h " * 500, "a b c d e f g h " * 499 + "z", "x" * 3000,
]
CLASH = "kept boolean, keep_id string, group_size string, size long, target string, taken string, score string, n_links string, s string, __text string, __size string, __bin string, __copy string, __source string, __quality string, __gone string, __id string, __h string, __row string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(TEXTS)]
    rows += [(None, "alpha beta gamma delta epsilon zeta", "en", "src0", 3), (0, TEXTS[0], "en", "src0", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def is_set(df):
    assert df.collect() == []


# 1. exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda t: F.lit(b"same"), lambda t: F.unhex(F.substring(F.md5(t), 1, 1).cast("string"))])
def test_exact_dedup(docs, clashing, keep, digest):
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    pick = min if keep == "smallest" else max
    want = []
    for text, ids in groups.items():
        best = pick((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact_dedup.mark_copies(clashing, keep, digest=digest)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    left = exact_dedup.drop_copies(clashing, keep, digest=digest)
    assert left.columns == clashing.columns
    assert sorted((r.text or "", r.doc_id) for r in left.collect()) == sorted((t, pick(i for i in ids if i is not None)) for t, ids in groups.items())
    is_set(exact_dedup.mark_copies(docs.limit(0), keep))
    is_set(exact_dedup.drop_copies(docs.limit(0), keep))


def test_exact_dedup_null_id_only(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert rows(exact_dedup.mark_copies(df), "keep_id", "group_size", "kept") == [(None, 1, True), (None, 2, True), (None, 2, True)]
    assert exact_dedup.drop_copies(df).count() == 2


# 2. quality


def test_factorisation_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    n = quality.WORD_BUCKETS + len(quality.STATS)
    m = quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 8)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    at, value = quality.features("some words and Some more words!! 42", 30)
    x = m.scaled(at, value)
    pairs = sum(m.factor[i] @ m.factor[j] * a * b for (i, a), (j, b) in itertools.combinations(zip(at, x), 2))
    assert math.isclose(m.raw(at, x), m.bias + m.weight[at] @ x + pairs, rel_tol=1e-9)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95


def test_quality_edges(docs, clashing, labels):
    model = quality.train(docs, labels)
    got = quality.score(clashing, model)
    assert got.count() == docs.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert set(quality.keep_good(clashing, model, 0.0).columns) == set(clashing.columns)
    empty = quality.train(docs, labels.limit(0))
    assert abs(empty.score("anything", None) - 0.5) < 1e-9
    is_set(quality.score(docs.limit(0), model))
    one = quality.train(docs, labels.filter("quality = 1"))
    assert one.score("", None) > 0.9


# 3. embeddings


def _brute_vectors(items, cosine=0.9):
    ok = {i: np.array(v, float) for i, v in items if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    link = {i: set() for i, _ in items}
    for a, b in itertools.combinations(ok, 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine:
            link[a].add(b), link[b].add(a)
    return {i: (len(link[i]), _least(i, link)) for i, _ in items}


def _least(i, link):
    seen, todo = {i}, [i]
    while todo:
        for j in link[todo.pop()] - seen:
            seen.add(j), todo.append(j)
    return min(seen)


def test_vectors_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    items = [(i, (base[i % 60] / np.linalg.norm(base[i % 60]) + rng.normal(size=32) * 0.057).tolist()) for i in range(600)]
    items += [(600 + i, items[i][1]) for i in range(0, 60, 3)]
    want = _brute_vectors(items)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(items, "vec_id long, embedding array<double>")).collect()}
    found, all_ = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and all_ > 1000
    assert found >= 0.99 * all_
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)


def test_vectors_large_bucket_and_edges(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    items = [(i, (np.eye(8)[0] + rng.normal(size=8) * 0.01).tolist()) for i in range(100)] + [(100 + i, [0.0] * 8) for i in range(2)]
    items += [(110, None), (111, []), (112, [1.0, None] + [0.0] * 6), (113, [float("nan")] + [0.0] * 7), (114, [2.0] + [0.0] * 7), (115, [1.0, 0.0]), (116, [-1.0] + [0.0] * 7)]
    df = spark.createDataFrame(items, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == _brute_vectors(items)
    is_set(vectors.near_vectors(df.limit(0)))
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<double>")).collect()] == [(None, 0, None, True)]


# 4. pieces


@pytest.fixture(scope="module")
def unigram():
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # single precision cannot hold scores of minus 1e9 beside others
        p.score = max(p.score, -40000.0)
    t = pieces.default_table()
    table = pieces.Pieces([(a, i, max(s, -40000.0)) for a, i, s in t.pieces], t.byte_ids, t.unknown, t.size)
    return table, sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_pieces_match_the_library_and_round_trip(spark, docs, clashing, unigram):
    table, library = unigram
    df = clashing.filter("length(text) < 2000 or text is null").select("doc_id", "text", "s").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).select(F.col("doc_id") + 100, "text", F.lit("").alias("s")).toDF("doc_id", "text", "s"))
    got = rows(pieces.encode(df, table).select("text", "ids", pieces.decode("ids", table).alias("back")))
    assert len(got) == df.count()
    for text, ids, back in got:
        assert ids == library.encode(text) and back == text
    is_set(pieces.encoded(docs.limit(0), table))


def test_pieces_long_runs_come_back(spark, unigram):
    df = spark.createDataFrame([(1, "x" * 5000), (2, " " * 700), (3, "\x00\x07é" * 400), (None, "ab")], "doc_id long, text string")
    assert all(r.restored for r in pieces.encoded(df, unigram[0]).collect())


def test_pieces_long_runs_match_the_library(spark, unigram):
    table, library = unigram
    rng = random.Random(4)
    runs = ["x" * 3000, " " * 700 + "ab", "".join(rng.choices("etaoinshr", k=3000)), "".join(rng.choices("的一是不了人我在有他", k=3000)), "see " + "".join(rng.choices("aeinr0123+/", k=1500)) + " end\n" + "\x07é𝔘" * 200,
            "".join(rng.choices("eatn", k=256)), "".join(rng.choices("eatn", k=257))]
    got = rows(pieces.encode(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), table).select("doc_id", "ids", pieces.decode("ids", table).alias("back")))
    assert [back for *_, back in got] == runs
    for i, ids, _ in got:
        assert ids == library.encode(runs[i]), i


def test_pieces_travel_compressed_and_by_both_ways(spark, unigram, monkeypatch):
    """Frequent words have their answers sent to all tasks, others in blocks of their bucket; texts take less than half their bytes on the way."""
    table, library = unigram
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(pieces, "FREQUENT", 5)
    rng = random.Random(9)
    letters = ["a", "e", "n", "t", "é", "𝔘", ".", "-", "\n", " ", "  ", "▁", "\x00"]
    texts = ["".join(rng.choices(letters, [9, 9, 9, 9, 1, 1, 1, 1, 1, 9, 1, 0, 1], k=rng.randint(0, 400))) for _ in range(60)] + ["", None, " a", "a ", "\n", " \n b", "a\n b", "the the the", "the the the"]
    df = spark.createDataFrame([(i % 50 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert 0 < pieces.frequent_words(df.filter("text is not null"), 1).count() <= 5
    got = sorted(((r.text, r.ids, r.back) for r in pieces.encode(df, table).select("text", "ids", pieces.decode("ids", table).alias("back")).collect()), key=repr)
    assert got == sorted(((t or "", library.encode(t or ""), t or "") for t in texts), key=repr)
    long = spark.range(400).select((F.col("id") % 2).cast("int").alias("b"), F.concat_ws(" ", *[F.concat(F.lit("word "), F.col("id") * i) for i in range(30)]).alias("text")).coalesce(1)
    blocks = pieces.packed(long, "b").collect()
    assert sorted(r.b for r in blocks) == [0, 1] and 2 * sum(len(r.block) for r in blocks) < sum(len(r.text) for r in long.collect())


def test_pieces_kernel_takes_the_same_path(unigram):
    """The fold over all words of a batch against the recurrence word by word, ties included."""
    scored = [("a", 3, -1.0), ("b", 4, -1.0), ("ab", 5, -2.0), ("aba", 6, -3.0), ("bab", 7, -2.5)]
    rng = random.Random(2)
    words = ["".join(rng.choices("abéx", [5, 5, 1, 1], k=rng.randint(1, 30))) for _ in range(300)]
    for byte_ids in ({}, {b: 100 + b for b in range(256)}):
        table = pieces.Pieces(scored, byte_ids, 1, 400)
        scores = np.full(401, table.unknown_score)
        scores[[3, 4, 5, 6, 7]] = [x for *_, x in scored]
        edges = [[(e * pieces.START + s) * pieces.EDGE + (table.known[w[s:e]][1] + 1 if w[s:e] in table.known else 0) for e in range(1, len(w) + 1) for s in range(max(0, e - 3), e) if w[s:e] in table.known or e - s == 1] for w in words]
        assert pieces.best_paths(pa.array(words), pa.array(edges, pa.list_(pa.int64())), scores, byte_ids, 1).to_pylist() == [table.path(w) for w in words]


# 5. toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs_, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.train(docs_, marks.filter("doc_id % 4 > 0"))
    scored = {r.doc_id: r.toxic for r in toxicity.score(docs_.filter("doc_id % 4 = 0"), chain).collect()}
    truth = {r.doc_id: r.toxic for r in marks.filter("doc_id % 4 = 0").collect()}
    hit = [(scored[i] >= chain[3], y == 1) for i, y in truth.items()]
    assert sum(a and b for a, b in hit) >= 0.8 * sum(b for _, b in hit)
    assert sum(a and not b for a, b in hit) <= 0.02 * len(hit)


def test_toxicity_edges(docs, clashing, labels):
    chain = toxicity.train(docs, labels)
    got = toxicity.score(clashing, chain).collect()
    assert len(got) == docs.count() and all(0 <= p <= 1 for r in got for p in r[1:])
    none = toxicity.train(docs, labels.limit(0))
    assert max(r.toxic for r in toxicity.score(docs, none).collect()) < 0.5
    is_set(toxicity.score(docs.limit(0), chain))


# 6. mixing


def _sql(name, module, df, **tables):
    con = duckdb.connect()
    for t, frame in {"documents": df, **tables}.items():
        con.register(t, frame.toArrow())
    return sorted(map(repr, con.execute(module.ORACLES[name]).fetchall()))


def test_mixing_matches_sql(docs, clashing):
    df = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = mixing.mix(df)
    assert sorted(map(repr, map(tuple, got.select("doc_id", "size", "source_size", "target", "taken").collect()))) == _sql("op6_mixing", mixing, df)
    everything = mixing.mix(clashing).collect()
    assert len(everything) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in everything)
    taken = mixing.take_mix(clashing)
    assert taken.columns == clashing.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in taken.collect()) == sum(r.taken for r in everything)
    is_set(mixing.mix(docs.limit(0)))
    is_set(mixing.take_mix(docs.limit(0)))
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(docs.filter("text is null or trim(text) = ''")).collect())


def test_mixing_targets(spark):
    for sizes in ([100, 100, 100], [1, 1000, 5, 0, 70], [10], [3, 3, 3, 3, 900]):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
        w, full = [i % 3 + 1 for i in range(len(sizes))], set()
        while True:
            level = (sum(sizes) - sum(3 * sizes[i] for i in full)) / max(sum(w[i] for i in range(len(sizes)) if i not in full), 1e-9)
            more = {i for i in range(len(sizes)) if i not in full and level * w[i] > 3 * sizes[i]}
            if not more:
                break
            full |= more
        want = [3 * sizes[i] if i in full else level * w[i] for i in range(len(sizes))]
        assert np.allclose(got, want)


# 7. masked language model


def test_masked_lm_is_a_distribution_and_learns():
    p = masked_lm.fresh()
    context = np.array([[5, 9, masked_lm.VOCABULARY, 70]] * masked_lm.VOCABULARY)
    target = np.arange(masked_lm.VOCABULARY)
    assert math.isclose(np.exp(masked_lm.log_probabilities(p, context, target)).sum(), 1, rel_tol=1e-4)
    rng = np.random.default_rng(0)
    text = np.tile(rng.permutation(50), 400).astype(np.int32)
    seen = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    before = masked_lm.log_probabilities(p, masked_lm.contexts(text), text).mean()
    for _ in range(30):
        masked_lm.learn(p, seen, masked_lm.contexts(text), text)
    after = masked_lm.log_probabilities(p, masked_lm.contexts(text), text).mean()
    mixed = rng.permutation(text)
    assert after > before + 3 and after > masked_lm.log_probabilities(p, masked_lm.contexts(mixed), mixed).mean() + 1


def test_masked_lm_tokens_are_looked_up_once():
    class Watched(masked_lm.Tokens):
        asked = 0

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

    rng = random.Random(6)
    words = ["the", "of", "été", "𝔘", "x", "other", "an\x00"] + ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(300)]
    for first in (0, masked_lm.TAILS):
        tokens = Watched({w: first + i for i, w in enumerate(words[:40])})
        text = "  ".join(rng.choices(words, k=900)) + "\nThe OF"
        assert tokens.of(text).tolist() == [tokens[w] for w in text.lower().split()] and tokens.asked == 0
        assert tokens.of("").tolist() == []


def test_masked_lm_gradient():
    p = {k: v.astype(np.float64) for k, v in masked_lm.fresh(2).items()}
    context, target = np.array([[1, 2, 3, 4], [4, 3, 2, 1], [1, 1, 1, 1]]), np.array([7, 300, 7])
    new = {k: v.copy() for k, v in p.items()}
    seen = {k: np.full_like(v, 1e12) for k, v in p.items()}
    masked_lm.learn(new, seen, context, target, rate=1e6)  # the step is the gradient
    loss = lambda q: -masked_lm.log_probabilities(q, context, target).mean()
    for name, at in (("places", (0, 1, 3)), ("hidden", (5,)), ("class_w", (2, 7)), ("class_b", (7,)), ("word_w", (7, 4, 0)), ("word_b", (12, 9))):
        up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert math.isclose((p[name][at] - new[name][at]), (loss(up) - loss(down)) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


def test_masked_lm_scores_against_brute_force(docs, clashing):
    words = masked_lm.vocabulary(docs)
    p = masked_lm.train(docs, words, 2)
    got = masked_lm.score(clashing, words, p)
    tokens = masked_lm.Tokens(words)
    for r in got.join(docs.filter("doc_id > 0").select("doc_id", "text"), "doc_id").collect():
        t = (r.text or "").lower().split()
        ids = [tokens[w] for w in t]
        assert r.n_tokens == len(t)
        total = 0.0
        for i, x in enumerate(ids[:40] if len(ids) <= 40 else []):
            around = [ids[i + q] if 0 <= i + q < len(ids) else masked_lm.VOCABULARY for q in masked_lm.PLACES]
            total += masked_lm.log_probabilities(p, np.array([around]), np.array([x]))[0]
        if len(ids) <= 40:
            assert math.isclose(r.log_likelihood, total, rel_tol=1e-3, abs_tol=1e-4)
    assert got.count() == docs.count()
    is_set(masked_lm.pseudo_likelihood(docs.limit(0)))


def test_masked_lm_gives_every_word_its_own_probability(spark):
    counted = collections.Counter({f"common{i}": 12 for i in range(960)} | {f"often{i}": 9 for i in range(40)} | {f"rare{i}": 1 for i in range(500)} | {"é": 1, "ab": 2, "你好吗呀": 3})
    texts = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counted.items())] + [(None, None), (5000, ""), (5000, "")]
    texts += [(6001, "common1 often7 common2"), (6002, "common1 often7 common2"), (6002, "common1 often7 common2")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("w", F.lit(1))
    counted.update("common1 often7 common2".split() * 3)
    table = masked_lm.counts(df)
    assert {r.w: r.n for r in table.collect()} == counted
    words = masked_lm.most_frequent(table)
    share = {r.w: r.share for r in masked_lm.shares(table, words).collect()}
    assert share.keys() | words.keys() == counted.keys() and not share.keys() & words.keys()
    tokens = masked_lm.Tokens(words)
    inside = collections.Counter()
    for w, x in share.items():
        inside[tokens[w]] += math.exp(x)
        assert math.isclose(x, math.log(counted[w] / sum(n for o, n in counted.items() if o not in words and tokens[o] == tokens[w])), rel_tol=1e-9, abs_tol=1e-12)
    assert all(math.isclose(x, 1, rel_tol=1e-9) for x in inside.values())
    p = masked_lm.train(df, words, 2)
    text_of = dict(texts)
    plain = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood + sum(share.get(w, 0) for w in (text_of[r.doc_id] or "").split())) for r in masked_lm.score(df, words, p).collect())
    for buckets in (1, 7):
        got = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in masked_lm.score_words(df, words, p, masked_lm.shares(table, words), buckets).collect())
        assert [r[:2] for r in got] == [r[:2] for r in plain]
        assert np.allclose([r[2] for r in got], [r[2] for r in plain], rtol=1e-4, atol=1e-4)
    of = {r.doc_id: r.log_likelihood for r in masked_lm.pseudo_likelihood(df).collect()}
    one = next(i for i, t in texts if t and t.startswith("often3") and tokens["often3"] == tokens[t.split()[0]])
    assert of[one] / 9 > min(of[i] for i, t in texts if t and t.startswith("rare"))


def test_masked_lm_products_stay_on_one_thread():
    """A batch's gradient is that of its rows one by one, and its products wake no other thread."""
    rng = np.random.default_rng(3)
    p = masked_lm.fresh(1)
    context, target = rng.integers(0, masked_lm.VOCABULARY + 1, (masked_lm.BATCH, 4)).astype(np.int32), rng.integers(0, 90, masked_lm.BATCH).astype(np.int32)
    exact = {k: v.astype(np.float64) for k, v in p.items()}
    h = np.tanh(sum(exact["places"][i][context[:, i]] for i in range(4)) + exact["hidden"])
    classes, word = target % masked_lm.CLASSES, target // masked_lm.CLASSES
    one, two = h @ exact["class_w"] + exact["class_b"], np.einsum("nw,nwk->nk", h, exact["word_w"][classes]) + exact["word_b"][classes]
    rows = np.arange(len(target))
    want = sum(x[rows, at] - np.log(np.exp(x).sum(1)) for x, at in ((one, classes), (two, word)))
    assert np.allclose(masked_lm.log_probabilities(p, context, target), want, atol=1e-4)
    soft = np.exp(one) / np.exp(one).sum(1, keepdims=True)
    soft[rows, classes] -= 1
    new, seen = {k: v.copy() for k, v in p.items()}, {k: np.full_like(v, 1e12) for k, v in p.items()}
    masked_lm.learn(new, seen, context, target, rate=1e9)  # the step is a thousand times the gradient
    assert np.allclose((p["class_w"] - new["class_w"]) / 1e3, h.T @ soft / len(target), atol=1e-5)
    largest = [x.stop - x.start for x in masked_lm._blocks(0, masked_lm.BATCH)]
    assert sum(largest) == masked_lm.BATCH and max(largest) * masked_lm.WIDTH * masked_lm.CLASSES <= 1 << 18


# 8. personal data


def _base_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and personal.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_personal_spans_against_plain_patterns(spark):
    rng = random.Random(1)
    parts = ["a.b+c@x-y.co.uk", "a@b", "@b.c", "x@y.z%w@v.u", "1.2.3.4", "256.1.1.1", "0001.02.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1 2", "é", "你", " ", "\n", "..", "12", "GB82 WEST 1234 5698 7654 32", "ssn 219-09-9999", "0" * 5000]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", None]
    got = personal.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit(1))).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in personal.BASE] == _base_spans(text)
        assert all(text[s.start:s.end] == s.found for s in r.spans)


def test_personal_checksums_and_context():
    assert personal.mod97("GB82 WEST 1234 5698 7654 32") and not personal.mod97("GB82 WEST 1234 5698 7654 33")
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    kinds = lambda t: [s[0] for s in personal.find_spans(t)]
    assert kinds("219-09-9999") == [] and kinds("SSN: 219-09-9999") == ["ssn"] and "iban" in kinds("GB82WEST12345698765432")
    near, far = personal.find_spans("card 4111 1111 1111 1111"), personal.find_spans("4111 1111 1111 1111")
    assert near[0][3] > far[0][3]


def test_personal_query_columns(spark):
    got = personal.op8_personal_data(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got.collect():
        base = _base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in personal.BASE)
    empty = spark.createDataFrame([], "doc_id long, text string")
    is_set(personal.personal_spans(empty))


# 9. Jaccard join


def _brute_jaccard(items, n, percent):
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    sets = {i: grams(t) for i, t in items}
    link = {i: {j for j in sets if j != i and s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j])} for i, s in sets.items()}
    return {i: (len(s), _least(i, link)) for i, s in sets.items()}


def _mutants(rng, count, words=60):
    pool = [f"w{i}" for i in range(400)]
    passage = [rng.choice(pool) for _ in range(55)]
    seeds = [[rng.choice(pool) for _ in range(rng.randint(3, words))] for _ in range(12)]
    out = []
    for _ in range(count):
        t = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(pool)
        if rng.random() < 0.3:
            t += passage
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("n, percent, block, spread, hot", [(4, 85, 256, 4096, 1 << 20), (5, 80, 3, 7, 50), (3, 60, 2, 5, 0)])
def test_jaccard_against_brute_force(spark, monkeypatch, n, percent, block, spread, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SPREAD", spread)
    items = list(enumerate(_mutants(random.Random(n), 300) + ["", None, "one", "ONE", "a b c d e f", "É a", "é a"]))
    df = spark.createDataFrame(items, "doc_id long, text string").withColumn("set_id", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, percent, hot=hot).collect()}
    assert got == _brute_jaccard(items, n, percent)


def test_clashing_columns_come_back(docs, clashing, labels):
    kept = clashing.withColumn("__size", F.lit("own")).withColumn("__source", F.lit("mine")).withColumn("__quality", F.col("doc_id"))
    for out in (mixing.take_mix(kept), jaccard.drop_near_copies(kept), quality.keep_good(kept, quality.train(docs, labels), 0.0)):
        assert out.columns == kept.columns
        assert all((r["__size"], r["__source"], r["__quality"]) == ("own", "mine", r.doc_id) for r in out.collect())


def test_jaccard_edges(docs, clashing):
    got = jaccard.jaccard_components(clashing).collect()
    assert len(got) == docs.count() and all((r.doc_id is None) == (r.component_id is None) for r in got)
    left = jaccard.drop_near_copies(clashing)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} >= {0, 2, 3, 4, 5, 6, 7, 8, 11, None}
    is_set(jaccard.jaccard_components(docs.limit(0)))
    is_set(jaccard.drop_near_copies(docs.limit(0)))


def test_near_copies_leave_other_texts_of_an_id(spark):
    a = " ".join(f"word{i}" for i in range(40))
    b, c = "another text that nothing else comes near to at all", a + " end"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (4, None), (4, b)], "doc_id long, text string")
    assert rows(jaccard.drop_near_copies(df)) == rows(spark.createDataFrame([(1, a), (2, b), (4, None)], df.schema))
    # One id with two texts of one group: one of them stays.
    assert jaccard.drop_near_copies(spark.createDataFrame([(7, a), (7, c), (8, a)], df.schema)).count() == 1


def test_sub_lists_skip_only_what_cannot_match():
    rng = np.random.default_rng(0)
    for _ in range(200):
        m = rng.integers(3, 12)
        size = rng.integers(5, 40, m)
        at = np.array([rng.integers(0, s) for s in size])
        part = jaccard.sub_lists(size, at, 80)
        for a, b in itertools.combinations(range(m), 2):
            if jaccard.compatible(size[a], at[a], size[b], at[b], 80) and min(size[a], size[b]) * 100 >= 80 * max(size[a], size[b]):
                assert part[a] == part[b] >= 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(60)}
    is_set(components.components(spark.createDataFrame([], "a long, b long")))


# 10. line templates


def test_line_templates_match_sql(spark, docs, clashing):
    boiler = [f"Copyright {y} by the authors of work {n} all rights reserved" for y, n in ((1999, "one"), (2001, "one"), (2002, "one"), (2003, "two"))]
    texts = [f"{w} {w} {w} {w} stays here as it is\n{b}\nshort line" for w, b in zip(("red", "green", "blue", "grey"), boiler)] + ["", None, "\n\n", boiler[0] + "\n" + boiler[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("leaf", F.lit(1))
    got = line_templates.drop_recurring(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == _sql("op10_line_templates", line_templates, df)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[0].text == "red red red red stays here as it is" and by_id[0].n_dropped == 2 and by_id[7].text == ""
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(map(repr, map(tuple, line_templates.drop_recurring(unique).collect()))) == _sql("op10_line_templates", line_templates, unique)
    assert line_templates.drop_recurring(clashing).count() == docs.count()
    is_set(line_templates.drop_recurring(docs.limit(0)))


def test_line_templates_long_passage_in_two_documents(spark):
    passage, short = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)), "a line of only seven tokens here"
    texts = [f"first {w} text stands alone\n{passage}\n{short}\nends {w}" for w in ("red", "green")] + ["another text that holds " + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(df).collect()}
    assert got == {i: t.replace(passage + "\n", "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in line_templates.drop_recurring(df, long_docs=line_templates.MIN_DOCS).collect()} == dict(enumerate(texts))


def test_line_templates_short_lines(spark, docs):
    texts = [f"All rights reserved.\n\nPage {i}\n7\n<*>\n{w} stays" for i, w in enumerate(("red", "green", "blue"))] + ["All rights  reserved.", "Page 1\nred stays", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_templates.drop_recurring(df)
    assert {r.doc_id: r.text for r in got.collect()} == {0: "\nPage 0\nred stays", 1: "\nPage 1\ngreen stays", 2: "\nPage 2\nblue stays", 3: "", 4: texts[4], 5: "", 6: ""}
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    for some in (df, unique, df.union(unique.select(F.col("doc_id") + 100, "text"))):
        got = line_templates.drop_recurring(some)
        assert sorted(map(repr, map(tuple, got.collect()))) == _sql("op10_whole_lines", line_templates, some)


def test_line_templates_read_every_text_twice_only(spark):
    odd = ["  two\tgaps  and 12 digits\r", "two gaps and x9\x0b digits", "\t \r", "a1b 2c d3 4 5e f", "9 2c d3 4 5e f", "é1 é 𝔘2 你 <*> f", "7 é 𝔘3 你 <*> f", "a b c d 1" + "x" * 3000 + " z", "a b c d " + "x" * 3000 + "1 z"]
    df = spark.createDataFrame([(i, "\n".join(odd[i % 4:] + [str(i)])) for i in range(12)], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, line_templates.drop_recurring(df).collect()))) == _sql("op10_line_templates", line_templates, df)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = df.select(F.col("doc_id").alias("doc"), "text").mapInArrow(count, "doc long, text string")
    assert line_templates.recurring_lines(counted).count() and read.value == 2 * df.count()


# pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[k] = docs.collect()
    good, texts = kept[0], {}
    for r in sorted(good, key=lambda r: r.doc_id):
        texts.setdefault(r.text or "", r.doc_id)
    assert sorted(r.doc_id for r in kept[1]) == sorted(texts.values())
    near = _brute_jaccard([(r.doc_id, r.text) for r in kept[1]], 5, 80)
    assert sorted(r.doc_id for r in kept[2]) == sorted(i for i, (_, c) in near.items() if i == c)
    mixed = {r.doc_id: r.taken // r.size for r in mixing.mix(spark.createDataFrame(kept[2], docs_schema(spark, sf))).collect() if r.size}
    assert collections.Counter(r.doc_id for r in kept[3]) == collections.Counter({i: n for i, n in mixed.items() if n})
    assert len(kept[4]) == len(kept[3]) and all(r.restored for r in kept[4])
    assert sorted(map(repr, map(tuple, corpus_pipeline.run(spark, sf).collect()))) == sorted(map(repr, map(tuple, kept[4])))


def docs_schema(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").schema
