"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct word shingles as 64-bit hashes. Equal sets are
one class, represented by its smallest id. Between classes the join is exact (up
to a chance of 2^-64 per pair of different shingles):

1. *Order.* Shingles are ordered by hash, but those that several sets have at
   the front of that order come last, by frequency; at most ``HOT`` of them, the most
   frequent. Any fixed order gives the same links, so the bound on this broadcast
   list costs no result, only comparisons.
2. *Index.* The first ``n - ceil(t n) + 1`` shingles of a set of n go to the index with
   their position. A list is cut into blocks of equal (size, position); two blocks
   that cannot reach the threshold by their sizes and by what is left behind
   their positions are skipped, and what remains connected is one sub-list.
3. *Answers.* The smallest set of a sub-list leads it. Leaders are compared with their
   followers, each follower once whatever the number of lists they share. Followers linked with
   their leader have its component and are never compared with each other; only the
   outsiders, followers not linked, are compared with the other followers, and there a
   pair is skipped when the two known distances to the leader already exclude it
   (Jaccard distance obeys the triangle inequality).

No pairs of a group are emitted: comparisons stream the followers past a bounded
block of anchors (a leader, or ``BLOCK`` outsiders), and only links that join two
parts leave the task. A group with a third of all rows is dealt over many tasks, its
anchors copied to each.

Defined cases: null and empty texts have no set, size 0, and link with nothing;
texts shorter than a shingle are one shingle of all their words; a null id carries its
size and has a null component; each text of a repeated id keeps
a row and a set of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut, documents, rows_of, small_batches, text_of, within
from fleetgrade.llm.components import components

HOT = 1 << 20
BLOCK = 256
SPREAD = 4096
MEMO = 1 << 19
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of the words met lately."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text, A-Z in lower case, as sorted hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > MEMO:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - k + 1, 0x2545F4914F6CDD1D * k & (1 << 64) - 1, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i:len(h) - k + 1 + i]) * np.uint64(_MIX[i % len(_MIX)])
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _need(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, h, n_shingles, set_id): the hash of the text, the size of its set, and the set's own 64-bit name, null for the empty set."""

    def run(batches):
        for batch in batches:
            sizes, names = [], []
            for (text,) in rows_of([batch], "text"):
                s = shingles(text, n)
                sizes.append(len(s))
                names.append(_name(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["doc_id", "h", "n_shingles", "set_id"])

    text = text_of("text")
    return docs.select("doc_id", _text_hash(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h binary, n_shingles long, set_id long")


def _text_hash(text):
    return F.unhex(F.md5(text))


def shared_shingles(firsts: DataFrame, n: int, percent: int, hot: int = HOT) -> np.ndarray:
    """Shingles that stand, by hash, in the prefix of several sets, the most frequent last: at most ``hot`` of them."""

    def run(batches):
        for batch in batches:
            found = [s[:len(s) - _need(len(s), percent) + 1] for s in (shingles(t, n) for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([_ints(np.concatenate([np.empty(0, np.uint64), *found]))], ["s"])

    counted = firsts.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counted.orderBy(F.desc("n"), "s").limit(hot).toArrow()
    return top.column("s").to_numpy().view(np.uint64)[::-1]


def prefixes(firsts: DataFrame, n: int, percent: int, shared: np.ndarray) -> DataFrame:
    """(s, set_id, n, at): the first shingles of each set in the common order, shared ones last."""
    order = np.argsort(shared)
    known = firsts.sparkSession.sparkContext.broadcast((shared[order], order + 1))

    def run(batches):
        names, place = known.value
        for batch in batches:
            parts = [[np.empty(0, np.uint64)], [], [], []]
            for (text,) in rows_of([batch], "text"):
                s = shingles(text, n)
                if not len(s):
                    continue
                set_id, size = _name(s), len(s)
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    s = s[np.lexsort((s, np.where(names[at] == s, place[at], 0)))]
                s = s[:size - _need(size, percent) + 1]
                for part, column in zip(parts, (s, np.full(len(s), set_id), np.full(len(s), size), np.arange(len(s))), strict=True):
                    part.append(column)
            yield pa.RecordBatch.from_arrays([_ints(np.concatenate([np.empty(0, np.int64), *p]) if i else np.concatenate(p)) for i, p in enumerate(parts)], ["s", "set_id", "n", "at"])

    return firsts.select("text").mapInArrow(run, "s long, set_id long, n long, at long")


def compatible(n1, p1, n2, p2, percent: int):
    """Whether sets of these sizes, whose first common shingle stands at these positions, may reach the threshold."""
    overlap = -(-percent * (n1 + n2) // (100 + percent))
    return np.minimum(n1 - p1, n2 - p2) >= overlap


def sub_lists(size: np.ndarray, position: np.ndarray, percent: int) -> np.ndarray:
    """Sub-list number of every entry of one list, -1 for entries that no other entry can reach.

    Entries of equal (size, position) are one block; blocks are linked if compatible.
    """
    blocks, of, many = np.unique(np.stack([size, position]), axis=1, return_inverse=True, return_counts=True)
    of, (n, p) = of.reshape(-1), blocks
    label = np.arange(len(n))
    alone = (many < 2) | ~compatible(n, p, n, p, percent)
    reach = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n)):
        j = i + 1 + np.flatnonzero(compatible(n[i], p[i], n[i + 1:reach[i]], p[i + 1:reach[i]], percent))
        if len(j):
            alone[i] = alone[j] = False
            joined = np.unique(label[np.append(j, i)])
            label[np.isin(label, joined)] = joined[0]
    return np.where(alone, -1, label)[of]


def _lists(batches: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole lists of a partition sorted by shingle: (shingles, set ids, sizes, positions) of one or more lists at a time."""
    rest = [np.empty(0, np.int64)] * 4
    for batch in batches:
        rest = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("s", "set_id", "n", "at"), strict=True)]
        whole = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
        if whole:
            yield tuple(r[:whole] for r in rest)
            rest = [r[whole:] for r in rest]
    yield tuple(rest)


def _led(key: np.ndarray, size: np.ndarray, at: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leaders, members) of one list of more than two."""
    part = sub_lists(size, at, percent)
    for k in np.unique(part[part >= 0]):
        inside = part == k
        members = key[inside]
        leader = members[np.lexsort((members, size[inside]))[0]]
        members = np.unique(members[members != leader])
        yield np.full(len(members), leader), members


def followers(entries: DataFrame, percent: int) -> DataFrame:
    """(leader, member): every pair of sets that may be linked is in the group of one leader, or is leader and member."""

    def lead(batches):
        for s, key, size, at in _lists(batches):
            starts = np.flatnonzero(np.diff(s, prepend=s[:1] - 1)) if len(s) else np.empty(0, np.int64)
            many = np.diff(starts, append=len(s))
            a = starts[many == 2]
            a = a[compatible(size[a], at[a], size[a + 1], at[a + 1], percent)]
            swap = (size[a + 1] < size[a]) | ((size[a + 1] == size[a]) & (key[a + 1] < key[a]))
            pairs = [(np.where(swap, key[a + 1], key[a]), np.where(swap, key[a], key[a + 1]))]
            for x, m in zip(starts[many > 2], many[many > 2], strict=True):
                pairs += _led(key[x:x + m], size[x:x + m], at[x:x + m], percent)
            both = np.unique(np.concatenate([np.stack(p) for p in pairs], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["leader", "member"])

    listed = entries.repartition("s").sortWithinPartitions("s")
    return listed.mapInArrow(lead, "leader long, member long").distinct()


class Anchors:
    """A bounded block of sets, ready to be met by any other set."""

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]
        self.size = np.array([len(s) for s in sets])

    def common(self, s: np.ndarray) -> np.ndarray:
        """Shingles that ``s`` shares with each anchor."""
        low, high = np.searchsorted(self.every, s, "left"), np.searchsorted(self.every, s, "right")
        many = high - low
        hit = np.flatnonzero(many)
        if not len(hit):
            return np.zeros(len(self.size), np.int64)
        start = np.repeat(low[hit] - np.cumsum(many[hit]) + many[hit], many[hit])
        return np.bincount(self.owner[start + np.arange(len(start))], minlength=len(self.size))


def _grouped(batches: Iterator) -> Iterator[tuple[list, Iterator]]:
    """Rows sorted by (g, block, salt, anchor first) as (anchor rows, member rows) of each group; members are streamed."""
    rows = rows_of(batches, "g", "block", "salt", "anchor", "id", "label", "away", "s")
    head = next(rows, None)
    while head is not None:
        key, anchors = head[:3], []
        while head is not None and head[:3] == key and head[3]:
            anchors.append(head[4:])
            head = next(rows, None)

        def members():
            nonlocal head
            while head is not None and head[:3] == key and not head[3]:
                yield head[4:]
                head = next(rows, None)

        stream = members()
        yield anchors, stream
        for _ in stream:
            pass


def _measure(percent: int):
    """Leader against followers: (leader, member, distance to it, linked)."""

    def run(batches):
        for anchors, members in _grouped(batches):
            if not anchors:
                continue
            leader = anchors[0][0]
            ready = Anchors([np.frombuffer(anchors[0][3], np.uint64)])
            out = []
            for member, _, _, s in members:
                both = int(ready.common(np.frombuffer(s, np.uint64))[0])
                union = int(ready.size[0]) + len(s) // 8 - both
                out.append((leader, member, 1 - both / union, 100 * both >= percent * union))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], ["leader", "member", "away", "linked"])

    return run


def _compare(percent: int):
    """Outsiders against the other followers: links that join two parts."""

    def run(batches):
        for anchors, members in _grouped(batches):
            if not anchors:
                continue
            ids, labels, away = (np.array([a[i] for a in anchors]) for i in range(3))
            ready = Anchors([np.frombuffer(a[3], np.uint64) for a in anchors])
            part: dict = {}

            def root(x):
                while part.get(x, x) != x:
                    x = part[x]
                return x

            links = []
            for member, label, far, s in members:
                s = np.frombuffer(s, np.uint64)
                small, large = np.minimum(ready.size, len(s)), np.maximum(ready.size, len(s))
                open_ = (labels != label) & (100 * small >= percent * large) & (np.abs(away - far) <= 1 - percent / 100 + 1e-9)
                if not open_.any():
                    continue
                both = ready.common(s)
                linked = open_ & (100 * both >= percent * (ready.size + len(s) - both))
                for k in np.flatnonzero(linked):
                    a, b = root(int(labels[k])), root(label)
                    if a != b:
                        part[max(a, b)] = min(a, b)
                        links.append((int(ids[k]), member))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "block", "salt").sortWithinPartitions("g", "block", "salt", F.desc("anchor"), "id")


def linked_sets(firsts: DataFrame, classes: DataFrame, n: int, percent: int, hot: int = HOT) -> DataFrame:
    """(a, b): links between sets that join everything the threshold joins.

    ``firsts`` has (doc_id, text) of one document per set, ``classes`` (set_id, first) says which.
    """
    pairs = cut(followers(prefixes(firsts, n, percent, shared_shingles(firsts, n, percent, hot)), percent))
    touched = cut(pairs.select(F.col("leader").alias("id")).unionByName(pairs.select(F.col("member").alias("id"))).distinct())

    def again(batches):
        for batch in batches:
            found = [s for s in (shingles(t, n) for t in batch.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "s"])

    # Only texts of touched sets are read again; a first id with several texts may bring sets that are not.
    wanted = cut(classes.join(touched, F.col("set_id") == F.col("id"), "left_semi").select(F.col("first").alias("doc_id")).distinct())
    texts = firsts.join(within(wanted, 1_000_000), "doc_id", "left_semi").select("text")
    arrays = texts.mapInArrow(again, "id long, s binary").join(within(touched, 1_000_000), "id", "left_semi")
    arrays = cut(arrays.dropDuplicates(["id"]))

    # A large group is dealt over several salts, its leader copied to each.
    sized = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("many")).withColumn("salts", F.floor(F.col("many") / SPREAD) + 1)
    sized = cut(sized)
    salt = F.pmod(F.xxhash64("member"), F.col("salts"))
    none = [F.lit(0).cast("long").alias("label"), F.lit(0.0).alias("away")]
    leads = sized.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    leads = leads.join(arrays, leads.leader == arrays.id).select(F.col("leader").alias("g"), F.lit(0).cast("long").alias("block"), "salt", F.lit(True).alias("anchor"), "id", *none, "s")
    rest = pairs.join(sized, "leader").withColumn("salt", salt)
    rest = rest.join(arrays, rest.member == arrays.id).select(F.col("leader").alias("g"), F.lit(0).cast("long").alias("block"), "salt", F.lit(False).alias("anchor"), "id", *none, "s")
    measured = cut(_dealt(leads.unionByName(rest)).mapInArrow(_measure(percent), "leader long, member long, away double, linked boolean"))

    stars = measured.filter("linked").select(F.col("leader").alias("a"), F.col("member").alias("b"))
    labels = cut(components(stars))
    # Followers with their component so far; outsiders are those outside their leader's.
    found = measured.join(labels.select(F.col("node").alias("member"), F.col("component").alias("mc")), "member", "left")
    found = found.join(labels.select(F.col("node").alias("leader"), F.col("component").alias("lc")), "leader", "left")
    found = found.select("leader", "member", "away", F.coalesce("mc", "member").alias("label"), F.coalesce("lc", "leader").alias("lead_label"))
    found = cut(found.withColumn("out", F.col("label") != F.col("lead_label")))
    counts = cut(found.groupBy("leader").agg(F.sum(F.col("out").cast("long")).alias("outs"), F.count(F.lit(1)).alias("many")).filter("outs > 0 and many > 1"))
    counts = counts.withColumn("blocks", F.floor((F.col("outs") + BLOCK - 1) / BLOCK)).withColumn("salts", F.floor(F.col("many") / SPREAD) + 1)
    open_ = found.join(counts.select("leader", "blocks", "salts"), "leader")
    outs = open_.filter("out").withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    others = open_.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "member"), F.col("salts"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def with_sets(rows, anchor):
        return rows.join(arrays, rows.member == arrays.id).select(F.col("leader").alias("g"), "block", "salt", F.lit(anchor).alias("anchor"), "id", "label", "away", "s")

    more = _dealt(with_sets(outs, True).unionByName(with_sets(others, False))).mapInArrow(_compare(percent), "a long, b long")
    return stars.unionByName(cut(more))


def _placed(docs: DataFrame, n: int, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_shingles, set_id) of every document, and (set_id, first, part): the component of each set."""
    small_batches(docs.sparkSession)
    sets = cut(document_sets(docs, n))
    classes = cut(sets.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first")))
    firsts = docs.select("doc_id", text_of("text").alias("text")).join(within(classes.select(F.col("first").alias("doc_id")).distinct(), 1_000_000), "doc_id", "left_semi")
    joined = components(linked_sets(firsts, classes, n, percent, hot))
    part = classes.join(joined, F.col("set_id") == F.col("node"), "left").select("set_id", "first", F.coalesce("component", "set_id").alias("part"))
    return sets, cut(part)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    sets, part = _placed(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), n, percent, hot)
    answer = part.join(part.groupBy("part").agg(F.min("first").alias("component_id")), "part").select("set_id", "component_id")
    met = sets.select("doc_id", "n_shingles", "set_id").join(answer, "set_id", "left")
    return met.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component with all its columns: the one of smallest id, among texts of that id the one of smallest hash.

    A document is its id and its text: another text under the id of a copy stays, rows alike in both stay or go together.
    Documents without words or id stay.
    """
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    sets, part = _placed(docs.select(doc.alias("doc_id"), text.alias("text")), n, percent, HOT)
    named = sets.filter("set_id is not null and doc_id is not null").select("doc_id", "h", "set_id").join(part.select("set_id", "part"), "set_id")
    named = cut(named.select("part", F.struct("doc_id", "h").alias("one")))
    keep = named.groupBy("part").agg(F.min("one").alias("keep"))
    gone = cut(named.join(keep, "part").filter("one <> keep").select(F.col("one.doc_id").alias("__id"), F.col("one.h").alias("__h")).distinct())
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), doc.alias("__id"), _text_hash(text_of(text)).alias("__h"))
    return packed.join(within(gone), ["__id", "__h"], "left_anti").select("__row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), n=4, percent=85)


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES = {
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n, list_sort(grams) AS grams FROM s),
c AS (SELECT min(doc_id) AS rep, n, grams FROM n WHERE n > 0 GROUP BY n, grams),
g AS (SELECT rep, n, unnest(grams) AS gram FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.gram = b.gram AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
k AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(k.component, n.doc_id) AS component_id
FROM n LEFT JOIN c ON n.n = c.n AND n.grams = c.grams LEFT JOIN k ON c.rep = k.node""",
}
