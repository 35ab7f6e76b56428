"""Line deduplication by a log-template tree, as joins and aggregates.

A line's place in the tree is its number of tokens and its first ``DEPTH`` tokens, where
tokens with a digit are variable. Inside such a leaf a token is fixed if it stands at
its position in at least two documents, and variable otherwise; the line with its variable
tokens generalised is its template. A template that at least ``MIN_DOCS`` documents hold,
and at least half of which is fixed, recurs: its lines are dropped everywhere. Long lines, of ``LONG_TOKENS`` tokens or more, recur
from ``LONG_DOCS`` documents on. Lines of fewer than ``MIN_TOKENS`` tokens have leaves of
their own: all their tokens, digits as they stand, so they recur if they are equal.

The tree is never built in one place. A leaf is open if the smallest and the largest document in it
differ, a token is fixed by the same test: aggregates of fixed size, partial before each shuffle, so
a line in a third of all documents is a row per task. Equal lines of a leaf are one pattern; only
patterns of open leaves are looked at token by token, and those that one document
alone holds are compared with the fixed tokens, as all tokens of the others are fixed.

Documents, leaves, patterns, places and templates are named by 64-bit hashes: among n of them two are confused with a chance
of n squared over 2^65, and a line is then judged by the other's documents.

Defined cases: null and empty texts have no lines and stay as they are (null as empty); blank lines
always stay; rows equal in id and text are one document; a null id is a document like any other;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut, documents, text_of, within

DEPTH = 4
MIN_TOKENS = 5
MIN_DOCS = 3
LONG_TOKENS = 50
LONG_DOCS = 2
STAR = "<*>"


BLANK = " \t\x0b\x0c\r"


def _plain(raw: Column) -> Column:
    """The tokens of a line with one space between them. What most lines lack, other blanks and two in a row, is looked for before it is treated."""
    others = reduce(Column.__or__, (F.contains(raw, F.lit(c)) for c in BLANK[1:]))
    spaced = F.when(others, F.translate(raw, BLANK[1:], BLANK[0] * len(BLANK[1:]))).otherwise(raw)
    gaps = F.contains(spaced, F.lit(BLANK[0] * 2)) | F.startswith(spaced, F.lit(BLANK[0])) | F.endswith(spaced, F.lit(BLANK[0]))
    return F.when(gaps, F.trim(F.regexp_replace(spaced, " {2,}+", " "))).otherwise(spaced)


def _mask(plain: Column) -> Column:
    """Tokens with a digit become variable; every token is looked at once."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", STAR)).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line, n, leaf, tokens) of the lines that are not blank: number of tokens and, variable ones masked, the tokens with a space between.

    Tokens are counted by their spaces and stay one text: a line is not taken apart before it is compared."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.select("doc", "line", _plain(F.col("raw")).alias("plain")).filter("plain <> ''")
    lines = lines.withColumn("n", F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    lines = lines.select("doc", "line", "n", F.when(F.col("n") >= MIN_TOKENS, _mask(F.col("plain"))).otherwise(F.col("plain")).alias("tokens"))
    return lines.withColumn("leaf", F.xxhash64("n", F.substring_index("tokens", " ", DEPTH)))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(doc, line) of the lines to drop. ``docs`` has a key ``doc`` and a text that is not null."""
    lines = _lines(docs).withColumn("pattern", F.xxhash64("leaf", "tokens"))
    # Names of all lines, written once: of the texts, only those that stand for a pattern of an open leaf are read again.
    named = cut(lines.select("doc", "line", "leaf", "pattern"))
    leaves = cut(_spread(named.select("leaf", F.col("doc").alias("a"), F.col("doc").alias("b")), "leaf").select("leaf"))
    masked = lines.join(within(leaves, 2_000_000), "leaf", "left_semi")
    patterns = masked.groupBy("pattern", "leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.first("tokens").alias("tokens"))
    patterns = cut(patterns.select("pattern", "leaf", "a", "b", F.split("tokens", " ").alias("tokens")))
    places = patterns.select("pattern", "leaf", "a", "b", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")).filter((F.col("token") != STAR) | (F.col("n") < MIN_TOKENS))
    places = places.withColumn("place", F.xxhash64("leaf", "at", "token"))
    fixed = _spread(places, "place").select("place")
    alone = places.filter("a = b").select("pattern", "leaf", "n", "place").join(fixed, "place", "left_semi")
    # The fixed tokens with their positions are the template; their order does not matter to the fold.
    shared = places.filter("a <> b").select("pattern", "leaf", "n", "place")
    shaped = alone.unionByName(shared).groupBy("pattern", "leaf", "n").agg(F.bit_xor("place").alias("template"), F.count(F.lit(1)).alias("known"))
    shaped = cut(shaped.filter(F.col("known") * 2 >= F.col("n")).select("pattern", F.xxhash64("leaf", "template", "known").alias("template"), (F.col("n") >= LONG_TOKENS).alias("long")))
    held = cut(named.select("doc", "line", "pattern").join(within(shaped, 2_000_000), "pattern").select("doc", "line", "template", "long"))
    enough = F.when(F.col("long"), long_docs).otherwise(min_docs)
    often = held.select("template", "long", "doc").distinct().groupBy("template", "long").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= enough)
    return held.join(often, "template", "left_semi").select("doc", "line")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", long_docs: int = LONG_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text without its recurring lines."""
    picked = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    gone = recurring_lines(picked, min_docs, long_docs).groupBy("doc").agg(F.collect_set("line").alias("gone"))
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    met = picked.join(gone, "doc", "left").withColumn("lines", lines)
    # The set difference is by hash, so a text costs its lines and not their product with the dropped ones.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), left.alias("text"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(documents(spark, sf_dir))


_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc, doc_id, text, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM d),
r AS (SELECT doc, unnest(lines) AS raw, unnest(range(len(lines))) AS line FROM l),
w AS (SELECT doc, line, list_filter(string_split(translate(raw, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '') AS words FROM r),
t AS (SELECT doc, line, len(words) AS n, [CASE WHEN len(words) >= {MIN_TOKENS} AND regexp_matches(x, '[0-9]') THEN '{STAR}' ELSE x END FOR x IN words] AS tokens FROM w WHERE len(words) > 0),
p AS (SELECT doc, line, n, n || ' ' || array_to_string(CASE WHEN n < {MIN_TOKENS} THEN tokens ELSE tokens[1:{DEPTH}] END, ' ') AS leaf, tokens FROM t),
o AS (SELECT p.* FROM p JOIN (SELECT leaf FROM p GROUP BY leaf HAVING min(doc) <> max(doc)) USING (leaf)),
e AS (SELECT doc, line, n, leaf, unnest(tokens) AS token, unnest(range(n)) AS place FROM o),
f AS (SELECT leaf, place, token FROM e WHERE token <> '{STAR}' OR n < {MIN_TOKENS} GROUP BY ALL HAVING min(doc) <> max(doc)),
s AS (SELECT doc, line, n, leaf, string_agg(place || ' ' || token, ' ' ORDER BY place) AS template, count(*) AS known FROM e JOIN f USING (leaf, place, token) GROUP BY doc, line, n, leaf),
m AS (SELECT * FROM s WHERE known * 2 >= n),
g AS (SELECT DISTINCT doc, line FROM m JOIN (SELECT n, leaf, template FROM m GROUP BY ALL HAVING count(DISTINCT doc) >= CASE WHEN n >= {LONG_TOKENS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END) USING (leaf, template)),
k AS (SELECT doc, list(line) AS gone FROM g GROUP BY doc)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i] FOR i IN list_filter(range(1, len(lines) + 1), lambda j: NOT list_contains(gone, j - 1))], chr(10)) END AS text
FROM l LEFT JOIN k USING (doc)"""
# Both names ask for the same; the second one is kept for those who use it.
QUERIES = {"op10_line_templates": op10_line_templates, "op10_whole_lines": op10_line_templates}
ORACLES = dict.fromkeys(QUERIES, _SQL)
