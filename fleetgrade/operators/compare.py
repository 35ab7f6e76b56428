"""Comparison of two runs: baseline matching, multiset diff, ratchet, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S
from fleetgrade.operators.prefix import LINE_CHUNK, occurrence, running_sums
from fleetgrade.session import cut


def normalize_path(path: Column) -> Column:
    """Without empty and ``.`` parts; ``..`` swallows the part before it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.array_append(acc, p)),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(folded, "/"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def match_baseline(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, entry): the baseline entry of each file; several files may share one.

    Same normalised path first, else the same file name when it is unique in the baseline.
    """
    mine = files.select("path", normalize_path(F.col("path")).alias("_p"), basename(F.col("path")).alias("_b"))
    entries = baseline.select(F.col("path").alias("entry"), normalize_path(F.col("path")).alias("_p"), basename(F.col("path")).alias("_b"))
    by_path = entries.groupBy("_p").agg(F.min("entry").alias("same_path"))
    by_name = entries.groupBy("_b").agg(F.count("*").alias("_n"), F.min("entry").alias("same_name")).filter("_n = 1")
    return (
        mine.join(by_path, "_p", "left").join(by_name.select("_b", "same_name"), "_b", "left")
        .select("path", F.coalesce("same_path", "same_name").alias("entry"))
    )


def multiset_states(before: DataFrame, after: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Rows of ``after`` marked new or unchanged: the first k copies of an item known k times are unchanged."""
    known = before.groupBy(*keys, item).agg(F.count("*").alias("_known"))
    numbered = occurrence(after, [*keys, item], "position", name="_nth", chunk=LINE_CHUNK)
    joined = numbered.join(known, [*keys, item], "left")
    unchanged = F.col(item).isNotNull() & (F.col("_nth") <= F.coalesce("_known", F.lit(0)))
    return joined.withColumn("state", F.when(unchanged, "unchanged").otherwise("new")).drop("_nth", "_known")


def diff_baseline(findings: DataFrame, base_findings: DataFrame, matched: DataFrame, base_scores: DataFrame) -> DataFrame:
    """Per file with an entry: new, fixed and unchanged counts and the previous score."""
    pairs = matched.filter("entry is not null")
    now = findings.join(pairs, "path").groupBy("path", "fingerprint").agg(F.count("*").alias("a"))
    then = (
        base_findings.filter("fingerprint is not null").withColumnRenamed("path", "entry")
        .groupBy("entry", "fingerprint").agg(F.count("*").alias("b"))
        .join(pairs, "entry").select("path", "fingerprint", "b")
    )
    both = now.join(then, ["path", "fingerprint"], "full").fillna(0, ["a", "b"])
    counts = both.groupBy("path").agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("new"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("fixed"),
        F.sum(F.least("a", "b")).alias("unchanged"),
    )
    return (
        pairs.join(base_scores.select(F.col("path").alias("entry"), F.col("global").alias("previous")), "entry", "left")
        .join(counts, "path", "left")
        .select("path", "entry", "previous", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("new", "fixed", "unchanged")])
    )


def score_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of the global and category scores of files present on both sides, one decimal."""
    names = ("global", *dims.CATEGORIES)
    old = before.select("path", *[F.col(n).alias(f"_{n}") for n in names])
    return after.join(old, "path").select(
        "path", *[S.round1(F.round(F.col(n) - F.col(f"_{n}"), 6)).alias(f"{n}_delta") for n in names]
    )


def tighten_baseline(baseline: DataFrame, comparison: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline findings after the ratchet: an entry is replaced only with no new and some fixed.

    ``comparison`` is the result of :func:`diff_baseline`; the stored path is kept.
    """
    ready = comparison.filter("new = 0 and fixed > 0").select("path", "entry")
    # Several files may share an entry: the last one in path order is the one stored.
    chosen = ready.groupBy("entry").agg(F.max("path").alias("path"))
    replaced = current.join(chosen, "path").drop("path").withColumnRenamed("entry", "path")
    kept = baseline.join(chosen.select(F.col("entry").alias("path")), "path", "left_anti")
    names = [c for c in baseline.columns if c in replaced.columns]
    return kept.select(*names).unionByName(replaced.select(*names))


def tighten_counts(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count_if((F.col("new") == 0) & (F.col("fixed") > 0)).alias("updated"),
        F.coalesce(F.sum(F.when(F.col("new") == 0, F.col("fixed"))), F.lit(0)).alias("removed"),
        F.count_if(F.col("new") > 0).alias("refused"),
    )


# ---------------------------------------------------------------- matching of two reports


def _suffixes(df: DataFrame) -> DataFrame:
    """Every path tail of each row as (…, depth, tail)."""
    parts = F.reverse(F.filter(F.split(normalize_path(F.col("path")), "/"), lambda p: p != ""))
    return df.withColumn("_parts", parts).select(
        *df.columns,
        F.posexplode(
            F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.array_join(F.slice("_parts", F.lit(1), n), "/"))
        ).alias("depth", "tail"),
    )


def match_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, before_path) for every ``after`` file; null when unmatched. Input: (path, ord).

    The same path matches first. Then, in the order of ``after``, a file takes the one left
    ``before`` file of the same name with the longest common path tail, if only one has it;
    what is taken is gone for those after it. Instead of a loop over files each round assumes
    that only files with a single candidate take one, counts per path tail what is left at
    every position with running sums, and accepts all files up to the first one for which
    this assumption fails. Work is linear in paths × depth; no pairs are formed.
    """
    b = before.withColumn("_p", normalize_path(F.col("path")))
    a = after.withColumn("_p", normalize_path(F.col("path")))
    first_b = b.groupBy("_p").agg(F.min("ord").alias("ord"), F.min_by("path", "ord").alias("before_path"))
    first_a = a.groupBy("_p").agg(F.min("ord").alias("_o"))
    same = a.join(first_b.drop("ord"), "_p").join(first_a, "_p").filter(F.col("ord") == F.col("_o")).select("path", "ord", "before_path")
    taken = first_b.join(first_a, "_p", "left_semi").select("ord")
    left_b = cut(b.select("path", "ord").join(taken, "ord", "left_anti"))
    todo = cut(a.select("path", "ord").join(same, ["path", "ord"], "left_anti"))
    done = [same]
    while not todo.isEmpty() and not left_b.isEmpty():
        nodes = _suffixes(left_b).groupBy("tail", "depth").agg(F.count("*").alias("stock"), F.min("ord").alias("b_ord"))
        # Every tail of every waiting file, also those nobody has: a file climbs over empty ones.
        reach = _suffixes(todo.withColumn("name", basename(F.col("path")))).join(nodes, ["tail", "depth"])
        best = reach.groupBy("ord").agg(F.max_by(F.struct("stock", "b_ord"), "depth").alias("n"))
        takers = best.filter("n.stock = 1").groupBy(F.col("n.b_ord").alias("b_ord")).agg(F.min("ord").alias("ord"))
        takes = _suffixes(left_b.withColumnRenamed("ord", "b_ord")).join(takers, "b_ord").select("tail", "depth", "ord", F.lit(1).alias("one"))
        events = reach.select("tail", "depth", "ord", "name", "stock", F.lit(0).alias("one")).unionByName(
            takes.withColumn("name", F.lit(None).cast("string")).withColumn("stock", F.lit(None).cast("bigint"))
        )
        # A file's own take comes after its own look.
        flow = running_sums(events, ["tail", "depth"], "ord", {"gone": F.col("one")}, tie=["one"]).filter("name is not null")
        then = (
            flow.withColumn("remain", F.col("stock") - F.col("gone")).filter("remain >= 1")
            .groupBy("name", "ord").agg(F.max_by("remain", "depth").alias("remain"))
        )
        # A waiting file that is no taker but would see a single candidate ends the safe stretch.
        stop = (
            then.filter("remain = 1").join(takers.select("ord"), "ord", "left_anti").groupBy("name").agg(F.min("ord").alias("stop"))
        )
        safe = (
            todo.withColumn("name", basename(F.col("path"))).join(stop, "name", "left")
            .filter(F.col("stop").isNull() | (F.col("ord") < F.col("stop"))).select("path", "ord")
        )
        step = cut(
            safe.join(takers, "ord", "left")
            .join(left_b.select(F.col("ord").alias("b_ord"), F.col("path").alias("before_path")), "b_ord", "left")
            .select("path", "ord", "before_path", "b_ord")
        )
        done.append(step.select("path", "ord", "before_path"))
        todo = cut(todo.join(step, "ord", "left_anti"))
        left_b = cut(left_b.join(step.filter("b_ord is not null").select(F.col("b_ord").alias("ord")), "ord", "left_anti"))
    done.append(todo.withColumn("before_path", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, done).select("path", "before_path")


def issue_key() -> Column:
    """Fingerprint, or rule and line where it is missing."""
    return F.coalesce("fingerprint", F.concat("rule", F.lit("@"), F.col("line").cast("string")))


def diff_reports(before: DataFrame, after: DataFrame, pairs: DataFrame, before_paths: DataFrame) -> DataFrame:
    """Issues of both reports with a state: new, unchanged, fixed; whole files: added, removed.

    ``pairs`` is the result of :func:`match_reports`; ``before_paths`` lists the files of the
    earlier report. Output: (path, state, n).
    """
    matched = pairs.filter("before_path is not null")
    a = after.withColumn("k", issue_key()).groupBy("path", "k").agg(F.count("*").alias("a")).join(matched, "path", "left_semi")
    b = (
        before.withColumn("k", issue_key()).withColumnRenamed("path", "before_path")
        .groupBy("before_path", "k").agg(F.count("*").alias("b")).join(matched, "before_path").select("path", "k", "b")
    )
    both = a.join(b, ["path", "k"], "full").fillna(0, ["a", "b"])
    counts = both.groupBy("path").agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("new"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("fixed"),
        F.sum(F.least("a", "b")).alias("unchanged"),
    )
    issues = matched.select("path").join(counts, "path", "left").select(
        "path",
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("state"), F.coalesce(s, F.lit(0)).cast("bigint").alias("n")) for s in ("new", "fixed", "unchanged")
        ])).alias("s"),
    ).select("path", "s.*")
    added = pairs.filter("before_path is null").select("path", F.lit("added").alias("state"), F.lit(1).cast("bigint").alias("n"))
    removed = before_paths.select("path").join(matched.select(F.col("before_path").alias("path")), "path", "left_anti").select(
        "path", F.lit("removed").alias("state"), F.lit(1).cast("bigint").alias("n")
    )
    return issues.unionByName(added).unionByName(removed)


# ---------------------------------------------------------------- gates and summaries


def gate_thresholds(scores: DataFrame, states: DataFrame, minimum: dict[str, float], worst_new: str | None) -> DataFrame:
    """Reasons to fail: files below a minimum, new findings at or above a severity."""
    low = [
        scores.filter(F.col(name) < limit).select("path", F.lit(f"{name} < {limit}").alias("reason"))
        for name, limit in minimum.items()
    ]
    if worst_new:
        bad = dims.severity_rank(F.col("severity")) <= dims.SEVERITIES.index(worst_new)
        low.append(states.filter((F.col("state") == "new") & bad).select("path", F.lit(f"new {worst_new}").alias("reason")).distinct())
    return reduce(DataFrame.unionByName, low)


def gate_diff(deltas: DataFrame, states: DataFrame, worst_new: str | None) -> DataFrame:
    """Reasons to fail a comparison: a lower global score, or a severe new finding."""
    lower = deltas.filter("global_delta < 0").select("path", F.lit("lower score").alias("reason"))
    if not worst_new:
        return lower
    bad = dims.severity_rank(F.col("severity")) <= dims.SEVERITIES.index(worst_new)
    return lower.unionByName(
        states.filter((F.col("state") == "new") & bad).select("path", F.lit(f"new {worst_new}").alias("reason")).distinct()
    )


def triage_order(compared: DataFrame) -> DataFrame:
    """Rank of changed files (path, new, fixed, delta): worse, new, fixed, same; then delta."""
    rank = F.when(F.col("delta") < 0, 0).when(F.col("new") > 0, 1).when(F.col("fixed") > 0, 2).otherwise(3)
    return compared.withColumn("rank", rank).orderBy("rank", "delta", "path")


def changed_only(compared: DataFrame) -> DataFrame:
    return compared.filter("new > 0 or fixed > 0 or delta <> 0")


def average_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean before and after over the files on both sides."""
    both = after.select("path", F.col("global").alias("a")).join(before.select("path", F.col("global").alias("b")), "path")
    return both.agg(
        S.round1(F.round(F.avg("b"), 6)).alias("before"), S.round1(F.round(F.avg("a"), 6)).alias("after"), F.count("*").alias("files")
    )


def diff_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("files"), F.sum("new").alias("new"), F.sum("fixed").alias("fixed"), F.sum("unchanged").alias("unchanged"),
        F.count_if(F.col("delta") < 0).alias("worse"), F.count_if(F.col("delta") > 0).alias("better"),
    )
