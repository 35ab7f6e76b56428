"""Scalar functions over columns. All but the fingerprint hash stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Grade limits, best first.
GRADE_LIMITS = (("A", 9.0), ("B", 7.5), ("C", 6.0), ("D", 4.0))
LAST_GRADE = "E"

# The words a secret name ends with, and the endings that make it a location.
SECRET_WORDS = (
    "pass|password|passwd|secret|token|apikey|api_key|accesskey|access_key|"
    "privatekey|private_key|credential|credentials"
)
LOCATION_ENDINGS = "file|path|dir|url|name|id|env|var|length"

# 64-bit FNV-1a.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
_MASK64 = (1 << 64) - 1


def round1(value: Column) -> Column:
    """One decimal by multiply, round, divide; negative ties move away from zero."""
    return F.round(value * 10) / 10


def grade(score: Column) -> Column:
    out = None
    for name, limit in GRADE_LIMITS:
        out = F.when(score >= limit, name) if out is None else out.when(score >= limit, name)
    return out.otherwise(LAST_GRADE)


def grade_rank(grade_col: Column) -> Column:
    """0 for the best grade."""
    return F.ascii(grade_col) - F.lit(65)


def trim_blanks(text: Column) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(trim_blanks(text), r"(?U)\s+", " ")


def normalize_dist(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def matches_rule(pattern: Column, rule: Column) -> Column:
    """Exact id, a trailing ``*`` wildcard, or ``ALL``."""
    stem = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return (pattern == "ALL") | F.when(F.endswith(pattern, F.lit("*")), F.startswith(rule, stem)).otherwise(
        pattern == rule
    )


def matches_code(pattern: Column, rule: Column) -> Column:
    """As ``matches_rule`` without the ``ALL`` word (equivalence lists)."""
    stem = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return F.when(F.endswith(pattern, F.lit("*")), F.startswith(rule, stem)).otherwise(pattern == rule)


def is_secret_name(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(rf"({SECRET_WORDS})s?\z") & ~low.rlike(rf"_({LOCATION_ENDINGS})\z")


def is_pinned_image(image: Column) -> Column:
    img = F.trim(image)
    last = F.element_at(F.split(img, "/"), -1)
    tag = F.when(F.contains(last, F.lit(":")), F.element_at(F.split(last, ":"), -1)).otherwise("")
    free = (img == "") | F.contains(img, F.lit("$")) | F.contains(img, F.lit("@sha256:"))
    return free | ((tag != "") & (tag != "latest"))


# Sample values that are not secrets, also with digits behind.
SAMPLE_VALUES = (
    "change_me|change-me|changeme|password|passwd|secret|example|default|placeholder|"
    "dummy|test|testing|none|null|todo"
)


def looks_like_real_secret(value: Column) -> Column:
    """At least eight characters, no blank, no template mark, no sample value, three distinct characters."""
    sample = rf"^(({SAMPLE_VALUES})|your[_-]?\w*)\d*\z"
    return (
        (F.length(value) >= 8)
        & ~value.rlike(r"[ {}<>$%]")
        & ~F.lower(value).rlike(sample)
        & (F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))) > 2)
    )


def shannon_entropy(text: Column) -> Column:
    """Bits per character: one pass over the sorted characters, where equal ones stand together."""
    found = F.filter(F.split(text, ""), lambda c: c != "")

    # The number of characters is part of the state: named inside a step, the array would be built anew for every character.
    def share(acc: Column) -> Column:
        return F.when(acc["run"] > 0, acc["run"] / acc["n"] * F.log2(acc["run"] / acc["n"])).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(
            c.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"), F.when(same, acc["bits"]).otherwise(acc["bits"] - share(acc)).alias("bits"), acc["n"].alias("n"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("bits"), F.size(found).cast("double").alias("n"))
    return F.aggregate(F.sort_array(found), start, step, lambda acc: acc["bits"] - share(acc))


def json_int(text: Column) -> Column:
    """Integer of a JSON field that may be a number or a numeric string; null otherwise."""
    return F.trim(text.cast("string")).try_cast("double").cast("int")


def json_double(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("double")


def reference_family(ref: Column) -> Column:
    return (
        F.when(F.startswith(ref, F.lit("CWE-")), "CWE")
        .when(F.startswith(ref, F.lit("OWASP CICD")), "OWASP CI/CD")
        .when(F.startswith(ref, F.lit("OWASP")), "OWASP Top 10 2021")
        .otherwise("ANSSI")
    )


# Titles of the ten risks of 2021 in order and of five pipeline risks, as their pages spell them, and addresses of guides.
RISKS_2021 = (
    "Broken Access Control", "Cryptographic Failures", "Injection", "Insecure Design", "Security Misconfiguration", "Vulnerable and Outdated Components",
    "Identification and Authentication Failures", "Software and Data Integrity Failures", "Security Logging and Monitoring Failures", "Server-Side Request Forgery %28SSRF%29",
)
PIPELINE_RISKS = {
    3: "Dependency Chain Abuse", 4: "Poisoned Pipeline Execution", 5: "Insufficient PBAC", 6: "Insufficient Credential Hygiene", 9: "Improper Artifact Integrity Validation",
}
RISKS_SITE, PIPELINE_SITE = "https://top10.owasp.org/2021/", "https://owasp.org/www-project-top-10-ci-cd-security-risks/"
GUIDES = {
    "ANSSI-BP-028": "https://messervices.cyber.gouv.fr/documents-guides/fr_np_linux_configuration-v2.0.pdf",
    "ANSSI-FT-082": "https://messervices.cyber.gouv.fr/documents-guides/docker_fiche_technique.pdf",
    "ANSSI OpenSSH": "https://messervices.cyber.gouv.fr/documents-guides/NT_OpenSSH.pdf",
}


def reference_url(ref: Column) -> Column:
    """Page of a reference; a pipeline risk without a page of its own leads to the list, an unknown reference is null."""
    weakness = F.regexp_extract(ref, r"^CWE-(\d+)\z", 1)
    pipeline = F.regexp_extract(ref, r"^OWASP CICD-SEC-(\d+)\z", 1)
    risks = {f"OWASP A{i:02d}:2021": f"{RISKS_SITE}A{i:02d}_2021-{title.replace(' ', '_')}/" for i, title in enumerate(RISKS_2021, 1)}
    pages = {n: f"CICD-SEC-{n:02d}-{title.replace(' ', '-')}" for n, title in PIPELINE_RISKS.items()}
    one = [F.when(weakness != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), weakness, F.lit(".html")))]
    one.append(F.try_element_at(F.create_map(*[F.lit(x) for kv in risks.items() for x in kv]), ref))
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in pages.items() for x in kv]), pipeline.try_cast("int"))
    one.append(F.when(pipeline != "", F.concat(F.lit(PIPELINE_SITE), F.coalesce(own, F.lit("")))))
    one += [F.when(F.startswith(ref, F.lit(start)), F.lit(page)) for start, page in GUIDES.items()]
    return F.coalesce(*one)


def requirement_name(line: Column) -> Column:
    """Distribution named by one requirement, normalised; null when it names none."""
    text = F.regexp_replace(F.trim(line), r"^(-e|--editable)[ =]\s*", "")
    is_url = text.rlike(r"^[\w+]+://")
    egg = F.nullif(F.regexp_extract(text, r"#egg=([\w.-]+)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(text, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1), F.lit(""))
    return normalize_dist(F.when(is_url, egg).otherwise(plain))


def score_delta_text(delta: Column) -> Column:
    d = round1(delta)
    return F.concat(F.when(d >= 0, "+").otherwise(""), F.format_string("%.1f", d))


def escape_command(text: Column, prop: bool = False) -> Column:
    """Escape a value of a workflow command line."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    out = F.replace(F.replace(out, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    if prop:
        out = F.replace(F.replace(out, F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    return out


def _fnv_many(texts: list[str]) -> list[str]:
    """FNV-1a of many strings at once: one vector step per byte position."""
    data = [(t or "").encode("utf-8") for t in texts]
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    sizes = np.array([len(data[i]) for i in order], dtype=np.int64)
    flat = np.frombuffer(b"".join(data[i] for i in order), dtype=np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    state = np.full(len(data), FNV_OFFSET, dtype=np.uint64)
    prime = np.uint64(FNV_PRIME)
    step = 0
    live = len(data)
    with np.errstate(over="ignore"):
        while True:
            live = int(np.searchsorted(-sizes, -step, side="left"))
            if live < 16:
                break
            state[:live] = (state[:live] ^ flat[starts[:live] + step]) * prime
            step += 1
    out = [""] * len(data)
    for row, i in enumerate(order):
        h = int(state[row])
        if row < live:
            for b in data[i][step:]:
                h = ((h ^ b) * FNV_PRIME) & _MASK64
        out[i] = f"{h:016x}"
    return out


def _fnv_series(text: pd.Series) -> pd.Series:
    return pd.Series(_fnv_many(text.tolist()))


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a in hexadecimal. Spark has no such function, so Arrow batches are hashed with numpy."""
    return F.pandas_udf(_fnv_series, "string")(text)


def register(spark: SparkSession) -> None:
    """Make the scalar functions callable from SQL."""
    spark.udf.register("fnv1a64", F.pandas_udf(_fnv_series, "string"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION grade(score DOUBLE) RETURNS STRING RETURN CASE "
        + " ".join(f"WHEN score >= {limit} THEN '{name}'" for name, limit in GRADE_LIMITS)
        + f" ELSE '{LAST_GRADE}' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION is_secret_name(name STRING) RETURNS BOOLEAN RETURN "
        f"lower(name) rlike r'({SECRET_WORDS})s?\\z' AND NOT lower(name) rlike r'_({LOCATION_ENDINGS})\\z'"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION is_pinned_image(image STRING) RETURNS BOOLEAN RETURN "
        "trim(image) = '' OR contains(image, '$') OR contains(image, '@sha256:') OR "
        "(contains(element_at(split(trim(image), '/'), -1), ':') AND "
        "element_at(split(element_at(split(trim(image), '/'), -1), ':'), -1) NOT IN ('', 'latest'))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION matches_rule(pattern STRING, rule STRING) RETURNS BOOLEAN RETURN "
        "pattern = 'ALL' OR pattern = rule OR (endswith(pattern, '*') AND "
        "startswith(rule, substring(pattern, 1, length(pattern) - 1)))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(t STRING) RETURNS DOUBLE RETURN "
        "aggregate(array_distinct(filter(split(t, ''), c -> c <> '')), 0.0D, (acc, c) -> acc - "
        "(size(filter(split(t, ''), x -> x = c)) / length(t)) * "
        "log2(size(filter(split(t, ''), x -> x = c)) / length(t)))"
    )
