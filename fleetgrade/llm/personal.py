"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (``email ip card phone``) are every confirmed match, whatever its score.
Added kinds are proposals that stand only with enough score: ``iban`` is confirmed
by its mod-97 remainder, ``ssn`` needs a context word close by.

One pass per text and kind in the order given, leftmost matches that do not overlap
within a kind; a match that fails its check is dropped and the search goes on
after it. Offsets count code points, the end is exclusive. Whole texts are read;
one Arrow batch is in memory at a time.

Defined cases: a null or empty text has no spans and the hash of the empty string;
a null id is carried along; repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import documents, rows_of, small_batches, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
ADDED_SCORE = 0.7
WINDOW = 48

# Fixed values of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: a run that fails from its start fails from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "insurance number"),
}
CONFIRMED = {"email": 0.6, "ip": 0.6, "card": 0.9, "phone": 0.5, "iban": 0.9, "ssn": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    account = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, started at the sign instead of at every letter."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and not NOT_LOCAL.match(text[start - 1]):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            floor = found.end()
        at = text.find("@", max(at + 1, floor))


def _checked(kind: str, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for found in pattern.finditer(text):
        match = found.group()
        if kind == "ip":
            good = all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in match.split(".")))
        elif kind == "iban":
            good = mod97(match)
        elif kind == "ssn":
            good = match[:3] not in ("000", "666") and match[0] != "9" and match[4:6] != "00" and match[7:] != "0000"
        else:
            digits = "".join(c for c in match if "0" <= c <= "9")
            good = 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15
        if good:
            yield found.span()


def score_of(kind: str, text: str, start: int, end: int) -> float:
    """Confidence: what confirmed the span, raised by a context word close to it."""
    near = (text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]).lower()
    return min(1.0, CONFIRMED[kind] + 0.3 * any(w in near for w in CONTEXT[kind]))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind and start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN), ("ssn", SSN)):
        spans += ((kind, a, b) for a, b in _checked(kind, pattern, text))
    scored = ((kind, a, b, score_of(kind, text, a, b)) for kind, a, b in spans)
    return [s for s in scored if s[0] in BASE or s[3] >= ADDED_SCORE]


SPANS = "array<struct<kind:string,start:long,end:long,score:double,found:string>>"


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, with the text found and a score."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("found", pa.string())]))

    def scan(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s), found=text[s[1]:s[2]]) for s in find_spans(text)] for (text,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    picked = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return picked.mapInArrow(scan, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return personal_spans(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


QUERIES = {"op8_personal_data": op8_personal_data}
ORACLES: dict[str, str] = {}
