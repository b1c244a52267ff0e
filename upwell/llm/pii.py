"""Personal data: patterns propose spans, checksums confirm, nearby words adjust a score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NullType, StructType

from upwell.llm._common import ship_package

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds that the method adds.
EXTRA_KINDS = ["iban", "ssn", "nino", "card13"]
KINDS = BASE_KINDS + EXTRA_KINDS

#: Base patterns by contract (fixed values); possessive where a run can't match otherwise.
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NINO = re.compile(r"(?<![A-Za-z0-9])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D](?![A-Za-z0-9])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W\d_]+")

#: Words that make a kind likelier nearby (lower case), and how far to look.
CONTEXT = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "login", "client"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "nino": {"nino", "insurance", "national"},
    "card13": {"card", "credit", "visa", "payment", "carte", "karte", "tarjeta"},
}
CONTEXT_CHARS, CONTEXT_GAIN = 48, 0.25
#: What a confirmed span starts with; extra kinds count from a score of THRESHOLD.
START = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.5, "nino": 0.5, "card13": 0.5}
THRESHOLD = 0.7


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters count 10 to 35."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # every match has one @, so a look around each @ replaces trying each start
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def _base(text: str) -> Iterator[tuple[int, int, str]]:
    for a, b in _emails(text):
        yield a, b, "email"
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            yield m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield m.start(), m.end(), "phone"


def _extra(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _IBAN.finditer(text):
        # the pattern may run into words that follow: the longest valid part counts
        for end in range(m.end(), m.start() + 14, -1):
            if (end == len(text) or not text[end].isalnum()) and text[end - 1] != " " and mod97(text[m.start() : end]):
                yield m.start(), end, "iban"
                break
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.start(), m.end(), "ssn"
    for m in _NINO.finditer(text):
        yield m.start(), m.end(), "nino"
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) == 13 and digits[0] == "4" and luhn(digits):
            yield m.start(), m.end(), "card13"


def _score(text: str, start: int, end: int, kind: str) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(near)}
    return min(1.0, START[kind] + CONTEXT_GAIN * bool(words & CONTEXT[kind]))


_MAY_HOLD = re.compile(r"[0-9@]").search


def find_spans(text: str) -> list[Span]:
    """All spans of a text, sorted by start, then kind; extra ones never touch base ones."""
    if not _MAY_HOLD(text):
        return []
    base = sorted((Span(a, b, k, _score(text, a, b, k)) for a, b, k in _base(text)), key=_place)
    starts, reached = [s.start for s in base], list(accumulate((s.end for s in base), max))
    more = []
    for a, b, k in _extra(text):
        before = bisect_left(starts, b)  # base spans that begin before the end
        if before and reached[before - 1] > a:
            continue
        score = _score(text, a, b, k)
        if score >= THRESHOLD:
            more.append(Span(a, b, k, score))
    return sorted(base + more, key=_place)


def _place(s: Span) -> tuple[int, int]:
    return s.start, KINDS.index(s.kind)


_RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_extra long, top_score double"


def scan_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts by base kind, ``base_sha256``, ``spans``,

    ``n_extra`` (spans of the added kinds) and ``top_score`` (0 without spans). Spans are
    kind:start:end in code points, end exclusive. A null text counts as empty. Each row
    stands alone, null and repeated doc_ids included; doc_id keeps its type, and other
    columns are ignored.
    """
    ship_package(docs.sparkSession)
    doc_id = F.col("doc_id").cast(LongType()) if isinstance(docs.schema["doc_id"].dataType, NullType) else F.col("doc_id")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(_RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                spans = find_spans(text.as_py() or "")
                shown = [f"{s.kind}:{s.start}:{s.end}" for s in spans]
                base = ",".join(x for x, s in zip(shown, spans, strict=True) if s.kind in BASE_KINDS)
                counts = [sum(s.kind == k for s in spans) for k in BASE_KINDS]
                found.append([*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(shown), len(spans) - sum(counts), max((s.score for s in spans), default=0.0)])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.float64()]
            cols = [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], schema.names)

    return rows.mapInArrow(run, schema)
