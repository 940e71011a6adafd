"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import batch_column, bounded_batches

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "mac")
BASE = KINDS[:4]

# A run of digits is tried at its start only: what fails there fails at every later digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Fa-f:-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,64}|AIza[A-Za-z0-9_-]{35}|xox[abpr]-[A-Za-z0-9-]{10,72})(?![A-Za-z0-9])")
#: Score before any context, and what context words near the span add to it or take from it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.5, "secret": 0.9, "mac": 0.5}
CONTEXT_GAIN, CONTEXT_CHARS, MIN_SCORE = 0.15, 40, 0.5
#: Words that make a kind likelier nearby.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "kontakt", "correo"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password", "api"),
    "mac": ("mac", "device", "ethernet", "wifi", "adapter"),
}


#: Words that make a kind less likely nearby.
AGAINST = {
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "invoice", "tracking", "serial"),
    "phone": ("isbn", "order", "invoice", "tracking", "serial"),
    "ssn": ("isbn", "order", "invoice", "part", "serial"),
    "mac": ("hash", "checksum", "time"),
}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` finds, in time linear in the text: each match holds one @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _is_ip(text: str) -> bool:
    return all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in text.split("."))


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of each kind, without their scores."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if _is_ip(m[0]):
                    yield "ip", m.start(), m.end()
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    yield "phone", m.start(), m.end()
        for m in _IBAN.finditer(text):
            if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x):
                yield "iban", m.start(), m.end()
        if "-" in text:
            for m in _SSN.finditer(text):
                yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        yield "secret", m.start(), m.end()
    if ":" in text or "-" in text:
        for m in _MAC.finditer(text):
            yield "mac", m.start(), m.end()


_WORDS = re.compile(r"[^\W_]+")


def context_words(text: str, start: int, end: int) -> set[str]:
    """Words in lower case within CONTEXT_CHARS before start or behind end; a word that the distance cuts is none."""
    out = set()
    for low, high in ((max(0, start - CONTEXT_CHARS), start), (end, min(len(text), end + CONTEXT_CHARS))):
        for m in _WORDS.finditer(text, low, high):
            if (m.start() > low or low in (0, end) or not _WORDS.match(text, low - 1, low)) and (m.end() < high or high in (start, len(text)) or not _WORDS.match(text, high, high + 1)):
                out.add(m[0].lower())
    return out


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind and start; offsets in code points. Spans of the base kinds stay whatever their score."""
    out = []
    for kind, start, end in _proposals(text or ""):
        near = context_words(text, start, end)
        score = PRIOR[kind] + CONTEXT_GAIN * (not near.isdisjoint(CONTEXT[kind])) - CONTEXT_GAIN * (not near.isdisjoint(AGAINST.get(kind, ())))
        score = round(min(1.0, score), 2)
        if kind in BASE or score > MIN_SCORE:
            out.append(Span(kind, start, end, score))
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in angle brackets."""
    if not spans:
        return text
    parts, done, last = [], 0, -1
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= last:
            parts += [text[done : s.start], f"<{s.kind}>"]
        last = done = max(last, s.end)
    return "".join(parts) + text[done:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id and pii_spans, an array of kind, start, end and score.

    score: the kind's prior, more with whole words near the span that speak for the kind and less with those against it; kinds
    other than the base ones must pass MIN_SCORE. Null and empty texts have no spans; texts of any length are read whole, in time
    linear in them. Spans of different kinds may overlap, and equal scores tie: all are given. Repeated rows and null ids each give
    their own row; other columns are not read; an empty table gives no rows.
    """
    chosen = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find_spans(x.as_py())] for x in batch_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch_column(batch, "id"), pa.array(spans, _ARROW_SPANS)], ["id", "spans"])

    schema = T.StructType([T.StructField("id", chosen.schema["id"].dataType), T.StructField("spans", SPANS)])
    return chosen.mapInArrow(scan, schema).select(F.col("id").alias(id_col), F.col("spans").alias("pii_spans"))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of personal data in text_col replaced by their kind; all rows and columns stay."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda x: redacted(x, find_spans(x)), na_action="ignore")

    return bounded_batches(docs).withColumn(text_col, clean(F.col(text_col)))


def span_digest(kinds: tuple[str, ...]):
    """pii_spans as kind:start:end, comma-joined, for the given kinds."""
    wanted = F.filter(F.col("pii_spans"), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_of(text: str | None) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in find_spans(text) if s.kind in BASE).encode()).hexdigest()
