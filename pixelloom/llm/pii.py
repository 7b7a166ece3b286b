"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Proposed kinds are e-mail, IP, card (Luhn), phone and, beyond the base, iban
(mod-97). Each confirmed span has a prior by kind; words within 40 code points
on either side move it up ("card", "tel", ...) or down ("order", "version",
...). Base spans always stay, whatever their score; added spans stay from
`min_score` on, and only where no base span overlaps them.

Offsets are code points, ends exclusive. Defined results: null and empty texts
have no spans; repeated rows each get their row; digits in runs of any length
are compared as text, never as numbers; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_column

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
MIN_SCORE = 0.5
CONTEXT = 40
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits in which a match fails fails from each of its digits, so a search begins at runs' first digits only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looked ahead for, so that one that fails hides none that begins inside it.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
#: Characters of an IBAN by country.
_IBAN_LENGTH = {
    c: n
    for n, cs in (
        (15, "NO"), (16, "BE"), (18, "DK FI FO GL NL"), (19, "MK SI"), (20, "AT BA EE KZ LT LU XK"), (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ TL"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"),
        (25, "LY PT ST"), (26, "IS TR"), (27, "FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HU LB PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU"), (31, "MT SC"), (32, "LC"),
    )
    for c in cs.split()
}
_WORD_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8}
_FOR = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    "card": re.compile(r"card|visa|master|credit|payment|karte|carte|tarjeta|pay", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|telefon|appel|llam", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta|transfer", re.I),
}
_AGAINST = {
    "email": re.compile(r"example|noreply", re.I),
    "ip": re.compile(r"version|release|section|v\.", re.I),
    "card": re.compile(r"order|serial|isbn|tracking|invoice", re.I),
    "phone": re.compile(r"score|ratio|version|order", re.I),
    "iban": re.compile(r"serial|part|model|product", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    reach, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > reach and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, (reach := m.end())
        else:
            reach = max(reach, at + 1) if start < at else reach
        at = text.find("@", max(at + 1, reach))


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base: leftmost non-overlapping matches per kind, failing ones dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each candidate the part of its country's length, or for other countries the longest, that ends with a word and has the right checksum."""
    reach = 0
    for m in _IBAN.finditer(text):
        if m.start() < reach:
            continue
        a = m.start()
        for b in reversed([e.end() for e in _WORD_END.finditer(text, a, m.end(1) + 1) if e.end() <= m.end(1)]):
            size = b - a - text.count(" ", a, b)
            if size == _IBAN_LENGTH.get(text[a : a + 2], size) and mod97(text[a:b]):
                yield a, (reach := b)
                break


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
    return min(1.0, max(0.0, _PRIOR[kind] + 0.2 * bool(_FOR[kind].search(near)) - 0.4 * bool(_AGAINST[kind].search(near))))


def find_spans(text: str, min_score: float = MIN_SCORE) -> list[dict]:
    """All spans of a text, by kind as listed, then start."""
    base = base_spans(text)
    found = [(k, a, b, _score(text, k, a, b)) for k, a, b in base]
    if _DIGIT.search(text):
        for a, b in _ibans(text):
            if not any(x < b and a < y for _, x, y in base) and (s := _score(text, "iban", a, b)) >= min_score:
                found.append(("iban", a, b, s))
    return [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in found]


def _join(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def redact(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the first one's kind in brackets."""
    out, reach = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= reach:
            out += [text[reach : s["start"]], f"[{s['kind'].upper()}]"]
        reach = max(reach, s["end"])
    return "".join([*out, text[reach:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """A row for each document: its id, spans (array of kind, start, end, score), counts by base kind, base_sha256 and all spans as text."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t, min_score) for t in text_column(batch, "text").to_pylist()]
            out = {"id": batch.column("id"), "found": pa.array(found, _SPAN_TYPE)}
            for kind in BASE:
                out[f"n_{kind}"] = pa.array([sum(s["kind"] == kind for s in x) for x in found], pa.int64())
            out["base_sha256"] = [hashlib.sha256(_join([s for s in x if s["kind"] in BASE]).encode()).hexdigest() for x in found]
            out["spans"] = pa.array([_join(x) for x in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, found {_SPANS}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", min_score: float = MIN_SCORE) -> DataFrame:
    """The same documents, in place, with personal data replaced in the text; length_col, if there, follows the text. A null text stays null."""
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t, find_spans(t, min_score)) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        kept = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(kept))
    return out
