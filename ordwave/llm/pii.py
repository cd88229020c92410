"""Personal data and secrets: patterns propose spans, checksums confirm them, nearby words adjust their score.

A span whose kind has a validator (card, iban, routing, ssn) and that fails it is never reported,
whatever stands near it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices

#: Kinds in the order in which equal starts are listed; the first four are kept whatever their score.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "routing", "key", "secret"]
BASE = 4

_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that does not begin a match where the run begins does not begin one further on.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ROUTING = re.compile(r"(?<![0-9-])[0-9]{9}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])A(?:KI|SI)A[0-9A-Z]{16}(?![A-Za-z0-9])")
# Long unbroken strings with digits and letters; a run is looked at once, where it begins.
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+")

#: Score of a span by its pattern alone and with its checksum, and what a context word adds.
PATTERN_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.3, "routing": 0.1, "key": 0.9, "secret": 0.3}
CHECKSUM_SCORE = {"card": 0.4, "iban": 0.6, "routing": 0.2}
CONTEXT_SCORE, REACH = 0.3, 48
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|debit|visa|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security)\b"),
    "routing": re.compile(r"(?i)\b(?:routing|aba)\b"),
    "key": re.compile(r"(?i)\b(?:aws|access|key)\b"),
    "secret": re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|credential)s?(?![a-z])"),
}


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(code: str) -> bool:
    """The check digits of bank accounts: country and check digits last, letters as 10 to 35, remainder 1."""
    value = 0
    for ch in code[4:] + code[:4]:
        value = (value * (10 if ch.isdigit() else 100) + int(ch, 36)) % 97
    return value == 1


def routing_check(digits: str) -> bool:
    """The check digit of bank routing numbers: digits weighted 3, 7, 1 by turns add up to a multiple of 10."""
    return sum(int(d) * (3, 7, 1)[i % 3] for i, d in enumerate(digits)) % 10 == 0 and digits != "000000000"


def _ibans(text: str):
    """Runs that pass mod-97; of a run's ends before something that is no letter or digit, the first that passes counts."""
    m = _IBAN.search(text)
    while m:
        a, z = m.span()
        ends = [i for i in range(a + 15, z + 1) if (i == len(text) or not (text[i].isascii() and text[i].isalnum())) and text[i - 1] != " "]
        end = next((i for i in ends if len(code := text[a:i].replace(" ", "")) >= 15 and mod97(code)), None)
        if end:
            yield a, end
        m = _IBAN.search(text, end or a + 1)


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            yield lo, end
        at = text.find("@", max(at + 1, end))


def find_spans(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the personal data of a text, by start, then kind as listed.

    Offsets are code points, end exclusive. Spans of one kind do not overlap; of different kinds they may.
    """
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
        found += [("iban", a, b) for a, b in _ibans(text)]
        if "-" in text:
            found += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
        found += [("routing", *m.span()) for m in _ROUTING.finditer(text) if routing_check(m[0])]
        if "AKIA" in text or "ASIA" in text:
            found += [("key", *m.span()) for m in _KEY.finditer(text)]
        found += [("secret", *m.span()) for m in _SECRET.finditer(text)]
    out = []
    for kind, a, b in found:
        near = CONTEXT[kind].search(text[max(0, a - REACH) : a]) or CONTEXT[kind].search(text[b : b + REACH])
        score = PATTERN_SCORE[kind] + CHECKSUM_SCORE.get(kind, 0) + CONTEXT_SCORE * bool(near)
        if KINDS.index(kind) < BASE or score >= threshold:
            out.append((kind, a, b, round(min(1.0, score), 3)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Finds personal data in every whole text.

    Returns for each row: id_col, spans (array of kind, start, end, score), redacted (the text with the
    spans replaced), and the columns named in `carry`. Email, ip, card and phone stay whatever their
    score; other kinds need `threshold`.

    Null text: no spans, redacted is null. Empty text: no spans. Null, tied or repeated ids: each row by
    itself. An empty table gives an empty one. Columns that are not carried are ignored, whatever
    their names. Time is linear in a text's length, also for long runs of digits or of one character.
    """
    carry = carry or []
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([source.schema["id"], T.StructField("spans", T.ArrayType(span)), T.StructField("redacted", T.StringType()), *[source.schema[f"c{i}"] for i in range(len(carry))]])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                found = [find_spans(t, threshold) if t else [] for t in texts]
                clean = [redact(t, s) if s else t for t, s in zip(texts, found)]
                rows = [[{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in s] for s in found]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind), pa.array(clean, pa.string()), *[batch.column(f"c{i}") for i in range(len(carry))]], names=schema.names)

    out = source.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "spans", "redacted", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
