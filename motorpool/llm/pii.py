"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import map_texts

#: The kinds in the order in which spans are listed; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "ssn", "secret")

#: Score of a confirmed span before its surroundings count.
CONFIRMED = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "short_card": 0.4, "ssn": 0.35, "secret": 0.5}
#: Words near a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "bank", "account", "transfer", "bic"},
    "short_card": {"card", "amex", "credit", "debit", "payment"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "secret": {"token", "password", "passwd", "secret", "key", "apikey", "credentials"},
}
AGAINST = {"order", "invoice", "version", "serial", "isbn", "tracking", "example"}
STEP = 0.2
BEFORE, AFTER = 60, 30
#: Spans of the added kinds need this score; base spans stay whatever their score is.
ENOUGH = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried once from its first digit: a start inside it cannot do better.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?:token|passw(?:or)?d|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?([A-Za-z0-9_+/-]{16,})", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go to the end, letters count from 10."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the @ outwards, so a long run of letters without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def _cards(text: str, least: int, most: int) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= least:
            digits = m[0].replace(" ", "").replace("-", "")
            if least <= len(digits) <= most and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        # A word in capitals may follow the number, so shorter ends before a blank are tried too.
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]
        for end in ends:
            compact = text[m.start() : end].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield m.start(), end
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


PROPOSE = {
    "email": _emails,
    "ip": _ips,
    "card": lambda t: _cards(t, 16, 19),
    "phone": _phones,
    "iban": _ibans,
    "short_card": lambda t: _cards(t, 13, 15),
    "ssn": _ssns,
    "secret": lambda t: (m.span(1) for m in _SECRET.finditer(t)),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    around = set(_WORD.findall(text[max(0, start - BEFORE) : start].lower()))
    around.update(_WORD.findall(text[end : end + AFTER].lower()))
    value = CONFIRMED[kind] + STEP * bool(around & CONTEXT[kind]) - STEP * bool(around & AGAINST)
    return round(min(1.0, max(0.0, value)), 3)


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def spans_of(text: str | None) -> list[dict]:
    """All spans of one text, by kind as listed and then by start; added ones do not overlap base ones."""
    text = text or ""
    base = {kind: list(PROPOSE[kind](text)) for kind in BASE}
    starts, ends = _merged([span for spans in base.values() for span in spans])
    found = []
    for kind in KINDS:
        for start, end in base[kind] if kind in base else PROPOSE[kind](text):
            value = score(text, kind, start, end)
            if kind not in base:
                before = bisect_left(starts, end) - 1  # the last stretch that starts before the span's end
                if value < ENOUGH or (before >= 0 and ends[before] > start):
                    continue
            found.append({"kind": kind, "start": start, "end": end, "score": value, "base": kind in base})
    return found


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        (
            "spans",
            pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])),
        ),
    ]
)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its spans, offsets in code points, ends exclusive.

    Nothing is shuffled; a text is read whole and once per kind, in time linear in its
    length but for the sorting of its spans.
    Null and empty texts have no spans, a null doc_id stays null, repeated rows give repeated
    rows, other columns are not read.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return map_texts(chosen, lambda c: ((i, spans_of(t)) for i, t in zip(*c)), SCHEMA)


def redact(text: str | None, spans: list) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    if text is None:
        return None
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind']}]"]
            done = s["end"]
    return "".join([*out, text[done:]])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda s: s["base"]))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))
