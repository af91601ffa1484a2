"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Four kinds (e-mail, IP address, payment card, phone) are always kept once their pattern and validator
agree; further kinds (IBAN by mod 97, social security number, short cards) are kept if their score,
raised by context words close by, reaches the threshold.

Defined results: a null text has no spans; spans count code points, end exclusive; repeated rows give a
row each; an empty table gives an empty table; other columns are carried along, but for one named
p_spans, which is replaced. The pass is narrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from aerolake.llm.tables import without
from aerolake.llm.text import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "card_short")
THRESHOLD = 0.7
#: Context words are looked for this many code points before and after a span.
NEAR = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
#: Lengths of account numbers by country.
_IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 "
    "TN24 TR26 UA29 VA22 VG24 XK20 "
).split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a confirmed span without context, and what a context word adds.
_SCORES = {"email": 0.95, "ip": 0.75, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.45, "card_short": 0.45}
_CONTEXT_GAIN = 0.35
_CONTEXT = {
    "email": ("mail", "contact"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social security", "tax id"),
    "card_short": ("card", "visa", "amex", "credit", "payment"),
}
_CONTEXT_PATTERNS = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")", re.I) for k, v in _CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: the front goes to the end, letters count from 10, the rest modulo 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` in time linear in the text:
    only what stands around an @ sign is looked at."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        else:
            low = max(low, start)
        at = text.find("@", max(at + 1, low))


def _ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def _card(found: str, low: int, high: int) -> bool:
    digits = _digits(found)
    return low <= len(digits) <= high and luhn(digits)


def _ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The spans that ``mod97`` confirms: from each start the one of its country's length or else the longest.

    They end where a word ends, since the words behind an account number (a bank code, a currency, a year) may look
    like more of it."""
    m = _IBAN.search(text)
    while m:
        ends, end = [], m.end(1)
        while end > m.end():
            if not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()):
                ends.append((end, text[m.start() : end].replace(" ", "")))
            end = text.rfind(" ", m.end(), end)
        fixed = _IBAN_LENGTHS.get(m.group()[:2])
        ends = [e for e in sorted(ends, key=lambda e: len(e[1]) != fixed) if len(e[1]) >= 15]
        end = next((e for e, found in ends if mod97(found)), m.end())
        if end > m.end():
            yield m.start(), end
        m = _IBAN.search(text, end)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of all kinds, each kind from left to right without overlap."""
    for a, b in emails(text):
        yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if _ip(m.group()):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if _card(m.group(), 16, 19):
            yield "card", *m.span()
        elif _card(m.group(), 13, 15):
            yield "card_short", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                yield "phone", *m.span()
    for a, b in ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        if _ssn(m.group()):
            yield "ssn", *m.span()


def scored(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    text = text or ""
    out = []
    for kind, a, b in proposals(text):
        context = _CONTEXT_PATTERNS[kind]
        near = context.search(text[max(0, a - NEAR) : a]) or context.search(text[b : b + NEAR])
        score = min(1.0, _SCORES[kind] + (_CONTEXT_GAIN if near else 0.0))
        if kind in BASE_KINDS or score >= threshold:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def redacted(text: str | None, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [(text or "")[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + (text or "")[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, redact: bool = False) -> DataFrame:
    """The documents with ``p_spans`` in place of the text or, with ``redact``, beside the redacted text."""
    docs = without(docs, ["p_spans"])
    kept = [f for f in docs.schema.fields if redact or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "p_spans array<struct<kind:string,start:int,end:int,score:double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                spans = [scored(t, threshold) for t in texts]
                columns = [pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string()) if f.name == text else part.column(part.schema.get_field_index(f.name)) for f in kept]
                found = pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in spans], _SPANS)
                yield pa.RecordBatch.from_arrays([*columns, found], names=[*(f.name for f in kept), "p_spans"])

    return docs.mapInArrow(run, schema)
