"""Personal data: expressions propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import map_texts, read

#: The contract's four kinds in its order, then added kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Whole words that make a span of a kind likelier within the window on either side of it.
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
#: Score of a confirmed span by itself, and with a context word.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "ssn": 0.5}
RAISED = 0.3
WINDOW = 40
_CONTEXT = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(words) + r")(?![^\W_])", re.I) for k, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    moved = s[4:] + s[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A run may go on into the words after it, so the longest end between words whose checksum holds is taken."""
    for m in _IBAN.finditer(text):
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not text[end : end + 1].isalnum() and 15 <= len((own := text[m.start() : end]).replace(" ", "")) <= 34 and mod97(own):
                yield m.start(), end
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The only @ of a match ends its local part, so each @ is tried with the run before it."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def find(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end) of confirmed spans, by kind and then by start, in code points."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    out += [(4, *span) for span in ibans(text)]
    out += [(5, *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    return out


def score(text: str, rank: int, start: int, end: int) -> float:
    """The kind's prior, raised where a context word stands before or after the span."""
    kind = KINDS[rank]
    a, b = max(0, start - WINDOW), min(len(text), end + WINDOW)
    before, after = text[a:start], text[end:b]
    near = any(m.start() or not a for m in _CONTEXT[kind].finditer(before)) or any(m.end() < len(after) or b == len(text) for m in _CONTEXT[kind].finditer(after))
    return min(1.0, PRIOR[kind] + RAISED * near)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<kind,start,end,score>>`` for every row, in code points, end exclusive.

    Null and empty texts have no spans; equal rows give equal spans.
    """

    def work(texts: list[str]):
        return [[[{"kind": KINDS[k], "start": s, "end": e, "score": score(t, k, s, e)} for k, s, e in find(t)] for t in texts]]

    return map_texts(docs, {"spans": "array<struct<kind:string,start:int,end:int,score:double>>"}, lambda: work, {"spans": SPANS})


def summary(text: str) -> tuple:
    """Counts of the base kinds, hash of their spans, all spans, and the best score."""
    spans = find(text)
    base = [x for x in spans if x[0] < BASE]
    kinds = [x[0] for x in base]
    return (*(kinds.count(k) for k in range(BASE)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), max((score(text, k, s, e) for k, s, e in spans), default=0.0))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    fields = {f"n_{k}": "long" for k in KINDS[:BASE]} | {"base_sha256": "string", "spans": "string", "top_score": "double"}
    return map_texts(read(spark, sf_dir, "documents"), fields, lambda: lambda texts: list(zip(*map(summary, texts), strict=True)))
