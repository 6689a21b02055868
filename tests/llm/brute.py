"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets(text: str) -> dict:
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = [x[1] for x in spans]
    return {"n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "base_sha256": sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)))}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii(text: str) -> dict:
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    kinds = [x[0] for x in spans]
    return {f"n_{k}": kinds.count(k) for k in ("email", "ip", "card", "phone")} | {"base_sha256": sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str) -> set:
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(texts: dict[int, str]) -> dict[int, int]:
    """The least id that links of 75 per cent lead to, by holding every pair of texts against each other."""
    sets = {d: shingles(t) for d, t in texts.items()}
    near, ids = {d: {d} for d in sets}, sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
                near[b].add(a)
    out = {}
    for d in sets:
        reached, todo = {d}, [d]
        while todo:
            new = near[todo.pop()] - reached
            reached |= new
            todo += new
        out[d] = min(reached)
    return out


def passages(texts: dict[int, str], items: dict[int, str], rate: float) -> dict[tuple[int, int], int]:
    """Least edit distance of every item to a part of every text, where it is within the item's budget: the whole
    table of distances, row by row over all texts end to end."""
    gap, out = "\0" * 400, {}
    joined = gap.join(texts.values()) + gap
    codes = np.array([ord(c) for c in joined], np.int32)
    ends = np.cumsum([len(t) + len(gap) for t in texts.values()])
    place = np.arange(len(codes) + 1)
    for item, pattern in items.items():
        k = int(len(pattern) * rate)
        row = np.zeros(len(codes) + 1, np.int32)
        for c in pattern:
            new = np.minimum(row + 1, np.r_[row[0] + 1, row[:-1] + (codes != ord(c))])
            new[0] = row[0] + 1
            row = np.minimum.accumulate(new - place) + place
        for doc, a, b in zip(texts, np.r_[0, ends[:-1]], ends, strict=True):
            if (least := int(row[a + 1 : b - len(gap) + 1].min(initial=len(pattern)))) <= k:
                out[doc, item] = least
    return out


def masked(text: str, rules) -> str:
    """A text with the merged spans of all rules replaced."""
    spans = sorted(m.span() for r in rules for m in re.finditer(r.pattern, text, re.A) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "<secret>"
        at = max(at, b)
    return out + text[at:]


def resampled(pcm: list[int]) -> list[int]:
    """Twice the rate: samples stay, a half-band filter makes those between, the ends are held."""
    taps, out, n = (-3, 13, -42, 288, 288, -42, 13, -3), [], len(pcm)
    for i, v in enumerate(pcm):
        total = sum(t * pcm[min(n - 1, max(0, i - 3 + j))] for j, t in enumerate(taps))
        out += [v, max(-32768, min(32767, (total + 256) >> 9))]
    return out


def mulaw(code: int) -> int:
    code = ~code & 255
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return -size if code & 128 else size


def alaw(code: int) -> int:
    code ^= 0x55
    size, segment = (code & 15) << 4, code >> 4 & 7
    size = size + 8 if not segment else size + 0x108 << segment - 1
    return size if code & 128 else -size
