"""Boolean trigram queries that any text matching a regular expression must satisfy."""

from __future__ import annotations

import itertools

#: Alternatives beyond which a stretch of a pattern is read as unknown text.
MOST_BRANCHES = 32
MOST_CLASS = 8

#: The set of texts that a part of a pattern may be, or None where it may be anything.
Part = set[str] | None


class _Reader:
    """Reads a pattern of literals, classes, groups, alternatives and repeats into consecutive parts.

    Anything else that a pattern may hold (look-around, references) is a ValueError.
    """

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def whole(self) -> list[Part]:
        parts = self.alternatives()
        if self.at < len(self.pattern):
            raise ValueError(f"unbalanced pattern: {self.pattern}")
        return parts

    def take(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def alternatives(self) -> list[Part]:
        options = [self.sequence()]
        while self.take("|"):
            options.append(self.sequence())
        if len(options) == 1:
            return options[0]
        texts = [_product(o) for o in options]
        return [None if None in texts else set().union(*texts)]

    def sequence(self) -> list[Part]:
        out: list[Part] = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            out += self.repeated(self.atom())
        return out

    def atom(self) -> list[Part]:
        if self.take("("):
            if self.take("?") and not (self.take(":") or self.take("i:")):
                raise ValueError(f"cannot read this group of {self.pattern}")
            inside = self.alternatives()
            if not self.take(")"):
                raise ValueError(f"unbalanced pattern: {self.pattern}")
            return inside
        if self.take("["):
            return [self.members()]
        ch = self.pattern[self.at]
        if ch == "\\":
            return [self.escaped()]
        self.at += 1
        return [] if ch in "^$" else [None if ch == "." else {ch}]

    def escaped(self) -> Part:
        kind = self.pattern[self.at + 1]
        self.at += 2
        if kind == "x":
            self.at += 2
            return {chr(int(self.pattern[self.at - 2 : self.at], 16))}
        if kind.isalnum():
            if kind not in "tnrfvdDwWsSbB":
                raise ValueError(f"cannot read \\{kind} of {self.pattern}")
            return {"t": {"\t"}, "n": {"\n"}, "r": {"\r"}, "f": {"\f"}, "v": {"\v"}, "b": {""}, "B": {""}}.get(kind)
        return {kind}

    def members(self) -> Part:
        """Members of a class, None where it is large, a range or negated."""
        out: Part = None if self.take("^") else set()
        first = True
        while first or not self.take("]"):
            first = False
            if self.pattern[self.at] == "\\":
                one = self.escaped()
            else:
                one = {self.pattern[self.at]}
                self.at += 1
            if self.pattern[self.at] == "-" and self.pattern[self.at + 1] != "]":  # a range
                self.at += 1
                if self.pattern[self.at] == "\\":
                    self.escaped()
                else:
                    self.at += 1
                one = None
            out = None if out is None or one is None else out | one
        return out if out is not None and len(out) <= MOST_CLASS else None

    def repeated(self, parts: list[Part]) -> list[Part]:
        least, most = 1, 1
        if self.take("?"):
            least = 0
        elif self.take("*") or self.take("+"):
            least, most = int(self.pattern[self.at - 1] == "+"), -1
        elif self.take("{"):
            end = self.pattern.index("}", self.at)
            low, comma, high = self.pattern[self.at : end].partition(",")
            least, most = int(low or 0), int(high) if high else -1 if comma else int(low)
            self.at = end + 1
        else:
            return parts
        if not self.take("?"):  # lazy or possessive repeats match the same kind of text
            self.take("+")
        inner = _product(parts)
        if inner is not None and (least, most) == (0, 1):
            return [inner | {""}]
        if inner is not None and least == most <= 8:
            return [_product([inner] * least)]
        return [None]


def _product(parts: list[set[str] | None]) -> set[str] | None:
    texts = {""}
    for part in parts:
        if part is None or len(texts) * len(part) > MOST_BRANCHES:
            return None
        texts = {a + b for a in texts for b in part}
    return texts


def derive(pattern: str) -> list[frozenset[str]]:
    """Disjunction of conjunctions of lower-case trigrams; empty where nothing is mandatory.

    Each maximal run of known parts gives one clause: one of its texts must
    occur, so all trigrams of one of them must. Clauses are multiplied out; one
    with a text of fewer than three characters demands nothing.
    """
    runs: list[list[set[str]]] = [[]]
    for part in _Reader(pattern).whole():
        if part is None or len(_product([*runs[-1], part]) or ()) == 0:
            runs.append([])
        if part is not None:
            runs[-1].append(part)
    clauses = []
    for run in runs:
        texts = _product(run) or {""}
        grams = [frozenset(t[i : i + 3].lower() for i in range(len(t) - 2)) for t in texts]
        if all(grams):
            clauses.append(sorted(set(grams), key=sorted))
    if not clauses:
        return []
    best = [frozenset().union(*pick) for pick in itertools.islice(itertools.product(*clauses), MOST_BRANCHES * MOST_BRANCHES)]
    if len(best) < _count(clauses):
        return max(clauses, key=lambda x: min(map(len, x)))
    return [x for x in dict.fromkeys(best) if not any(y < x for y in best)]


def _count(clauses: list) -> int:
    n = 1
    for x in clauses:
        n *= len(x)
    return n


def satisfied(text: str, query: list[frozenset[str]]) -> bool:
    """Whether a text may match: the plain reading of the index, for tests."""
    low = text.lower()
    return not query or any(all(g in low for g in branch) for branch in query)
