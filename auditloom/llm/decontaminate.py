"""Benchmark decontamination by pigeonhole edit matching.

A passage with at most ``k`` edits leaves one of ``k + 1`` pieces of the item
untouched. All pieces of a block of items form one Aho-Corasick automaton; every
text is read against it once, and each place that a piece points to is verified
with Myers' bit-parallel distance over a window around it.

Items are a query set: they are read in blocks of at most ``BLOCK_BYTES`` of
text, each a bounded closure, so the benchmark's size bounds passes, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import by_bytes, docs_of, keep_rows, read

#: Edits allowed per character of an item.
ERROR_RATE = 0.07
#: Shorter items (after normalisation) are searched between word boundaries, since within words they would match by chance.
LEAST_WITHIN = 12
BLOCK_BYTES = 4 << 20


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate) if len(item) >= LEAST_WITHIN else 0


def between_words(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends within a word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(a) and not inside(b)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, text) of ``k + 1`` consecutive parts, as even as can be."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


@dataclass
class Pattern:
    """An item ready for Myers' algorithm."""

    text: str

    def __post_init__(self):
        self.masks: dict[str, int] = {}
        for i, ch in enumerate(self.text):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i
        self.top = 1 << (len(self.text) - 1)
        self.full = (1 << len(self.text)) - 1

    def best(self, window: str, k: int) -> tuple[int, int] | None:
        """(distance, end in the window) of the closest substring, the first of equals; None beyond ``k``."""
        masks, top, full = self.masks, self.top, self.full
        pv, mv, score = full, 0, len(self.text)
        found = None
        for j, ch in enumerate(window):
            eq = masks.get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
            if score <= k and (found is None or score < found[0]):
                found = (score, j + 1)
                if not score:
                    break
        return found


    def begin(self, before: str, distance: int) -> int:
        """Length of the end of ``before`` that has this (least) distance from the whole pattern; the
        one nearest to the pattern's length of equals."""
        masks, top, full = self.reversed.masks, self.top, self.full
        pv, mv, score, m = full, 0, len(self.text), len(self.text)
        best = (0, m) if m == distance else None
        for j, ch in enumerate(reversed(before), 1):
            eq = masks.get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | 1) & full  # an end that is not anchored would be free of cost
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
            if score == distance and (best is None or abs(j - m) < best[1]):
                best = (j, abs(j - m))
        return best[0] if best else m

    @cached_property
    def reversed(self) -> Pattern:
        return Pattern(self.text[::-1])


class Matcher:
    """Finds items in texts with at most their budget of edits."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.patterns: list[tuple[int, Pattern, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(text, rate)
            for offset, piece in pieces(text, k):
                places.setdefault(piece, []).append((len(self.patterns), offset))
            self.patterns.append((item_id, Pattern(text), k))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of all places of items in a normalised text, by item and place. Of
        places of one item that overlap the closest counts, then the first."""
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for last, (size, at) in self.automaton.iter(text):
            for p, offset in at:
                starts.setdefault(p, []).append(last + 1 - size - offset)
        out = []
        for p, begins in starts.items():
            item_id, pattern, k = self.patterns[p]
            m, hits = len(pattern.text), set()
            begins.sort()
            i = 0
            while i < len(begins):  # begins within k of each other share a window
                j = i
                while j + 1 < len(begins) and begins[j + 1] - begins[j] <= k:
                    j += 1
                todo = [(max(0, begins[i] - k), min(len(text), begins[j] + m + k))]
                while todo:  # around a place there may be others
                    a, b = todo.pop()
                    hit = pattern.best(text[a:b], k) if b - a >= m - k else None
                    if hit:
                        end = a + hit[1]
                        start = end - pattern.begin(text[max(0, end - m - k) : end], hit[0]) if hit[0] else end - m
                        todo += [(a, start), (end, b)]
                        if m >= LEAST_WITHIN or between_words(text, start, end):  # short items: without edits
                            hits.add((hit[0], start, end))
                i = j + 1
            last: list[tuple[int, int]] = []
            for distance, start, end in sorted(hits):
                if all(end <= a or start >= b for a, b in last):
                    last.append((start, end))
                    out.append((item_id, start, end, distance))
        return sorted(out)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size, read one block at a time; null items are left out."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        block.append((row["item_id"], normal(row["text"])))
        size += len(row["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``doc_id, item_id, start, end, distance``: one row per document row and place of an item in it.

    Places are in the normalised text. Null and empty texts match nothing; a
    repeated row repeats its matches; without items there are no rows.
    """
    rows, fields = docs_of(docs), [("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]

    def searched(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in by_bytes(batches):
                found = [(i, *m) for i, t in enumerate(batch.column("text").to_pylist()) for m in matcher.find(normal(t))]
                if found:
                    at, *columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], names=["doc_id", *(n for n, _ in fields)])

        return rows.mapInArrow(run, SCHEMA)

    parts = [searched(items) for items in item_blocks(benchmark)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], SCHEMA)


SCHEMA = "doc_id long, item_id long, start int, end int, distance int"


def remove(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found: one pass over them per block of items."""
    for items in item_blocks(benchmark):

        def begin(items=items):
            matcher = Matcher(items, rate)
            return lambda texts: [not matcher.find(normal(t)) for t in texts]

        docs = keep_rows(docs, begin)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
