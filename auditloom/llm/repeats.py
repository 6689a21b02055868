"""Removal of repeated passages by distributed prefix doubling over sampled suffixes.

A suffix array of all positions would sort a row per byte several times over.
The only order that matters here is whether the first ``LENGTH`` bytes of a
suffix also start one in an earlier document, so ranks are class names, classes
of one member are dropped as prefix doubling drops unique ranks, and names of
growing length are asked for only where the shorter ones are shared:

1. Names of whole texts find exact copies of earlier ones.
2. Names of 32 bytes. Of the 19 that lie in a window of 50 bytes the least one
   stands for the window, so equal windows have equal samples. Sampled names are
   sorted in buckets; names in one document only are unique, and so is every
   window that they stand for.
3. The windows left get names of their 50 bytes, which are sorted in buckets
   too. A window is a repeat if its name is also in an earlier document. Repeated
   windows' bytes are removed.

Documents lie in blocks of consecutive doc_ids, so a name's bucket answers
whether an earlier block has it, and the block itself knows its own documents. A
block sends a name once, whatever its count.

Names of windows have 96 bits: among n different windows two agree with a
probability of n**2 / 2**97, which is 0.3 % for the 2 * 10**13 shared-looking
windows of 100 TB. Samples (40 bits) only let windows through to that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import blocks as bl
from auditloom.llm.common import byte_view, docs_of, materialize, read
from auditloom.llm.textbytes import names32, names_at

LENGTH = 50
SAMPLE = 32
BLOCK_BYTES = 14 << 20
#: Text whose names are held at once.
PART_BYTES = 1 << 19
#: Bits of a sampled name that are sent; a clash only lets a window through to the full comparison.
SAMPLE_BITS = 40
LAST = (1 << 63) - 1  # place of rows without doc_id: after all others

#: Kinds of rows that travel: see ``blocks``. HASH and OWN are names of whole texts, COPY the doc_ids found by them.
COPY, SEED, KNOWN, WINDOW, HASH, OWN = 1, 2, 3, 4, 5, 6


def least_of(names: np.ndarray, width: int) -> np.ndarray:
    """Least value among each ``width`` consecutive ones, by doubling."""
    size = 1
    while size * 2 <= width:
        names = np.minimum(names[:-size], names[size:])
        size *= 2
    rest = width - size
    return np.minimum(names[: len(names) - rest], names[rest:]) if rest else names


def among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in sorted ``held``."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def grouped(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the (one, other) pairs that puts equal ones together, by ``one``, and which begin a group."""
    order = np.argsort(one)
    a, b = one[order], other[order]
    new = a[1:] != a[:-1]
    if np.any(~new & (b[1:] != b[:-1])):  # equal halves of different names: rare, and sorted in full then
        order = np.lexsort((other, one))
        a, b = one[order], other[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.r_[np.ones(min(len(a), 1), bool), new]


class Part:
    """Some documents of a block, each of at least ``length`` bytes: the sample of every window, run by run."""

    def __init__(self, rows: np.ndarray, raw: np.ndarray, offsets: np.ndarray, length: int):
        self.rows, self.raw, self.offsets, self.length = rows, raw, offsets, length
        seed = least_of(names32(raw) >> np.uint64(64 - SAMPLE_BITS), length - SAMPLE + 1)
        self.valid = np.ones(len(seed), bool)
        self.valid[(offsets[1:-1, None] - np.arange(1, length)).ravel()] = False  # windows over two documents
        begins = self.valid.copy()
        begins[1:] &= (seed[1:] != seed[:-1]) | ~self.valid[:-1]
        self.begin = np.flatnonzero(begins)
        self.seed = seed[self.begin]

    def samples(self) -> np.ndarray:
        """Sorted distinct names, each with a lowest bit that tells whether several documents here have it."""
        row = np.searchsorted(self.offsets, self.begin, side="right") - 1
        pairs = np.sort(self.seed << np.uint64(64 - SAMPLE_BITS) | row.astype(np.uint64))
        name = pairs >> np.uint64(64 - SAMPLE_BITS)
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        several = pairs[first] != pairs[np.r_[first[1:], len(pairs)] - 1]
        return name[first] << np.uint64(1) | several

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Places of the windows whose sample is in sorted ``shared``."""
        held = np.repeat(among(self.seed, shared), np.diff(np.r_[self.begin, len(self.valid)]))
        return np.flatnonzero(held & self.valid)


class Block:
    """What was sent to a block: its texts, copies among them, and answers."""

    def __init__(self, got: dict, length: int):
        self.length = length
        tables = [bl.expand(data) for _, data in got.get(bl.TEXT, [])]
        self.table = pa.concat_tables(tables).combine_chunks()
        self.raw, self.offsets = byte_view(self.table.column("text"))
        self.sizes = np.diff(self.offsets)
        self.ids = self.table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        gone = [bl.expand(data).column("doc_id").to_numpy() for _, data in got.get(COPY, [])]
        self.copy = np.isin(self.ids, np.concatenate(gone)) & (self.sizes >= length) if gone else np.zeros(len(self.ids), bool)

    def parts(self) -> Iterator[Part]:
        """The rows that have windows and are no copies, in bounded pieces."""
        rows = np.flatnonzero((self.sizes >= self.length) & ~self.copy)
        ends = np.cumsum(self.sizes[rows])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, side="right")))
            own = rows[at:end]
            skips = np.flatnonzero(np.r_[True, np.diff(own) > 1, True])
            raw = np.concatenate([self.raw[self.offsets[own[a]] : self.offsets[own[b - 1] + 1]] for a, b in zip(skips[:-1], skips[1:], strict=True)])
            yield Part(own, raw, np.r_[0, np.cumsum(self.sizes[own])], self.length)
            at = end

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct sampled names, and whether several documents here have each."""
        marked = np.sort(np.concatenate([np.zeros(0, np.uint64), *(part.samples() for part in self.parts())]))
        name = marked >> np.uint64(1)
        first = np.flatnonzero(np.r_[np.ones(min(len(name), 1), bool), name[1:] != name[:-1]])
        several = (np.diff(np.r_[first, len(name)]) > 1) | (marked[first] & np.uint64(1) == 1)
        return name[first], several

    def windows(self, got: dict) -> tuple[list[tuple[Part, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """Candidate places by part, and name (both halves) and doc_id rank of all of them end to end."""
        answers = [bl.numbers(bl.expand(data), "key") for kind in (KNOWN, SEED) for _, data in got.get(kind, [])]
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *answers]))
        rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int32)
        places, ones, others, docs = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for part in self.parts():
            place = part.candidates(shared)
            one, other = names_at(part.raw, place, self.length)
            ones.append(one)
            others.append(other)
            docs.append(np.repeat(rank[part.rows], np.diff(np.searchsorted(place, part.offsets))))
            places.append((part.rows, part.raw, part.offsets, place.astype(np.int32)))
        return places, np.concatenate(ones), np.concatenate(others), np.concatenate(docs)


def _sample_bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of names, so that a bucket's names differ little and pack well."""
    return ((names * np.uint64(buckets)) >> np.uint64(SAMPLE_BITS)).astype(np.int32)


def _name_bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _shared_samples(bucket, got):
    """Tells each block which of the names it sent another block has; what a block told itself goes on."""
    for origin, data in got.get(KNOWN, []):
        yield KNOWN, origin, origin, data
    if not got.get(SEED):
        return
    origins = [origin for origin, _ in got[SEED]]
    keys = [bl.numbers(bl.expand(data), "key") for _, data in got[SEED]]
    names = np.sort(np.concatenate(keys))
    twice = np.unique(names[1:][names[1:] == names[:-1]])
    for origin, key in zip(origins, keys, strict=True):
        yield SEED, origin, bucket, bl.squeeze(key=key[among(key, twice)])


def _named_before(kind: int, late: int):
    """Tells each block which of the names it sent an earlier block has. Blocks from ``late`` on, of rows
    without doc_id, are no earlier than each other."""

    def work(bucket, got):
        for origin, data in got.get(OWN, []):
            yield OWN, origin, origin, data
        if not got.get(kind):
            return
        origins = [origin for origin, _ in got[kind]]
        tables = [bl.expand(data) for _, data in got[kind]]
        one, other = (np.concatenate([bl.numbers(t, n) for t in tables]) for n in ("key", "other"))
        edges = np.cumsum([0, *(t.num_rows for t in tables)])
        block = np.repeat(np.minimum(np.array(origins, np.int32), late), np.diff(edges))
        order, new = grouped(one, other)
        ranked = block[order]
        first = np.flatnonzero(new)
        answer = np.empty(len(one), bool)
        answer[order] = ranked > np.repeat(np.minimum.reduceat(ranked, first), np.diff(np.r_[first, len(one)]))
        for origin, a, b in zip(origins, edges[:-1], edges[1:], strict=True):
            yield kind, origin, bucket, bl.squeeze(v=pa.array(answer[a:b]))

    return work


def _sent(kind: int, block: int, one: np.ndarray, other: np.ndarray, buckets: int):
    """Distinct names of a block, to the buckets that they belong to."""
    order, new = grouped(one, other)
    pick = order[new]
    yield from bl.scatter(kind, block, one[pick], _name_bucket(one[pick], buckets), other=other[pick])


def _repeated(kind: int, got: dict, one: np.ndarray, other: np.ndarray, docs: np.ndarray, buckets: int) -> np.ndarray:
    """Which of a block's names (with the rank of their documents) an earlier document has, here or in another block."""
    if not len(one):
        return np.zeros(0, bool)
    order, new = grouped(one, other)
    first = np.flatnonzero(new)
    earlier = bl.gather(got.get(kind, []), _name_bucket(one[order[new]], buckets), "v", np.zeros(len(first), bool))
    sizes = np.diff(np.r_[first, len(one)])
    ranked = docs[order]
    out = np.empty(len(one), bool)
    out[order] = np.repeat(earlier, sizes) | (ranked > np.repeat(np.minimum.reduceat(ranked, first), sizes))
    return out


def _whole_names(got: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc_ids (null: LAST) of a block's longer texts and both halves of their names."""
    kinds = got.get(HASH, []) + got.get(OWN, [])
    table = pa.concat_tables([bl.expand(data) for _, data in kinds])
    halves = np.frombuffer(b"".join(table.column("h").to_pylist()), "<u8").reshape(-1, 2)
    return table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False), halves[:, 0].copy(), halves[:, 1].copy()


def copies(rows: DataFrame, place, buckets: int, late: int, length: int) -> DataFrame:
    """Rows COPY to each block: doc_ids whose one text an earlier document has as a whole. A doc_id with
    several texts is compared in full, so that one copied text does not hide another."""
    hashed = rows.where(F.octet_length("text") >= length).select("doc_id", "spread", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"))

    def send(block, got):
        _, one, other = _whole_names(got)
        yield from _sent(HASH, block, one, other, buckets)
        for _, data in got[HASH]:
            yield OWN, block, block, data

    def settle(block, got):
        if not got.get(OWN):
            return
        ids, one, other = _whole_names({OWN: got[OWN]})
        unique, rank = np.unique(ids, return_inverse=True)
        hit = _repeated(HASH, got, one, other, rank.astype(np.int32), buckets)
        order, new = grouped(rank.astype(np.uint64), one ^ other)
        several = np.bincount(rank[order[new]], minlength=len(unique)) > 1  # two texts of one doc_id
        gone = unique[np.unique(rank[hit & ~several[rank]])]
        gone = gone[gone < LAST]
        if len(gone):
            yield COPY, block, block, bl.squeeze(doc_id=gone)

    return bl.at_each(bl.at_each(bl.at_each(bl.dealt(hashed, place, HASH, ["doc_id", "h"]), send), _named_before(HASH, late)), settle)


def edges_of(docs: DataFrame, blocks: int) -> list[float]:
    """Doc_ids that part the documents into blocks of about equal numbers."""
    if blocks < 2:
        return []
    return sorted(set(docs.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.1 / blocks)))


def find_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left) for every row.

    ``length`` is at least 32. A byte goes if a ``length``-byte string over it also starts in a document with
    a smaller doc_id, judged on the input. Null and empty texts lose nothing; rows
    of one doc_id do not repeat each other; rows without doc_id come after all
    others and do not repeat each other; an empty table gives no rows.
    """
    if length < SAMPLE:
        raise ValueError(f"strings of {SAMPLE} bytes or more")
    null = F.col("doc_id").isNull()
    totals = docs_of(docs).groupBy(null.alias("null")).agg(F.sum(F.octet_length("text")).alias("b"))
    size = {r["null"]: r["b"] for r in totals.collect()}
    buckets, spread = (max(1, -(-int(size.get(k) or 0) // block_bytes)) for k in (False, True))
    rows = docs_of(docs).withColumn("spread", F.when(null, F.pmod(F.xxhash64("text"), F.lit(spread)).cast("int")))
    edges = edges_of(rows.where(~null), buckets)
    place, late = bl.by_range(edges), len(edges) + 1
    text = bl.dealt(rows, place, bl.TEXT, ["doc_id", "text"])
    base = text.unionAll(materialize(copies(rows, place, buckets, late, length)))

    def send_samples(block, got):
        names, several = Block(got, length).samples()
        yield from bl.scatter(SEED, block, names, _sample_bucket(names, buckets))
        yield KNOWN, block, block, bl.squeeze(key=names[several])

    samples = materialize(bl.at_each(bl.at_each(base, send_samples), _shared_samples))

    def send_windows(block, got):
        _, one, other, _ = Block(got, length).windows(got)
        yield from _sent(WINDOW, block, one, other, buckets)

    windows = materialize(bl.at_each(bl.at_each(base.unionAll(samples), send_windows), _named_before(WINDOW, late)))

    def finish(table: pa.Table) -> pa.Table:
        got = bl.packed_rows(table)
        block = Block(got, length)
        parts, one, other, ranks = block.windows(got)
        hit, at = _repeated(WINDOW, got, one, other, ranks, buckets), 0
        del one, other, ranks
        whole = block.copy
        removed, spans = np.where(whole, block.sizes, 0), whole.astype(np.int64)
        kept: dict[int, bytes] = dict.fromkeys(np.flatnonzero(whole).tolist(), b"")
        for rows_, raw, offsets, place_ in parts:
            hits = place_[hit[at : at + len(place_)]]
            at += len(place_)
            if not len(hits):
                continue
            change = np.zeros(len(raw) + 1, np.int8)
            change[hits] += 1
            change[hits + length] -= 1
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offsets[:-1]] = gone[offsets[:-1]]
            removed[rows_], spans[rows_] = np.add.reduceat(gone, offsets[:-1], dtype=np.int64), np.add.reduceat(begins, offsets[:-1], dtype=np.int64)
            for i in np.flatnonzero(removed[rows_]):
                a, b = offsets[i], offsets[i + 1]
                kept[int(rows_[i])] = raw[a:b][~gone[a:b]].tobytes()
        cuts = block.offsets
        left = (kept[i] if i in kept else block.raw[cuts[i] : cuts[i + 1]] for i in range(len(block.ids)))
        columns = {"doc_id": block.table.column("doc_id"), "n_bytes": pa.array(block.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        if keep_text:
            texts = [bytes(x) for x in left]
            return pa.table(columns | {"kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "kept": pa.array(texts, pa.binary())})
        return pa.table(columns | {"kept_sha256": [hashlib.sha256(t).hexdigest() for t in left]})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return base.unionAll(samples).unionAll(windows).groupBy("at").applyInArrow(finish, schema)


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    return find_repeats(read(spark, sf_dir, "documents"))
