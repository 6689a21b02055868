"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the
bytes before. A node at depth d holds the counts of zeros and ones that followed
its d bytes; its Krichevsky-Trofimov estimate and the product of its children
are weighted half and half, from the deepest contexts up to the empty one. A
text's code length is the sum of the mixed predictions' logarithms.

How the corpus gives it, without a row per byte (see ``blocks``):

1. Each block of documents sends its distinct (context, byte) strings with
   training counts, and its distinct words, to buckets by fingerprint.
2. Buckets add up counts. Distinct strings go on, dealt by their two nearest
   context bytes, so that a subtree from depth 2 down lies in one bucket.
3. Subtrees are weighted there. Their sums per nearest byte (at most 256 * 255
   rows) give the two upper depths on the driver.
4. Each distinct string gets its log probability once; buckets answer the blocks,
   and blocks add up their texts' scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import blocks as bl
from auditloom.llm.common import block_count, byte_view, crc_mod, docs_of, materialize, mix64, read
from auditloom.llm.textbytes import lowered, words

DEPTH = 6
BLOCK_BYTES = 12 << 20
#: Text that is worked on at once within a block.
PART_BYTES = 2 << 20
#: Blocks for each bucket of strings, once there are LEAST_BUCKETS: pairs of a block and a bucket grow with the square of the input.
BLOCKS_A_BUCKET = 2
LEAST_BUCKETS = 24
#: Strings that a bucket holds before it adds them up.
PENDING = 1 << 20
#: Buckets of contexts for each bucket of strings: a tree takes more memory than the counts it is made of.
CONTEXT_BUCKETS = 4
EDGE = 255  # never a byte of UTF-8: stands before a text and after it
#: Kinds of rows that travel: see ``blocks``.
WORD, GRAM, SCORE, TOTAL = 1, 2, 3, 4
END = np.uint64(0)  # the fingerprint kept for the end of a text

_HALF_LOG = math.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of x >= 0.5, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth and bit: sorted ids, probability of a one, weight of stopping here."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        kt = log_kt(a, b)
        self.ids, self.one = ids, (b + 0.5) / (a + b + 1.0)
        self.log_w = kt if below is None else np.logaddexp(_HALF_LOG + kt, _HALF_LOG + below)
        self.stop = np.ones(len(ids)) if below is None else np.exp(_HALF_LOG + kt - self.log_w)
        self.a, self.b = a, b

    def at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        i = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return i, self.ids[i] == ids


def parent(ids: np.ndarray, bit: int) -> np.ndarray:
    """Id at the depth above: the farthest context byte goes."""
    prefix = np.uint64((1 << bit) - 1)
    return ((ids >> np.uint64(bit + 8)) << np.uint64(bit)) | (ids & prefix)


def cut(keys: np.ndarray, depth_from: int, depth: int) -> np.ndarray:
    """(context, byte) keys with the context cut to its nearest ``depth`` bytes."""
    return ((keys >> np.uint64(8 * (depth_from - depth + 1))) << np.uint64(8)) | (keys & np.uint64(255))


class Subtree:
    """The trees over some (context, byte) keys, from contexts of ``depth`` bytes up to ``top``.

    Keys without counts are nodes too: a node that has seen nothing has weight one and
    predicts one half, as an absent one does, and so every key finds its nodes by index.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH):
        self.top, self.depth = top, depth
        self.keys, self.counts = {depth: keys}, {depth: counts.astype(float)}
        self.up: dict[int, np.ndarray] = {}  # place of each key of the depth below among this depth's
        self.place = {depth: np.arange(len(keys), dtype=np.int32)}  # of each of the deepest keys
        for d in range(depth - 1, top - 1, -1):
            own = cut(self.keys[d + 1], d + 1, d)
            order = np.argsort(own)
            ranked = own[order]
            new = np.r_[np.ones(min(len(own), 1), bool), ranked[1:] != ranked[:-1]]
            self.up[d] = np.empty(len(own), np.int32)
            self.up[d][order] = np.cumsum(new, dtype=np.int32) - 1
            self.keys[d] = ranked[new]
            self.counts[d] = np.bincount(self.up[d], weights=self.counts[d + 1], minlength=len(self.keys[d]))
            self.place[d] = self.up[d][self.place[d + 1]]

    def weigh(self, bit: int) -> tuple[dict[int, Level], dict[int, np.ndarray]]:
        """The weighted trees of one bit by depth, and the node of each depth's keys; the bits' trees do not touch,
        so one is held at a time."""
        levels: dict[int, Level] = {}
        nodes: dict[int, np.ndarray] = {}
        first_below = None
        for d in range(self.depth, self.top - 1, -1):
            keys, counts = self.keys[d], self.counts[d]
            if not len(keys):
                continue
            ids = keys >> np.uint64(8 - bit)
            new = np.r_[True, ids[1:] != ids[:-1]]
            first = np.flatnonzero(new)
            nodes[d] = np.cumsum(new, dtype=np.int32) - 1
            ones = np.where((keys >> np.uint64(7 - bit)) & np.uint64(1), counts, 0.0)
            total, b = np.add.reduceat(counts, first), np.add.reduceat(ones, first)
            below = None if first_below is None else np.bincount(nodes[d][self.up[d][first_below]], weights=levels[d + 1].log_w, minlength=len(first))
            levels[d], first_below = Level(ids[first], total - b, b, below), first
        return levels, nodes

    def log10(self, bit: int, upper: dict[int, Level] | None = None) -> np.ndarray:
        """log10 of the mixed probability of one bit of each key's byte after its context."""
        levels, nodes = self.weigh(bit)
        keys = self.keys[self.depth]
        p = np.full(len(keys), 0.5)
        for d in sorted(levels, reverse=True):
            n = nodes[d][self.place[d]]
            stop = levels[d].stop[n]
            p = stop * levels[d].one[n] + (1 - stop) * p
        highest = self.keys[self.top]
        for d in sorted(upper or {}, reverse=True):  # few nodes: looked up for the few keys of the top
            i, seen = upper[d].at(cut(highest, self.top, d) >> np.uint64(8 - bit))
            stop, one = np.where(seen, upper[d].stop[i], 1.0), np.where(seen, upper[d].one[i], 0.5)
            p = stop[self.place[self.top]] * one[self.place[self.top]] + (1 - stop[self.place[self.top]]) * p
        return np.log10(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1), p, 1 - p))


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) keys of every byte and of the end, nearest context byte first; and where each text's begin.

    Eight bytes read as a little-endian number have the last one in front, which
    is the order of a context; ``depth`` is at most 6.
    """
    pad = bytes([EDGE])
    joined = b"".join([pad * 8, *(pad * depth + t + pad for t in texts)])
    raw = np.frombuffer(joined, np.uint8)
    before = np.ndarray(len(raw) - 8, "<u8", joined, strides=(1,))  # the eight bytes before each place
    keys = (before >> np.uint64(8 * (8 - depth))) << np.uint64(8)
    keys |= raw[8:]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes + depth) - sizes
    real = np.ones(len(keys), bool)
    for j in range(1, depth + 1):
        real[starts - j] = False
    return keys[real], np.cumsum(sizes) - sizes


def _parts(chunks: list[tuple[int, bytes]]) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """A block's rows and their lower-cased bytes, a bounded part at a time."""
    for _, data in chunks:
        table = bl.expand(data)
        raw, offsets = byte_view(table.column("text"))
        at = 0
        while at < table.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1)
            low = lowered(raw[offsets[at] : offsets[end]]).tobytes()
            cuts = offsets[at : end + 1] - offsets[at]
            yield table.slice(at, end - at), [low[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = end


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words (63 bits), and how many words each text has."""
    offsets = np.cumsum([0, *map(len, texts)])
    prints, before = words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    return prints >> np.uint64(1), np.diff(before)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (under 63 bits) and how often each is in training: one sort, the flag in the lowest bit."""
    marked = (keys << np.uint64(1)) | train
    marked.sort()
    distinct = marked >> np.uint64(1)
    first = np.flatnonzero(np.r_[True, distinct[1:] != distinct[:-1]])
    return distinct[first], np.add.reduceat(marked & np.uint64(1), first).astype(np.int32)


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.r_[np.ones(min(len(keys), 1), bool), ranked[1:] != ranked[:-1]]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], place


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct keys of all parts."""
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return keys[np.r_[np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]]


def _totals_of(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of packed rows and the sums of their counts, added up whenever PENDING more are held."""
    ks: list[np.ndarray] = []
    cs: list[np.ndarray] = []
    more = 0
    for _, data in rows:
        part = bl.unflat(data)
        ks.append(part["key"])
        cs.append(part["n"].astype(np.int64))
        more += len(ks[-1])
        if more >= max(PENDING, len(ks[0])):
            ks, cs = ([x] for x in bl.summed(ks, cs))
            more = 0
    return bl.summed(ks, cs)


def _looked_up(every: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values of keys of 56 bits at most, all of them in sorted ``every``.

    Runs of 2**16 keys are sorted by their upper bits, with their places in the low
    16, since lookups nearly in order stay in cache and a plain sort is far cheaper
    than one of indexes.
    """
    out = np.empty(len(keys), values.dtype)
    places = np.arange(1 << 16, dtype=np.uint64)
    for a in range(0, len(keys), 1 << 16):
        part = keys[a : a + (1 << 16)]
        marked = ((part >> np.uint64(8)) << np.uint64(16)) | places[: len(part)]
        marked.sort()
        order = (marked & np.uint64(0xFFFF)).astype(np.int64)
        out[a : a + len(part)][order] = values[np.searchsorted(every, part[order])]
    return out


def _distinct(chunks: list[tuple[int, bytes]], depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct words and strings of a block with their training counts (0: in held-out texts only)."""
    held: dict[int, tuple[list, list]] = {WORD: ([], []), GRAM: ([], [])}
    for table, texts in _parts(chunks):
        train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
        prints, n = _words_of(texts)
        keys, starts = grams(texts, depth)
        sizes = np.diff(np.r_[starts, len(keys)])
        for kind, own, each in ((WORD, np.r_[prints, np.full(len(texts), END)], np.r_[np.repeat(train, n), train]), (GRAM, keys, np.repeat(train, sizes))):
            ks, cs = held[kind]
            k, c = _counted(own, each)
            ks.append(k)
            cs.append(c)
            if len(ks) == 4:
                held[kind] = tuple([x] for x in bl.summed(ks, cs))
    return {kind: bl.summed(ks, cs) for kind, (ks, cs) in held.items()}


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(buckets)).astype(np.int32)


def _context_bucket(keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    return _bucket(keys >> np.uint64(8 * (depth - 1)), buckets)


def upper_levels(sums: pd.DataFrame) -> dict[int, dict[int, Level]]:
    """Depths 1 and 0 of each bit from the sums of depth 2 (``bit, id, a, b, below``)."""
    out: dict[int, dict[int, Level]] = {bit: {} for bit in range(8)}
    for bit, g in sums.sort_values(["bit", "id"]).groupby("bit"):
        one = Level(g["id"].to_numpy(np.int64).astype(np.uint64), g["a"].to_numpy(), g["b"].to_numpy(), g["below"].to_numpy())
        ids, inverse = np.unique(parent(one.ids, bit), return_inverse=True)
        add = lambda v, i=inverse: np.bincount(i, weights=v)
        out[bit] = {1: one, 0: Level(ids, add(one.a), add(one.b), add(one.log_w))}
    return out


def scored(docs: DataFrame, train: DataFrame | None = None, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``docs`` has ``doc_id, text, train``: rows marked train are learned from, all
    are scored. ``score`` is log10 of the probability of the lower-cased text and
    its end. The empty text has one token, its end. Rows without doc_id and
    repeated rows are scored like others; an empty table gives no rows; without
    training rows every decision has probability one half.
    """
    blocks = block_count(docs, block_bytes)
    buckets = min(blocks, max(LEAST_BUCKETS, -(-blocks // BLOCKS_A_BUCKET)))
    contexts = CONTEXT_BUCKETS * buckets
    text = bl.dealt(docs.select("doc_id", "text", "train"), bl.by_hash(blocks))

    def send(block, got):
        for kind, (keys, counts) in _distinct(got[bl.TEXT], depth).items():
            yield from bl.scatter(kind, block, keys, _bucket(keys, buckets), bl.flat, n=counts.astype(np.int32))

    sent = materialize(bl.at_each(text, send))

    def add_up(bucket, got):
        keys, counts = _totals_of(got.get(GRAM, []))
        yield from bl.scatter(GRAM, bucket, keys, _context_bucket(keys, contexts, depth), bl.flat, n=counts)
        _, n = _totals_of(got.get(WORD, []))
        yield TOTAL, -1, bucket, bl.squeeze(tokens=np.array([n.sum()]), distinct=np.array([np.count_nonzero(n)]))

    reduced = materialize(bl.at_each(sent, add_up))
    n_all, n_distinct = _totals(reduced.where(F.col("kind") == TOTAL))
    strings = reduced.where(F.col("kind") == GRAM)

    def subtree(got):
        return Subtree(*_totals_of(got[GRAM]), 2, depth)

    def tops(table: pa.Table) -> pa.Table:
        tree, out = subtree(bl.packed_rows(table)), []
        for bit in range(8):
            if (level := tree.weigh(bit)[0].get(2)) is not None:
                ids, inverse = np.unique(parent(level.ids, bit), return_inverse=True)
                out.append(pd.DataFrame({"bit": np.int32(bit), "id": ids.astype(np.int64)} | {n: np.bincount(inverse, weights=v) for n, v in (("a", level.a), ("b", level.b), ("below", level.log_w))}))
        empty = pd.DataFrame({"bit": pd.Series(dtype="int32"), "id": pd.Series(dtype="int64")} | {n: pd.Series(dtype="float64") for n in ("a", "b", "below")})
        return pa.Table.from_pandas(pd.concat(out) if out else empty, preserve_index=False)

    sums = strings.groupBy("at").applyInArrow(tops, "bit int, id long, a double, b double, below double").groupBy("bit", "id").agg(*[F.sum(c).alias(c) for c in ("a", "b", "below")])
    upper = upper_levels(sums.toPandas())  # at most 256 contexts times 255 decisions

    def evaluate(context, got):
        tree = subtree(got)
        total = np.zeros(len(tree.keys[depth]))
        for bit in range(8):
            total += tree.log10(bit, upper[bit])
        for origin, data in got[GRAM]:
            asked = bl.unflat(data)["key"]
            yield SCORE, origin, context, bl.flat(v=total[np.searchsorted(tree.keys[depth], asked)].astype(np.float32))

    def answer(bucket, got):
        keys, _ = _totals_of(got.get(GRAM, []))
        logs = bl.gather(got.get(SCORE, []), _context_bucket(keys, contexts, depth), "v", np.zeros(len(keys), np.float32), _column)
        vocabulary, seen = _totals_of(got.get(WORD, []))
        for kind, every, values in ((GRAM, keys, logs), (WORD, vocabulary, seen)):
            for origin, data in got.get(kind, []):
                yield kind, origin, bucket, bl.flat(v=values[np.searchsorted(every, _column(data, "key"))])  # sorted keys

    replies = bl.at_each(sent.unionAll(bl.at_each(strings, evaluate)), answer)

    def finish(table: pa.Table) -> pa.Table:
        got = bl.packed_rows(table)
        held, held_words, held_grams = [], [], []
        for part, texts in _parts(got.get(bl.TEXT, [])):
            prints, n = _words_of(texts)
            keys, starts = grams(texts, depth)
            held.append((part.select(["doc_id", "train"]), n, starts))
            held_words.append(_placed(prints))
            held_grams.append(_placed(keys))
        vocabulary = _merged([*(k for k, _ in held_words), np.full(1, END)])
        every = _merged([k for k, _ in held_grams])
        count = bl.gather(got.get(WORD, []), _bucket(vocabulary, buckets), "v", np.zeros(len(vocabulary), np.int64), _column)
        logs = bl.gather(got.get(GRAM, []), _bucket(every, buckets), "v", np.zeros(len(every), np.float32), _column)
        end = count[np.searchsorted(vocabulary, END)]
        out = []
        for (part, n, starts), (own_words, word), (own_grams, gram) in zip(held, held_words, held_grams, strict=True):
            c = count[np.searchsorted(vocabulary, own_words)][word]
            row = np.repeat(np.arange(len(n)), n)
            per_word = np.bincount(row, weights=np.log10(c + 1.0), minlength=len(n)) + math.log10(end + 1.0)
            out.append(pa.table({
                "doc_id": part.column("doc_id").cast(pa.int64()),
                "held_out": pa.array(~part.column("train").to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": pa.array(n + 1, pa.int64()),
                "n_known": pa.array(np.bincount(row, weights=c > 0, minlength=len(n)).astype(np.int64) + int(end > 0)),
                "train_tokens": pa.array(np.full(len(n), n_all, np.int64)),
                "base_score": pa.array(per_word - (n + 1) * math.log10(n_all + n_distinct + 1)),
                "score": pa.array(np.add.reduceat(_looked_up(every, logs, own_grams)[gram].astype(float), starts)),
            }))
        return pa.concat_tables(out) if out else EMPTY

    return text.unionAll(replies).groupBy("at").applyInArrow(finish, SCHEMA)


def _column(data: bytes, name: str) -> np.ndarray:
    return bl.unflat(data)[name]


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()


def _totals(rows: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones over all buckets, added up where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bl.expand(x) for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: pa.array([int(bl.numbers(p, n)[0]) for p in parts], pa.int64()) for n in ("tokens", "distinct")})

    row = rows.mapInArrow(run, "tokens long, distinct long").agg(F.sum("tokens").alias("t"), F.sum("distinct").alias("d")).first()
    return int(row["t"] or 0), int(row["d"] or 0)


def op1_ctw(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(read(spark, sf_dir, "documents"))
    return scored(docs.withColumn("train", crc_mod("doc_id", 7) != 2))
