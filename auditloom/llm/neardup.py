"""Near-duplicate groups: one-permutation hashing, banded buckets, star-shaped edges.

1. A document's words give a set of distinct 5-word shingles. One permutation
   deals the set's fingerprints into bins; each bin keeps its least value, and an
   empty bin copies from a bin picked by its own sequence of draws (optimal
   densification).
2. Documents with equal sets are one node. Bands of the signature are buckets.
3. In each bucket every node has one candidate edge, to the bucket's least node,
   so a bucket of n nodes gives n - 1 of them. What these edges connect is a
   cluster: all nodes that share a bucket are in one.
4. Within a cluster, every node is held against one centre on full sets. Nodes
   that are not similar to it are then looked up in the cluster's postings,
   block by block, so that no link between two points of a star is lost. A block
   sends on a spanning forest of the links it finds, never all of them.
5. Groups come from alternating large-star and small-star steps on these edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import by_bytes, byte_view, docs_of, materialize, mix64, read
from auditloom.llm.textbytes import lowered, shingles, words

WORDS = 5
#: A pair at the threshold misses all buckets with a probability of (1 - 0.75**ROWS)**BANDS, 6e-9.
BANDS, ROWS = 50, 4
BINS = BANDS * ROWS
SIMILARITY = 75  # per cent
#: Ids that are broadcast at most (8 bytes each); beyond that the join shuffles.
BROADCAST_IDS = 500_000
#: Text whose words are named at once: some 60 bytes of numbers a byte, in arrays small enough to be used again.
PART_BYTES = 1 << 20
#: Nodes of a cluster that one task looks up, and those it looks them up among.
BLOCK_NODES = 1000

_DRAWS = (mix64((np.arange(1024, dtype=np.uint64)[:, None] << np.uint64(10)) + np.arange(BINS, dtype=np.uint64) + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)
_SALTS = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000))


def signature(sorted_set: np.ndarray) -> np.ndarray:
    """Least value of each bin of a non-empty sorted set, with empty bins densified."""
    bins = (((sorted_set >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = sorted_set[first], True
    empty = np.flatnonzero(~filled)
    for draws in _DRAWS:
        if not len(empty):
            return out
        donor = draws[empty]
        got = filled[donor]
        out[empty[got]] = out[donor[got]]
        empty = empty[~got]
    out[empty] = out[bins[first[0]]]  # after many draws: a bin that every holder of this first bin shares
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    keys = _SALTS.copy()
    for column in sig.reshape(BANDS, ROWS).T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def sets_of(column) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text of an Arrow column."""
    data, offsets = byte_view(column)
    prints, before = words(lowered(data), offsets)
    for i in range(len(offsets) - 1):
        yield np.unique(shingles(prints[before[i] : before[i + 1]], WORDS))


def _longs(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_id, bands`` of each row; set_id is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=PART_BYTES):
            sizes, ids, keys = [], [], []
            for s in sets_of(batch.column("text")):
                sizes.append(len(s))
                ids.append(_set_id(s) if len(s) else None)
                keys.append(bands(signature(s)) if len(s) else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), _longs(keys)], names=["doc_id", "n_shingles", "set_id", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``node, items``: the whole set of each row's text, under the set's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=PART_BYTES):
            sets = [s for s in sets_of(batch.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.binary()), _longs(sets)], names=["node", "items"])

    return docs.mapInArrow(run, "node binary, items array<long>")


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


#: Ways in which the edges of one node are dealt, since a star's centre may have most of them.
SALTS = 8


def _beside_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (``a, b``) with the ``m`` that ``least`` has for their ``a``, a node's edges over several tasks."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(spread, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` with the least node reachable over ``a, b`` edges, itself included, by large-star and small-star steps."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _fingerprint(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _beside_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _beside_least(large, small_least).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small, replaces=edges)
        after = _fingerprint(edges)
        if before == after:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots)
        before = after


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def near_groups(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Rows that share a doc_id are one document; equal sets are linked whatever their texts. Documents without words link with
    nothing. Rows without doc_id link like others; a group without any doc_id has
    null as component_id and is kept. component_id is the least doc_id of a group.
    """
    rows = docs_of(docs)
    sig = materialize(signed(rows))
    nodes = sig.where("set_id is not null").groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("named"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("c")).where("c > 1").select("key", "centre")
    candidates = materialize(keys.join(centres, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    clusters = materialize(_parted(components(candidates).withColumnRenamed("label", "cluster")))
    named = nodes.select("node", "named").join(clusters, "node")
    needed = materialize(named.select(F.col("named").alias("wanted")).distinct())
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    sets = materialize(full_sets(rows.join(needed, rows["doc_id"].eqNullSafe(F.col("wanted")), "left_semi").select("text")).dropDuplicates(["node"]).join(clusters, "node"))
    links = _links(candidates, sets, similarity)
    # rows of one doc_id with different sets are one document
    several = sig.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("doc_id is not null and lo <> hi").select("doc_id", "lo")
    same_id = sig.join(several, "doc_id").where("set_id <> lo").select(F.col("set_id").alias("a"), F.col("lo").alias("b"))
    labels = components(links.unionAll(same_id))
    grouped = sig.select("doc_id", "n_shingles", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = grouped.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = grouped.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(spread, ["label", "salt"], "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _parted(clusters: DataFrame) -> DataFrame:
    """``node, cluster, parts, part``: large clusters in parts of about BLOCK_NODES nodes, so that no task has to meet all of one."""
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("parts"))
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["cluster", "salt"]).select("node", "cluster", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))


def _each_part(df: DataFrame) -> DataFrame:
    """Rows of a cluster once for each of its parts."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _links(candidates: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Edges ``a, b`` between similar sets of ``node, items, cluster, parts, part``, such that all similar sets are connected."""
    degree = candidates.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("degree"))
    picked = sets.select("node", "cluster", "parts").join(degree, "node", "left").groupBy("cluster").agg(F.max_by("node", F.struct(F.coalesce("degree", F.lit(0)), "node")).alias("centre"), F.max("parts").alias("parts"))
    centres = _each_part(sets.select(F.col("node").alias("centre"), F.col("items").alias("own")).join(picked, "centre"))
    both = F.size(F.array_intersect("items", "own"))
    core = both * 100 >= (F.size("items") + F.size("own") - both) * similarity
    starred = materialize(sets.join(centres, ["cluster", "part"]).select("cluster", "parts", "node", "centre", core.alias("core")))
    sizes = starred.groupBy("cluster").agg(F.max("parts").alias("parts"), F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("nb"), F.ceil(F.sum((~F.col("core")).cast("int")) / BLOCK_NODES).cast("int").alias("nq")).where("nq > 0")
    rows = sets.join(starred.select("node", "core"), "node").join(_each_part(sizes), ["cluster", "part"]).withColumn("h", F.xxhash64("node"))
    members = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.pmod("h", "nb").cast("int").alias("mb"), F.lit(False).alias("query"), "node", "core", "items")
    queries = rows.where("not core").select("cluster", F.pmod("h", "nq").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("mb"), F.lit(True).alias("query"), "node", "core", "items")

    def look_up(table: pa.Table) -> pa.Table:
        return _spanning(table, similarity)

    found = members.unionAll(queries).groupBy("cluster", "qb", "mb").applyInArrow(look_up, "a binary, b binary")
    stars = starred.where("core and node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return stars.unionAll(found)


def _spanning(table: pa.Table, similarity: int) -> pa.Table:
    """Links between a task's queries and members that join what was not joined before; core members are joined already."""
    query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
    sides = []
    for side in (table.filter(pa.array(~query)), table.filter(pa.array(query))):
        items = side.column("items").combine_chunks()
        items = items if isinstance(items, pa.ListArray) else items.chunk(0)
        offsets = items.offsets.to_numpy()
        sides.append((side.column("node").to_pylist(), items.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], side.column("core").to_numpy(zero_copy_only=False).astype(bool)))
    (members, held, cuts, core), (queries, asked, bounds, _) = sides
    sizes = np.diff(cuts)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    first_core = int(np.flatnonzero(core)[0]) if core.any() else -1
    root = {q: q for q in queries} | {m: members[first_core] if c else m for m, c in zip(members, core, strict=True)}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i, q in enumerate(queries):
        own = asked[bounds[i] : bounds[i + 1]]
        lo, hi = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
        n = hi - lo
        hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(hits, minlength=len(members))
        for j in np.flatnonzero(shared * 100 >= (sizes + len(own) - shared) * similarity):
            a, b = find(q), find(members[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((q, members[j]))
    return pa.table([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], names=["a", "b"])


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_groups`` keeps; of rows that repeat a doc_id, all or none; rows without doc_id stay."""
    groups = near_groups(docs, similarity).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(groups, docs["doc_id"].cast("long") == groups["gone"], "left_anti")


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
