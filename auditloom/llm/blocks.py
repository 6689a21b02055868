"""Texts in blocks of bounded size, and exchanges of packed arrays between blocks and buckets.

Operators that need facts about every string of a corpus do not shuffle a row
per string. Each block of documents sends its distinct strings as packed arrays,
one per bucket; a bucket reduces what all blocks sent and answers each block with
an array in the same order. What moves is what a block has of distinct strings,
whatever their frequency, and no bucket sees a string more than once per block.

All rows have one shape, ``kind, at, origin, data``: a packed table of some kind,
sent to a block or bucket (``at``) from another (``origin``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import mix64

#: Text that a mapper holds back before it writes its chunks.
FLUSH_BYTES = 24 << 20

ROWS = "kind int, at int, origin int, data binary"
TEXT = 0

Row = tuple[int, int, int, bytes]


def squeeze(**columns) -> bytes:
    """Columns as one compressed binary. Ascending 64-bit ``key`` goes as differences, byte by byte: the
    upper bytes of the differences are mostly zero, and the lower ones do not compress."""
    if "key" in columns:
        key = np.ascontiguousarray(columns.pop("key")).view(np.uint64)
        planes = np.diff(key, prepend=np.uint64(0)) if len(key) else key
        columns |= {f"key{i}": column for i, column in enumerate(np.ascontiguousarray(planes.view(np.uint8).reshape(-1, 8).T))}
    batch = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array | pa.ChunkedArray) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def expand(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def numbers(table: pa.Table, name: str) -> np.ndarray:
    if name != "key":
        return table.column(name).to_numpy()
    planes = np.stack([table.column(f"key{i}").to_numpy() for i in range(8)], axis=1)
    return np.cumsum(planes.view(np.uint64).reshape(-1), dtype=np.uint64)


def flat(**columns: np.ndarray) -> bytes:
    """Columns of numbers as one compressed binary, byte by byte as in ``squeeze``, ``key`` as differences. Where many
    small rows travel, Arrow's stream takes longer to set up than to fill: 290 us for 300 keys, this 30 us."""
    head, body = [], []
    for name, column in columns.items():
        own = np.ascontiguousarray(column)
        if name == "key" and len(own):
            own = np.diff(own.view(np.uint64), prepend=np.uint64(0))
        head.append(f"{name} {own.dtype.str} {len(own)}")
        body.append(own.view(np.uint8).reshape(-1, own.dtype.itemsize).T.tobytes())
    raw = b"".join([",".join(head).encode(), b"\n", *body])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unflat(data: bytes) -> dict[str, np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    at = raw.index(b"\n") + 1
    out = {}
    for column in raw[: at - 1].decode().split(","):
        name, kind, n = column.split(" ")
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, int(n) * width, at).reshape(width, -1)
        own = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        out[name] = np.cumsum(own, dtype=np.uint64) if name == "key" else own
        at += int(n) * width
    return out


def table_of(rows: list[Row]) -> pa.Table:
    kind, at, origin, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(origin, pa.int32()), pa.array(data, pa.binary())], names=["kind", "at", "origin", "data"])


def packed_rows(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    """(origin, data) by kind, in an order that does not depend on tasks."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for kind, origin, data in sorted(zip(table.column("kind").to_pylist(), table.column("origin").to_pylist(), table.column("data").to_pylist(), strict=True)):
        out.setdefault(kind, []).append((origin, data))
    return out


def by_hash(blocks: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Blocks by doc_id; a row without one goes by its text."""

    def at(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column("doc_id")
        filled = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
        if ids.null_count:
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            filled[nulls] = [zlib.crc32(t.as_py().encode()) for t in batch.column("text").filter(ids.is_null())]
        return (mix64(filled + np.uint64(1)) % np.uint64(blocks)).astype(np.int32)

    return at


def by_range(edges: list[float]) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Blocks of consecutive doc_ids; rows without one are dealt by ``spread`` over the blocks after them."""

    def at(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column("doc_id")
        place = np.searchsorted(np.array(edges), ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        late = len(edges) + 1 + batch.column("spread").fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), late, place).astype(np.int32)

    return at


def dealt(rows: DataFrame, block_of: Callable[[pa.RecordBatch], np.ndarray], kind: int = TEXT, names: list[str] | None = None) -> DataFrame:
    """Columns ``names`` (else all) of ``rows`` (with doc_id) as packed chunks, each sent to the block of its rows."""
    names = names or rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.append_column("_at", pa.array(np.concatenate([block_of(b) for b in held]))).sort_by("_at")
            block = table.column("_at").to_numpy()
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            out = [(kind, int(block[a]), 0, squeeze(**{n: table.column(n).slice(a, b - a).combine_chunks() for n in names})) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield from table_of(out).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, ROWS)


def at_each(rows: DataFrame, work: Callable[[int, dict[int, list[tuple[int, bytes]]]], Iterator[Row]]) -> DataFrame:
    """Runs ``work`` on what was sent to each block or bucket; it sends rows on."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return table_of(list(work(key[0].as_py(), packed_rows(table))))

    return rows.groupBy("at").applyInArrow(run, ROWS)


def scatter(kind: int, origin: int, keys: np.ndarray, bucket_of: np.ndarray, pack: Callable[..., bytes] = squeeze, **values: np.ndarray) -> Iterator[Row]:
    """One packed row per bucket of sorted ``keys`` and ``values``, which stay in order within it."""
    if np.all(bucket_of[1:] >= bucket_of[:-1]):
        order, ranked = None, bucket_of
    else:
        order = np.argsort(bucket_of, kind="stable")
        ranked = bucket_of[order]
    edges = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1], True]) if len(ranked) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = slice(a, b) if order is None else order[a:b]
        yield kind, int(ranked[a]), origin, pack(key=keys[part], **{n: v[part] for n, v in values.items()})


def gather(replies: list[tuple[int, bytes]], bucket_of: np.ndarray, name: str, out: np.ndarray, values_of: Callable[[bytes, str], np.ndarray] = lambda data, name: numbers(expand(data), name)) -> np.ndarray:
    """Puts what buckets answered back in the order of the keys that ``bucket_of`` deals."""
    order = np.argsort(bucket_of, kind="stable")
    ranked = bucket_of[order]
    for bucket, data in replies:
        values = values_of(data, name)
        a = np.searchsorted(ranked, bucket)
        out[order[a : a + len(values)]] = values
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not sum(map(len, keys)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)  # equal keys in any order: their counts are added up
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c, first)
