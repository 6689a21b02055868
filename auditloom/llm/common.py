"""Shared pieces of the training-data operators.

Every operator reads a ``documents`` frame and uses only ``doc_id`` and
``text``; other columns may be null, missing or named like an operator's own
working columns, because each operator first projects the two it needs.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: what the JVM holds for a Python worker at once.
BATCH_ROWS = 512
#: Bytes of text that a worker holds at once; a longer text is a part by itself.
PART_BYTES = 4 << 20

_OWN_SCRATCH: list[str] = []
#: Where the tables that ``materialize`` gave lie.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, a local one with a local master; on
    a cluster that is an error, since executors would not see each other's files."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="auditloom-"))
    return f"file://{_OWN_SCRATCH[0]}"


def tables(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{scratch(spark)}/auditloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and reread it: cuts the lineage, and a lost executor takes
    nothing with it. The table of ``replaces``, which nothing reads any more, is deleted then."""
    path = f"{tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None and replaces in _WRITTEN:
        _delete(df.sparkSession, _WRITTEN[replaces])
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: for the end of a job, when its results are written."""
    _delete(spark, tables(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, for plans made from here on in this session; a number that the session
    was given stays. Spark has no setting for a single query, and its own default of 10,000 rows of text is
    what an executor's memory is short of."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def docs_of(df: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null read as empty."""
    tune(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_mod(column: str, modulus: int):
    """crc32 of a column written as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut and joined to batches of at most ``most`` bytes of a column, or one row."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + most - size, side="right"))
            if end <= at and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                continue
            end = max(end, at + 1)
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1]) - before
            at = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_texts(docs: DataFrame, fields: dict[str, str], begin: Callable[[], Callable[[list[str]], Sequence]], types: dict[str, pa.DataType] | None = None, part: int = PART_BYTES) -> DataFrame:
    """``doc_id`` and ``fields`` (name: type) for every row of ``doc_id, text``.

    ``begin`` runs once per task and gives the function from a batch's texts to
    the fields' columns. doc_id passes through as it is, null or not.
    """
    kinds = [(types or {}).get(n) or ARROW[t] for n, t in fields.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in by_bytes(batches, most=part):
            columns = work(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", *fields])

    return docs_of(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {t}" for n, t in fields.items())]))


def keep_rows(docs: DataFrame, begin: Callable[[], Callable[[list[str]], Sequence[bool]]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for whose texts (null: empty) the function says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in by_bytes(batches, text):
            yield batch.filter(pa.array(work([t or "" for t in batch.column(text).to_pylist()]), pa.bool_()))

    tune(docs.sparkSession)
    text = f"c{docs.columns.index('text')}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # columns may have names that need quotes
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and the offsets of its rows, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def block_count(df: DataFrame, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text that ``df`` makes."""
    total = df.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // block_bytes))
