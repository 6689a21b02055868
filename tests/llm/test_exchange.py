"""Exchanges between blocks and buckets: packed columns, and how many pairs there are."""

from __future__ import annotations

import numpy as np

from auditloom.llm import blocks as bl
from auditloom.llm import ctw


def test_flat_columns_come_back_and_are_small():
    rng = np.random.default_rng(0)
    for n in (0, 1, 300):
        key = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        columns = {"key": key, "n": np.arange(len(key), dtype=np.int32), "v": rng.normal(size=len(key)).astype(np.float32), "w": np.arange(len(key), dtype=np.int64)}
        got = bl.unflat(bl.flat(**columns))
        assert all((got[c] == columns[c]).all() and got[c].dtype == columns[c].dtype for c in columns)
    assert len(bl.flat(v=np.zeros(3, np.float32))) < 60 < len(bl.squeeze(v=np.zeros(3, np.float32)))


def test_places_of_keys():
    keys = np.random.default_rng(0).integers(0, 50, 1000).astype(np.uint64)
    for part in (keys, keys[:1], keys[:0]):
        every, place = ctw._placed(part)
        assert (every == np.unique(part)).all() and (every[place] == part).all()
    assert (ctw._merged([keys[:500], keys[300:]]) == np.unique(keys)).all() and not len(ctw._merged([]))


def test_counts_are_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(ctw, "PENDING", 10)
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 99, 30, dtype=np.uint64)) for _ in range(20)]
    keys, counts = ctw._totals_of([(i, bl.flat(key=p, n=np.ones(len(p), np.int32))) for i, p in enumerate(parts)])
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert (keys == want[0]).all() and (counts == want[1]).all()


def test_buckets_grow_slower_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(ctw, "LEAST_BUCKETS", 2)
    written, write = [], ctw.materialize
    monkeypatch.setattr(ctw, "materialize", lambda df: written.append(write(df)) or written[-1])
    docs = spark.createDataFrame([(i, f"text {i % 7} of some words {i}", i % 3 > 0) for i in range(200)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in ctw.scored(docs, block_bytes=300).collect()}
    sent = written[0].where(f"kind = {ctw.GRAM}")
    assert sent.select("at").distinct().count() <= (sent.select("origin").distinct().count() + 2) // 2
    whole = {r["doc_id"]: r["score"] for r in ctw.scored(docs).collect()}
    assert got.keys() == whole.keys() and np.allclose([got[i] for i in got], [whole[i] for i in got], atol=1e-5)
