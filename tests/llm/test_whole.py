"""Each operator does its whole job: cases that a smaller job would miss."""

from __future__ import annotations

import random

import numpy as np

from auditloom.llm import ctw, decontaminate, neardup, toxicity

SCHEMA = "doc_id long, text string"


def test_repeated_words_are_learned(spark):
    """Every text holds the marker once; toxic ones repeat it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(10))
    made = lambda n: " ".join([word() for _ in range(20)] + ["zurbel" + word()[:3] for _ in range(n)])
    docs = spark.createDataFrame([(i, made(3 if i % 4 == 0 else 1)) for i in range(200)], SCHEMA)
    fitted = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert any(w.endswith("+") for w in fitted.learned)
    assert (fitted.scores([made(3), made(1), made(0), ""]) >= 0.5).tolist() == [True, False, False, False]


def test_repeats_go_with_length():
    s = toxicity.Scorer({"zurbe*+": 1.0})
    assert s.repeats("zurbela und zurbelo") == {"zurbe*"} and s.repeats("zurbela und") == frozenset()
    assert s.repeats("zurbela und zurbelo " + "wort " * 1000) == frozenset()
    assert s.features("ein zurbela. der zurbelo.")[0] == 1.0 and s.features("ein zurbela.") == (0.0, 0.0, 0.0, 0.0)


def test_contexts_of_six_bytes_are_learned(spark):
    """What follows five bytes in common is told apart by the sixth."""
    docs = spark.createDataFrame([(i, ("xabcdey" if i % 2 else "zabcdew") * 40, True) for i in range(8)] + [(8, "xabcdey" * 40, False), (9, "xabcdew" * 40, False)], "doc_id long, text string, train boolean")
    at = lambda depth: {r["doc_id"]: r["score"] for r in ctw.scored(docs, **depth).collect()}
    six, five = at({}), at({"depth": 5})
    assert six == at({"depth": 6}) and six[8] > five[8] + 5


def test_lookups_of_wide_keys():
    rng = np.random.default_rng(1)
    every = np.unique(rng.integers(0, 1 << 56, 100_000).astype(np.uint64))
    asked = rng.permutation(np.r_[every, every])
    assert (ctw._looked_up(every, np.arange(len(every)), asked) == np.searchsorted(every, asked)).all()


def test_short_items_are_found():
    m = decontaminate.Matcher([(1, "oslo"), (2, "who wrote the iliad"), (3, "c++"), (4, "")])
    found = lambda t: [(r[0], r[1], r[2], r[3]) for r in sorted(m.find(t))]
    assert found("in oslo.") == [(1, 3, 7, 0)] and found("oslo") == [(1, 0, 4, 0)] and found("use c++ now") == [(3, 4, 7, 0)]
    assert found("oslos") == found("xoslo is oslo2") == found("") == []
    assert found("xoslo, oslo") == [(1, 7, 11, 0)]
    assert [r[::3] for r in found("say who wrote teh iliad")] == [] and [r[::3] for r in found("say who wrote th iliad")] == [(2, 1)]


def test_banding_finds_pairs_at_the_threshold():
    assert (1 - 0.75**neardup.ROWS) ** neardup.BANDS < 5e-6 and neardup.BANDS * neardup.ROWS == neardup.BINS
