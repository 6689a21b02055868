"""Plug-in predictors: query rows dealt over tasks, and distances a bounded number at once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from auditloom.operators import predict
from auditloom.queries import audits


def test_nearest_holds_few_distances():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(1000, 64)), rng.normal(size=(400, 64))
    model = audits.Nearest().fit(x, np.arange(1000) % 3)
    tracemalloc.start()
    got = model.predict_proba(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # all at once: 200 MB
    assert (got.argmax(1) == ((q[:, None] - x[None]) ** 2).sum(-1).argmin(1) % 3).all()


def test_query_rows_are_dealt_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    listed = [{"dataset_id": d, "manip_key": "default", "role": "context" if i % 3 else "query", "row_id": i, "x": rng.normal(size=2).tolist(), "y": None if i == 6 else int(rng.integers(4, 6) + 3 * (i % 2))} for d in (1, 2) for i in range(90)]
    rows = pd.DataFrame(listed)
    frame = spark.createDataFrame(listed, "dataset_id int, manip_key string, role string, row_id long, x array<double>, y int")

    class Counted(audits.Nearest):
        def predict_proba(self, x):
            return np.column_stack([super().predict_proba(x), np.full(len(x), -float(len(x)))])

    def run(most):
        monkeypatch.setattr(predict, "QUERY_ROWS", most)
        return predict.plug_in(frame, Counted).toPandas().sort_values(["dataset_id", "row_id"]).reset_index(drop=True)

    whole, dealt = run(1000), run(8)
    assert len(dealt) == 60 and dealt[["dataset_id", "row_id", "y", "pred"]].equals(whole[["dataset_id", "row_id", "y", "pred"]])
    assert {-p[-1] for p in whole["probs"]} == {30.0} and max(-p[-1] for p in dealt["probs"]) < 20
    own = rows[(rows.role == "query") & rows.y.notna()].groupby("dataset_id")["y"].unique().map(sorted)
    want = [0 if pd.isna(y) else own[d].index(y) for d, y in rows[rows.role == "query"][["dataset_id", "y"]].itertuples(index=False)]
    assert whole["y"].tolist() == want
