"""The registered audits do the whole job: cases that a smaller job would miss."""

from __future__ import annotations

from auditloom.operators import audit, models
from auditloom.queries import audits


def test_external_audit_runs_all_draws_arms_and_schemes(spark, sf, monkeypatch):
    asked = []
    external = audit.external
    monkeypatch.setattr(audit, "external", lambda pool, arms, **more: asked.append((arms, more)) or external(pool, arms, **more))
    got = {(r["arm"], r["scheme"]): r for r in audits.external_audit(spark, sf).collect()}
    assert set(got) == {(a, s) for a in ("ALL", "base") for s in ("noscreen", "screen")}
    assert got["ALL", "noscreen"]["draws"] == 10 and all(r["draws"] <= 10 for r in got.values())
    assert [m for _, m in asked] == [{"screened": False}, {"screened": True}] and all(len(n) == 6 for arms, _ in asked for n in arms.values())


def test_combo_search_tries_five_of_six_columns(spark, sf, monkeypatch):
    tried = []
    combos = models.combos
    monkeypatch.setattr(models, "combos", lambda *a, **more: tried.append(combos(*a, **more)) or tried[-1])
    got = audits.combo_search(spark, sf).collect()
    assert {k: sum(r["k"] == k for r in got) for k in range(1, 7)} == {1: 5, 2: 5, 3: 5, 4: 5, 5: 5, 6: 0}
    every = [r["combo"] for r in tried[0].collect()]
    assert len(set(every)) == len(every) == 6 + 15 + 20 + 15 + 6 and any("base_loss" in c for c in every) and any("base_prediction_margin" in c for c in every)


def test_bootstraps_take_2000_replicates(spark, sf, monkeypatch):
    import inspect

    from auditloom.operators import split

    asked = []
    internal, bootstrap = audit.internal, split.bootstrap
    monkeypatch.setattr(audit, "internal", lambda *a, **more: asked.append(inspect.signature(internal).bind(*a, **more)) or internal(*a, **more))
    monkeypatch.setattr(split, "bootstrap", lambda *a, **more: asked.append(inspect.signature(bootstrap).bind(*a, **more)) or bootstrap(*a, **more))
    audits.internal_audit(spark, sf)
    used = audits.paired_bootstrap(spark, sf).first()["used"]
    for call in asked:
        call.apply_defaults()
    assert [call.arguments["replicates"] for call in asked] == [2000, 2000, 2000] and 500 < used <= 2000  # the internal audit has its own
