"""Rows in files: shared by models, gone through by one task or by many."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from premia.operators import boost

FEATURES = ["a", "b", "c"]
PARAMS = boost.BoostParams(rounds=3, learning_rate=0.4, max_depth=4, min_leaf=5, max_bins=32, row_share=0.9, write_every=2)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 1500
    out = pd.DataFrame({"quote_id": np.arange(n), "a": rng.uniform(0, 9, n), "b": rng.normal(size=n), "c": rng.integers(0, 6, n) * 1.0})
    out["y"] = 90 + 40 * (out["a"] > 4) + 9 * out["b"] + 5 * (out["c"] % 2) + rng.gamma(2, 3, n)
    out["w"], out["held"] = rng.uniform(0.5, 1, n), rng.random(n) < 0.2
    out["insurer"] = np.where(np.arange(n) % 3 == 0, "p", "q")
    return out


def fitted(spark, frame, params, store=None):
    df = spark.createDataFrame(frame)
    binning = boost.fit_bins(df.where("NOT held"), FEATURES, params.max_bins, ["c"])
    rows = boost.packed_rows(df, binning, weight="w", valid=F.col("held"), keep=["insurer"])
    return boost.fit_rows(rows, ["p", "q"], binning, params, store)


def trees(model):
    return [t for f in boost.read_trees(model.store, model.name, 9) for t in zip(f.feature, f.bin, f.mask.tolist(), strict=True)], [
        v for f in boost.read_trees(model.store, model.name, 9) for v in f.value
    ]


@pytest.mark.parametrize("objective", boost.OBJECTIVES)
def test_many_tasks_grow_the_trees_of_one(spark, frame, monkeypatch, objective):
    params = replace(PARAMS, objective=objective, level_share=0.7, l1=0.5, l2=1.0)
    one = fitted(spark, frame, params)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boost, "PIECE_ROWS", 130)
    monkeypatch.setattr(boost, "NODES_TOGETHER", 3)
    many = fitted(spark, frame, params)
    for name in ("p", "q"):
        assert many[name].start == pytest.approx(one[name].start)
        assert trees(many[name])[0] == trees(one[name])[0]
        assert trees(many[name])[1] == pytest.approx(trees(one[name])[1])
        for a, b in zip(many[name].history, one[name].history, strict=True):
            assert a == pytest.approx(b)


def test_rows_are_written_once_and_go_with_the_fit(spark, frame, tmp_path, monkeypatch):
    store, seen = tmp_path / "store", []
    commit = boost.Rounds.commit

    def looked(self, over=False):
        seen.append((sorted(p.name for p in (store / "rows").iterdir()), sorted(p.name for p in (store / "scores").iterdir())))
        commit(self, over)

    monkeypatch.setattr(boost.Rounds, "commit", looked)
    fitted(spark, frame, replace(PARAMS, rounds=5), str(store))
    assert len({tuple(rows) for rows, _ in seen}) == 1
    # Besides the last scores only those of the last record.
    assert [scores for _, scores in seen] == [["000002"], ["000002", "000004"], ["000004", "000005"]]
    assert sorted(p.name for p in store.iterdir()) == ["done", "trees"]


def test_members_share_rows(spark, frame):
    """Models of one name that differ in the rows they train on, against fits of those rows alone."""
    df = spark.createDataFrame(frame)
    binning = boost.fit_bins(df, FEATURES, PARAMS.max_bins)
    rows = boost.packed_rows(df, binning, weight="w", keep=["insurer", "quote_id"])
    part = F.col("quote_id") % 4

    def role(k):
        return F.when(part == k, F.expr("X'02'")).when(part == 3, F.expr("X'00'")).otherwise(F.expr("X'01'"))

    shared = boost.fit_rows(rows.withColumn("_role", F.concat(*[role(k) for k in range(3)])), ["p", "q"], binning, PARAMS, members=list("012"))
    assert set(shared) == {f"{i}|{k}" for i in "pq" for k in range(3)}
    for k in range(3):
        own = rows.where(part != 3).withColumn("_valid", part == k)
        for i, alone in boost.fit_rows(own, ["p", "q"], binning, PARAMS).items():
            assert trees(alone)[0] == trees(shared[f"{i}|{k}"])[0]
            assert alone.history[-1] == pytest.approx(shared[f"{i}|{k}"].history[-1])
