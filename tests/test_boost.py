import uuid
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from premia.operators import boost

FEATURES = ["signal", "weak", "noise"]
SMALL = boost.BoostParams(rounds=4, learning_rate=0.4, max_depth=3, min_leaf=5, max_bins=32, write_every=2)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 800
    frame = pd.DataFrame(
        {
            "quote_id": np.arange(n),
            "signal": rng.uniform(0, 10, n),
            "weak": rng.uniform(0, 10, n),
            "noise": rng.uniform(0, 10, n),
            "held": rng.random(n) < 0.25,
            "w": rng.uniform(0.5, 1.0, n),
        }
    )
    frame["y"] = 100 + 60 * (frame["signal"] > 5) + 5 * frame["weak"] + rng.gamma(2, 3, n)
    frame.loc[::40, "noise"] = np.nan
    return spark.createDataFrame(frame).cache(), frame


@pytest.mark.parametrize("objective", boost.OBJECTIVES)
def test_loss_falls_and_beats_constant(spark, data, objective):
    df, frame = data
    params = replace(SMALL, objective=objective, huber_delta=20.0, row_share=0.9)
    model = boost.fit_boosted(df, FEATURES, params, valid=F.col("held"))
    losses = [h["loss"] for h in model.history]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    held = frame[frame["held"]]
    constant = (held["y"] - frame[~frame["held"]]["y"].median()).abs().mean()
    scored = model.transform(df.where("held")).toPandas()
    error = (scored["pred"] - scored["y"]).abs().mean()
    assert error < constant
    # Trees scored from their stored form give the error seen in training.
    assert error == pytest.approx(model.history[model.best_iteration]["valid_mae"])
    top = boost.top_features(spark, {"m": model}, 1).first()
    assert (top.insurer, top["rank"], top.feature) == ("m", 1, "signal")


def test_same_seed_same_model(spark, data):
    df, _ = data
    params = replace(SMALL, rounds=2, row_share=0.8, tree_share=0.7)
    one = boost.fit_boosted(df, FEATURES, params)
    two = boost.fit_boosted(df.repartition(5, "weak"), FEATURES, params)
    a, b = (
        m.transform(df).toPandas().set_index("quote_id")["pred"].sort_index() for m in (one, two)
    )
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_weights_log_target_and_store(spark, data, tmp_path):
    df, _ = data
    params = replace(SMALL, rounds=2, log_target=True)
    models = {
        "A": boost.fit_boosted(df, FEATURES, params, weight="w", valid=F.col("held")),
        "B": boost.fit_boosted(df, FEATURES[:2], replace(SMALL, rounds=1, objective="tweedie")),
    }
    path = str(tmp_path / "models")
    boost.save_models(spark, models, path)
    again = boost.load_models(spark, path)
    assert {i: replace(m, store="", name="") for i, m in again.items()} == {
        i: replace(m, store="", name="") for i, m in models.items()
    }
    both = boost.score_models({("was", i): m for i, m in models.items()} | {("is", i): m for i, m in again.items()})
    assert df.where(sum(F.abs(both["was", i] - both["is", i]) for i in models) > 0).isEmpty()
    assert set(boost.load_models(spark, path, ["B"])) == {"B"}
    scored = boost.score_models(models)
    got = df.select(*[c.alias(i) for i, c in scored.items()]).toPandas()
    assert got["A"].between(90, 250).all() and got["B"].between(90, 250).all()


def test_early_stop_keeps_best(spark, data):
    df, _ = data
    noise = df.withColumn("y", F.rand(3) * 100)
    params = replace(SMALL, rounds=8, early_stop=2, min_leaf=1)
    model = boost.fit_boosted(noise, ["noise"], params, valid=F.col("held"))
    errors = [h["valid_mae"] for h in model.history]
    assert model.best_iteration == int(np.argmin(errors)) and len(errors) < 9
    stored = sum(len(f.roots) for f in boost.read_trees(model.store, model.name, model.best_iteration))
    assert stored == model.best_iteration


def test_no_rows_no_model(spark, data):
    df, _ = data
    assert boost.fit_boosted(df.where("false"), FEATURES, SMALL) is None
    held = df.withColumn("held", F.lit(True))
    assert boost.fit_boosted(held, FEATURES, SMALL, valid=F.col("held")) is None


def test_missing_value_is_its_own_branch(spark):
    rows = [(i, None if i % 2 else float(i), 10.0 if i % 2 else 500.0) for i in range(200)]
    df = spark.createDataFrame(rows, "quote_id long, x double, y double")
    model = boost.fit_boosted(df, ["x"], replace(SMALL, rounds=1, learning_rate=1.0))
    got = model.transform(df).groupBy("y").agg(F.avg("pred")).collect()
    assert {r[0]: round(r[1], 6) for r in got} == {10.0: 10.0, 500.0: 500.0}


def test_select_features(spark, data):
    df, _ = data
    names, cats = boost.select_features(
        df, FEATURES, ["noise", "signal"], replace(SMALL, rounds=2), top_n=2, valid=F.col("held")
    )
    assert names[0] == "signal" and len(names) == 2 and "noise" not in names and cats == ["signal"]


def test_presets_are_known():
    assert {p.objective for p in boost.PRESETS.values()} <= set(boost.OBJECTIVES)
    with pytest.raises(ValueError):
        boost.BoostParams("gamma")


# --- shared rounds --------------------------------------------------------------------


def many(spark, frame, groups):
    """The rows once for each group, with a target of its own."""
    parts = [frame.assign(insurer=g, y=frame["y"] * (k + 1)) for k, g in enumerate(groups)]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def fitted_together(df, features, params, groups, store=None):
    binning = boost.fit_bins(df.where("NOT held"), features, params.max_bins)
    rows = boost.packed_rows(df, binning, weight="w", valid=F.col("held"), keep=["insurer"])
    return boost.fit_rows(rows, groups, binning, params, store)


def jobs_of(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("objective", ["squared", "absolute"])
def test_models_grown_together_are_those_grown_alone(spark, data, objective):
    _, frame = data
    params = replace(SMALL, objective=objective, rounds=3, row_share=0.9)
    df = many(spark, frame, ["p", "q", "r"])
    together = fitted_together(df, FEATURES, params, ["p", "q", "r", "none"])
    assert set(together) == {"p", "q", "r"}
    alone = fitted_together(df.where("insurer = 'q'"), FEATURES, params, ["q"])["q"]
    scored = boost.score_models({"t": together["q"], "a": alone})
    own = df.where("insurer = 'q'").select(scored["t"].alias("t"), scored["a"].alias("a"), boost.score_own(together).alias("o"))
    got = own.toPandas()
    # Edges of the features come from the same values, so trees and scores are equal.
    np.testing.assert_allclose(got["t"], got["a"], rtol=1e-9)
    np.testing.assert_allclose(got["t"], got["o"], rtol=1e-12)
    assert [h["loss"] for h in together["q"].history] == pytest.approx([h["loss"] for h in alone.history])


def test_jobs_do_not_grow_with_models_nor_rounds(spark, data):
    _, frame = data
    params = replace(SMALL, rounds=2)
    few, more = many(spark, frame, ["p"]), many(spark, frame, [f"g{k}" for k in range(9)])
    counts = [
        jobs_of(spark, lambda df=df, n=n, r=r: fitted_together(df, FEATURES, replace(params, rounds=r), [f"g{k}" for k in range(n)] if n > 1 else ["p"]))
        for df, n, r in ((few, 1, 2), (more, 9, 2), (more, 9, 4), (more, 9, 6))
    ]
    assert counts[0] == counts[1]
    assert counts[2] - counts[1] == counts[3] - counts[2]


def test_stopped_fit_goes_on_where_it_was(spark, data, tmp_path, monkeypatch):
    _, frame = data
    params = replace(SMALL, rounds=7, write_every=2, row_share=0.8, objective="absolute", learning_rate=0.2)
    df = many(spark, frame, ["p", "q"]).cache()
    whole = fitted_together(df, FEATURES, params, ["p", "q"], str(tmp_path / "whole"))
    grow, done = boost.Rounds.grow, []

    def stops(self):
        if self.round == 5:
            raise RuntimeError("stopped")
        grow(self)
        done.append(self.round)

    monkeypatch.setattr(boost.Rounds, "grow", stops)
    with pytest.raises(RuntimeError):
        fitted_together(df, FEATURES, params, ["p", "q"], str(tmp_path / "part"))
    assert done == [1, 2, 3, 4, 5]

    def counts(self):
        grow(self)
        done.append(self.round)

    monkeypatch.setattr(boost.Rounds, "grow", counts)
    again = fitted_together(df, FEATURES, params, ["p", "q"], str(tmp_path / "part"))
    # Written after four rounds: the fifth is grown again, the first four are not.
    assert done == [1, 2, 3, 4, 5, 5, 6, 7]
    for name in ("p", "q"):
        assert replace(again[name], store="", history=()) == replace(whole[name], store="", history=())
        assert [h["round"] for h in again[name].history] == list(range(8))
        for a, b in zip(again[name].history, whole[name].history, strict=True):
            assert a == pytest.approx(b)
        trees = [[t for f in boost.read_trees(m.store, m.name, 7) for t in f.value] for m in (again[name], whole[name])]
        assert trees[0] == pytest.approx(trees[1])


def test_first_split_is_the_best_there_is(spark, data):
    df, frame = data
    params = replace(SMALL, rounds=1, max_depth=1, learning_rate=1.0, max_bins=256, min_leaf=7, l1=30.0, l2=4.0)
    model = boost.fit_boosted(df, FEATURES, params, weight="w")
    y, w = frame["y"].to_numpy(), frame["w"].to_numpy()
    start = (w * y).sum() / w.sum()
    assert model.start == pytest.approx(start)
    g = w * (start - y)

    def score(g_, h_):
        return max(abs(g_) - params.l1, 0) ** 2 / (h_ + params.l2)

    best = (0.0, None, None)
    for k, (c, edges) in enumerate(zip(FEATURES, model.binning.values, strict=True)):
        x = frame[c].fillna(-np.inf).to_numpy()
        for edge in (-np.inf, *edges):
            left = x <= edge
            if min(left.sum(), (~left).sum()) >= 7:
                gain = score(g[left].sum(), w[left].sum()) + score(g[~left].sum(), w[~left].sum())
                best = max(best, (gain, -k, edge))
    left = frame[FEATURES[-best[1]]].fillna(-np.inf).to_numpy() <= best[2]
    values = [-np.sign(g[s].sum()) * max(abs(g[s].sum()) - 30.0, 0) / (w[s].sum() + 4.0) for s in (left, ~left)]
    got = model.transform(df).toPandas().set_index("quote_id")["pred"].sort_index().to_numpy()
    np.testing.assert_allclose(got, start + np.where(left, *values), rtol=1e-9)


def weighted_median(r, w):
    order = np.argsort(r)
    r, upto = r[order], np.cumsum(w[order])
    at = int(np.argmax(2 * upto >= upto[-1]))
    return (r[at] + r[at + 1]) / 2 if 2 * upto[at] == upto[-1] and at + 1 < len(r) else r[at]


@pytest.mark.parametrize("l1, l2, integers", [(0.0, 0.0, True), (0.0, 3.0, False), (40.0, 5.0, True)])
def test_absolute_loss_takes_weighted_medians(spark, data, monkeypatch, l1, l2, integers):
    _, frame = data
    monkeypatch.setattr(boost, "MEDIAN_BINS", 4)  # many passes
    frame = frame.assign(w=(frame["w"] * 6).astype(int).astype(float) if integers else frame["w"], y=frame["y"].round(1))
    frame.loc[::50, "w"] = 0.0
    df = spark.createDataFrame(frame)
    params = replace(SMALL, objective="absolute", rounds=1, max_depth=2, learning_rate=1.0, l1=l1, l2=l2)
    model = boost.fit_boosted(df, FEATURES, params, weight="w")
    start = weighted_median(frame["y"].to_numpy(), frame["w"].to_numpy())
    assert model.start == start
    got = model.transform(df).toPandas()
    assert got["pred"].nunique() > 2
    for value, rows in got.groupby("pred"):
        r, w = (rows["y"] - start).to_numpy(), rows["w"].to_numpy()
        middle = weighted_median(np.append(r, 0.0), np.append(w, l1))
        assert value == pytest.approx(start + middle * w.sum() / (w.sum() + l2))


def test_one_node_parts_categories_no_threshold_parts(spark):
    rows = [(k, float(k % 8), 100.0 if k % 8 in (1, 4, 6) else 10.0) for k in range(400)]
    rows += [(400 + k, None, 55.0) for k in range(40)] + [(500 + k, 90.0 + k, 10.0) for k in range(5)]
    df = spark.createDataFrame(rows, "quote_id long, c double, y double").withColumn("held", F.lit(False))
    params = replace(SMALL, rounds=1, max_depth=1, learning_rate=1.0, min_leaf=1, max_bins=10)
    sets = boost.fit_boosted(df.where("y <> 55"), ["c"], params, nominal=["c"])
    got = {r[0]: r[1] for r in sets.transform(df.where("y <> 55")).groupBy("y").agg(F.collect_set(F.round("pred", 6))).collect()}
    assert got == {10.0: [10.0], 100.0: [100.0]}
    # Codes the fit has not seen go with the rare ones; a threshold on codes cannot do it with one node.
    new = spark.createDataFrame([(1, 777.0)], "quote_id long, c double")
    assert sets.transform(new).first()["pred"] == pytest.approx(10.0)
    line = boost.fit_boosted(df.where("y <> 55"), ["c"], params)
    assert line.transform(df.where("y <> 55")).where("abs(pred - y) > 1").count() > 0
    missing = boost.fit_boosted(df, ["c"], replace(params, max_depth=2), nominal=["c"])
    assert missing.transform(df).where("abs(pred - y) > 1e-6").isEmpty()


def test_a_tree_keeps_to_its_features(spark):
    rng = np.random.default_rng(5)
    names = [f"x{k}" for k in range(10)]
    frame = pd.DataFrame(rng.uniform(size=(600, 10)), columns=names).assign(quote_id=range(600))
    frame["y"] = sum(frame[c] * (k + 1) for k, c in enumerate(names))
    df = spark.createDataFrame(frame)
    params = replace(SMALL, rounds=4, max_depth=4, tree_share=0.5, level_share=0.5)
    model = boost.fit_boosted(df, names, params)
    used = []
    for forest in boost.read_trees(model.store, model.name, 4):
        for root in forest.roots.tolist():
            round_ = len(used)
            own = boost.drawn(range(10), 0.5, params.seed, round_)
            assert len(own) == 5
            level = [root]
            for depth in range(4):
                allowed = set(boost.drawn(own, 0.5, params.seed, round_, depth))
                inner = [n for n in level if forest.feature[n] >= 0]
                assert {int(forest.feature[n]) for n in inner} <= allowed <= set(own)
                level = [c for n in inner for c in (forest.left[n], forest.right[n])]
            used.append(tuple(own))
    assert len(used) == 4 and len(set(used)) > 1


def test_score_of_five_thousand_trees(spark, tmp_path, monkeypatch):
    """The trees are read where they are applied: neither the query nor the driver holds them."""
    rng, depth, rounds = np.random.default_rng(2), 6, 5000
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    cells, values = [], []
    for k in range(rounds):
        tree = np.zeros(nodes, boost.NODE)
        tree["feature"][inner:] = -1
        tree["feature"][:inner] = rng.integers(0, 3, inner)
        tree["bin"][:inner] = rng.integers(0, 20, inner)
        tree["left"][:inner], tree["right"][:inner] = 2 * np.arange(inner) + 1, 2 * np.arange(inner) + 2
        tree["value"] = rng.normal(size=nodes)
        cells.append(("m", k, tree.tobytes()))
        values.append(tree)
    store = f"file://{tmp_path}/store"
    spark.createDataFrame(cells, boost.TREES).repartitionByRange(25, "round").write.parquet(f"{store}/trees")
    binning = boost.Binning(("a", "b", "c"), (False,) * 3, (tuple(np.linspace(0, 1, 20)),) * 3)
    model = boost.BoostedTrees(binning, boost.BoostParams(rounds=rounds), 1.0, store, "m", (1.0, 0.0, 0.0), rounds)
    frame = pd.DataFrame(rng.uniform(size=(300, 3)), columns=["a", "b", "c"])
    df = spark.createDataFrame(frame)
    x = binning.of([frame[c].to_numpy() for c in "abc"])
    expected = np.full(300, 1.0)
    for tree in values:
        forest = boost.Forest([tree])
        expected += 0.2 * forest.value[forest.descend(np.zeros(300, int), x)]
    from pyspark import cloudpickle

    monkeypatch.setattr(boost, "KEPT_TREES", 1 << 20)  # far less than the trees take
    score = boost.score_models({"m": model})["m"]
    assert len(cloudpickle.dumps(model)) < 100_000 < rounds * nodes * boost.NODE.itemsize
    got = df.select("a", "b", "c", score.alias("p")).toPandas().merge(frame.assign(e=expected), on=["a", "b", "c"])
    np.testing.assert_allclose(got["p"], got["e"], rtol=1e-9)
