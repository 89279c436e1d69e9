import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from premia.operators import order
from premia.operators.quantiles import column_quantiles, exact_quantiles

KEYS = ("ts", "quote_id")


@pytest.fixture(scope="module")
def quoted(spark):
    """Insurer A holds most rows; B few; C one. Times tie."""
    rng = np.random.default_rng(5)
    n = 3000
    insurer = np.where(rng.random(n) < 0.9, "A", "B")
    insurer[0] = "C"
    frame = pd.DataFrame(
        {
            "quote_id": rng.permutation(n),
            "ts": rng.integers(0, 40, n),
            "insurer": insurer,
            "y": np.where(rng.random(n) < 0.3, 10.0, rng.gamma(2, 100, n).round(1) + 10),
        }
    )
    return spark.createDataFrame(frame), frame


@pytest.mark.parametrize("exact_rows,bins", [(10**6, 4096), (20, 8), (1, 2)])
def test_quantiles_match_numpy(spark, quoted, exact_rows, bins):
    df, frame = quoted
    probs = [0.0, 0.1, 0.25, 0.5, 0.995, 1.0]
    got = exact_quantiles(df, "y", probs, ["insurer"], exact_rows=exact_rows, bins=bins)
    for insurer, part in frame.groupby("insurer"):
        found = got[(insurer,)]
        assert found.count == len(part)
        np.testing.assert_allclose(found.values, part["y"].quantile(probs), rtol=1e-12)


def test_quantiles_of_wide_range(spark):
    values = [float(v) for v in (-1e12, -3, -2.5, 0, 1e-9, 2e-9, 5, 7, 1e300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = exact_quantiles(df, "x", [0.3, 0.5, 0.7], exact_rows=1, bins=4)[()]
    np.testing.assert_allclose(got.values, np.quantile(values, [0.3, 0.5, 0.7]))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, "x", [0.5]) == {}
    both = spark.createDataFrame([(1.0, None)], "x double, z double")
    assert set(column_quantiles(both, ["x", "z"], [0.5])) == {"x"}


def test_row_index(spark, quoted):
    df, frame = quoted
    got = order.row_index(df, KEYS).toPandas().set_index("quote_id")["row_index"]
    want = frame.sort_values(list(KEYS)).reset_index(drop=True)
    assert (got.loc[want["quote_id"]].to_numpy() == np.arange(len(want))).all()


def test_row_index_in_groups(spark, quoted):
    df, frame = quoted
    got = order.row_index(df.repartition(7), KEYS, ("insurer",), num_partitions=5).toPandas()
    got = got.sort_values(["insurer", *KEYS])
    want = got.groupby("insurer").cumcount()
    assert (got["row_index"].to_numpy() == want.to_numpy()).all()


def test_recency(spark, quoted):
    df, _ = quoted
    weights = order.recency_weight(df, KEYS).toPandas().sort_values(["insurer", *KEYS])
    for _, part in weights.groupby("insurer"):
        n = len(part)
        np.testing.assert_allclose(part["weight"], 0.5 + 0.5 * np.arange(n) / max(n - 1, 1))
    recency = order.quote_recency(df, KEYS).toPandas().sort_values(list(KEYS))["quote_recency"]
    np.testing.assert_allclose(recency, np.arange(3000) / 3000)


@pytest.mark.parametrize("share", [0.8, 0.333, 1.0])
def test_temporal_split(spark, quoted, share):
    df, frame = quoted
    got = order.temporal_split(df, KEYS, share).toPandas().sort_values(list(KEYS))["split"]
    cut = int(len(frame) * share)
    assert (got.iloc[:cut] == "train").all() and (got.iloc[cut:] == "valid").all()


def test_decile_bins_match_qcut(spark, quoted):
    df, _ = quoted
    got = order.decile_bins(df).toPandas()
    for _, part in got.groupby("insurer"):
        if len(part) > 1:
            want = pd.qcut(part["y"], 10, labels=False, duplicates="drop")
            assert (part["bin"] == want).all()
        else:
            assert part["bin"].tolist() == [0]


def test_decile_bins_of_equal_values(spark):
    df = spark.createDataFrame([(i, "A", 5.0) for i in range(20)], "quote_id long, insurer string, y double")
    assert {r["bin"] for r in order.decile_bins(df).collect()} == {0}


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_hash_rank(spark, quoted, digits):
    df, _ = quoted
    got = order.hash_rank(df, ("insurer",), "quote_id", (7,), digits=digits).toPandas()
    for _, part in got.groupby("insurer"):
        assert sorted(part["rank"]) == list(range(len(part)))
    same = order.hash_rank(df.repartition(9), ("insurer",), "quote_id", (7,), digits=2).toPandas()
    merged = got.merge(same, on=["quote_id", "insurer"])
    assert (merged["rank_x"] == merged["rank_y"]).all()


def test_folds_keep_bin_shares(spark, quoted):
    df, _ = quoted
    folded = order.stratified_folds(order.decile_bins(df)).toPandas()
    sizes = folded.groupby(["insurer", "bin", "fold"]).size().unstack(fill_value=0)
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


@pytest.mark.parametrize("digits", [None, 2])
def test_bag_sample(spark, quoted, digits):
    df, frame = quoted
    got = order.bag_sample(df, share=0.85, digits=digits).toPandas()
    want = (frame.groupby("insurer").size() * 0.85).astype(int)
    sizes = got.groupby("insurer").size().reindex(want.index, fill_value=0)
    assert (sizes == want).all() and not got.duplicated(["quote_id", "insurer"]).any()
    other = order.bag_sample(df, share=0.85, bag=1).toPandas()
    assert set(other["quote_id"]) != set(got["quote_id"])
    again = order.bag_sample(df.repartition(6), share=0.85).toPandas()
    assert set(again["quote_id"]) == set(got["quote_id"])


def test_fold_split(spark, quoted):
    df, _ = quoted
    folded = df.withColumn("fold", F.col("quote_id") % 5)
    train, valid = order.fold_split(folded, 2)
    assert train.where("fold = 2").isEmpty() and valid.where("fold <> 2").isEmpty()
    assert train.count() + valid.count() == 3000


def split_by_sorting(frame, keys, share):
    ordered = frame.sort_values(list(keys), na_position="first").reset_index(drop=True)
    return set(ordered["id"][: int(len(ordered) * share)])


def test_temporal_split_counts_instead_of_sorting(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 500
    frame = pd.DataFrame(
        {
            # A third of all rows share one time; ids reach both ends of 64 bits.
            "at": pd.Timestamp("1969-12-31 23:59:59.999990") + pd.to_timedelta(np.where(rng.random(n) < 0.33, 9, rng.integers(0, 40, n)), "us"),
            "id": rng.choice(np.array([-(2**63), 2**63 - 1, *rng.integers(-(2**62), 2**62, n - 2)]), n, replace=False),
        }
    )
    df = spark.createDataFrame(frame)
    df = df.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("day", F.col("at").cast("date"))
    monkeypatch.setattr(order, "row_index", None)
    for share in (0.0, 0.1, 0.5, 0.8, 0.999):
        got = order.temporal_split(df, ("at", "id"), share)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r["id"] for r in got.where("split = 'train'").collect()} == split_by_sorting(frame, ("at", "id"), share)
    got = order.temporal_split(df.withColumn("at", F.col("at").cast("timestamp")), ("day", "at", "id"), 0.4)
    assert {r["id"] for r in got.where("split = 'train'").collect()} == split_by_sorting(frame, ("at", "id"), 0.4)


def test_temporal_split_with_nulls_and_other_keys(spark):
    rows = [(None, 3), (None, 1), (5, 2), (4, 9), (7, 0), (7, 8)]
    df = spark.createDataFrame(rows, "a int, id long")
    for k, want in enumerate([set(), {1}, {1, 3}, {1, 3, 9}, {1, 2, 3, 9}, {0, 1, 2, 3, 9}]):
        got = order.temporal_split(df, ("a", "id"), (k + 0.5) / 6)
        assert {r["id"] for r in got.where("split = 'train'").collect()} == want
    names = df.select(F.concat(F.lit("n"), "id").alias("name"), "id")
    got = order.temporal_split(names, ("name",), 0.5)
    assert {r["id"] for r in got.where("split = 'train'").collect()} == {0, 1, 2}
    assert order.temporal_split(df.limit(0), ("a", "id")).count() == 0


def test_value_at_every_rank(spark):
    values = [None, None, -9, -1, -1, 0, 0, 0, 3, 8, 8, 1 << 62]
    numbers = spark.createDataFrame([(v,) for v in values], "v long")
    for rank, value in enumerate(values):
        below = sum(1 for v in values if v is None) if value is not None else 0
        below += sum(1 for v in values if v is not None and value is not None and v < value)
        assert order.value_at(numbers, "v", rank, bins=4) == (value, below)
