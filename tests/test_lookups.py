"""Fitted tables joined to wide rows, edges from points, members of a bag by expression."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from premia.operators import encode, order
from premia.operators.bins import POINTS, column_edges, fewer
from premia.session import looked_up


def test_a_row_travels_as_one_value(spark):
    df = spark.range(40).select("id", *[(F.col("id") % (k + 2)).cast("string").alias(f"c{k}") for k in range(4)], F.lit(None).cast("string").alias("n"))
    table = spark.createDataFrame([("0", 5), ("1", 6), (None, 7)], "category string, code int")
    out = looked_up(df, [(f"v{k}", [F.col(c)], table, ["category"], "code", 3) for k, c in enumerate(["c0", "c1", "n"])])
    got = out.orderBy("id").toPandas()
    assert list(got.columns) == [*df.columns, "v0", "v1", "v2"] and len(got) == 40
    assert got["v0"].tolist() == [5 + k % 2 for k in range(40)] and (got["v2"] == 7).all()
    assert [None if np.isnan(x) else int(x) for x in got["v1"]] == [5 + k % 3 if k % 3 < 2 else None for k in range(40)]


def test_codes_do_not_take_the_row_apart(spark):
    df = spark.range(30).select(F.col("id").alias("quote_id"), F.lit("2000-01-01").cast("timestamp_ntz").alias("quote_ts"), (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("b"), F.rand(1).alias("x"))
    codes = encode.fit_labels(df, ["a", "b"])
    out = codes.transform(df)
    assert out.columns == df.columns
    assert "_extract_" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["a"], r["b"]) for r in out.collect()} == {(k % 3, k % 5) for k in range(30)}


@pytest.mark.parametrize("parts", [1, 7])
def test_edges_are_values_at_even_ranks(spark, parts):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"many": rng.normal(size=30_000), "few": rng.integers(0, 9, 30_000) * 1.0, "none": np.nan})
    frame.loc[::10, "few"] = np.nan
    many, few, none = column_edges(spark.createDataFrame(frame).repartition(parts), ["many", "few", "none"], 50)
    ranks = np.searchsorted(np.sort(frame["many"]), many) / len(frame)
    np.testing.assert_allclose(ranks, np.arange(1, 51) / 51, atol=1 / POINTS)
    known = np.sort(frame["few"].dropna())
    assert few == tuple(sorted({known[int(np.ceil(k / 51 * len(known))) - 1] for k in range(1, 51)})) and none == ()


def test_points_keep_the_weight():
    values, weights = fewer(np.arange(10_000.0), np.ones(10_000), 100)
    assert len(values) == 100 and weights.sum() == 10_000 and weights.max() == 100 and values[-1] == 9999


def test_ends_of_a_bag_are_the_bag(spark):
    df = spark.range(500).select(F.col("id").alias("quote_id"), F.when(F.col("id") < 300, "A").otherwise("B").alias("insurer"))
    bag = {r["quote_id"] for r in order.bag_sample(df, share=0.6, bag=1, fold=2).collect()}
    ends = {r["insurer"]: r for r in order.bag_ends(df, "quote_id", 0.6, order.SEED, 1, 2).collect()}
    digest = {r["quote_id"]: r for r in df.withColumn("d", order.salted_hash("quote_id", order.SEED, 1, 2)).collect()}
    assert bag == {k for k, r in digest.items() if (r["d"], k) <= (ends[r["insurer"]]["_cut"], ends[r["insurer"]]["_cut_key"])}
    assert len(bag) == 180 + 120
