import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from premia.operators import evaluate, stack, submit
from premia.roles import DISPLAY_PRICE_COLS, INSURERS, PRICE_COLS
from premia.sources import blocks, submissions


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(1)
    n = 400
    y = rng.gamma(3, 100, n)
    frame = pd.DataFrame(
        {
            "quote_id": np.arange(n),
            "insurer": rng.choice(["A", "B"], n),
            "kind": rng.choice(["x", "y"], n),
            "y": y,
            "pred_a": y + rng.normal(0, 20, n),
            "pred_b": y * 0.9 + rng.normal(0, 10, n),
        }
    )
    frame["pred"] = frame["pred_a"]
    return spark.createDataFrame(frame), frame


def test_mae_skips_missing_targets(spark):
    df = spark.createDataFrame([("A", 1.0, 3.0), ("A", 5.0, None)], "insurer string, pred double, y double")
    row = evaluate.mae(df).first()
    assert (row["n"], row["mae"]) == (1, 2.0)
    assert evaluate.pooled_mae(df).first()["mae"] == 2.0


def test_pooled_equals_weighted_mean(spark, preds):
    df, frame = preds
    pooled = evaluate.pooled_mae(df).first()
    assert pooled["mae"] == pytest.approx((frame["pred"] - frame["y"]).abs().mean())
    summary = evaluate.training_summary(df)
    again = evaluate.pooled_from_summary(summary, "mae_a").first()
    assert again["mae"] == pytest.approx(pooled["mae"]) and again["n"] == pooled["n"]


def test_ridge_matches_normal_equations(spark, preds):
    df, frame = preds
    meta = stack.fit_ridge_meta(df)
    for insurer, part in frame.groupby("insurer"):
        x = np.column_stack([part["pred_a"], part["pred_b"], (part["pred_a"] - part["pred_b"]).abs()])
        xc, yc = x - x.mean(axis=0), part["y"] - part["y"].mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
        np.testing.assert_allclose(meta.coefficients[insurer], w, rtol=1e-8)
        assert meta.intercepts[insurer] == pytest.approx(part["y"].mean() - x.mean(axis=0) @ w)
        got = meta.transform(df.where(F.col("insurer") == insurer)).toPandas()["price"]
        want = np.clip(x @ w + meta.intercepts[insurer], 1, None)
        np.testing.assert_allclose(np.sort(got), np.sort(want))


def test_blend_takes_first_minimum(spark):
    rows = [("A", 10.0, 10.0, 12.0), ("A", 20.0, 20.0, 19.0)]
    df = spark.createDataFrame(rows, "insurer string, pred_a double, pred_b double, y double")
    assert stack.blend_grid(df).first()["weight"] == 0.0


def test_blend_grid_matches_loop(spark, preds):
    df, frame = preds
    got = stack.blend_weights(stack.blend_grid(df))
    for insurer, part in frame.groupby("insurer"):
        errors = [
            (w * part["pred_a"] + (1 - w) * part["pred_b"] - part["y"]).abs().mean()
            for w in stack.BLEND_GRID
        ]
        assert got[insurer] == stack.BLEND_GRID[int(np.argmin(errors))]


def test_segment_bias_totals(spark, preds):
    df, frame = preds
    got = evaluate.segment_bias(df, "kind").toPandas().set_index(["insurer", "segment"])
    total = got.loc[("ALL", "ALL")]
    assert total["n"] == len(frame)
    assert total["mean_error"] == pytest.approx((frame["pred"] - frame["y"]).mean())
    assert got.loc[("A", "ALL")]["n"] == (frame["insurer"] == "A").sum()


def test_cross_matrix(spark):
    rows = [(1, 10.0, 20.0, 12.0, None), (2, 30.0, 40.0, None, 44.0)]
    df = spark.createDataFrame(
        rows,
        "quote_id long, Insurer_A_predicted double, Insurer_B_predicted double, "
        "Insurer_A_price double, Insurer_B_price double",
    )
    got = {(r["model"], r["insurer"]): r["mae"] for r in evaluate.cross_insurer_mae(df, ("A", "B")).collect()}
    assert got == {("A", "A"): 2.0, ("A", "B"): 14.0, ("B", "A"): 8.0, ("B", "B"): 4.0}


def full(spark, n=4, offset=0.0, ids=None):
    ids = list(ids if ids is not None else range(n))
    rows = [(i, *[100.0 * k + i + offset for k in range(len(INSURERS))]) for i in ids]
    schema = "quote_id long, " + ", ".join(f"{c} double" for c in PRICE_COLS)
    return spark.createDataFrame(rows, schema)


def test_merge_by_key_not_position(spark):
    base, new = full(spark), full(spark, offset=0.12345, ids=[3, 1, 9])
    got = submit.keyed_merge(base, new).toPandas().set_index("quote_id")
    assert list(got.columns) == list(PRICE_COLS) and len(got) == 4
    assert got.loc[1, PRICE_COLS[0]] == pytest.approx(1.123)
    assert got.loc[0, PRICE_COLS[0]] == 0.0 and 9 not in got.index


def test_merge_takes_renamed_key_and_prices(spark):
    base = submit.rename_prices(full(spark)).withColumnRenamed("quote_id", "Quote Id")
    new = full(spark, offset=5.0).select("quote_id", *PRICE_COLS)
    got = submit.replace_subset(base, new, key="Quote Id", new_key="quote_id")
    row = got.where("`Quote Id` = 2").first()
    assert row["Insurer E price"] == 407.0 and row["Insurer A price"] == 2.0
    assert got.columns == ["Quote Id", *DISPLAY_PRICE_COLS]


def test_merge_rejects_duplicates_and_unknown_names(spark):
    twice = full(spark).unionByName(full(spark, 1))
    with pytest.raises(ValueError, match="new table repeats"):
        submit.keyed_merge(full(spark), twice)
    with pytest.raises(ValueError, match="lacking Insurer_A_price"):
        submit.replace_subset(full(spark).select("quote_id", F.lit(1).alias("x")), full(spark))


def test_validate_counts_violations(spark):
    good = full(spark, 4, offset=1.0)
    assert {r["violations"] for r in submit.validate_submission(good, good).collect()} == {0}
    bad = (
        good.withColumn(PRICE_COLS[0], F.when(F.col("quote_id") == 1, None).otherwise(0.5))
        .where("quote_id <> 2")
        .unionByName(full(spark, 1, offset=1.0))
        .unionByName(full(spark, offset=1.0, ids=[77]))
        .withColumn("note", F.lit("x"))
    )
    got = {r["rule"]: r["violations"] for r in submit.validate_submission(bad, good).collect()}
    assert got == {
        "columns": 1,
        "missing_prices": 1,
        "prices_below_floor": 2,
        "duplicate_quotes": 1,
        "missing_quotes": 1,
        "unknown_quotes": 1,
    }


def test_submission_round_trip(spark, tmp_path):
    df = submit.round_prices(full(spark, offset=0.5))
    path = str(tmp_path / "sub")
    submissions.write_submission(df, path, single_file=True)
    again = submissions.read_submission(spark, path)
    assert again.schema == df.schema and sorted(again.collect()) == sorted(df.collect())
    first = [p for p in (tmp_path / "sub").iterdir() if p.suffix == ".csv"]
    assert len(first) == 1 and first[0].read_text().startswith("quote_id;Insurer_A_price;")


def test_store_resumes(spark, tmp_path):
    schema = "quote_id long, price double, insurer string"
    df = spark.createDataFrame([(1, 5.0, "A"), (2, 6.0, "B"), (3, 7.0, "B")], schema)
    store = submissions.PredictionStore(spark, str(tmp_path / "store"), df.schema)
    everyone = spark.createDataFrame([("A",), ("B",)], "insurer string")
    assert store.pending(everyone).count() == 2
    store.save("B", df)
    store.save("B", df)
    assert [r[0] for r in store.pending(everyone).collect()] == ["A"]
    assert store.predictions().count() == 2
    # Predictions without a completion record do not count.
    half = df.where("insurer = 'A'").drop("insurer")
    half.write.parquet(str(tmp_path / "store/predictions/insurer=A"))
    assert store.predictions().count() == 2


def test_head_and_profile(spark, tmp_path):
    df = spark.createDataFrame([(3, 1, "x"), (1, 2, None), (2, 3, "z")], "quote_ts long, quote_id long, c string")
    assert [r["quote_id"] for r in blocks.head(df, 2).collect()] == [2, 3]
    blocks.export_head(df, str(tmp_path / "head"), 2)
    text = spark.read.csv(str(tmp_path / "head"), header=True).collect()
    assert [r["Unnamed: 0"] for r in text] == ["0", "1"]
    got = {r["name"]: r["non_null"] for r in blocks.profile(df).collect()}
    assert got == {"quote_ts": 3, "quote_id": 3, "c": 2}


def segment_rows(spark, copies=1):
    rng = np.random.default_rng(3)
    n = 600
    frame = pd.DataFrame(
        {
            "insurer": rng.choice(["A", "B", "C"], n, p=[0.6, 0.3, 0.1]),
            "kind": rng.choice(["x", "y", None], n),
            "age": np.where(rng.random(n) < 0.1, np.nan, rng.integers(18, 30, n)),
            "y": np.where(rng.random(n) < 0.1, np.nan, rng.gamma(3, 100, n)),
        }
    )
    frame["pred"] = frame["y"].fillna(5) * 1.1 + rng.normal(0, 5, n)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)] * copies
    return spark.createDataFrame(rows, "insurer string, kind string, age double, y double, pred double"), frame


def test_bias_of_many_segments_matches_pandas(spark):
    df, frame = segment_rows(spark)
    edges = evaluate.segment_edges(df, ["age"])
    assert edges["age"] == tuple(sorted(set(frame["age"].dropna().quantile([0.25, 0.5, 0.75]))))
    got = evaluate.bias_by_segments(df, ["kind"], edges).toPandas().set_index(["insurer", "segment", "value"])
    frame = frame[frame["y"].notna()].copy()
    frame["kind"] = frame["kind"].fillna("_MISSING_")
    place = np.searchsorted(edges["age"], frame["age"], "left")
    frame["age"] = np.where(frame["age"].isna(), "_MISSING_", "b" + pd.Series(place, frame.index).astype(str))
    want = {("ALL", "ALL", "ALL"): frame, **{(i, "ALL", "ALL"): p for i, p in frame.groupby("insurer")}}
    for segment in ("kind", "age"):
        want |= {("ALL", segment, v): p for v, p in frame.groupby(segment)}
        want |= {(i, segment, v): p for (i, v), p in frame.groupby(["insurer", segment])}
    assert set(got.index) == set(want)
    for key, part in want.items():
        error = part["pred"] - part["y"]
        assert got.loc[key, "n"] == len(part)
        assert got.loc[key, "mean_error"] == pytest.approx(error.mean())
        assert got.loc[key, "mae"] == pytest.approx(error.abs().mean())
        assert got.loc[key, "bias_ratio"] == pytest.approx(part["pred"].sum() / part["y"].sum())


def test_bias_of_many_segments_is_one_shuffle(spark):
    df, _ = segment_rows(spark)
    plan = evaluate.bias_by_segments(df, ["kind"], {"age": (20.0, 25.0)})._jdf.queryExecution()
    assert plan.sparkPlan().toString().count("Expand") == 1
    assert plan.executedPlan().toString().count("Exchange") == 1


def test_bias_without_rows_or_values(spark):
    df, _ = segment_rows(spark)
    none = df.limit(0)
    assert evaluate.segment_edges(none, ["age"]) == {"age": ()}
    assert evaluate.bias_by_segments(none, ["kind"], {"age": ()}).isEmpty()
    bare = df.withColumn("age", F.lit(None).cast("double"))
    got = evaluate.bias_by_segments(bare, (), evaluate.segment_edges(bare, ["age"]))
    assert {r["value"] for r in got.collect()} == {"ALL", "_MISSING_"}
