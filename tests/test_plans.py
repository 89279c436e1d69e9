"""Whole plans on small tables, and the physical plans behind them."""

import os

import pytest
from pyspark.sql import functions as F

from premia.operators import boost, longform, submit
from premia.operators.encode import fit_target_encoding
from premia.operators.features import engineer_features
from premia.plans import stacking, standin
from premia.plans.checks_models import FEW
from premia.roles import INSURERS, PRICE_COLS, price_col
from premia.session import drop_written, scratch_path, write_table
from premia.sources import quotes as source
from premia.sources.submissions import PredictionStore, read_submission
from premia.streaming.arrivals import read_arrivals, score_arrivals

SF_DIR = os.environ.get("PREMIA_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def blocks(spark):
    return write_table(source.quotes(spark, SF_DIR), "blocks")


def test_stacking_resumes_and_covers_every_quote(spark, blocks):
    one = {**FEW, "rounds": 1, "max_depth": 2}
    settings = stacking.Settings(
        boost.preset("tweedie_a", **one),
        boost.preset("tweedie_b", **one),
        boost.preset("scout", **one),
        folds=2,
        zones=5,
        top_n=10,
    )
    schema = spark.createDataFrame([], stacking.PREDICTION_SCHEMA).schema
    store = PredictionStore(spark, scratch_path(spark, "stacking"), schema)
    # K has no price at this scale, so no model and nothing stored.
    first = stacking.run(blocks, store, settings, ("A", "K"))
    assert set(first) == {"A"} and len(first["A"].features) == 10
    second = stacking.run(blocks, store, settings, ("A", "B"))
    assert set(second) == {"B"}
    for name in ("block2", "block3"):
        wide = stacking.submission(store, name)
        assert wide.count() == blocks.where(F.col("block") == name).count()
        bad = wide.where("Insurer_A_price IS NULL OR Insurer_B_price < 1")
        assert bad.isEmpty()
    assert set(first["A"].stored_models()) == {"A_a", "A_b"}
    rows = stacking.metrics(spark, {**first, **second}).collect()
    assert [r["insurer"] for r in rows] == ["A", "B"]


def test_arriving_blocks_score_like_a_batch(spark, blocks, tmp_path):
    folded = standin.folded_training(standin.categories(blocks), ["vehicle_maker"])
    fitted = fit_target_encoding(folded, ["vehicle_maker"])
    later = source.unpriced(blocks.where("block <> 'block1'"))
    inbox = str(tmp_path / "inbox")
    known = sorted(fitted.means)

    def score(df):
        wide = fitted.transform_wide(df.na.fill("_MISSING_", ["vehicle_maker"]), "vehicle_maker", price_col)
        return submit.round_prices(wide.select("quote_id", *[price_col(i) for i in known]))

    for name in ("block2", "block3"):
        later.where(F.col("block") == name).coalesce(1).write.mode("append").parquet(inbox)
        arrivals = read_arrivals(spark, inbox, later.schema)
        query = score_arrivals(arrivals, score, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(120)
    columns = ["quote_id", *[price_col(i) for i in known]]
    got = [
        r
        for n in (0, 1)
        for r in read_submission(spark, str(tmp_path / f"out/batch={n}"), columns).collect()
    ]
    assert sorted(got) == sorted(score(later).collect())


def test_scans_read_what_is_used(spark, blocks):
    one = blocks.where(F.col("Insurer_A_price").isNotNull()).select("quote_id")
    plan = physical(one)
    assert "PushedFilters: [IsNotNull(Insurer_A_price)]" in plan
    assert "vehicle_power" not in plan
    rows = engineer_features(blocks).select("quote_id", "power_per_weight")
    assert "struct<quote_id:bigint,vehicle_power:double,vehicle_net_weight:double>" in physical(rows)


def test_features_are_projections_without_shuffle(spark, blocks):
    plan = physical(engineer_features(blocks))
    assert "Exchange" not in plan and "Python" not in plan and "*(1)" in plan


def test_no_row_pairs(spark, blocks):
    folded = standin.folded_training(standin.categories(blocks), ["vehicle_maker", "municipality"])
    preds = standin.oof_predictions(folded)
    cells = longform.quoted_rows(blocks, ["quote_id"])
    for df in (preds, cells):
        plan = physical(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_written_tables_can_be_dropped(spark):
    path = write_table(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert drop_written(spark) > 0
    assert not os.path.exists(path)


def test_long_and_wide_agree(spark, blocks):
    fresh = write_table(source.quotes(spark, SF_DIR).select("quote_id", *PRICE_COLS), "again")
    long = longform.quoted_rows(fresh, ["quote_id"])
    back = longform.to_wide(long, "quote_id", "price")
    kept = fresh.where(F.coalesce(*PRICE_COLS).isNotNull())
    assert back.exceptAll(kept).isEmpty() and kept.exceptAll(back).isEmpty()
    assert len(INSURERS) == 11
