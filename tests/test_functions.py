import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from premia.functions import dates, numbers
from premia.operators import clean
from premia.operators.features import age_bucket, engineer_features
from premia.roles import DEDUCTIBLE_COLS, MISSING


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_parse_number(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "1d", "NaN", "", "n/a", "0x10", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = column(df, numbers.parse_number(F.col("s")))
    assert got == [1.0, 2.5, -300.0, 0.5, None, None, None, None, None, None]


def test_bounds_keep_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (3.0,)], "x double")
    assert column(df, numbers.at_least(F.col("x"), 1)) == [None, 1.0, 3.0]
    assert column(df, numbers.floor_price(F.col("x"))) == [None, 1.0, 3.0]
    assert column(df, numbers.flag(F.col("x") > 0)) == [0, 0, 1]


def test_round_price_is_half_even(spark):
    values = [0.0005, 0.0015, 2.0005, 1234.5675, 10.1234]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = column(df, numbers.round_price(F.col("x")))
    assert got == list(np.round(np.array(values), 3))


def test_row_statistics_match_pandas(spark):
    rows = [(1.0, 2.0, 4.0), (None, 3.0, None), (None, None, None), (5.0, None, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    names = ["a", "b", "c"]
    frame = pd.DataFrame(rows, columns=names, dtype=float)
    stats = df.withColumn("m", numbers.row_mean(names))
    got = stats.select(
        "m", numbers.row_std(names, "m"), numbers.row_max(names), numbers.row_min(names)
    ).toPandas()
    want = pd.DataFrame(
        {0: frame.mean(axis=1), 1: frame.std(axis=1), 2: frame.max(axis=1), 3: frame.min(axis=1)}
    )
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_parse_date_is_day_first(spark):
    texts = ["03/04/1990", "3-4-1990", "1990-04-03", "31/02/1990", "unknown", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    parsed = dates.parse_date(F.col("s"), df.schema["s"].dataType).cast("date")
    day = dt.date(1990, 4, 3)
    assert column(df, parsed) == [day, day, day, None, None, None]


def test_days_round_down(spark):
    times = ["2024-12-31 12:00:00", "2024-12-31 00:00:00", "2025-01-01 06:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("t")
    )
    kind = df.schema["t"].dataType
    reference = pd.Timestamp("2025-01-01")
    want = [(reference - pd.Timestamp(t)).days for t in times]
    assert column(df, dates.days_before("2025-01-01", F.col("t"), kind)) == want
    after = [(pd.Timestamp(t) - reference).days for t in times]
    assert column(df, dates.days_after("2025-01-01", F.col("t"), kind)) == after


def test_age_bucket_matches_cut(spark):
    ages = [None, 0.0, -1.0, 25.0, 25.0001, 35.0, 50.0, 65.0, 120.0, 121.0]
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    cut = pd.cut(
        pd.Series(ages, dtype=float),
        [0, 25, 35, 50, 65, 120],
        labels=["very_young", "young", "mid", "senior", "elderly"],
    )
    want = [MISSING if pd.isna(v) else v for v in cut]
    assert column(df, age_bucket(F.col("age"))) == want


def test_absent_columns_leave_formulas_out(spark):
    df = spark.createDataFrame([(1, dt.date(1990, 1, 1))], "quote_id long, contractor_birthdate date")
    out = engineer_features(df)
    assert "value_per_age" not in out.columns and "mean_deductible" not in out.columns
    assert out.first()["claim_free_x_age"] == 0.0


def test_absent_vehicle_age_counts_as_one(spark):
    df = spark.createDataFrame([(200.0,)], "vehicle_value_new double")
    assert engineer_features(df).first()["value_per_age"] == 200.0


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert column(clean.nan_to_null(df), F.col("x")) == [None, 1.0]


@pytest.mark.parametrize("good,accepted", [(80, False), (81, True)])
def test_numeric_share_is_strict(spark, good, accepted):
    rows = [(str(i) if i < good else "bad",) for i in range(100)] + [(None,)]
    found = clean.infer_numeric(spark.createDataFrame(rows, "s string"))
    assert (found.numeric == ("s",)) is accepted


def test_all_null_text_stays_text(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert clean.infer_numeric(df).numeric == ()


def test_align_schema(spark):
    df = spark.createDataFrame([(1, "7", None)], "quote_id long, size string, colour string")
    features = clean.FeatureList(("size", "colour", "doors", "fuel"), ("colour", "fuel"))
    row = clean.align_schema(df, features, ("quote_id",)).first()
    assert tuple(row) == (1, 7.0, MISSING, None, MISSING)


def test_column_roles(spark):
    df = spark.createDataFrame(
        [(1, "A", "5", None, 2.0)],
        f"quote_id long, coverage string, size string, contractor_birthdate date, "
        f"{DEDUCTIBLE_COLS[0]} double",
    )
    roles = {r["name"]: r["role"] for r in clean.column_roles(df).collect()}
    assert roles == {
        "quote_id": "id",
        "coverage": "categorical",
        "size": "numeric",
        "contractor_birthdate": "date",
        DEDUCTIBLE_COLS[0]: "numeric",
    }
