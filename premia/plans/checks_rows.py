"""Registered queries over single rows: sources, cleaning, projections, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.numbers import floor_price, log_price, unlog_price
from premia.operators import clean, submit
from premia.operators.encode import fit_all_labels, fit_labels, oof_target_encode
from premia.operators.features import date_features, engineer_features
from premia.operators.longform import attach_columns, quoted_rows
from premia.operators.prepare import fit_nn_prep, with_log_target
from premia.plans import standin
from premia.plans.registry import query, r4, rounded
from premia.roles import CATEGORICAL_COLS, DATE_COLS, INSURERS, PRICE_COLS, ROLES, price_col
from premia.session import scratch_path, write_table
from premia.sources import blocks, submissions
from premia.sources.quotes import block, quotes

# Query name -> feature columns it shows.
DATE_QUERIES = {
    "contractor_age": ["contractor_age"],
    "second_driver_age": ["second_driver_age"],
    "has_second_driver": ["has_second_driver"],
    "days_since_inspection": ["days_since_inspection"],
    "inspection_days_remaining": ["inspection_days_remaining"],
    "years_since_last_registration": ["years_since_last_registration"],
    "years_since_first_registration": ["years_since_first_registration"],
    "years_since_country_first_reg": ["years_since_country_first_reg"],
}
ACTUARIAL_QUERIES = {
    "age_squares": ["contractor_age_sq", "second_driver_age_sq"],
    "age_bucket": ["contractor_age_bucket"],
    "claim_free_x_age": ["claim_free_x_age"],
    "claim_free_per_age": ["claim_free_per_age"],
    "claim_free_x_vehicle_age": ["claim_free_x_vehicle_age"],
    "second_driver_interactions": [
        "second_driver_claim_free_x_age",
        "total_claim_free_years",
        "claim_free_diff",
    ],
    "power_weight": ["weight_per_power", "power_per_weight"],
    "value_ratios": ["value_per_age", "log_vehicle_value"],
    "value_per_power": ["value_per_power"],
    "log_exposure": ["log_address_density", "log_mileage"],
    "has_deficiencies": ["has_deficiencies"],
    "deductible_row_stats": [
        "mean_deductible",
        "std_deductible",
        "max_deductible",
        "min_deductible",
    ],
    "ded_vs_mean": [f"{i}_ded_vs_mean" for i in INSURERS],
    "ded_ratio": ["mean_deductible_ratio", *[f"{i}_ded_ratio" for i in INSURERS]],
    "coverage_x_age_bucket": ["coverage_x_age_bucket"],
}
# Rows of the exported head: fewer than any table of the tests has.
HEAD_ROWS = 5_000
INTEGER_OR_TEXT = {
    "has_second_driver",
    "contractor_age_bucket",
    "has_deficiencies",
    "coverage_x_age_bucket",
}


def numeric_columns(df):
    """Numbers of a table that are neither ids nor prices."""
    return [c for c, t in df.dtypes if t in ("double", "int", "bigint") and c not in ROLES.non_features]


def categorical_columns(df):
    return [c for c in CATEGORICAL_COLS if c in df.columns]


def _dates_as_text(df):
    """Dates spelled alike on both sides of a comparison."""
    found = {c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t.startswith(("date", "timestamp"))}
    return df.withColumns(found)


def _feature_query(name, columns, add):
    @query(name)
    def run(spark, sf_dir):
        df = add(quotes(spark, sf_dir))
        shown = [F.col(c) if c in INTEGER_OR_TEXT else r4(c).alias(c) for c in columns]
        return df.select("quote_id", *shown)


for _name, _columns in DATE_QUERIES.items():
    _feature_query(_name, _columns, date_features)
for _name, _columns in ACTUARIAL_QUERIES.items():
    _feature_query(_name, _columns, engineer_features)


@query("feature_projection")
def feature_projection(spark, sf_dir):
    """Every derived column of the full family in one projection."""
    df = engineer_features(quotes(spark, sf_dir))
    names = [c for cols in (DATE_QUERIES | ACTUARIAL_QUERIES).values() for c in cols]
    shown = [F.col(c) if c in INTEGER_OR_TEXT else r4(c).alias(c) for c in names]
    return df.select("quote_id", *shown)


# --- sources and sinks -----------------------------------------------------------


@query("read_block")
def read_block(spark, sf_dir):
    path = scratch_path(spark, "block1")
    block(quotes(spark, sf_dir), "block1").write.parquet(path)
    return rounded(_dates_as_text(blocks.read_block(spark, path)), *PRICE_COLS)


@query("write_submission")
def write_submission(spark, sf_dir):
    """The lines of the written files, header left out."""
    path = scratch_path(spark, "submission")
    df = quotes(spark, sf_dir).select("quote_id", *PRICE_COLS)
    submissions.write_submission(submit.round_prices(df.na.fill(1.0, list(PRICE_COLS))), path)
    lines = spark.read.text(path).where(~F.col("value").startswith("quote_id"))
    parts = F.split("value", ";")
    return lines.select(
        F.size(parts).alias("n_fields"),
        parts[0].cast("bigint").alias("quote_id"),
        *[parts[n].cast("double").alias(c) for n, c in enumerate(PRICE_COLS, 1)],
    )


@query("read_submission")
def read_submission(spark, sf_dir):
    path = scratch_path(spark, "submission")
    df = quotes(spark, sf_dir).select("quote_id", *PRICE_COLS)
    submissions.write_submission(submit.round_prices(df), path)
    return submissions.read_submission(spark, path)


@query("export_head")
def export_head(spark, sf_dir):
    path = scratch_path(spark, "head")
    df = quotes(spark, sf_dir)
    blocks.export_head(df, path, HEAD_ROWS)
    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    written = spark.read.csv(path, header=True, schema=f"row_index long, {types}", enforceSchema=True)
    return rounded(_dates_as_text(written), *PRICE_COLS)


@query("profile")
def profile(spark, sf_dir):
    return blocks.profile(quotes(spark, sf_dir))


# --- typing, cleaning, roles -------------------------------------------------------


@query("infer_numeric")
def infer_numeric(spark, sf_dir):
    columns = ["quote_id", "vehicle_engine_size", "vehicle_width_note"]
    df = quotes(spark, sf_dir).select(*columns)
    typed = clean.infer_numeric(df).transform(df)
    return typed.select(
        "quote_id", (F.col("vehicle_engine_size") + 0.5).alias("engine_size"), "vehicle_width_note"
    )


@query("parse_date")
def parse_date(spark, sf_dir):
    df = _dates_as_text(clean.parse_dates(quotes(spark, sf_dir)))
    return df.select("quote_id", *[c for c in DATE_COLS if c in df.columns])


@query("column_roles")
def column_roles(spark, sf_dir):
    return clean.column_roles(quotes(spark, sf_dir))


@query("fill_categorical")
def fill_categorical(spark, sf_dir):
    df = quotes(spark, sf_dir)
    columns = categorical_columns(df)
    return clean.fill_categorical(df, columns).select("quote_id", *columns)


@query("align_schema")
def align_schema(spark, sf_dir):
    """All features of the view, and two it lacks; a number comes as text."""
    df = quotes(spark, sf_dir)
    cats = (*categorical_columns(df), "vehicle_fuel_type")
    numbers = (*numeric_columns(df), "vehicle_engine_size", "vehicle_doors")
    features = clean.FeatureList((*numbers, *cats), cats)
    return clean.align_schema(df, features, keep=("quote_id",))


def _first_seen(df):
    return block(df, "block1")


@query("label_encode")
def label_encode(spark, sf_dir):
    df = quotes(spark, sf_dir)
    columns = categorical_columns(df)
    df = clean.fill_categorical(df, columns)
    df = write_table(df.select("quote_id", "quote_ts", "block", *columns), "blocks")
    return fit_labels(_first_seen(df), columns).transform(df).select("quote_id", *columns)


@query("auto_categorical")
def auto_categorical(spark, sf_dir):
    df = quotes(spark, sf_dir)
    text = [c for c in clean.string_columns(df) if c not in ("block", "second_driver_birthdate")]
    df = write_table(df.select("quote_id", "quote_ts", "block", *text), "blocks")
    codes = fit_all_labels(_first_seen(df))
    return codes.transform(df).select("quote_id", *codes.columns)


@query("attach_columns")
def attach_columns_query(spark, sf_dir):
    folded = standin.training(spark, sf_dir, ["province"])
    encoded = oof_target_encode(folded, ["province"]).select("quote_id", "insurer", "province_te")
    joined = attach_columns(folded.select("quote_id", "insurer", "province", "price"), encoded)
    return rounded(joined, "price", "province_te")


# --- filters, projections, scalar post-processing -----------------------------------


@query("quoted_rows")
def quoted(spark, sf_dir):
    return rounded(quoted_rows(quotes(spark, sf_dir), ["quote_id", "block"]), "price")


@query("project_features")
def project_features(spark, sf_dir):
    df = quotes(spark, sf_dir)
    return clean.project_features(
        df, ["vehicle_power", "vehicle_age", "province"], keep=("quote_id",)
    )


@query("rename_prices")
def rename_prices(spark, sf_dir):
    df = submit.rename_prices(quotes(spark, sf_dir).select("quote_id", *PRICE_COLS))
    return rounded(df, *[c for c in df.columns if c != "quote_id"])


@query("order_columns")
def order_columns(spark, sf_dir):
    shuffled = quotes(spark, sf_dir).select(*reversed(PRICE_COLS), "quote_id")
    df = submit.order_columns(submit.rename_prices(shuffled))
    return rounded(df, *df.columns[1:])


@query("floor_price")
def floor_prices(spark, sf_dir):
    cells = quoted_rows(quotes(spark, sf_dir), ["quote_id"])
    low = floor_price(F.col("price") - 30000)
    return cells.select("quote_id", "insurer", r4(low).alias("price"))


@query("round_prices")
def round_prices(spark, sf_dir):
    return submit.round_prices(quotes(spark, sf_dir).select("quote_id", *PRICE_COLS))


@query("log_target")
def log_target(spark, sf_dir):
    cells = quoted_rows(quotes(spark, sf_dir), ["quote_id"])
    log = log_price(F.col("price"))
    return cells.select(
        "quote_id", "insurer", r4(log).alias("log_y"), r4(unlog_price(log)).alias("back")
    )


@query("nn_prep")
def nn_prep(spark, sf_dir):
    """All numeric features filled and scaled, and the log price of every insurer."""
    rich = engineer_features(quotes(spark, sf_dir))
    columns = numeric_columns(rich)
    df = write_table(rich.select("quote_id", "block", *PRICE_COLS, *columns), "blocks")
    prep = fit_nn_prep(block(df, "block1"), clean.FeatureList(tuple(columns), ()))
    done = prep.transform(df)
    logs = [f"log_y_{i}" for i in INSURERS]
    for insurer, name in zip(INSURERS, logs, strict=True):
        done = with_log_target(done, price_col(insurer), name)
    return rounded(done, *logs, *columns).select("quote_id", *logs, *columns)
