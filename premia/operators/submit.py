"""Assembling, merging and checking submission tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.functions.numbers import round_price
from premia.roles import (
    DISPLAY_PRICE_COLS,
    INSURERS,
    PRICE_COLS,
    PRICE_FLOOR,
    display_price_col,
    price_col,
)


def rename_prices(df: DataFrame) -> DataFrame:
    """``Insurer_X_price`` to ``Insurer X price``; nothing when already renamed."""
    if PRICE_COLS[0] not in df.columns:
        return df
    return df.withColumnsRenamed(dict(zip(PRICE_COLS, DISPLAY_PRICE_COLS)))


def order_columns(df: DataFrame, key: str = "quote_id", name=display_price_col) -> DataFrame:
    return df.select(key, *[name(i) for i in INSURERS])


def round_prices(df: DataFrame, columns=None) -> DataFrame:
    columns = columns or [c for c in df.columns if c in PRICE_COLS + DISPLAY_PRICE_COLS]
    return df.withColumns({c: round_price(F.col(c)) for c in columns})


def format_submission(df: DataFrame) -> DataFrame:
    return round_prices(rename_prices(df))


def priced_as(df: DataFrame, insurers=INSURERS):
    """Naming function under which a table has the price of each of ``insurers``."""
    have = set(df.columns)
    fitting = [name for name in (price_col, display_price_col) if have.issuperset(map(name, insurers))]
    if not fitting:
        lacking = sorted({price_col(i) for i in insurers} - have)
        raise ValueError(f"a price column per insurer is needed; lacking {', '.join(lacking)}")
    return fitting[0]


def keyed_merge(
    base: DataFrame, new: DataFrame, insurers=INSURERS, round_all: bool = False, check: bool = True,
    key: str = "quote_id", new_key: str | None = None,
) -> DataFrame:
    """Replace the prices of ``insurers`` by key; rows without a new price keep theirs.

    Column set and order of ``base`` are kept. New prices are rounded; ``round_all``
    also rounds the prices that stay. Both tables must have each key once, which is
    counted in one pass over the keys of both.
    """
    new_key = new_key or key
    base_name, new_name = priced_as(base), priced_as(new, insurers)
    if check:
        keys = base.select(F.col(key).alias("_k"), F.lit(0).alias("_t"))
        keys = keys.union(new.select(F.col(new_key).alias("_k"), F.lit(1).alias("_t")))
        again = keys.groupBy("_t", "_k").count().where("count > 1").agg(F.min("_t"), F.max("_t")).first()
        if again[0] is not None:
            raise ValueError(f"the {('base', 'new')[again[0]]} table repeats values of its key")
    fresh = new.select(
        F.col(new_key).alias("_key"),
        *[round_price(F.col(new_name(i))).alias(f"_new_{i}") for i in insurers],
    )
    merged = base.join(fresh, F.col(key) == F.col("_key"), "left")
    replaced = {
        base_name(i): F.coalesce(F.col(f"_new_{i}"), F.col(base_name(i))) for i in insurers
    }
    out = merged.withColumns(replaced).select(*base.columns)
    return round_prices(out) if round_all else out


def replace_subset(base: DataFrame, part: DataFrame, insurers=("E", "I", "K"), **keys) -> DataFrame:
    """Replace a few insurers of a full submission and round every price; ``keys`` name the keys."""
    return keyed_merge(base, part, insurers, round_all=True, **keys)


def validate_submission(df: DataFrame, expected: DataFrame, key: str = "quote_id") -> DataFrame:
    """Violation counts, one row per rule; a valid submission has zeros only.

    Rules: exactly the expected columns, a number of at least the floor in every cell, one
    row per expected quote and no other.
    """
    name = priced_as(df)
    columns = [key, *[name(i) for i in INSURERS]]
    stray = len(set(df.columns) ^ set(columns))
    prices = [F.col(c) for c in columns[1:] if c in df.columns]
    missing = sum(((p.isNull() | F.isnan(p)).cast("int") for p in prices), F.lit(0))
    low = sum((F.coalesce((p < PRICE_FLOOR).cast("int"), F.lit(0)) for p in prices), F.lit(0))
    cells = df.select(F.col(key).alias("_key"), missing.alias("_m"), low.alias("_l"))
    per_key = cells.groupBy("_key").agg(
        F.count("*").alias("_n"), F.sum("_m").alias("_m"), F.sum("_l").alias("_l")
    )
    both = per_key.join(
        expected.select(F.col(key).alias("_want")).distinct(),
        F.col("_key") == F.col("_want"),
        "full",
    )

    def count(condition):
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    counts = both.agg(
        F.lit(stray).cast("long").alias("columns"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_prices"),
        F.coalesce(F.sum("_l"), F.lit(0)).alias("prices_below_floor"),
        count(F.col("_n") > 1).alias("duplicate_quotes"),
        count(F.col("_key").isNull()).alias("missing_quotes"),
        count(F.col("_want").isNull()).alias("unknown_quotes"),
    )
    return counts.unpivot([], counts.columns, "rule", "violations")
