"""Wide quotes to one row per quote and insurer, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.roles import INSURERS, price_col


def to_long(df: DataFrame, keep, insurers=INSURERS, quoted_only: bool = True) -> DataFrame:
    """One row ``(keep..., insurer, price)`` per quote and insurer.

    Declined quotes are dropped unless ``quoted_only`` is off; they are never filled.
    """
    long = df.unpivot(
        list(keep), [price_col(i) for i in insurers], "insurer", "price"
    ).withColumn("insurer", F.substring("insurer", len("Insurer_") + 1, 1))
    return long.where(F.col("price").isNotNull()) if quoted_only else long


def quoted_rows(df: DataFrame, keep, insurers=INSURERS) -> DataFrame:
    return to_long(df, keep, insurers, quoted_only=True)


def to_wide(long: DataFrame, key: str, value: str, insurers=INSURERS, name=price_col) -> DataFrame:
    """One column per insurer; null where the long form has no row."""
    return long.groupBy(key).agg(
        *[F.max(F.when(F.col("insurer") == i, F.col(value))).alias(name(i)) for i in insurers]
    )



def attach_columns(df: DataFrame, extra: DataFrame, keys=("quote_id", "insurer")) -> DataFrame:
    """Add the columns of a table keyed like ``df``. Row-local columns need no join."""
    return df.join(extra, list(keys), "left")
