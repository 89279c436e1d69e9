"""Reading blocks, heads and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from premia.operators.clean import nan_to_null
from premia.roles import ROLES


def read_block(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """A parquet block with missing numbers as null; only ``columns`` when given."""
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def block_shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def profile(df: DataFrame) -> DataFrame:
    """Type and non-null count per column and the row count: rows ``(name, dtype, ...)``."""
    names = df.columns
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{n}") for n, c in enumerate(names)]
    )
    types = dict(df.dtypes)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.lit(types[c]).alias("dtype"),
                F.col(f"_{n}").alias("non_null"),
                F.col("_rows").alias("n_rows"),
            )
            for n, c in enumerate(names)
        ]
    )
    return counts.select(F.inline(entries))


def head(df: DataFrame, n: int = 50_000, order_by=ROLES.order_key, index: bool = False) -> DataFrame:
    """First rows in key order, optionally numbered from 0 in an unnamed column."""
    top = df.orderBy(*order_by).limit(n)
    if not index:
        return top
    # One task numbers the rows, which are never more than the head.
    position = F.row_number().over(Window.orderBy(*order_by)) - 1
    return top.select(position.alias("Unnamed: 0"), "*")


def export_head(df: DataFrame, path: str, n: int = 50_000, order_by=ROLES.order_key) -> None:
    head(df, n, order_by, index=True).write.mode("overwrite").csv(path, header=True)
