"""Category encodings: label codes and smoothed target means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from premia.functions.numbers import by_key
from premia.operators.clean import string_columns
from premia.operators.order import row_index
from premia.operators.stats import rows_per_column
from premia.roles import ROLES, SMOOTHING, TARGET_ENCODED
from premia.session import looked_up, small_side, write_table

UNSEEN_CODE = -1


@dataclass(frozen=True)
class LabelCodes:
    """Integer code per category: ``(column, category, code)``."""

    table: DataFrame
    columns: tuple[str, ...]
    sizes: dict[str, int]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Replace (or, with a suffix, add) codes; unseen categories become -1."""
        # Null is a category of its own here.
        found = looked_up(
            df,
            [
                (f"_code_{c}", [F.col(c).cast("string")], self.table.where(F.col("column") == c), ["category"], "code", self.sizes.get(c, 0))
                for c in self.columns
            ],
            drop=() if suffix else self.columns,
        )
        codes = {
            f"{c}{suffix}": F.coalesce(F.col(f"_code_{c}"), F.lit(UNSEEN_CODE)).cast("int")
            for c in self.columns
        }
        names = list(dict.fromkeys([*df.columns, *codes]))
        return found.select(*[codes[c].alias(c) if c in codes else F.col(f"`{c}`") for c in names])


def fit_labels(train: DataFrame, columns, order_by=ROLES.order_key) -> LabelCodes:
    """Codes by first appearance in key order, all columns in one pass."""
    columns = tuple(c for c in columns if c in train.columns)
    firsts = (
        train.select(*order_by, *[F.col(c).cast("string").alias(f"_s_{c}") for c in columns])
        .unpivot(list(order_by), [f"_s_{c}" for c in columns], "column", "category")
        .groupBy(F.expr("substring(column, 4)").alias("column"), "category")
        .agg(F.min(F.struct(*order_by)).alias("_first"))
        .select("column", "category", *[F.col(f"_first.{k}").alias(k) for k in order_by])
    )
    indexed = row_index(firsts, order_by, ("column",), "code")
    table = write_table(indexed.select("column", "category", F.col("code").cast("int")), "labels")
    return LabelCodes(table, columns, rows_per_column(table))


def fit_all_labels(train: DataFrame, roles=ROLES) -> LabelCodes:
    """Codes for every text column that is a feature."""
    names = [c for c in string_columns(train) if c not in roles.non_features]
    return fit_labels(train, names, roles.order_key)


def _smoothed(total: Column, n: Column, prior: Column, smoothing: float) -> Column:
    return (total + smoothing * prior) / (n + smoothing)


def target_means(train: DataFrame, target: str = "y") -> dict[str, float]:
    rows = train.groupBy("insurer").agg(F.avg(target).alias("m")).collect()
    return {r["insurer"]: r["m"] for r in rows}


def _category_sums(train: DataFrame, columns, keys, target: str) -> DataFrame:
    """Target sum and row count per insurer, column and category, in one pass."""
    return (
        train.select(*keys, target, *[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([*keys, target], list(columns), "column", "category")
        .where(F.col("category").isNotNull())
        .groupBy(*keys, "column", "category")
        .agg(F.sum(target).alias("_sum"), F.count("*").alias("_n"))
    )


def _attach(df: DataFrame, table: DataFrame, sizes, columns, keys, means, name) -> DataFrame:
    """Join each column's encoding; a category without one gets the insurer's mean."""
    prior = by_key(F.col("insurer"), means)
    # No table has a category that is null.
    out = looked_up(
        df,
        [
            (name(c), [F.col(k) for k in (*keys, c)], table.where(F.col("column") == c), [*keys, "category"], "_te", sizes.get(c, 0))
            for c in columns
        ],
    )
    encoded = {name(c): F.coalesce(F.col(name(c)), prior) for c in columns}
    return out.withColumns(encoded).select(*df.columns, *encoded)


def _te_name(column: str) -> str:
    return f"{column}_te"


def oof_target_encode(
    train: DataFrame,
    columns=TARGET_ENCODED,
    target: str = "y",
    smoothing: float = SMOOTHING,
    name=_te_name,
) -> DataFrame:
    """Smoothed target mean of each row's category over the other folds.

    ``train`` is long: ``insurer``, ``fold``, the target and the category columns. Sums of
    the other folds are the category's total minus its own fold; only those sums are
    shuffled, never the rows of a category.
    """
    columns = [c for c in columns if c in train.columns]
    means = target_means(train, target)
    sums = _category_sums(train, columns, ["insurer", "fold"], target)
    category = Window.partitionBy("insurer", "column", "category")
    others = sums.select(
        "insurer",
        "fold",
        "column",
        "category",
        (F.sum("_sum").over(category) - F.col("_sum")).alias("_sum"),
        (F.sum("_n").over(category) - F.col("_n")).alias("_n"),
    ).where(F.col("_n") > 0)
    prior = by_key(F.col("insurer"), means)
    te = others.withColumn("_te", _smoothed(F.col("_sum"), F.col("_n"), prior, smoothing))
    table = write_table(te.drop("_sum", "_n"), "oof_encoding")
    sizes = rows_per_column(table)
    return _attach(train, table, sizes, columns, ["insurer", "fold"], means, name)


@dataclass(frozen=True)
class TargetEncoding:
    """Smoothed target mean per insurer, column and category of all training rows."""

    table: DataFrame
    means: dict[str, float]
    columns: tuple[str, ...]
    sizes: dict[str, int]

    def transform(self, df: DataFrame, name=_te_name) -> DataFrame:
        """Encode long rows ``(insurer, categories...)``."""
        return _attach(
            df, self.table, self.sizes, self.columns, ["insurer"], self.means, name
        )

    def transform_wide(self, df: DataFrame, column: str, name) -> DataFrame:
        """Add one encoding of ``column`` per insurer to wide rows, with a single join."""
        mine = self.table.where(F.col("column") == column)
        wide = mine.groupBy(F.col("category").alias(column)).agg(
            *[F.max(F.when(F.col("insurer") == i, F.col("_te"))).alias(name(i)) for i in self.means]
        )
        filled = {name(i): F.coalesce(F.col(name(i)), F.lit(m)) for i, m in self.means.items()}
        return df.join(small_side(wide, self.sizes.get(column, 0)), column, "left").withColumns(filled)


def fit_target_encoding(
    train: DataFrame, columns=TARGET_ENCODED, target: str = "y", smoothing: float = SMOOTHING
) -> TargetEncoding:
    columns = tuple(c for c in columns if c in train.columns)
    means = target_means(train, target)
    sums = _category_sums(train, columns, ["insurer"], target)
    prior = by_key(F.col("insurer"), means)
    te = sums.withColumn("_te", _smoothed(F.col("_sum"), F.col("_n"), prior, smoothing))
    table = write_table(te.drop("_sum", "_n"), "target_encoding")
    return TargetEncoding(table, means, columns, rows_per_column(table))


def insample_target_encode(train: DataFrame, columns=TARGET_ENCODED, **kw) -> DataFrame:
    """Encode the fitted rows with their own target: for bias checks only."""
    return fit_target_encoding(train, columns, **kw).transform(train)


def fold_encoding_tables(
    train: DataFrame, column: str, target: str = "y", smoothing: float = SMOOTHING
) -> DataFrame:
    """Mean over the folds of each fold model's value: ``(insurer, category, value)``.

    The model of a fold sees the other folds; a category it never saw gets the prior.
    """
    means = target_means(train, target)
    sums = _category_sums(train, [column], ["insurer", "fold"], target)
    folds = train.select("fold").distinct().count()
    category = Window.partitionBy("insurer", "category")
    prior = by_key(F.col("insurer"), means)
    others_n = F.sum("_n").over(category) - F.col("_n")
    others = F.sum("_sum").over(category) - F.col("_sum")
    total = sums.select(
        "insurer",
        "category",
        F.sum("_sum").over(category).alias("_all"),
        F.sum("_n").over(category).alias("_all_n"),
        F.when(others_n > 0, _smoothed(others, others_n, prior, smoothing))
        .otherwise(prior)
        .alias("_own"),
    )
    # Folds without the category train on all of its rows.
    whole = _smoothed(F.col("_all"), F.col("_all_n"), prior, smoothing)
    per = total.withColumn("_whole", whole).groupBy("insurer", "category")
    return per.agg(
        (
            (F.sum("_own") + (F.lit(folds) - F.count("*")) * F.max("_whole")) / F.lit(folds)
        ).alias("value")
    )
