"""Combining predictions: blends, averages, stacked ridge, wide assembly.

Long predictions are rows ``(quote_id, insurer, pred_a, pred_b[, y])``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions.numbers import by_key, floor_price
from premia.roles import INSURERS, price_col

# Weights of the first model tried by the blend search.
BLEND_GRID = tuple(round(k * 0.05, 2) for k in range(21))
META_INPUTS = ("pred_a", "pred_b", "disagreement")


def disagreement(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def simple_average(a: Column, b: Column) -> Column:
    return (a + b) / 2


def blend_scores(preds: DataFrame, target: str = "y", grid=BLEND_GRID) -> DataFrame:
    """Mean absolute error of every weight, one row per insurer and weight.

    All weights are aggregates of one pass; rows are not multiplied by the grid.
    """
    a, b, y = F.col("pred_a"), F.col("pred_b"), F.col(target)
    errors = [F.avg(F.abs(w * a + (1 - w) * b - y)).alias(f"w{n}") for n, w in enumerate(grid)]
    scored = preds.groupBy("insurer").agg(*errors, F.count(y).alias("n"))
    pairs = F.array(
        *[F.struct(F.lit(w).alias("weight"), F.col(f"w{n}").alias("mae")) for n, w in enumerate(grid)]
    )
    return scored.select("insurer", "n", F.inline(pairs))


def blend_grid(preds: DataFrame, target: str = "y", grid=BLEND_GRID, digits: int = 9) -> DataFrame:
    """Best weight per insurer; of equal errors the smallest weight.

    Errors are compared to ``digits`` decimals, below which they are summation noise.
    """
    scored = blend_scores(preds, target, grid)
    return scored.groupBy("insurer").agg(
        F.min_by("weight", F.struct(F.round("mae", digits), F.col("weight"))).alias("weight"),
        F.min("mae").alias("mae"),
        F.max("n").alias("n"),
    )


def blend_weights(grid: DataFrame) -> dict[str, float]:
    return {r["insurer"]: r["weight"] for r in grid.select("insurer", "weight").collect()}


def blend_apply(preds: DataFrame, weights: dict[str, float], name: str = "price") -> DataFrame:
    w = by_key(F.col("insurer"), weights, 0.5)
    mixed = w * F.col("pred_a") + (1 - w) * F.col("pred_b")
    return preds.withColumn(name, floor_price(mixed))


@dataclass(frozen=True)
class RidgeMeta:
    """Coefficients of ``pred_a, pred_b, |pred_a - pred_b|`` and intercept per insurer."""

    coefficients: dict[str, tuple[float, float, float]]
    intercepts: dict[str, float]

    def raw(self) -> Column:
        """Stacked price before the floor."""
        inputs = [F.col("pred_a"), F.col("pred_b"), disagreement(F.col("pred_a"), F.col("pred_b"))]
        insurer = F.col("insurer")
        value = by_key(insurer, self.intercepts)
        for n, x in enumerate(inputs):
            value = value + by_key(insurer, {i: c[n] for i, c in self.coefficients.items()}) * x
        return value

    def transform(self, preds: DataFrame, name: str = "price") -> DataFrame:
        return preds.withColumn(name, floor_price(self.raw()))

    def rows(self) -> list[tuple]:
        return [(i, *c, self.intercepts[i]) for i, c in sorted(self.coefficients.items())]


def fit_ridge_meta(preds: DataFrame, target: str = "y", alpha: float = 1.0) -> RidgeMeta:
    """Ridge with intercept for all insurers: one aggregation of moments, then 3x3 solves."""
    y = F.col(target)
    x = preds.where(y.isNotNull()).select(
        "insurer",
        "pred_a",
        "pred_b",
        disagreement(F.col("pred_a"), F.col("pred_b")).alias("disagreement"),
        y.alias("_y"),
    )
    pairs = list(combinations_with_replacement(META_INPUTS, 2))
    rows = (
        x.groupBy("insurer")
        .agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(f"mean_{c}") for c in (*META_INPUTS, "_y")],
            *[F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in pairs],
            *[F.covar_pop(a, "_y").alias(f"cov_{a}_y") for a in META_INPUTS],
        )
        .collect()
    )
    coefficients, intercepts = {}, {}
    for r in rows:
        gram = np.zeros((3, 3))
        for a, b in pairs:
            i, j = META_INPUTS.index(a), META_INPUTS.index(b)
            gram[i, j] = gram[j, i] = r[f"cov_{a}_{b}"] * r["n"]
        moment = np.array([r[f"cov_{a}_y"] * r["n"] for a in META_INPUTS])
        w = np.linalg.solve(gram + alpha * np.eye(3), moment)
        means = np.array([r[f"mean_{a}"] for a in META_INPUTS])
        coefficients[r["insurer"]] = tuple(float(v) for v in w)
        intercepts[r["insurer"]] = float(r["mean__y"] - w @ means)
    return RidgeMeta(coefficients, intercepts)


def fold_average(preds: DataFrame, keys=("quote_id", "insurer"), value: str = "pred") -> DataFrame:
    """Mean over fold (or bag) models of a long table of predictions."""
    return preds.groupBy(*keys).agg(F.avg(value).alias(value))


def mean_of(columns) -> Column:
    """Mean over fold models that are columns of the same row."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    return sum(columns[1:], columns[0]) / len(columns)


def finish_price(pred: Column, log_target: bool = False) -> Column:
    """Back from the log scale where needed, then floored."""
    return floor_price(F.expm1(pred) if log_target else pred)


def assemble_wide(df: DataFrame, predictions: dict[str, Column], key: str = "quote_id"):
    """One submission row per quote from one prediction expression per insurer."""
    missing = [i for i in INSURERS if i not in predictions]
    filled = {**predictions, **{i: F.lit(None).cast("double") for i in missing}}
    return df.select(key, *[filled[i].alias(price_col(i)) for i in INSURERS])

