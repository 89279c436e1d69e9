"""Scores and reports. Declined quotes never count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.operators.quantiles import column_quantiles, exact_quantiles
from premia.operators.stack import blend_grid
from premia.roles import INSURERS, MISSING, price_col

# Shares at which numeric segment columns are cut.
QUARTERS = (0.25, 0.5, 0.75)


def abs_error(pred: str = "pred", target: str = "y") -> Column:
    return F.abs(F.col(pred) - F.col(target))


def mae(preds: DataFrame, pred: str = "pred", target: str = "y") -> DataFrame:
    """Mean absolute error per insurer over rows that have a price."""
    err = abs_error(pred, target)
    return preds.groupBy("insurer").agg(F.count(err).alias("n"), F.avg(err).alias("mae"))


def pooled_mae(preds: DataFrame, pred: str = "pred", target: str = "y") -> DataFrame:
    """Sum of absolute errors over count of priced cells, all insurers together."""
    err = abs_error(pred, target)
    return preds.agg(F.count(err).alias("n"), (F.try_divide(F.sum(err), F.count(err))).alias("mae"))


def quote_rate(df: DataFrame, insurers=INSURERS) -> DataFrame:
    """Percentage of rows each insurer priced: one pass over the wide block."""
    rates = [F.avg(F.col(price_col(i)).isNotNull().cast("double")).alias(i) for i in insurers]
    return (
        df.agg(*rates)
        .unpivot([], list(insurers), "insurer", "rate")
        .select("insurer", (F.col("rate") * 100).alias("pct_quoted"))
    )


def target_summary(quoted: DataFrame, target: str = "y") -> DataFrame:
    """Rows, minimum, maximum, median and mean price per insurer."""
    found = exact_quantiles(quoted, target, [0.5], by=["insurer"])
    means = {r[0]: r[1] for r in quoted.groupBy("insurer").agg(F.avg(target)).collect()}
    rows = [
        (k[0], q.count, q.minimum, q.maximum, q.values[0], means[k[0]]) for k, q in found.items()
    ]
    return quoted.sparkSession.createDataFrame(
        rows, "insurer string, n long, min double, max double, median double, mean double"
    )


def prediction_summary(preds: DataFrame, pred: str = "pred") -> DataFrame:
    """Mean, population deviation, minimum and maximum of the predictions."""
    return preds.groupBy("insurer").agg(
        F.avg(pred).alias("mean"),
        F.stddev_pop(pred).alias("std"),
        F.min(pred).alias("min"),
        F.max(pred).alias("max"),
    )


def training_summary(preds: DataFrame, target: str = "y") -> DataFrame:
    """Per insurer: error of both models and of the best blend, its weights, row count."""
    base = preds.groupBy("insurer").agg(
        F.avg(abs_error("pred_a", target)).alias("mae_a"),
        F.avg(abs_error("pred_b", target)).alias("mae_b"),
    )
    best = blend_grid(preds, target).select(
        "insurer",
        F.col("mae").alias("mae_blend"),
        F.col("weight").alias("weight_a"),
        (1 - F.col("weight")).alias("weight_b"),
        "n",
    )
    return base.join(best, "insurer").orderBy("insurer")


def pooled_from_summary(summary: DataFrame, error: str = "mae_blend") -> DataFrame:
    """Pooled error as the row-weighted mean of the insurers' errors."""
    return summary.agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col(error) * F.col("n")), F.sum("n")).alias("mae"),
    )


def actual_vs_predicted(quotes: DataFrame, preds: DataFrame, insurers=INSURERS) -> DataFrame:
    """Every quote with actual and predicted price per insurer, null where declined."""
    cells = []
    for i in insurers:
        mine = F.col("insurer") == i
        cells.append(F.max(F.when(mine, F.col("y"))).alias(f"Insurer_{i}_actual"))
        cells.append(F.max(F.when(mine, F.col("pred"))).alias(f"Insurer_{i}_predicted"))
    wide = preds.groupBy("quote_id").agg(*cells)
    return quotes.select("quote_id").join(wide, "quote_id", "left")


def segment_bias(preds: DataFrame, segment: str, pred: str = "pred", target: str = "y") -> DataFrame:
    """Bias per insurer and segment value, with totals (label ``ALL``) per rollup level."""
    error = F.col(pred) - F.col(target)
    return (
        preds.where(F.col(target).isNotNull())
        .rollup("insurer", segment)
        .agg(
            F.count("*").alias("n"),
            F.avg(error).alias("mean_error"),
            F.avg(F.abs(error)).alias("mae"),
            F.try_divide(F.sum(pred), F.sum(target)).alias("bias_ratio"),
            F.grouping("insurer").alias("_all_insurers"),
            F.grouping(segment).alias("_all_segments"),
        )
        .select(
            F.when(F.col("_all_insurers") == 1, "ALL").otherwise(F.col("insurer")).alias("insurer"),
            F.when(F.col("_all_segments") == 1, "ALL").otherwise(F.col(segment)).alias("segment"),
            "n",
            "mean_error",
            "mae",
            "bias_ratio",
        )
    )


def segment_edges(rows: DataFrame, columns, probs=QUARTERS) -> dict[str, tuple[float, ...]]:
    """Distinct inner edges of numeric columns, fitted by counting; columns without a value have none."""
    found = column_quantiles(rows, columns, probs)
    return {c: tuple(sorted(set(found[c].values))) if c in found else () for c in columns}


def segment_label(column: str, edges: tuple[float, ...] | None = None) -> Column:
    """The segment of a row as text: a category, or the right-closed bin ``b0``, ``b1``, ... of a number."""
    value = F.col(column)
    if edges is None:
        return F.coalesce(value.cast("string"), F.lit(MISSING))
    above = [(value.cast("double") > e).cast("int") for e in edges]
    place = sum(above, F.lit(0)).cast("string")
    return F.when(value.isNull() | F.isnan(value.cast("double")), MISSING).otherwise(F.concat(F.lit("b"), place))


def bias_by_segments(
    preds: DataFrame, categories=(), edges=None, pred: str = "pred", target: str = "y"
) -> DataFrame:
    """Bias per insurer and value of every segment column, with totals, in one aggregation.

    ``edges`` maps numeric segment columns to their fitted edges (``segment_edges``); ``categories`` are
    taken as they are. Returns ``insurer``, ``segment`` (the column), ``value``, ``n``, ``mean_error``,
    ``mae`` and ``bias_ratio``. Totals have ``ALL`` as insurer, or as segment and value. Grouping sets copy
    a row once per set inside the task and are summed there, so what is shuffled grows with the number of
    insurers and values, not with the rows; a column of very many values should be left out or binned first.
    Rows without a target or a prediction do not count; nulls and NaN are a value of their own, ``_MISSING_``.
    """
    edges = edges or {}
    names = [*categories, *edges]
    error = F.col(pred) - F.col(target)
    labels = [segment_label(c, edges.get(c)).alias(f"_s{k}") for k, c in enumerate(names)]
    rows = preds.where(F.col(target).isNotNull() & F.col(pred).isNotNull()).select(
        F.col("insurer").alias("_insurer"),
        *labels,
        error.alias("_error"),
        F.col(pred).alias("_pred"),
        F.col(target).alias("_target"),
    )
    own = [f"_s{k}" for k in range(len(names))]
    sets = [[], ["_insurer"], *([s] for s in own), *(["_insurer", s] for s in own)]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], "_insurer", *own).agg(
        F.count("*").alias("n"),
        F.avg("_error").alias("mean_error"),
        F.avg(F.abs("_error")).alias("mae"),
        F.try_divide(F.sum("_pred"), F.sum("_target")).alias("bias_ratio"),
        F.grouping("_insurer").alias("_all"),
        *[F.grouping(s).alias(f"{s}_all") for s in own],
    )
    segment = F.coalesce(*[F.when(F.col(f"{s}_all") == 0, F.lit(c)) for s, c in zip(own, names)], F.lit("ALL"))
    value = F.coalesce(*[F.when(F.col(f"{s}_all") == 0, F.col(s)) for s in own], F.lit("ALL"))
    return grouped.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("_insurer")).alias("insurer"),
        segment.alias("segment"),
        value.alias("value"),
        "n",
        "mean_error",
        "mae",
        "bias_ratio",
    ).where("n > 0")


def cross_insurer_mae(wide: DataFrame, insurers=INSURERS, pred=None) -> DataFrame:
    """Error of the model of ``i`` against the prices of ``j``: rows ``(model, insurer, mae)``.

    ``wide`` has one row per quote with a predicted and an actual column per insurer, so
    the whole matrix is one aggregation; rows are not paired.
    """
    predicted = pred or (lambda i: f"Insurer_{i}_predicted")
    names = [(i, j) for i in insurers for j in insurers]
    cells = wide.agg(
        *[
            F.avg(F.abs(F.col(predicted(i)) - F.col(price_col(j)))).alias(f"{i}_{j}")
            for i, j in names
        ]
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("model"), F.lit(j).alias("insurer"), F.col(f"{i}_{j}").alias("mae"))
            for i, j in names
        ]
    )
    return cells.select(F.inline(entries))
