"""In-sample predictions beside actual prices, as input of bias reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.operators import boost, encode, evaluate, stack, stats
from premia.operators.bins import fit_bins
from premia.operators.longform import quoted_rows
from premia.plans import fitting
from premia.plans.stacking import _te_name
from premia.roles import INSURERS, TARGET_ENCODED
from premia.session import write_table


def insample_predictions(
    df: DataFrame,
    params_a: boost.BoostParams = boost.PRESETS["insample_a"],
    params_b: boost.BoostParams = boost.PRESETS["insample_b"],
    insurers=INSURERS,
    zones: int | None = 100,
) -> tuple[fitting.Prepared, DataFrame]:
    """Mean of two models on the rows they were fitted on: ``(quote_id, insurer, y, pred)``."""
    prepared = fitting.prepare(df, "full", insurers, zones=zones)
    encoded = [c for c in TARGET_ENCODED if c in prepared.features.features]
    texts = [f"{c}_text" for c in encoded]
    quoted = write_table(quoted_rows(prepared.train, ["quote_id", *texts], insurers), "quoted")
    capped = stats.fit_target_cap(quoted).transform(quoted)
    encoding = encode.fit_target_encoding(capped, texts)
    codes = [f"{c}_te" for c in encoded]
    wide = prepared.train.select("quote_id", *prepared.inputs)
    # Every quote and insurer once, with the sums of its categories; all insurers are fitted together.
    long = encoding.transform(capped, _te_name).select("quote_id", "insurer", "y", *codes).join(wide, "quote_id")
    binning = fit_bins(long, [*prepared.inputs, *codes], max(params_a.max_bins, params_b.max_bins))
    rows = write_table(boost.packed_rows(long, binning, keep=["quote_id", "insurer"]), "insample")
    models_a, models_b = (boost.fit_rows(rows, insurers, binning, p) for p in (params_a, params_b))
    mean = stack.simple_average(boost.score_own(models_a, "insurer", binning), boost.score_own(models_b, "insurer", binning))
    return prepared, rows.select("quote_id", "insurer", F.col("_y").alias("y"), mean.alias("pred"))


def bias_table(df: DataFrame, **kw) -> DataFrame:
    """Every training quote with actual and predicted price per insurer."""
    prepared, preds = insample_predictions(df, **kw)
    return evaluate.actual_vs_predicted(prepared.train, preds, kw.get("insurers", INSURERS))
