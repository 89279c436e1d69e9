"""Closed-form price models for all insurers at once.

Model a is the smoothed mean price by maker, model b by municipality. They train with
two small aggregations, so the ensemble, scoring and submission operators can be run
and checked value by value without boosted trees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.operators.clean import fill_categorical
from premia.operators.encode import TargetEncoding, fit_target_encoding, oof_target_encode
from premia.operators.features import engineer_features
from premia.operators.longform import quoted_rows, to_long
from premia.operators.order import decile_bins, stratified_folds
from premia.operators.stats import fit_target_cap
from premia.roles import MISSING, ROLES, TARGET_ENCODED
from premia.session import write_table
from premia.sources.quotes import block, quotes

MODEL_COLUMNS = {"pred_a": "vehicle_maker", "pred_b": "municipality"}
# The zone is a fitted cluster, which no closed form gives; the coverage stands in for it.
CATEGORIES = tuple("coverage" if c == "risk_zone" else c for c in TARGET_ENCODED)


def categories(df: DataFrame) -> DataFrame:
    """Keys, block, prices and filled category columns of a block."""
    return fill_categorical(engineer_features(df), CATEGORIES)


def folded_training(rows: DataFrame, columns=CATEGORIES) -> DataFrame:
    """Quoted training rows in long form with capped target ``y``, decile bin and fold."""
    keep = [*ROLES.order_key, *columns]
    quoted = write_table(quoted_rows(rows.where(F.col("block") == "block1"), keep), "quoted")
    capped = fit_target_cap(quoted).transform(quoted)
    return write_table(stratified_folds(decile_bins(capped)), "folded")


def training(spark: SparkSession, sf_dir: str, columns=CATEGORIES) -> DataFrame:
    return folded_training(categories(quotes(spark, sf_dir)), columns)


def _name(column: str) -> str:
    return next(k for k, v in MODEL_COLUMNS.items() if v == column)


def oof_predictions(folded: DataFrame) -> DataFrame:
    """Out-of-fold predictions of both models for every quoted training row."""
    encoded = oof_target_encode(folded, list(MODEL_COLUMNS.values()), name=_name)
    return encoded


@dataclass(frozen=True)
class StandInModels:
    encoding: TargetEncoding

    def score_long(self, rows: DataFrame, keep=("quote_id",)) -> DataFrame:
        """Predictions for every quote and insurer, declined ones too."""
        columns = [c for c in MODEL_COLUMNS.values() if c not in keep]
        cells = to_long(rows, [*keep, *columns], quoted_only=False)
        known = cells.where(F.col("insurer").isin(list(self.encoding.means)))
        return self.encoding.transform(known, name=_name)

    def score_wide(self, rows: DataFrame, model: str, name) -> DataFrame:
        """One prediction column per insurer."""
        column = MODEL_COLUMNS[model]
        filled = rows.withColumn(column, F.coalesce(F.col(column), F.lit(MISSING)))
        return self.encoding.transform_wide(filled, column, name)


def fit_models(folded: DataFrame) -> StandInModels:
    return StandInModels(fit_target_encoding(folded, list(MODEL_COLUMNS.values())))


def blocks(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    rows = categories(quotes(spark, sf_dir))
    return rows.where(F.col("block").isin(list(names))) if names else rows


def training_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block(quotes(spark, sf_dir), "block1")
