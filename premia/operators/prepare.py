"""Inputs of a smooth (non-tree) learner: numbers only, filled, scaled, log target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.functions.numbers import log_price
from premia.operators.clean import FeatureList
from premia.operators.encode import LabelCodes, fit_labels
from premia.operators.stats import Medians, Scaling, fit_medians, fit_scaling
from premia.roles import ROLES

FEW_NUMERIC = 5


@dataclass(frozen=True)
class NumericInputs:
    columns: tuple[str, ...]
    labels: LabelCodes | None
    medians: Medians
    scaling: Scaling

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the input columns by filled, scaled values; other columns stay."""
        coded = self.labels.transform(df) if self.labels else df
        return self.scaling.transform(self.medians.transform(coded))


def fit_nn_prep(train: DataFrame, features: FeatureList, order_by=ROLES.order_key) -> NumericInputs:
    """Use the numeric features; with fewer than five, label codes of categories as well."""
    names, labels, coded = features.numeric, None, train
    if len(names) < FEW_NUMERIC:
        labels = fit_labels(train, features.categorical, order_by)
        coded, names = labels.transform(train), features.features
    medians = fit_medians(coded, names)
    filled = medians.transform(coded)
    scaling = fit_scaling(filled, list(medians.values))
    return NumericInputs(tuple(medians.values), labels, medians, scaling)


def with_log_target(df: DataFrame, target: str = "y", name: str = "log_y") -> DataFrame:
    return df.withColumn(name, log_price(F.col(target)))
