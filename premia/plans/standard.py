"""Date features, one absolute-error model per insurer, time-ordered hold-out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from premia.operators import boost, order
from premia.plans import fitting
from premia.roles import INSURERS


@dataclass(frozen=True)
class Fitted:
    prepared: fitting.Prepared
    split: DataFrame
    models: dict[str, boost.BoostedTrees]

    def metrics(self) -> DataFrame:
        return fitting.holdout_metrics(self.split.sparkSession, self.models, self.split)

    def score(self, block: DataFrame | None = None) -> DataFrame:
        return fitting.score_block(self.models, self.prepared.later if block is None else block)


def fit(
    df: DataFrame,
    params: boost.BoostParams = boost.PRESETS["mae"],
    insurers=INSURERS,
    family: str = "dates",
    capped: bool = False,
    weighted: bool = False,
) -> Fitted:
    """``capped`` cuts training prices off at their cap, ``weighted`` gives newer quotes more weight."""
    prepared = fitting.prepare(df, family, insurers)
    split = order.temporal_split(prepared.train)
    first = split.where("split = 'train'")
    caps = fitting.price_caps(first, insurers) if capped else None
    weights = fitting.recency_weights(first, insurers) if weighted else None
    models = fitting.fit_with_holdout(prepared, params, insurers, split, caps, weights)
    return Fitted(prepared, split, models)


def quick_baseline(
    df: DataFrame, params: boost.BoostParams = boost.PRESETS["l1_quick"], insurers=INSURERS
) -> tuple[fitting.Prepared, dict[str, boost.BoostedTrees]]:
    """No derived features, no hold-out, a fixed number of rounds."""
    prepared = fitting.prepare(df, "raw", insurers)
    return prepared, fitting.fit_with_holdout(prepared, params, insurers)
