"""Two models per insurer on actuarial features, mixed by the best held-out weight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.functions.numbers import floor_price
from premia.operators import boost, order, stack
from premia.plans import fitting
from premia.roles import price_col
from premia.session import write_table

BLENDED = ("E", "I", "K")


@dataclass(frozen=True)
class Blend:
    prepared: fitting.Prepared
    split: DataFrame
    models_a: dict[str, boost.BoostedTrees]
    models_b: dict[str, boost.BoostedTrees]
    grid: DataFrame
    weights: dict[str, float]

    def score(self) -> DataFrame:
        """Blended and floored price of every later quote."""
        a, b = both_scores(self.models_a, self.models_b)
        mixed = {
            i: floor_price(w * a[i] + (1 - w) * b[i]) for i, w in self.weights.items()
        }
        return stack.assemble_wide(self.prepared.later, mixed).select(
            "quote_id", *[price_col(i) for i in self.weights]
        )


def both_scores(models_a, models_b):
    """Price expressions of two model sets from one pass over the rows."""
    together = {("a", i): m for i, m in models_a.items()} | {
        ("b", i): m for i, m in models_b.items()
    }
    scored = boost.score_models(together)
    return (
        {i: scored["a", i] for i in models_a},
        {i: scored["b", i] for i in models_b},
    )


def long_predictions(df: DataFrame, models_a, models_b, keep=("quote_id",)) -> DataFrame:
    """Rows ``(keep..., insurer, pred_a, pred_b, y)`` of the quoted cells."""
    a, b = both_scores(models_a, models_b)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("insurer"),
                a[i].alias("pred_a"),
                b[i].alias("pred_b"),
                F.col(price_col(i)).alias("y"),
            )
            for i in models_a
        ]
    )
    return df.select(*keep, F.inline(cells)).where(F.col("y").isNotNull())


def fit(
    df: DataFrame,
    params_a: boost.BoostParams = boost.PRESETS["rmse"],
    params_b: boost.BoostParams = boost.PRESETS["huber"],
    insurers=BLENDED,
) -> Blend:
    prepared = fitting.prepare(df, "blend", insurers)
    split = order.temporal_split(prepared.train)
    caps = fitting.price_caps(split.where("split = 'train'"), insurers)
    models_a = fitting.fit_with_holdout(prepared, params_a, insurers, split, caps)
    models_b = fitting.fit_with_holdout(prepared, params_b, insurers, split, caps)
    held = long_predictions(split.where("split = 'valid'"), models_a, models_b)
    grid = write_table(stack.blend_grid(held), "blend")
    weights = {i: 0.5 for i in models_a} | stack.blend_weights(grid)
    return Blend(prepared, split, models_a, models_b, grid, weights)

