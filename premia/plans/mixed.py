"""Prices from two model families: a plain one for some insurers, a log-target one for the rest."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.numbers import floor_price
from premia.operators import boost, clean, order, submit
from premia.plans import fitting, standard
from premia.roles import INSURERS, display_price_col, price_col

PLAIN = ("A", "H", "J")


@dataclass(frozen=True)
class Mixed:
    plain: standard.Fitted
    rich: standard.Fitted

    def score(self) -> DataFrame:
        """Two passes, one per feature set, joined by quote; ordered and rounded."""
        left = _prices(self.plain.models, self.plain.prepared.later)
        right = _prices(self.rich.models, self.rich.prepared.later)
        both = left.join(right, "quote_id")
        missing = [i for i in INSURERS if price_col(i) not in both.columns]
        full = both.withColumns({price_col(i): F.lit(None).cast("double") for i in missing})
        named = submit.rename_prices(full)
        return submit.round_prices(submit.order_columns(named, name=display_price_col))


def _prices(models, block: DataFrame) -> DataFrame:
    wanted = [clean.FeatureList(m.features, ()) for m in models.values()]
    names = tuple(dict.fromkeys(c for f in wanted for c in f.features))
    aligned = clean.align_schema(block, clean.FeatureList(names, ()), keep=("quote_id",))
    scored = boost.score_models(models)
    return aligned.select(
        "quote_id", *[floor_price(p).alias(price_col(i)) for i, p in scored.items()]
    )


def fit(
    df: DataFrame,
    plain: boost.BoostParams = boost.PRESETS["mae"],
    rich: boost.BoostParams = boost.PRESETS["rmse"],
    plain_insurers=PLAIN,
) -> Mixed:
    others = tuple(i for i in INSURERS if i not in plain_insurers)
    return Mixed(
        standard.fit(df, plain, plain_insurers),
        standard.fit(df, replace(rich, log_target=True), others, family="blend"),
    )


def holdout_eval(
    spark: SparkSession, path: str, df: DataFrame, insurers, family: str = "blend"
) -> DataFrame:
    """Error of stored models on the last fifth of block1, with rebuilt features."""
    models = boost.load_models(spark, path, insurers)
    prepared = fitting.prepare(df, family, INSURERS)
    split = order.temporal_split(prepared.train).where(F.col("split") == "valid")
    names = tuple(dict.fromkeys(c for m in models.values() for c in m.features))
    prices = [price_col(i) for i in models]
    aligned = clean.align_schema(split, clean.FeatureList(names, ()), keep=tuple(prices))
    scored = boost.score_models(models)
    cells = aligned.select(
        *prices, *[p.alias(f"pred_{i}") for i, p in scored.items()]
    )
    errors = {i: F.abs(F.col(f"pred_{i}") - F.col(price_col(i))) for i in models}
    totals = cells.agg(
        *[F.struct(F.count(e).alias("n"), F.avg(e).alias("mae")).alias(i) for i, e in errors.items()]
    )
    rows = F.array(*[F.struct(F.lit(i).alias("insurer"), f"{i}.n", f"{i}.mae") for i in models])
    return totals.select(F.inline(rows))
