"""Per-insurer training: shared inputs, models grown together, summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.numbers import floor_price
from premia.operators import boost, clean, encode, order, stats
from premia.operators.bins import fit_bins
from premia.operators.features import engineer_features
from premia.operators.longform import quoted_rows
from premia.operators.quantiles import column_quantiles
from premia.operators.stack import assemble_wide
from premia.roles import CLIP_QUANTILE, INSURERS, ROLES, ColumnRoles, price_col
from premia.session import write_table

# Feature family without derived columns.
RAW = "raw"


@dataclass(frozen=True)
class Prepared:
    """Feature tables of the training block and the later blocks, with equal columns."""

    train: DataFrame
    later: DataFrame
    features: clean.FeatureList
    roles: ColumnRoles

    @property
    def inputs(self) -> list[str]:
        """Model inputs: categories stand as codes."""
        return list(self.features.features)


def prepare(
    df: DataFrame,
    family: str = "full",
    insurers=INSURERS,
    zones: int | None = None,
    recency: bool = False,
    roles: ColumnRoles = ROLES,
    drop=(),
) -> Prepared:
    """Fit every statistic on block1 and apply it to all blocks alike.

    The result is written once: all insurers, folds and learners read it.
    """
    raw = df.drop(*drop)
    first = raw.where(F.col("block") == "block1")
    typed = clean.infer_numeric(first, roles).transform(raw)
    rich = typed if family == RAW else engineer_features(typed, family, insurers, roles)
    train = rich.where(F.col("block") == "block1")
    if family in ("blend", "full") and "municipality_crimes_per_1000" in rich.columns:
        rich = stats.fit_high_crime_area(train).transform(rich)
    if family == "full":
        rich = stats.fit_frequencies(train).transform(rich)
    if zones:
        rich = stats.fit_risk_zones(train, zones).transform(rich)
    if recency:
        keys = first.select(*roles.order_key)
        position = order.quote_recency(keys).select(roles.key, "quote_recency")
        joined = rich.join(position, roles.key, "left")
        later = F.lit(None).cast("double")
        for name, value in order.LATER_RECENCY.items():
            later = F.when(F.col("block") == name, value).otherwise(later)
        rich = joined.withColumn("quote_recency", F.coalesce("quote_recency", later))
    features = clean.feature_list(rich, roles)
    filled = clean.fill_categorical(rich, features.categorical)
    codes = encode.fit_labels(
        filled.where(F.col("block") == "block1"), features.categorical, roles.order_key
    )
    # Codes replace the text of inputs; the text stays under its own name for encodings.
    kept = filled.withColumns({f"{c}_text": F.col(c) for c in features.categorical})
    table = write_table(codes.transform(kept), "inputs")
    first_rows = table.where(F.col("block") == "block1")
    return Prepared(first_rows, table.where(F.col("block") != "block1"), features, roles)


def price_caps(rows: DataFrame, insurers=INSURERS) -> dict[str, float]:
    """Quantile at which each insurer's training prices are cut off."""
    found = column_quantiles(rows, [price_col(i) for i in insurers], [CLIP_QUANTILE])
    return {i: found[price_col(i)].values[0] for i in insurers if price_col(i) in found}


def recency_weights(rows: DataFrame, insurers=INSURERS) -> DataFrame:
    """``quote_id``, ``insurer`` and the recency weight of every quoted row, for all insurers at once."""
    weighed = order.recency_weight(quoted_rows(rows, ROLES.order_key, insurers))
    return write_table(weighed.select(ROLES.key, "insurer", "weight"), "weights")


def fit_with_holdout(
    prepared: Prepared,
    params: boost.BoostParams,
    insurers=INSURERS,
    split: DataFrame | None = None,
    caps: dict[str, float] | None = None,
    weights: DataFrame | None = None,
    store: str | None = None,
) -> dict[str, boost.BoostedTrees]:
    """One model per insurer, all grown together; rows tagged ``valid`` in ``split`` are held out.

    ``weights`` has a weight per quote and insurer; a row without one weighs 1. The features of a quote
    are binned once, whichever insurers priced it.
    """
    rows = prepared.train if split is None else split
    valid = (F.col("split") == "valid") if "split" in rows.columns else F.lit(False)
    nominal = prepared.features.categorical if params.nominal else ()
    binning = fit_bins(rows.where(~valid), prepared.inputs, params.max_bins, nominal)
    prices = [price_col(i) for i in insurers]
    keyed = rows.withColumns({"_valid": valid, "_h": F.xxhash64(ROLES.key)})
    binned = binning.packed(keyed, [ROLES.key, "_valid", "_h", *prices])

    def target(insurer: str) -> Column:
        price, cap = F.col(price_col(insurer)).cast("double"), (caps or {}).get(insurer)
        if cap is None:
            return price
        # Only training rows are capped; validation keeps the quoted price.
        return F.when(F.col("_valid") | price.isNull(), price).otherwise(F.least(price, F.lit(cap)))

    cells = F.array(*[F.struct(F.lit(i).alias("insurer"), target(i).alias("_y")) for i in insurers])
    long = binned.select(ROLES.key, "_valid", "_h", "_x", F.inline(cells)).where("_y IS NOT NULL")
    weight = F.lit(1.0)
    if weights is not None:
        long = long.join(weights.select(ROLES.key, "insurer", "weight"), [ROLES.key, "insurer"], "left")
        weight = F.coalesce(F.col("weight"), F.lit(1.0))
    return boost.fit_rows(long.withColumn("_w", weight), insurers, binning, params, store)


def score_block(
    models: dict[str, boost.BoostedTrees],
    block: DataFrame,
    finish: Callable[[Column], Column] = floor_price,
) -> DataFrame:
    """Price of every quote by every model, declined or not: one pass over the block."""
    return assemble_wide(block, {i: finish(p) for i, p in boost.score_models(models).items()})


def holdout_metrics(
    spark: SparkSession, models: dict[str, boost.BoostedTrees], split: DataFrame
) -> DataFrame:
    """Rows, best round and held-out error per insurer."""
    held = split.where(F.col("split") == "valid")
    preds = boost.score_models(models)
    wide = held.select(
        *[price_col(i) for i in models], *[p.alias(f"pred_{i}") for i, p in preds.items()]
    )
    errors = wide.agg(
        *[F.avg(F.abs(F.col(f"pred_{i}") - F.col(price_col(i)))).alias(f"mae_{i}") for i in models],
        *[F.count(price_col(i)).alias(f"n_{i}") for i in models],
    ).first()
    trained = (
        split.where(F.col("split") == "train")
        .agg(*[F.count(price_col(i)).alias(i) for i in models])
        .first()
    )
    rows = [
        (i, trained[i], errors[f"n_{i}"], m.best_iteration, errors[f"mae_{i}"], *m_loss(m))
        for i, m in sorted(models.items())
    ]
    return spark.createDataFrame(
        rows,
        "insurer string, n_train long, n_val long, best_iteration int, val_mae double, "
        "first_loss double, last_loss double",
    )


def m_loss(model: boost.BoostedTrees) -> tuple[float, float]:
    return model.history[0]["loss"], model.history[-1]["loss"]
