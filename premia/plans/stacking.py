"""Fold models of two learners per insurer, stacked by ridge regression.

All insurers share one training table with a row per quote and insurer, whose features are bytes. The
models of all insurers, folds and bags of a learner are grown together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.numbers import floor_price
from premia.operators import boost, encode, order, stack, stats
from premia.operators.bins import Binning, fit_bins
from premia.operators.longform import quoted_rows, to_wide
from premia.plans import fitting
from premia.roles import INSURERS, N_FOLDS, ROLES, TARGET_ENCODED
from premia.session import write_table
from premia.sources.submissions import PredictionStore

PREDICTION_SCHEMA = "block string, quote_id long, price double, insurer string"


@dataclass(frozen=True)
class Settings:
    params_a: boost.BoostParams = boost.PRESETS["tweedie_a"]
    params_b: boost.BoostParams = boost.PRESETS["tweedie_b"]
    scout: boost.BoostParams = boost.PRESETS["scout"]
    folds: int = N_FOLDS
    zones: int = 100
    top_n: int = 100
    bags: int = 1
    bag_share: float = 0.85

    def bins(self) -> int:
        """Bins that all learners share."""
        return max(p.max_bins for p in (self.params_a, self.params_b, self.scout))


@dataclass(frozen=True)
class StackInputs:
    """Feature tables, the encoding of whole categories, and one row per quote and insurer.

    ``rows`` has ``quote_id``, ``insurer``, ``fold``, target, weight, hash and, as bytes, the features with
    the out-of-fold encodings.
    """

    prepared: fitting.Prepared
    rows: DataFrame
    binning: Binning
    encoding: encode.TargetEncoding
    encoded: tuple[str, ...]

    def later(self, insurers) -> DataFrame:
        """Later quotes once for each insurer, with the encodings of the whole training block."""
        names = F.explode(F.array(*[F.lit(i) for i in insurers])).alias("insurer")
        return self.encoding.transform(self.prepared.later.select("*", names), _te_name)


def _te_name(column: str) -> str:
    return column.removesuffix("_text") + "_te"


def stack_inputs(df: DataFrame, settings: Settings, insurers=INSURERS) -> StackInputs:
    prepared = fitting.prepare(df, "full", zones=settings.zones, recency=True)
    encoded = tuple(c for c in TARGET_ENCODED if c in prepared.features.features)
    texts = [f"{c}_text" for c in encoded]
    quoted = quoted_rows(prepared.train, [*ROLES.order_key, *texts], insurers)
    quoted = write_table(quoted, "quoted")
    capped = stats.fit_target_cap(quoted).transform(quoted)
    weighted = order.recency_weight(capped)
    binned = order.decile_bins(weighted)
    folded = write_table(order.stratified_folds(binned, n_folds=settings.folds), "folded")
    oof = encode.oof_target_encode(folded, texts, name=_te_name)
    codes = [f"{c}_te" for c in encoded]
    # The only join of features and encodings; its rows leave it as bytes.
    wide = prepared.train.select(ROLES.key, *prepared.inputs)
    long = oof.select(ROLES.key, "insurer", "fold", "y", "weight", *codes).join(wide, ROLES.key)
    binning = fit_bins(long, [*prepared.inputs, *codes], settings.bins())
    rows = boost.packed_rows(long, binning, weight="weight", keep=[ROLES.key, "insurer", "fold"])
    encoding = encode.fit_target_encoding(folded, texts)
    return StackInputs(prepared, write_table(rows.drop("_valid"), "stack"), binning, encoding, encoded)


def chosen_features(inputs: StackInputs, settings: Settings, insurers) -> dict[str, tuple[str, ...]]:
    """The most important inputs of each insurer's scout, which holds out the first fold."""
    spark = inputs.rows.sparkSession
    rows = inputs.rows.withColumn("_valid", F.col("fold") == 0)
    scouts = boost.fit_rows(rows, insurers, inputs.binning, settings.scout)
    found: dict[str, tuple[str, ...]] = {}
    for r in boost.top_features(spark, scouts, settings.top_n).orderBy("insurer", "rank").collect():
        found[r["insurer"]] = found.get(r["insurer"], ()) + (r["feature"],)
    return found


def fold_models(inputs: StackInputs, params, settings: Settings, chosen, bags: int) -> dict[str, boost.BoostedTrees]:
    """Models of every insurer, fold and bag, grown together. Without bags a fold has one, on all of its rows.

    The models of an insurer share its rows; a byte of a row says what it is to each of them.
    """
    members, roles = [], []
    absent, train, held = (F.expr(f"X'{k:02x}'") for k in (boost.ABSENT, boost.TRAIN, boost.HELD))
    for fold in range(settings.folds):
        for bag in range(max(bags, 1)):
            members.append(f"{fold}|{bag}")
            drawn = F.lit(True)
            if bags:
                others = inputs.rows.where(F.col("fold") != fold).select("insurer", ROLES.key)
                ends = order.bag_ends(others, ROLES.key, settings.bag_share, params.seed, bag, fold).collect()
                digest = order.salted_hash(ROLES.key, params.seed, bag, fold)
                drawn = F.lit(False)
                for r in ends:
                    upto = (digest < r["_cut"]) | ((digest == r["_cut"]) & (F.col(ROLES.key) <= r["_cut_key"]))
                    drawn = F.when(F.col("insurer") == r["insurer"], upto).otherwise(drawn)
            roles.append(F.when(F.col("fold") == fold, held).when(drawn, train).otherwise(absent))
    rows = inputs.rows.withColumn("_role", F.concat(*roles))
    allowed = {f"{i}|{m}": chosen[i] for i in chosen for m in members}
    return boost.fit_rows(rows, list(chosen), inputs.binning, params, allowed=allowed, members=members)


def price_of(models, fold, bag: int, binned: Binning | None = None) -> Column:
    """Price by the models of the insurer of a row, a fold and a bag."""
    return boost.score_own(models, F.concat("insurer", F.lit("|"), fold, F.lit(f"|{bag}")), binned)


def _mean_of_bags(models, fold, bags: int, binned: Binning | None = None) -> Column:
    return stack.mean_of([price_of(models, fold, bag, binned) for bag in range(max(bags, 1))])


@dataclass(frozen=True)
class InsurerStack:
    """All level-one models of an insurer and the level-two weights."""

    insurer: str
    features: tuple[str, ...]
    models_a: dict[str, boost.BoostedTrees]
    models_b: dict[str, boost.BoostedTrees]
    meta: stack.RidgeMeta
    metrics: dict[str, float]

    def stored_models(self) -> dict[str, boost.BoostedTrees]:
        """The last fold's model of each learner."""
        last = max(self.models_a)
        return {f"{self.insurer}_a": self.models_a[last], f"{self.insurer}_b": self.models_b[max(self.models_b)]}


def oof_predictions(inputs: StackInputs, settings: Settings, models_a, models_b) -> DataFrame:
    """Every row priced by the models of its own fold, which have not seen it."""
    return inputs.rows.select(
        ROLES.key,
        "insurer",
        "fold",
        F.col("_y").alias("y"),
        floor_price(_mean_of_bags(models_a, F.col("fold"), settings.bags, inputs.binning)).alias("pred_a"),
        floor_price(_mean_of_bags(models_b, F.col("fold"), 0, inputs.binning)).alias("pred_b"),
    )


def later_prices(inputs: StackInputs, settings: Settings, models_a, models_b, meta, insurers) -> DataFrame:
    """Stacked price of later quotes, from the mean of all fold models."""
    folds = [str(f) for f in range(settings.folds)]
    # Features become bytes once, whatever the number of models that read them.
    rows = inputs.binning.packed(inputs.later(insurers), ["block", ROLES.key, "insurer"])
    preds = rows.select(
        "block",
        ROLES.key,
        "insurer",
        stack.mean_of([_mean_of_bags(models_a, F.lit(f), settings.bags, inputs.binning) for f in folds]).alias("pred_a"),
        stack.mean_of([_mean_of_bags(models_b, F.lit(f), 0, inputs.binning) for f in folds]).alias("pred_b"),
    )
    return meta.transform(preds).select("block", ROLES.key, "price", "insurer")


def fit(inputs: StackInputs, settings: Settings, insurers) -> tuple[dict[str, InsurerStack], DataFrame]:
    """Stacks of all insurers that have prices, and the prices of the later quotes."""
    chosen = chosen_features(inputs, settings, insurers)
    if not chosen:
        return {}, inputs.rows.sparkSession.createDataFrame([], PREDICTION_SCHEMA)
    models_a = fold_models(inputs, settings.params_a, settings, chosen, settings.bags)
    models_b = fold_models(inputs, settings.params_b, settings, chosen, 0)
    oof = write_table(oof_predictions(inputs, settings, models_a, models_b), "oof")
    meta = stack.fit_ridge_meta(oof)
    y = F.col("y")
    scores = oof.groupBy("insurer").agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("pred_a") - y)).alias("mae_a"),
        F.avg(F.abs(F.col("pred_b") - y)).alias("mae_b"),
        F.avg(F.abs(meta.raw() - y)).alias("mae_meta"),
    )
    known = {r["insurer"]: r.asDict() for r in scores.collect()}

    def of(models, insurer):
        return {n: m for n, m in models.items() if n.split("|")[0] == insurer}

    stacks = {
        i: InsurerStack(i, chosen[i], of(models_a, i), of(models_b, i), meta, known[i]) for i in sorted(known)
    }
    return stacks, later_prices(inputs, settings, models_a, models_b, meta, list(stacks))


def metrics(spark: SparkSession, stacks: dict[str, InsurerStack]) -> DataFrame:
    rows = [
        (i, s.metrics["n"], s.metrics["mae_a"], s.metrics["mae_b"], s.metrics["mae_meta"])
        + s.meta.coefficients[i][:2]
        for i, s in sorted(stacks.items())
    ]
    return spark.createDataFrame(
        rows,
        "insurer string, n long, mae_a double, mae_b double, mae_meta double, "
        "weight_a double, weight_b double",
    )


def run(
    df: DataFrame, store: PredictionStore, settings: Settings = Settings(), insurers=INSURERS
) -> dict[str, InsurerStack]:
    """Fit and predict the insurers the store does not hold yet, all together."""
    done = {r[0] for r in store.completed().collect()}
    todo = [i for i in insurers if i not in done]
    if not todo:
        return {}
    stacks, prices = fit(stack_inputs(df, settings, todo), settings, todo)
    if stacks:
        prices = write_table(prices, "prices")
    for insurer in stacks:
        store.save(insurer, prices)
    return stacks


def submission(store: PredictionStore, block: str) -> DataFrame:
    """Wide prices of one block from the stored predictions."""
    return to_wide(store.predictions().where(F.col("block") == block), "quote_id", "price")
