"""Registered queries that train boosted trees, clusters or components.

All train on whole tables and all their features, with the depth, bins, penalties, samples and weights of
the presets. ``FEW`` limits the rounds: the presets' own numbers are for fits that may run for hours and are
resumed from their store. Results are rows of metrics or checked invariants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.operators import boost, stack, stats
from premia.operators.features import engineer_features
from premia.plans import bias, blend, fitting, mixed, stacking, standard
from premia.plans.registry import query
from premia.roles import INSURERS
from premia.session import scratch_path, write_table
from premia.sources.quotes import block, quotes
from premia.sources.submissions import PredictionStore

# Rounds, and how many without a lower error end a fit; each step is larger than those of the presets.
FEW = {"rounds": 6, "learning_rate": 0.3, "early_stop": 2}
# Features the scout keeps per insurer: fewer than there are.
SELECTED = 30
# Prices here are far larger than real premiums; the quadratic zone grows with them.
HUBER_DELTA = 15000.0


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quote blocks as files, the form in which a training run finds them."""
    return write_table(quotes(spark, sf_dir), "blocks")


@query("fit_mae")
def fit_mae(spark, sf_dir):
    return standard.fit(_blocks(spark, sf_dir), boost.preset("mae", **FEW)).metrics()


@query("fit_rmse")
def fit_rmse(spark, sf_dir):
    params = boost.preset("rmse", **FEW)
    return standard.fit(_blocks(spark, sf_dir), params, family="blend", capped=True).metrics()


@query("fit_huber")
def fit_huber(spark, sf_dir):
    params = boost.preset("huber", huber_delta=HUBER_DELTA, **FEW)
    return standard.fit(_blocks(spark, sf_dir), params, family="blend", capped=True).metrics()


@query("fit_l1_quick")
def fit_l1_quick(spark, sf_dir):
    params = boost.preset("l1_quick", **FEW)
    prepared, models = standard.quick_baseline(_blocks(spark, sf_dir), params)
    return fitting.score_block(models, prepared.later)


@query("fit_tweedie_a")
def fit_tweedie_a(spark, sf_dir):
    params = boost.preset("tweedie_a", **FEW)
    return standard.fit(_blocks(spark, sf_dir), params, family="full", weighted=True).metrics()


@query("fit_tweedie_b")
def fit_tweedie_b(spark, sf_dir):
    params = boost.preset("tweedie_b", **FEW)
    return standard.fit(_blocks(spark, sf_dir), params, family="full", weighted=True).metrics()


@query("fit_mae_fold")
def fit_mae_fold(spark, sf_dir):
    params = boost.preset("mae_fold", **FEW)
    return standard.fit(_blocks(spark, sf_dir), params, family="full").metrics()


@query("boosted_trees")
def boosted_trees(spark, sf_dir):
    """Training loss per round of every objective and insurer, all insurers grown together."""
    prepared = fitting.prepare(_blocks(spark, sf_dir), "blend")
    rows = []
    for objective in boost.OBJECTIVES:
        params = boost.BoostParams(objective, 3, 0.3, max_bins=254, huber_delta=HUBER_DELTA, row_share=0.9)
        for insurer, m in sorted(fitting.fit_with_holdout(prepared, params).items()):
            losses = [h["loss"] for h in m.history]
            rows += [(objective, insurer, n, x, n == 0 or x < losses[n - 1]) for n, x in enumerate(losses)]
    return spark.createDataFrame(rows, "objective string, insurer string, round int, loss double, falls boolean")


@query("fit_tweedie_bagged")
def fit_tweedie_bagged(spark, sf_dir):
    """Two bags of every fold and insurer, averaged: out-of-fold error of the bags and of their mean."""
    settings = stacking.Settings(boost.preset("tweedie_bagged", **FEW), boost.preset("tweedie_bagged", **FEW), bags=2)
    inputs = stacking.stack_inputs(_blocks(spark, sf_dir), settings)
    chosen = {i: inputs.binning.features for i in INSURERS}
    models = stacking.fold_models(inputs, settings.params_a, settings, chosen, settings.bags)
    bags = [stacking.price_of(models, F.col("fold"), bag, inputs.binning) for bag in range(settings.bags)]
    scored = {"bag0": bags[0], "bag1": bags[1], "mean": stack.mean_of(bags)}
    cells = inputs.rows.select("insurer", F.col("_y").alias("y"), *[p.alias(n) for n, p in scored.items()])
    return cells.groupBy("insurer").agg(
        F.count("*").alias("n"), *[F.avg(F.abs(F.col(n) - F.col("y"))).alias(f"mae_{n}") for n in scored]
    )


@query("fit_insample")
def fit_insample(spark, sf_dir):
    """Actual and in-sample predicted price of every training quote and insurer."""
    return bias.bias_table(
        _blocks(spark, sf_dir),
        params_a=boost.preset("insample_a", **FEW),
        params_b=boost.preset("insample_b", **FEW),
    )


@query("select_features")
def select_features(spark, sf_dir):
    """Scout importances per insurer: the chosen features in order."""
    fitted = standard.fit(_blocks(spark, sf_dir), boost.preset("scout", **FEW), family="blend")
    return boost.top_features(spark, fitted.models, SELECTED)


@query("feature_importance_top")
def feature_importance_top(spark, sf_dir):
    fitted = standard.fit(_blocks(spark, sf_dir), boost.preset("mae", **FEW))
    return boost.top_features(spark, fitted.models, 20)


@query("score_all_rows")
def score_all_rows(spark, sf_dir):
    """Boosted price of every later quote and insurer."""
    return standard.fit(_blocks(spark, sf_dir), boost.preset("mae", **FEW)).score()


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Largest difference between scores of the fitted and the stored models."""
    fitted = standard.fit(_blocks(spark, sf_dir), boost.preset("rmse", **FEW))
    path = scratch_path(spark, "models")
    boost.save_models(spark, fitted.models, path)
    again = boost.load_models(spark, path)
    both = {("was", i): m for i, m in fitted.models.items()}
    both |= {("is", i): m for i, m in again.items()}
    scored = boost.score_models(both)
    rows = fitted.prepared.later.select(
        *[scored["was", i].alias(f"was_{i}") for i in fitted.models],
        *[scored["is", i].alias(f"is_{i}") for i in fitted.models],
    )
    gaps = [F.max(F.abs(F.col(f"was_{i}") - F.col(f"is_{i}"))).alias(i) for i in fitted.models]
    return rows.agg(*gaps).unpivot([], list(fitted.models), "insurer", "largest_gap")


@query("ensemble_blend")
def ensemble_blend(spark, sf_dir):
    """Blended prices of the later blocks for the three blended insurers."""
    fitted = blend.fit(
        _blocks(spark, sf_dir),
        boost.preset("rmse", **FEW),
        boost.preset("huber", huber_delta=HUBER_DELTA, **FEW),
    )
    return fitted.score()


@query("mixed_models")
def mixed_models(spark, sf_dir):
    fitted = mixed.fit(
        _blocks(spark, sf_dir), boost.preset("mae", **FEW), boost.preset("rmse", **FEW)
    )
    return fitted.score()


@query("holdout_eval")
def holdout_eval(spark, sf_dir):
    """Every insurer's stored log-target model on the last fifth of block1."""
    df = _blocks(spark, sf_dir)
    params = boost.preset("rmse", log_target=True, **FEW)
    fitted = standard.fit(df, params, family="blend")
    path = scratch_path(spark, "models")
    boost.save_models(spark, fitted.models, path)
    return mixed.holdout_eval(spark, path, df, fitted.models)


@query("stacking")
def stacking_run(spark, sf_dir):
    """Stacked prices of the later blocks."""
    settings = stacking.Settings(
        boost.preset("tweedie_a", **FEW), boost.preset("tweedie_b", **FEW), boost.preset("scout", **FEW)
    )
    path = scratch_path(spark, "stacking")
    schema = spark.createDataFrame([], stacking.PREDICTION_SCHEMA).schema
    store = PredictionStore(spark, path, schema)
    stacking.run(_blocks(spark, sf_dir), store, settings)
    return store.predictions().select("block", "quote_id", "insurer", "price")


@query("risk_zones")
def risk_zones(spark, sf_dir):
    """Zones of all blocks and how many quotes lie in a zone other than the nearest centre."""
    df = quotes(spark, sf_dir)
    fitted = stats.fit_risk_zones(block(df, "block1"), 100)
    centres = fitted.centres()
    columns = list(fitted.medians.values)
    point = [F.coalesce(F.col(c), F.lit(fitted.medians.values[c])) for c in columns]
    distances = F.array(
        *[
            sum(((p - F.lit(x)) * (p - F.lit(x)) for p, x in zip(point, centre)), F.lit(0.0))
            for centre in centres
        ]
    )
    zoned = fitted.transform(df).withColumn("_d", distances)
    mine = F.get("_d", F.col("risk_zone").cast("int"))
    far = mine > F.array_min("_d") + 1e-9
    return zoned.groupBy("risk_zone").agg(
        F.count("*").alias("n"), F.sum(far.cast("int")).alias("not_nearest")
    )


@query("pca_features")
def pca_features(spark, sf_dir):
    """Variance of each component over block1 and its share of the first."""
    df = engineer_features(block(quotes(spark, sf_dir), "block1"))
    columns = [
        c
        for c, t in df.dtypes
        if t in ("double", "int") and not c.endswith("_price") and c != "quote_id"
    ]
    fitted = stats.fit_pca(df.select("quote_id", *columns), columns)
    scored = fitted.transform(df.select("quote_id", *columns))
    names = [f"pca_{n}" for n in range(len(fitted.signs))]
    spread = scored.agg(*[F.var_pop(c).alias(c) for c in names])
    return spread.unpivot([], names, "component", "variance")

