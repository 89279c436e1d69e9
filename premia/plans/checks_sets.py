"""Registered queries over sets of rows: statistics, order, encodings, ensembles, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.numbers import floor_price
from premia.operators import encode, evaluate, order, stack, stats, submit
from premia.operators.features import engineer_features
from premia.operators.longform import quoted_rows, to_long, to_wide
from premia.plans import standin
from premia.plans.checks_rows import numeric_columns
from premia.plans.registry import query, r4, rounded
from premia.roles import (
    DISPLAY_PRICE_COLS,
    FREQUENCY_ENCODED,
    INSURERS,
    PRICE_COLS,
    ROLES,
    display_price_col,
    price_col,
)
from premia.session import scratch_path, small_side, write_table
from premia.sources import submissions
from premia.sources.quotes import block, quotes

TE_COLUMNS = [f"{c}_te" for c in standin.CATEGORIES]
MAKER = ["vehicle_maker"]
# Insurers whose price comes from the plain model; the others use the log-target model.
PLAIN_INSURERS = ("A", "H", "J")


# --- fitted statistics ---------------------------------------------------------------


@query("high_crime_area")
def high_crime_area(spark, sf_dir):
    df = _stored(spark, sf_dir, "municipality_crimes_per_1000")
    fitted = stats.fit_high_crime_area(block(df, "block1"))
    return fitted.transform(df).select("quote_id", "high_crime_area")


@query("frequency_encode")
def frequency_encode(spark, sf_dir):
    df = _stored(spark, sf_dir, *FREQUENCY_ENCODED)
    fitted = stats.fit_frequencies(block(df, "block1"))
    return fitted.transform(df).select("quote_id", *[f"{c}_freq" for c in fitted.columns])


@query("median_impute")
def median_impute(spark, sf_dir):
    columns = numeric_columns(quotes(spark, sf_dir))
    df = _stored(spark, sf_dir, *columns)
    filled = stats.fit_medians(block(df, "block1"), columns).transform(df)
    return rounded(filled, *columns).drop("block")


@query("standard_scale")
def standard_scale(spark, sf_dir):
    columns = numeric_columns(quotes(spark, sf_dir))
    df = _stored(spark, sf_dir, *columns)
    scaled = stats.fit_scaling(block(df, "block1"), columns).transform(df)
    return rounded(scaled, *columns).drop("block")


def _quoted(spark, sf_dir):
    """Quoted cells of block1, written once: most operators here pass over them repeatedly."""
    cells = quoted_rows(standin.training_block(spark, sf_dir), ROLES.order_key)
    return write_table(cells, "quoted")


def _stored(spark, sf_dir, *columns):
    """Some columns of all blocks, written once."""
    return write_table(quotes(spark, sf_dir).select("quote_id", "block", *columns), "blocks")


@query("target_clip")
def target_clip(spark, sf_dir):
    quoted = _quoted(spark, sf_dir)
    report = stats.fit_target_cap(quoted).report(quoted)
    return rounded(report, "threshold")


# --- order, sampling -----------------------------------------------------------------


@query("global_row_index")
def global_row_index(spark, sf_dir):
    keys = quotes(spark, sf_dir).select(*ROLES.order_key)
    return order.row_index(keys).select("quote_id", "row_index")


@query("quote_recency")
def quote_recency(spark, sf_dir):
    keys = _stored(spark, sf_dir, "quote_ts")
    parts = [order.quote_recency(block(keys, "block1"))]
    parts += [order.later_recency(block(keys, b), b) for b in ("block2", "block3")]
    rows = [p.select("quote_id", r4("quote_recency").alias("quote_recency")) for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("recency_weight")
def recency_weight(spark, sf_dir):
    weighted = order.recency_weight(_quoted(spark, sf_dir).drop("price"))
    return weighted.select("quote_id", "insurer", r4("weight").alias("weight"))


@query("temporal_split")
def temporal_split(spark, sf_dir):
    first = block(_stored(spark, sf_dir, "quote_ts"), "block1")
    return order.temporal_split(first).select("quote_id", "split")


@query("decile_bins")
def decile_bins(spark, sf_dir):
    quoted = _quoted(spark, sf_dir)
    capped = stats.fit_target_cap(quoted).transform(quoted)
    return order.decile_bins(capped).select("quote_id", "insurer", "bin")


@query("stratified_folds")
def stratified_folds(spark, sf_dir):
    return standin.training(spark, sf_dir, MAKER).select("quote_id", "insurer", "bin", "fold")


@query("bag_sample")
def bag_sample(spark, sf_dir):
    return order.bag_sample(_quoted(spark, sf_dir)).select("quote_id", "insurer")


@query("fold_split")
def fold_split(spark, sf_dir):
    folded = standin.training(spark, sf_dir, MAKER).select("quote_id", "insurer", "fold")
    train, valid = order.fold_split(folded, 0)
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid"))
    )


# --- target encoding -----------------------------------------------------------------


@query("oof_target_encode")
def oof_target_encode(spark, sf_dir):
    encoded = encode.oof_target_encode(standin.training(spark, sf_dir), standin.CATEGORIES)
    return rounded(encoded.select("quote_id", "insurer", *TE_COLUMNS), *TE_COLUMNS)


@query("test_target_encode")
def test_target_encode(spark, sf_dir):
    rows = standin.blocks(spark, sf_dir)
    fitted = encode.fit_target_encoding(standin.folded_training(rows), standin.CATEGORIES)
    later = to_long(
        rows.where("block <> 'block1'"), ["quote_id", *standin.CATEGORIES], quoted_only=False
    )
    known = later.where(F.col("insurer").isin(list(fitted.means)))
    encoded = fitted.transform(known.drop("price"))
    return rounded(encoded.select("quote_id", "insurer", *TE_COLUMNS), *TE_COLUMNS)


@query("insample_target_encode")
def insample_target_encode(spark, sf_dir):
    encoded = encode.insample_target_encode(standin.training(spark, sf_dir), standin.CATEGORIES)
    return rounded(encoded.select("quote_id", "insurer", *TE_COLUMNS), *TE_COLUMNS)


# --- closed-form models, ensembles -----------------------------------------------------


def _models(spark, sf_dir):
    """All blocks, folded training rows, fitted stand-in models."""
    columns = [*standin.MODEL_COLUMNS.values(), "coverage_x_age_bucket"]
    rows = standin.blocks(spark, sf_dir).select("block", *ROLES.order_key, *columns, *PRICE_COLS)
    rows = write_table(rows, "blocks")
    folded = standin.folded_training(rows, columns)
    return rows, folded, standin.fit_models(folded)


def _oof(spark, sf_dir):
    columns = [*standin.MODEL_COLUMNS.values(), "coverage_x_age_bucket"]
    return standin.oof_predictions(standin.training(spark, sf_dir, columns))


@query("fit_per_insurer")
def fit_per_insurer(spark, sf_dir):
    """One closed-form model per insurer, fitted and scored out of fold together."""
    preds = _oof(spark, sf_dir)
    fitted = preds.groupBy("insurer").agg(
        F.count("*").alias("n_train"),
        F.countDistinct("vehicle_maker").alias("n_categories"),
        F.avg("y").alias("mean_price"),
        F.avg(F.abs(F.col("pred_a") - F.col("y"))).alias("val_mae"),
    )
    return rounded(fitted, "mean_price", "val_mae")


@query("ridge_meta")
def ridge_meta(spark, sf_dir):
    meta = stack.fit_ridge_meta(_oof(spark, sf_dir))
    rows = spark.createDataFrame(
        meta.rows(), "insurer string, w_a double, w_b double, w_diff double, intercept double"
    )
    return rounded(rows, "w_a", "w_b", "w_diff").withColumn(
        "intercept", F.floor(F.col("intercept") * 100 + 0.5) / 100
    )


@query("stacked_price")
def stacked_price(spark, sf_dir):
    """Ridge fitted on out-of-fold predictions, applied to the later blocks."""
    rows, folded, models = _models(spark, sf_dir)
    meta = stack.fit_ridge_meta(standin.oof_predictions(folded))
    later = models.score_long(rows.where("block <> 'block1'"))
    priced = meta.transform(later.drop("price"))
    return priced.select(
        "quote_id", "insurer", (F.floor(F.col("price") * 100 + 0.5) / 100).alias("price")
    )


@query("score_block")
def score_block(spark, sf_dir):
    """A price for every cell of the later blocks, also where the insurer declines."""
    rows, _, models = _models(spark, sf_dir)
    later = rows.where("block <> 'block1'").select("quote_id", "vehicle_maker")
    wide = models.score_wide(later, "pred_a", price_col)
    preds = {i: floor_price(F.col(price_col(i))) for i in models.encoding.means}
    return rounded(stack.assemble_wide(wide, preds), *PRICE_COLS)


@query("mixed_score")
def mixed_score(spark, sf_dir):
    """Three insurers from the plain model, eight from a log-target model."""
    rows, _, models = _models(spark, sf_dir)
    later = rows.where("block <> 'block1'").select("quote_id", *standin.MODEL_COLUMNS.values())
    wide = models.score_wide(later, "pred_a", lambda i: f"plain_{i}")
    wide = models.score_wide(wide, "pred_b", lambda i: f"rich_{i}")
    preds = {}
    for i in models.encoding.means:
        if i in PLAIN_INSURERS:
            preds[i] = stack.finish_price(F.col(f"plain_{i}"))
        else:
            preds[i] = stack.finish_price(F.log1p(f"rich_{i}"), log_target=True)
    done = submit.order_columns(submit.rename_prices(stack.assemble_wide(wide, preds)))
    return rounded(submit.round_prices(done), *DISPLAY_PRICE_COLS)


@query("oof_predict")
def oof_predict(spark, sf_dir):
    preds = _oof(spark, sf_dir)
    return preds.select(
        "quote_id",
        "insurer",
        "fold",
        *[r4(floor_price(F.col(c))).alias(c) for c in ("pred_a", "pred_b")],
    )


@query("fold_average")
def fold_average(spark, sf_dir):
    """Later blocks priced by the mean of the five fold models."""
    rows, folded, models = _models(spark, sf_dir)
    table = encode.fold_encoding_tables(folded, "vehicle_maker")
    means = models.encoding.means
    wide = table.groupBy(F.col("category").alias("vehicle_maker")).agg(
        *[F.max(F.when(F.col("insurer") == i, F.col("value"))).alias(price_col(i)) for i in means]
    )
    later = rows.where("block <> 'block1'").select("quote_id", "vehicle_maker")
    joined = later.join(small_side(wide), "vehicle_maker", "left")
    preds = {i: F.coalesce(F.col(price_col(i)), F.lit(m)) for i, m in means.items()}
    return rounded(stack.assemble_wide(joined, preds), *PRICE_COLS)


@query("blend_grid")
def blend_grid(spark, sf_dir):
    return rounded(stack.blend_grid(_oof(spark, sf_dir)), "mae")


@query("blend_apply")
def blend_apply(spark, sf_dir):
    rows, folded, models = _models(spark, sf_dir)
    weights = stack.blend_weights(stack.blend_grid(standin.oof_predictions(folded)))
    later = models.score_long(rows.where("block <> 'block1'")).drop("price")
    return stack.blend_apply(later, weights).select("quote_id", "insurer", r4("price").alias("price"))


@query("disagreement")
def disagreement(spark, sf_dir):
    gap = stack.disagreement(F.col("pred_a"), F.col("pred_b"))
    return _oof(spark, sf_dir).select("quote_id", "insurer", r4(gap).alias("disagreement"))


@query("simple_average")
def simple_average(spark, sf_dir):
    mean = stack.simple_average(F.col("pred_a"), F.col("pred_b"))
    return _oof(spark, sf_dir).select("quote_id", "insurer", r4(mean).alias("price"))


# --- evaluation --------------------------------------------------------------------------


@query("mae")
def mae(spark, sf_dir):
    columns = [*standin.MODEL_COLUMNS.values()]
    preds = standin.oof_predictions(standin.training(spark, sf_dir, columns))
    return rounded(evaluate.mae(preds, "pred_a"), "mae")


@query("pooled_mae")
def pooled_mae(spark, sf_dir):
    return rounded(evaluate.pooled_mae(_oof(spark, sf_dir), "pred_a"), "mae")


@query("quote_rate")
def quote_rate(spark, sf_dir):
    return rounded(evaluate.quote_rate(standin.training_block(spark, sf_dir)), "pct_quoted")


@query("target_summary")
def target_summary(spark, sf_dir):
    quoted = _quoted(spark, sf_dir)
    capped = stats.fit_target_cap(quoted).transform(quoted)
    return rounded(evaluate.target_summary(capped), "min", "max", "median", "mean")


@query("prediction_summary")
def prediction_summary(spark, sf_dir):
    rows, _, models = _models(spark, sf_dir)
    later = models.score_long(rows.where("block <> 'block1'"))
    return rounded(evaluate.prediction_summary(later, "pred_a"), "mean", "std", "min", "max")


@query("training_summary")
def training_summary(spark, sf_dir):
    summary = evaluate.training_summary(_oof(spark, sf_dir))
    return rounded(summary, "mae_a", "mae_b", "mae_blend", "weight_a", "weight_b")


@query("actual_vs_predicted")
def actual_vs_predicted(spark, sf_dir):
    preds = _oof(spark, sf_dir).withColumn("pred", F.col("pred_a"))
    every = standin.training_block(spark, sf_dir)
    wide = evaluate.actual_vs_predicted(every, preds)
    return rounded(wide, *[c for c in wide.columns if c != "quote_id"])


@query("segment_bias")
def segment_bias(spark, sf_dir):
    bias = evaluate.segment_bias(_oof(spark, sf_dir), "coverage_x_age_bucket", "pred_a")
    return rounded(bias, "mean_error", "mae", "bias_ratio")


# Demographic and vehicle columns of the bias report: categories, and numbers cut at their fitted quartiles.
SEGMENTS = ("coverage", "payment_frequency", "usage", "province", "municipality", "vehicle_maker", "contractor_age_bucket")
NUMERIC_SEGMENTS = (
    "contractor_age", "claim_free_years", "vehicle_age", "vehicle_power", "vehicle_value_new",
    "postal_code_address_density", "vehicle_planned_annual_mileage", "municipality_crimes_per_1000",
)


@query("demographic_bias")
def demographic_bias(spark, sf_dir):
    """Bias of the out-of-fold predictions in fifteen segments at once."""
    columns = [c for c in (*SEGMENTS, *NUMERIC_SEGMENTS) if c != "vehicle_maker"]
    rows = engineer_features(standin.training_block(spark, sf_dir)).select("quote_id", *columns)
    rows = write_table(rows, "segments")
    preds = _oof(spark, sf_dir).select("quote_id", "insurer", "vehicle_maker", "y", "pred_a").join(rows, "quote_id")
    edges = evaluate.segment_edges(rows, NUMERIC_SEGMENTS)
    bias = evaluate.bias_by_segments(preds, SEGMENTS, edges, "pred_a")
    return rounded(bias, "mean_error", "mae", "bias_ratio")


@query("cross_insurer_mae")
def cross_insurer_mae(spark, sf_dir):
    rows, _, models = _models(spark, sf_dir)
    first = block(rows, "block1").select("quote_id", "vehicle_maker", *PRICE_COLS)
    wide = models.score_wide(first, "pred_a", lambda i: f"Insurer_{i}_predicted")
    known = [i for i in INSURERS if i in models.encoding.means]
    return rounded(evaluate.cross_insurer_mae(wide, known), "mae")


# --- submissions -----------------------------------------------------------------------------


def _base_and_new(spark, sf_dir, insurers=INSURERS):
    """A full submission from model a and new prices from model b for some quotes only."""
    rows, _, models = _models(spark, sf_dir)
    later = rows.where("block <> 'block1'").select("quote_id", *standin.MODEL_COLUMNS.values())
    wide = models.score_wide(later, "pred_a", lambda i: f"a_{i}")
    wide = models.score_wide(wide, "pred_b", lambda i: f"b_{i}")
    known = models.encoding.means
    base = stack.assemble_wide(wide, {i: F.col(f"a_{i}") for i in known})
    part = wide.where(F.col("quote_id") % 3 != 0)
    new = stack.assemble_wide(part, {i: F.col(f"b_{i}") for i in known})
    return base, new.select("quote_id", *[price_col(i) for i in insurers])


@query("keyed_merge")
def keyed_merge(spark, sf_dir):
    base, new = _base_and_new(spark, sf_dir)
    named = submit.format_submission(base).withColumnRenamed("quote_id", "Quote ID")
    merged = submit.keyed_merge(named, new, key="Quote ID", new_key="quote_id").withColumnRenamed("Quote ID", "quote_id")
    return rounded(merged, *DISPLAY_PRICE_COLS)


@query("replace_subset")
def replace_subset(spark, sf_dir):
    base, part = _base_and_new(spark, sf_dir, ("E", "I", "K"))
    return rounded(submit.replace_subset(base, part), *PRICE_COLS)


@query("format_submission")
def format_submission(spark, sf_dir):
    base, _ = _base_and_new(spark, sf_dir)
    done = submit.format_submission(base)
    return rounded(done, *[display_price_col(i) for i in INSURERS])


@query("validate_submission")
def validate_submission(spark, sf_dir):
    """The raw quotes as a submission: declined prices and foreign quotes are violations."""
    df = quotes(spark, sf_dir)
    given = df.where("block <> 'block3'").select("quote_id", *PRICE_COLS)
    return submit.validate_submission(given, df.where("block <> 'block1'"))


# --- stores ---------------------------------------------------------------------------------


@query("write_metrics")
def write_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    metrics = rounded(evaluate.mae(_oof(spark, sf_dir), "pred_a"), "mae")
    submissions.write_metrics(metrics, path)
    return submissions.read_metrics(spark, path, metrics.schema)


@query("checkpoint_resume")
def checkpoint_resume(spark, sf_dir):
    """Insurers left to do, with their rows, after three were saved."""
    preds = _oof(spark, sf_dir).select("quote_id", "insurer", "pred_a")
    store = submissions.PredictionStore(spark, scratch_path(spark, "store"), preds.schema)
    for insurer in ("E", "I", "A"):
        store.save(insurer, preds)
    left = preds.groupBy("insurer").agg(F.count("*").alias("n"))
    saved = store.predictions().groupBy("insurer").agg(F.count("*").alias("n"))
    return (
        store.pending(left)
        .withColumn("state", F.lit("pending"))
        .unionByName(saved.withColumn("state", F.lit("saved")))
    )


@query("submission_of_actuals")
def submission_of_actuals(spark, sf_dir):
    """Long prices back to one wide row per quote."""
    cells = quoted_rows(quotes(spark, sf_dir), ["quote_id"])
    return rounded(to_wide(cells, "quote_id", "price"), *PRICE_COLS)
