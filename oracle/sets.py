"""Check SQL for the queries of ``premia.plans.checks_sets``."""

from __future__ import annotations

from oracle.ctes import INSURERS, TE_COLUMNS, each, price, r4, sql
from oracle.rows import NUMBERS

SQL: dict[str, str] = {}
LATER = "block <> 'block1'"


def _r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def _r3(x: str) -> str:
    return f"round_even(({x}) * 1000, 0) / 1000"


def _pivot(value: str, name, where: str = "", source: str = "scored") -> str:
    """One row per quote with ``value`` of each insurer."""
    cells = ", ".join(
        f"max(CASE WHEN insurer = '{i}' THEN {value} END) AS {name(i)}" for i in INSURERS
    )
    return f"SELECT quote_id, {cells} FROM {source} {where} GROUP BY quote_id"


def _display(i: str) -> str:
    return f'"Insurer {i} price"'


SQL["high_crime_area"] = sql(
    "SELECT quote_id, CASE WHEN municipality_crimes_per_1000 > (SELECT "
    "quantile_cont(municipality_crimes_per_1000, 0.75) FROM quotes WHERE block = 'block1') "
    "THEN 1 ELSE 0 END AS high_crime_area FROM quotes"
)
_freq = ("postal_code", "municipality", "vehicle_maker", "vehicle_model")
SQL["frequency_encode"] = sql(
    "SELECT quote_id, "
    + ", ".join(f"coalesce(f{n}.n, 1) AS {c}_freq" for n, c in enumerate(_freq))
    + " FROM quotes q "
    + " ".join(
        f"LEFT JOIN (SELECT {c}, count(*) AS n FROM quotes WHERE block = 'block1' GROUP BY {c}) f{n} "
        f"ON f{n}.{c} = q.{c}"
        for n, c in enumerate(_freq)
    )
)
SQL["median_impute"] = sql(
    "SELECT quote_id, "
    + ", ".join(
        r4(f"coalesce({c}, (SELECT median({c}) FROM quotes WHERE block = 'block1'))") + f" AS {c}"
        for c in NUMBERS
    )
    + " FROM quotes"
)
SQL["standard_scale"] = sql(
    "SELECT quote_id, "
    + ", ".join(r4(f"({c} - m_{c}) / s_{c}") + f" AS {c}" for c in NUMBERS)
    + " FROM quotes, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMBERS)
    + " FROM quotes WHERE block = 'block1')"
)
SQL["target_clip"] = sql(
    f"SELECT insurer, {r4('max(threshold)')} AS threshold, "
    "CAST(sum(CASE WHEN price > threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_clipped "
    "FROM capped GROUP BY insurer"
)
SQL["global_row_index"] = sql(
    "SELECT quote_id, row_number() OVER (ORDER BY quote_ts, quote_id) - 1 AS row_index FROM quotes"
)
SQL["quote_recency"] = sql(
    "SELECT quote_id, "
    + r4(
        "CASE block WHEN 'block2' THEN 1.0::DOUBLE WHEN 'block3' THEN 1.2::DOUBLE ELSE "
        "(row_number() OVER (PARTITION BY block ORDER BY quote_ts, quote_id) - 1)::DOUBLE "
        "/ count(*) OVER (PARTITION BY block) END"
    )
    + " AS quote_recency FROM quotes"
)
SQL["recency_weight"] = sql(
    "SELECT quote_id, insurer, "
    + r4(
        "0.5::DOUBLE + 0.5::DOUBLE * ((row_number() OVER (PARTITION BY insurer ORDER BY quote_ts, quote_id) - 1)"
        "::DOUBLE / greatest(count(*) OVER (PARTITION BY insurer) - 1, 1))"
    )
    + " AS weight FROM quoted"
)
SQL["temporal_split"] = sql(
    "SELECT quote_id, CASE WHEN row_number() OVER (ORDER BY quote_ts, quote_id) - 1 < "
    "floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END AS split "
    "FROM quotes WHERE block = 'block1'"
)
SQL["decile_bins"] = sql("SELECT quote_id, insurer, bin FROM binned")
SQL["stratified_folds"] = sql("SELECT quote_id, insurer, bin, fold FROM folded")
SQL["bag_sample"] = sql(
    "SELECT quote_id, insurer FROM (SELECT quote_id, insurer, row_number() OVER (PARTITION BY insurer "
    "ORDER BY md5('42|0|0|' || CAST(quote_id AS VARCHAR)), quote_id) AS pos, "
    "count(*) OVER (PARTITION BY insurer) AS n FROM quoted) WHERE pos <= floor(n * 0.85::DOUBLE)"
)
SQL["fold_split"] = sql(
    "SELECT quote_id, insurer, fold, CASE WHEN fold = 0 THEN 'valid' ELSE 'train' END AS part "
    "FROM folded"
)


def _oof_te(c: str) -> str:
    """Category total minus own fold, by windows: no join of the category tables."""
    total = f"PARTITION BY f.insurer, {c}"
    own = f"{total}, fold"
    n = f"(count(*) OVER ({total}) - count(*) OVER ({own}))"
    s = f"(sum(f.y) OVER ({total}) - sum(f.y) OVER ({own}))"
    return r4(f"CASE WHEN {n} > 0 THEN ({s} + 20 * prior) / ({n} + 20) ELSE prior END") + f" AS {c}_te"


SQL["oof_target_encode"] = sql(
    "SELECT f.quote_id, f.insurer, "
    + ", ".join(map(_oof_te, TE_COLUMNS))
    + " FROM folded f JOIN priors p USING (insurer)"
)


def _full_te(source: str, where: str) -> str:
    return sql(
        "SELECT f.quote_id, f.insurer, "
        + ", ".join(
            r4(f"coalesce((t_{c}.s + 20 * prior) / (t_{c}.n + 20), prior)") + f" AS {c}_te"
            for c in TE_COLUMNS
        )
        + f" FROM {source} f JOIN priors p USING (insurer) "
        + " ".join(
            f"LEFT JOIN (SELECT insurer, {c}, sum(y) s, count(*) n FROM folded GROUP BY ALL) t_{c} "
            f"ON t_{c}.insurer = f.insurer AND t_{c}.{c} = f.{c}"
            for c in TE_COLUMNS
        )
        + where
    )


SQL["test_target_encode"] = _full_te("cells", " WHERE f.block <> 'block1'")
SQL["insample_target_encode"] = _full_te("folded", "")

SQL["fit_per_insurer"] = sql(
    "SELECT o.insurer, count(*) AS n_train, count(DISTINCT vehicle_maker) AS n_categories, "
    f"{r4('avg(o.y)')} AS mean_price, {r4('avg(abs(pred_a - o.y))')} AS val_mae "
    "FROM oof o JOIN folded f ON f.quote_id = o.quote_id AND f.insurer = o.insurer GROUP BY o.insurer"
)
SQL["ridge_meta"] = sql(
    f"SELECT insurer, {r4('wa')} AS w_a, {r4('wb')} AS w_b, {r4('wd')} AS w_diff, "
    f"{_r2('w0')} AS intercept FROM ridge"
)
SQL["stacked_price"] = sql(
    "SELECT quote_id, insurer, "
    + _r2("greatest(w0 + wa * pred_a + wb * pred_b + wd * abs(pred_a - pred_b), 1)")
    + f" AS price FROM scored JOIN ridge USING (insurer) WHERE {LATER}"
)
SQL["score_block"] = sql(
    _pivot(r4("greatest(pred_a, 1)"), price, f"WHERE {LATER}")
)
_mixed = (
    "CASE WHEN insurer IN ('A', 'H', 'J') THEN greatest(pred_a, 1) "
    "ELSE greatest(exp(ln(1 + pred_b)) - 1, 1) END"
)
SQL["mixed_score"] = sql(_pivot(r4(_r3(_mixed)), _display, f"WHERE {LATER}"))
SQL["oof_predict"] = sql(
    f"SELECT quote_id, insurer, fold, {r4('greatest(pred_a, 1)')} AS pred_a, "
    f"{r4('greatest(pred_b, 1)')} AS pred_b FROM oof"
)
_fold_models = (
    "SELECT t.insurer, t.vehicle_maker, f.fold, "
    "CASE WHEN t.n - coalesce(s.n, 0) > 0 THEN (t.s - coalesce(s.s, 0) + 20 * prior) "
    "/ (t.n - coalesce(s.n, 0) + 20) ELSE prior END AS v "
    "FROM totals_a t JOIN priors USING (insurer) CROSS JOIN (SELECT DISTINCT fold FROM folded) f "
    "LEFT JOIN sums_a s ON s.insurer = t.insurer AND s.vehicle_maker = t.vehicle_maker "
    "AND s.fold = f.fold"
)
SQL["fold_average"] = sql(
    "SELECT quote_id, "
    + ", ".join(
        r4(f"max(CASE WHEN insurer = '{i}' THEN v END)") + f" AS {price(i)}" for i in INSURERS
    )
    + " FROM (SELECT c.quote_id, c.insurer, coalesce(m.v, prior) AS v FROM cells c "
    f"JOIN priors USING (insurer) LEFT JOIN (SELECT insurer, vehicle_maker, avg(v) AS v FROM ({_fold_models}) "
    "GROUP BY insurer, vehicle_maker) m ON m.insurer = c.insurer AND m.vehicle_maker = c.vehicle_maker "
    f"WHERE {LATER}) GROUP BY quote_id"
)
SQL["blend_grid"] = sql(f"SELECT insurer, weight, {r4('mae')} AS mae, n FROM blend_best")
SQL["blend_apply"] = sql(
    f"SELECT quote_id, insurer, {r4('greatest(weight * pred_a + (1 - weight) * pred_b, 1)')} AS price "
    f"FROM scored JOIN blend_best USING (insurer) WHERE {LATER}"
)
SQL["disagreement"] = sql(
    f"SELECT quote_id, insurer, {r4('abs(pred_a - pred_b)')} AS disagreement FROM oof"
)
SQL["simple_average"] = sql(
    f"SELECT quote_id, insurer, {r4('(pred_a + pred_b) / 2')} AS price FROM oof"
)
SQL["mae"] = sql(
    f"SELECT insurer, count(*) AS n, {r4('avg(abs(pred_a - y))')} AS mae FROM oof GROUP BY insurer"
)
SQL["write_metrics"] = SQL["mae"]
SQL["pooled_mae"] = sql(
    f"SELECT count(*) AS n, {r4('sum(abs(pred_a - y)) / count(*)')} AS mae FROM oof"
)
SQL["quote_rate"] = sql(
    "SELECT insurer, "
    + r4("avg(CASE WHEN price IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * 100")
    + " AS pct_quoted FROM cells WHERE block = 'block1' GROUP BY insurer"
)
SQL["target_summary"] = sql(
    f"SELECT insurer, count(*) AS n, {r4('min(y)')} AS min, {r4('max(y)')} AS max, "
    f"{r4('median(y)')} AS median, {r4('avg(y)')} AS mean FROM capped GROUP BY insurer"
)
SQL["prediction_summary"] = sql(
    f"SELECT insurer, {r4('avg(pred_a)')} AS mean, {r4('stddev_pop(pred_a)')} AS std, "
    f"{r4('min(pred_a)')} AS min, {r4('max(pred_a)')} AS max FROM scored WHERE {LATER} GROUP BY insurer"
)
SQL["training_summary"] = sql(
    f"SELECT insurer, {r4('mae_a')} AS mae_a, {r4('mae_b')} AS mae_b, {r4('mae')} AS mae_blend, "
    f"{r4('weight')} AS weight_a, {r4('1 - weight')} AS weight_b, n FROM blend_best JOIN "
    "(SELECT insurer, avg(abs(pred_a - y)) AS mae_a, avg(abs(pred_b - y)) AS mae_b FROM oof "
    "GROUP BY insurer) USING (insurer)"
)
SQL["actual_vs_predicted"] = sql(
    "SELECT q.quote_id, "
    + ", ".join(
        f"{r4(f'max(CASE WHEN insurer = {chr(39)}{i}{chr(39)} THEN y END)')} AS Insurer_{i}_actual, "
        f"{r4(f'max(CASE WHEN insurer = {chr(39)}{i}{chr(39)} THEN pred_a END)')} AS Insurer_{i}_predicted"
        for i in INSURERS
    )
    + " FROM quotes q LEFT JOIN oof o ON o.quote_id = q.quote_id WHERE q.block = 'block1' "
    "GROUP BY q.quote_id"
)
SQL["segment_bias"] = sql(
    "SELECT coalesce(insurer, 'ALL') AS insurer, coalesce(coverage_x_age_bucket, 'ALL') AS segment, "
    f"count(*) AS n, {r4('avg(pred_a - y)')} AS mean_error, {r4('avg(abs(pred_a - y))')} AS mae, "
    f"{r4('sum(pred_a) / sum(y)')} AS bias_ratio FROM oof "
    "GROUP BY ROLLUP (insurer, coverage_x_age_bucket)"
)
_segments = ("coverage", "payment_frequency", "usage", "province", "municipality", "vehicle_maker", "contractor_age_bucket")
_numbers = (
    "contractor_age", "claim_free_years", "vehicle_age", "vehicle_power", "vehicle_value_new",
    "postal_code_address_density", "vehicle_planned_annual_mileage", "municipality_crimes_per_1000",
)
_labels = [f"coalesce(CAST(f.{c} AS VARCHAR), '_MISSING_')" for c in _segments] + [
    f"CASE WHEN f.{c} IS NULL THEN '_MISSING_' ELSE 'b' || CAST(len(list_filter(list_distinct(cut_{c}), "
    f"lambda e: e < f.{c})) AS VARCHAR) END"
    for c in _numbers
]
_cuts = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS cut_{c}" for c in _numbers)
_each = " UNION ALL ".join(
    f"SELECT o.insurer, '{c}' AS segment, {label} AS value, o.pred_a, o.y FROM oof o "
    "JOIN feats f ON f.quote_id = o.quote_id CROSS JOIN cuts"
    for c, label in zip((*_segments, *_numbers), _labels)
)
SQL["demographic_bias"] = sql(
    f"SELECT s.insurer, s.segment, s.value, count(*) AS n, {r4('avg(pred_a - y)')} AS mean_error, "
    f"{r4('avg(abs(pred_a - y))')} AS mae, {r4('sum(pred_a) / sum(y)')} AS bias_ratio FROM ("
    "SELECT unnest(['ALL', insurer]) AS insurer, segment, value, pred_a, y FROM ("
    f"WITH cuts AS (SELECT {_cuts} FROM feats WHERE block = 'block1') {_each} "
    "UNION ALL SELECT insurer, 'ALL', 'ALL', pred_a, y FROM oof)) s GROUP BY ALL"
)
SQL["cross_insurer_mae"] = sql(
    f"SELECT m.insurer AS model, a.insurer AS insurer, {r4('avg(abs(m.pred_a - a.price))')} AS mae "
    "FROM scored m JOIN scored a ON a.quote_id = m.quote_id WHERE m.block = 'block1' "
    "GROUP BY m.insurer, a.insurer"
)
_new = f"CASE WHEN quote_id % 3 <> 0 THEN {_r3('pred_b')} ELSE {_r3('pred_a')} END"
SQL["keyed_merge"] = sql(_pivot(r4(_new), _display, f"WHERE {LATER}"))
_part = (
    f"CASE WHEN quote_id % 3 <> 0 AND insurer IN ('E', 'I', 'K') THEN {_r3('pred_b')} "
    f"ELSE {_r3('pred_a')} END"
)
SQL["replace_subset"] = sql(_pivot(r4(_part), price, f"WHERE {LATER}"))
SQL["format_submission"] = sql(_pivot(r4(_r3("pred_a")), _display, f"WHERE {LATER}"))
SQL["validate_submission"] = sql(
    "SELECT 'columns' AS rule, CAST(0 AS BIGINT) AS violations "
    "UNION ALL SELECT 'missing_prices', count(*) FROM cells WHERE block <> 'block3' AND price IS NULL "
    "UNION ALL SELECT 'prices_below_floor', count(*) FROM cells WHERE block <> 'block3' AND price < 1 "
    "UNION ALL SELECT 'duplicate_quotes', CAST(0 AS BIGINT) "
    "UNION ALL SELECT 'missing_quotes', count(*) FROM quotes WHERE block = 'block3' "
    "UNION ALL SELECT 'unknown_quotes', count(*) FROM quotes WHERE block = 'block1'"
)
SQL["checkpoint_resume"] = sql(
    "SELECT insurer, count(*) AS n, CASE WHEN insurer IN ('A', 'E', 'I') THEN 'saved' ELSE 'pending' END "
    "AS state FROM oof GROUP BY insurer"
)
SQL["submission_of_actuals"] = sql(
    "SELECT quote_id, "
    + each(r4("Insurer_{i}_price") + " AS Insurer_{i}_price")
    + " FROM quotes WHERE coalesce("
    + each("Insurer_{i}_price")
    + ") IS NOT NULL"
)
