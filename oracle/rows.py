"""Check SQL for the queries of ``premia.plans.checks_rows``."""

from __future__ import annotations

from oracle.ctes import INSURERS, each, price, r4, sql
# Columns of the feature queries, and what the projection of all of them shows.
FEATURES = {
    "contractor_age": ["contractor_age"],
    "second_driver_age": ["second_driver_age"],
    "has_second_driver": ["has_second_driver"],
    "days_since_inspection": ["days_since_inspection"],
    "inspection_days_remaining": ["inspection_days_remaining"],
    "years_since_last_registration": ["years_since_last_registration"],
    "years_since_first_registration": ["years_since_first_registration"],
    "years_since_country_first_reg": ["years_since_country_first_reg"],
    "age_squares": ["contractor_age_sq", "second_driver_age_sq"],
    "age_bucket": ["contractor_age_bucket"],
    "claim_free_x_age": ["claim_free_x_age"],
    "claim_free_per_age": ["claim_free_per_age"],
    "claim_free_x_vehicle_age": ["claim_free_x_vehicle_age"],
    "second_driver_interactions": ["second_driver_claim_free_x_age", "total_claim_free_years", "claim_free_diff"],
    "power_weight": ["weight_per_power", "power_per_weight"],
    "value_ratios": ["value_per_age", "log_vehicle_value"],
    "value_per_power": ["value_per_power"],
    "log_exposure": ["log_address_density", "log_mileage"],
    "has_deficiencies": ["has_deficiencies"],
    "deductible_row_stats": ["mean_deductible", "std_deductible", "max_deductible", "min_deductible"],
    "ded_vs_mean": [f"{i}_ded_vs_mean" for i in INSURERS],
    "ded_ratio": ["mean_deductible_ratio", *[f"{i}_ded_ratio" for i in INSURERS]],
    "coverage_x_age_bucket": ["coverage_x_age_bucket"],
}
TEXT = ("contractor_age_bucket", "coverage_x_age_bucket")
WHOLE = ("has_second_driver", "has_deficiencies")
DATES = (
    "contractor_birthdate",
    "second_driver_birthdate",
    "vehicle_first_registration_date",
    "vehicle_country_first_registration_date",
    "vehicle_last_registration_date",
    "vehicle_inspection_report_date",
    "vehicle_inspection_expiry_date",
)
CATEGORIES = (
    "coverage",
    "payment_frequency",
    "usage",
    "vehicle_maker",
    "vehicle_model",
    "postal_code",
    "province",
    "municipality",
)

SQL: dict[str, str] = {}


def _shown(c: str) -> str:
    return c if c in TEXT + WHOLE else f"{r4(c)} AS {c}"


for _name, _columns in FEATURES.items():
    SQL[_name] = sql(f"SELECT quote_id, {', '.join(map(_shown, _columns))} FROM feats")
_all = [c for cols in FEATURES.values() for c in cols]
SQL["feature_projection"] = sql(f"SELECT quote_id, {', '.join(map(_shown, _all))} FROM feats")


def _r3(x: str) -> str:
    return f"round_even(({x}) * 1000, 0) / 1000"


_filled = ", ".join(f"{_r3(f'coalesce({price(i)}, 1.0)')} AS {price(i)}" for i in INSURERS)
SQL["write_submission"] = sql(f"SELECT CAST(12 AS INTEGER) AS n_fields, quote_id, {_filled} FROM quotes")
_prices3 = ", ".join(f"{_r3(price(i))} AS {price(i)}" for i in INSURERS)
SQL["read_submission"] = sql(f"SELECT quote_id, {_prices3} FROM quotes")
SQL["round_prices"] = SQL["read_submission"]
# Column types of the quote view, in its order.
TYPES = {
    "quote_id": "bigint",
    "quote_ts": "timestamp_ntz",
    "block": "string",
    "coverage": "string",
    "payment_frequency": "string",
    "usage": "string",
    "contractor_birthdate": "date",
    "second_driver_birthdate": "string",
    "claim_free_years": "double",
    "second_driver_claim_free_years": "double",
    "vehicle_first_registration_date": "date",
    "vehicle_country_first_registration_date": "date",
    "vehicle_last_registration_date": "date",
    "vehicle_inspection_report_date": "date",
    "vehicle_inspection_expiry_date": "date",
    "vehicle_inspection_number_of_deficiencies_found": "double",
    "vehicle_maker": "string",
    "vehicle_model": "string",
    "vehicle_power": "double",
    "vehicle_net_weight": "double",
    "vehicle_value_new": "double",
    "vehicle_age": "double",
    "vehicle_engine_size": "string",
    "vehicle_width_note": "string",
    "vehicle_planned_annual_mileage": "double",
    "postal_code": "string",
    "municipality": "string",
    "province": "string",
    "postal_code_latitude": "double",
    "postal_code_longitude": "double",
    "municipality_crimes_per_1000": "double",
    "postal_code_address_density": "double",
    **{f"Insurer_{i}_deductible": "double" for i in INSURERS},
    **{price(i): "double" for i in INSURERS},
}
NUMBERS = tuple(c for c, t in TYPES.items() if t == "double" and not c.endswith("_price"))


def _plain(c: str) -> str:
    """A column as the queries show it: dates as text, prices rounded."""
    if TYPES[c] in ("date", "timestamp_ntz"):
        return f"strftime({c}, '%Y-%m-%d') AS {c}"
    return f"{r4(c)} AS {c}" if c.endswith("_price") else c


_every = ", ".join(map(_plain, TYPES))
SQL["read_block"] = sql(f"SELECT {_every} FROM quotes WHERE block = 'block1'")
SQL["export_head"] = sql(
    f"SELECT row_number() OVER (ORDER BY quotes.quote_ts, quotes.quote_id) - 1 AS row_index, {_every} "
    "FROM quotes ORDER BY quotes.quote_ts, quotes.quote_id LIMIT 5000"
)
SQL["profile"] = sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM quotes"
        for c, t in TYPES.items()
    )
)


def _role(c: str) -> str:
    if c == "quote_id":
        return "'id'"
    if c in ("quote_ts", "block"):
        return "'context'"
    if c in DATES:
        return "'date'"
    if c.endswith("_price"):
        return "'target'"
    if c in CATEGORIES:
        return "'categorical'"
    if TYPES[c] == "string":
        return (
            f"CASE WHEN count(try_cast({c} AS DOUBLE)) > 0.8 * count({c}) "
            "THEN 'numeric' ELSE 'categorical' END"
        )
    return "'numeric'"


SQL["column_roles"] = sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, {_role(c)} AS role"
        + (" FROM quotes" if "count(" in _role(c) else "")
        for c in TYPES
    )
)
SQL["infer_numeric"] = sql(
    "SELECT quote_id, try_cast(vehicle_engine_size AS DOUBLE) + 0.5::DOUBLE AS engine_size, "
    "vehicle_width_note FROM quotes"
)
_dates = ", ".join(
    f"strftime(try_strptime({c}, '%d/%m/%Y'), '%Y-%m-%d') AS {c}" if TYPES[c] == "string" else _plain(c)
    for c in DATES
)
SQL["parse_date"] = sql(f"SELECT quote_id, {_dates} FROM quotes")
_filled_categories = ", ".join(f"coalesce({c}, '_MISSING_') AS {c}" for c in CATEGORIES)
SQL["fill_categorical"] = sql(f"SELECT quote_id, {_filled_categories} FROM quotes")
SQL["align_schema"] = sql(
    f"SELECT quote_id, {', '.join(NUMBERS)}, try_cast(vehicle_engine_size AS DOUBLE) AS vehicle_engine_size, "
    f"CAST(NULL AS DOUBLE) AS vehicle_doors, {_filled_categories}, '_MISSING_' AS vehicle_fuel_type FROM quotes"
)


def _codes(columns: list[str], fill: bool) -> str:
    """Codes by first appearance in block1, -1 for categories it lacks."""
    text = {c: f"coalesce({c}, '_MISSING_')" if fill else c for c in columns}
    ctes, joins, shown = [], [], []
    for n, c in enumerate(columns):
        ctes.append(
            f"m{n} AS (SELECT cat, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS code "
            f"FROM (SELECT {text[c]} AS cat, min(struct_pack(t := quote_ts, q := quote_id)) AS first "
            f"FROM quotes WHERE block = 'block1' GROUP BY 1))"
        )
        joins.append(f"LEFT JOIN m{n} ON m{n}.cat IS NOT DISTINCT FROM {text[c]}")
        shown.append(f"coalesce(m{n}.code, -1) AS {c}")
    body = sql(f"SELECT quote_id, {', '.join(shown)} FROM quotes {' '.join(joins)}")
    head, tail = body.rsplit(f" SELECT quote_id, {shown[0]}", 1)
    return f"{head}, {', '.join(ctes)} SELECT quote_id, {shown[0]}{tail}"


SQL["label_encode"] = _codes(list(CATEGORIES), True)
SQL["auto_categorical"] = _codes(
    [
        c
        for c, t in TYPES.items()
        if t == "string" and c not in ("block", "second_driver_birthdate")
    ],
    False,
)
SQL["attach_columns"] = sql(
    f"SELECT f.quote_id, f.insurer, f.province, {r4('f.price')} AS price, "
    + r4(
        "CASE WHEN t.n > s.n THEN (t.s - s.s + 20 * prior) / (t.n - s.n + 20) ELSE prior END"
    )
    + " AS province_te FROM folded f JOIN priors p USING (insurer) "
    "JOIN (SELECT insurer, province, fold, sum(y) s, count(*) n FROM folded GROUP BY 1, 2, 3) s "
    "ON s.insurer = f.insurer AND s.province = f.province AND s.fold = f.fold "
    "JOIN (SELECT insurer, province, sum(y) s, count(*) n FROM folded GROUP BY 1, 2) t "
    "ON t.insurer = f.insurer AND t.province = f.province"
)
SQL["quoted_rows"] = sql(
    f"SELECT quote_id, block, insurer, {r4('price')} AS price FROM cells WHERE price IS NOT NULL"
)
SQL["project_features"] = sql("SELECT quote_id, vehicle_power, vehicle_age, province FROM quotes")
SQL["rename_prices"] = sql(
    "SELECT quote_id, "
    + ", ".join(f'{r4(price(i))} AS "Insurer {i} price"' for i in INSURERS)
    + " FROM quotes"
)
SQL["order_columns"] = SQL["rename_prices"]
SQL["floor_price"] = sql(
    f"SELECT quote_id, insurer, {r4('greatest(price - 30000, 1)')} AS price FROM cells "
    "WHERE price IS NOT NULL"
)
SQL["log_target"] = sql(
    f"SELECT quote_id, insurer, {r4('ln(1 + price)')} AS log_y, {r4('exp(ln(1 + price)) - 1')} AS back "
    "FROM cells WHERE price IS NOT NULL"
)
_base = sql("SELECT 1 FROM feats").removesuffix(" SELECT 1 FROM feats")
_inputs = (*NUMBERS, *(c for c in _all if c not in TEXT))
SQL["nn_prep"] = (
    f"{_base}, med AS (SELECT "
    + ", ".join(f"median({c}) AS {c}" for c in _inputs)
    + " FROM feats WHERE block = 'block1'), filled AS (SELECT f.quote_id, f.block, "
    + ", ".join(f"ln(1 + f.{price(i)}) AS log_y_{i}" for i in INSURERS)
    + ", "
    + ", ".join(f"coalesce(f.{c}, m.{c})::DOUBLE AS {c}" for c in _inputs)
    + " FROM feats f, med m), scale AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _inputs)
    + " FROM filled WHERE block = 'block1') SELECT quote_id, "
    + ", ".join(f"{r4(f'log_y_{i}')} AS log_y_{i}" for i in INSURERS)
    + ", "
    + ", ".join(f"{r4(f'({c} - m_{c}) / CASE WHEN s_{c} <= 1e-9 THEN 1 ELSE s_{c} END')} AS {c}" for c in _inputs)
    + " FROM filled, scale"
)
