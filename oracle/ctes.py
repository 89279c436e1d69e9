"""Named SQL building blocks of the checks, in dependency order.

``sql(text)`` prepends the blocks a statement needs. Every rounded value is
``floor(x * 1e4 + 0.5) / 1e4``, which both engines compute alike.
"""

from __future__ import annotations

import re

INSURERS = "ABCDEFGHIJK"
TE_COLUMNS = (
    "postal_code",
    "municipality",
    "province",
    "vehicle_maker",
    "vehicle_model",
    "coverage_x_age_bucket",
    "coverage",
)


def r4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


def price(i: str) -> str:
    return f"Insurer_{i}_price"


def ded(i: str) -> str:
    return f"Insurer_{i}_deductible"


def each(template: str, sep: str = ", ") -> str:
    """The template once per insurer: ``{i}`` is the letter, ``{n}`` its number."""
    return sep.join(template.format(i=i, n=n) for n, i in enumerate(INSURERS))


BLOCKS: dict[str, str] = {}

BLOCKS["line_prices"] = (
    "SELECT l_orderkey, MIN(l_partkey) AS partkey, "
    + each(
        "MIN(CASE WHEN l_suppkey % 11 = {n} THEN l_extendedprice * (1 - l_discount) END)"
        " AS Insurer_{i}_price"
    )
    + " FROM lineitem GROUP BY l_orderkey"
)

BLOCKS["drawn"] = """
SELECT o_orderkey AS k,
  DATE '1925-01-01' + CAST((c_custkey * 37) % 31000 AS INTEGER) AS birth,
  DATE '1990-01-01' + CAST((o_orderkey * 41) % 12000 AS INTEGER) AS reg
FROM orders JOIN customer ON o_custkey = c_custkey"""

BLOCKS["quotes"] = (
    """
SELECT
  o.o_orderkey AS quote_id, o.o_orderdate AS quote_ts,
  CASE WHEN o.o_orderdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'block1'
       WHEN o.o_orderdate < TIMESTAMP '2001-01-01 00:00:00' THEN 'block2' ELSE 'block3' END AS block,
  CASE o.o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'MTPL' WHEN 2 THEN 'MTPL'
    WHEN 3 THEN 'Limited Casco' ELSE 'Casco' END AS coverage,
  o.o_orderpriority AS payment_frequency, c.c_mktsegment AS usage,
  d.birth AS contractor_birthdate,
  CASE WHEN o.o_orderkey % 4 <> 0 THEN NULL
       WHEN o.o_orderkey % 40 = 0 THEN 'unknown'
       ELSE lpad(CAST(EXTRACT(day FROM d.birth) AS VARCHAR), 2, '0') || '/'
         || lpad(CAST(EXTRACT(month FROM d.birth) AS VARCHAR), 2, '0') || '/'
         || CAST(EXTRACT(year FROM d.birth) AS VARCHAR) END AS second_driver_birthdate,
  CASE WHEN o.o_orderkey % 23 <> 0 THEN CAST(c.c_custkey % 20 AS DOUBLE) END AS claim_free_years,
  CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(c.c_custkey % 12 AS DOUBLE) END
    AS second_driver_claim_free_years,
  d.reg AS vehicle_first_registration_date,
  CASE WHEN o.o_orderkey % 13 <> 0 THEN d.reg + CAST(o.o_orderkey % 300 AS INTEGER) END
    AS vehicle_country_first_registration_date,
  d.reg + CAST(o.o_orderkey % 900 AS INTEGER) AS vehicle_last_registration_date,
  CASE WHEN o.o_orderkey % 9 <> 0 THEN DATE '2023-06-01' + CAST(o.o_orderkey % 500 AS INTEGER) END
    AS vehicle_inspection_report_date,
  CASE WHEN o.o_orderkey % 9 <> 0 THEN DATE '2024-06-01' + CAST(o.o_orderkey % 700 AS INTEGER) END
    AS vehicle_inspection_expiry_date,
  CASE WHEN o.o_orderkey % 9 <> 0 THEN CAST(o.o_orderkey % 3 AS DOUBLE) END
    AS vehicle_inspection_number_of_deficiencies_found,
  p.p_brand AS vehicle_maker, p.p_type || '_' || CAST(p.p_size AS VARCHAR) AS vehicle_model,
  CAST(p.p_size * 6 AS DOUBLE) AS vehicle_power,
  CAST(900 + p.p_partkey % 1500 AS DOUBLE) AS vehicle_net_weight,
  p.p_retailprice * 30 AS vehicle_value_new,
  CAST(o.o_orderkey % 21 AS DOUBLE) / 2 AS vehicle_age,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(800 + o.o_orderkey % 2400 AS VARCHAR) END
    AS vehicle_engine_size,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(150 + o.o_orderkey % 60 AS VARCHAR) END
    AS vehicle_width_note,
  CAST(5000 + (o.o_orderkey * 31) % 30000 AS DOUBLE) AS vehicle_planned_annual_mileage,
  CAST(1000 + c.c_custkey % 300 AS VARCHAR) AS postal_code, n.n_name AS municipality,
  r.r_name AS province,
  CAST(50.75 AS DOUBLE) + CAST((c.c_custkey * 7919) % 2750 AS DOUBLE) / 1000 AS postal_code_latitude,
  CASE WHEN c.c_custkey % 29 <> 0
    THEN CAST(3.3 AS DOUBLE) + CAST((c.c_custkey * 104729) % 3900 AS DOUBLE) / 1000 END
    AS postal_code_longitude,
  CASE WHEN n.n_nationkey % 8 <> 0 THEN CAST(20 + (n.n_nationkey * 13) % 60 AS DOUBLE) END
    AS municipality_crimes_per_1000,
  CAST((c.c_custkey * 17) % 6000 AS DOUBLE) AS postal_code_address_density,
  """
    + ",\n  ".join(
        f"CASE WHEN (o.o_orderkey + {n}) % 17 = 0 THEN NULL "
        f"ELSE CAST(100 * (1 + (o.o_orderkey * 7 + {13 * n}) % 10) AS DOUBLE) END AS {ded(i)}"
        for n, i in enumerate(INSURERS)
    )
    + ",\n  "
    + each("q.Insurer_{i}_price")
    + """
FROM orders o
JOIN drawn d ON d.k = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN line_prices q ON q.l_orderkey = o.o_orderkey
LEFT JOIN part p ON p.p_partkey = q.partkey"""
)

BLOCKS["dated"] = """
SELECT *, date_diff('day', contractor_birthdate, DATE '2025-01-01') / 365.25::DOUBLE AS contractor_age,
  CAST(try_strptime(second_driver_birthdate, '%d/%m/%Y') AS DATE) AS second_birth,
  date_diff('day', CAST(try_strptime(second_driver_birthdate, '%d/%m/%Y') AS DATE),
    DATE '2025-01-01') / 365.25::DOUBLE AS second_driver_age,
  CASE WHEN try_strptime(second_driver_birthdate, '%d/%m/%Y') IS NULL THEN 0 ELSE 1 END
    AS has_second_driver,
  date_diff('day', vehicle_inspection_report_date, DATE '2025-01-01') AS days_since_inspection,
  date_diff('day', DATE '2025-01-01', vehicle_inspection_expiry_date) AS inspection_days_remaining,
  date_diff('day', vehicle_last_registration_date, DATE '2025-01-01') / 365.25::DOUBLE
    AS years_since_last_registration,
  date_diff('day', vehicle_first_registration_date, DATE '2025-01-01') / 365.25::DOUBLE
    AS years_since_first_registration,
  date_diff('day', vehicle_country_first_registration_date, DATE '2025-01-01') / 365.25::DOUBLE
    AS years_since_country_first_reg,
  [""" + each("Insurer_{i}_deductible") + """] AS deds
FROM quotes"""

BLOCKS["bucketed"] = """
SELECT *, CASE WHEN contractor_age > 0 AND contractor_age <= 25 THEN 'very_young'
    WHEN contractor_age > 25 AND contractor_age <= 35 THEN 'young'
    WHEN contractor_age > 35 AND contractor_age <= 50 THEN 'mid'
    WHEN contractor_age > 50 AND contractor_age <= 65 THEN 'senior'
    WHEN contractor_age > 65 AND contractor_age <= 120 THEN 'elderly'
    ELSE '_MISSING_' END AS contractor_age_bucket,
  list_avg(deds) AS mean_deductible, list_stddev_samp(deds) AS std_deductible,
  list_max(deds) AS max_deductible, list_min(deds) AS min_deductible
FROM dated"""

BLOCKS["feats"] = (
    """
SELECT *, contractor_age * contractor_age AS contractor_age_sq,
  second_driver_age * second_driver_age AS second_driver_age_sq,
  claim_free_years * contractor_age AS claim_free_x_age,
  claim_free_years / CASE WHEN contractor_age < 18 THEN 18 ELSE contractor_age END
    AS claim_free_per_age,
  claim_free_years * vehicle_age AS claim_free_x_vehicle_age,
  second_driver_claim_free_years * second_driver_age AS second_driver_claim_free_x_age,
  coalesce(claim_free_years, 0) + coalesce(second_driver_claim_free_years, 0)
    AS total_claim_free_years,
  coalesce(claim_free_years, 0) - coalesce(second_driver_claim_free_years, 0) AS claim_free_diff,
  vehicle_net_weight / (vehicle_power + 1) AS weight_per_power,
  vehicle_power / (vehicle_net_weight + 1) AS power_per_weight,
  vehicle_value_new / CASE WHEN vehicle_age < 0.5 THEN 0.5::DOUBLE ELSE vehicle_age END
    AS value_per_age,
  ln(1 + CASE WHEN vehicle_value_new < 0 THEN 0 ELSE vehicle_value_new END) AS log_vehicle_value,
  vehicle_value_new / (vehicle_power + 1) AS value_per_power,
  ln(1 + postal_code_address_density) AS log_address_density,
  ln(1 + vehicle_planned_annual_mileage) AS log_mileage,
  CASE WHEN vehicle_inspection_number_of_deficiencies_found > 0 THEN 1 ELSE 0 END
    AS has_deficiencies,
  """
    + each("Insurer_{i}_deductible - mean_deductible AS {i}_ded_vs_mean")
    + """,
  mean_deductible / CASE WHEN vehicle_value_new < 1 THEN 1 ELSE vehicle_value_new END
    AS mean_deductible_ratio,
  """
    + each(
        "Insurer_{i}_deductible / CASE WHEN vehicle_value_new < 1 THEN 1 ELSE vehicle_value_new END"
        " AS {i}_ded_ratio"
    )
    + """,
  coalesce(coverage, '_MISSING_') || '_' || contractor_age_bucket AS coverage_x_age_bucket
FROM bucketed"""
)

CATS = (
    "postal_code, municipality, province, coalesce(vehicle_maker, '_MISSING_') AS vehicle_maker, "
    "coalesce(vehicle_model, '_MISSING_') AS vehicle_model, coverage_x_age_bucket, "
    "coalesce(coverage, '_MISSING_') AS coverage"
)

# One row per quote and insurer of all blocks, declined ones too.
BLOCKS["cells"] = each(
    "SELECT quote_id, quote_ts, block, '{i}' AS insurer, Insurer_{i}_price AS price, "
    + CATS
    + " FROM feats",
    " UNION ALL ",
)
BLOCKS["quoted"] = "SELECT * FROM cells WHERE block = 'block1' AND price IS NOT NULL"
BLOCKS["caps"] = (
    "SELECT insurer, quantile_cont(price, 0.995) AS threshold FROM quoted GROUP BY insurer"
)
BLOCKS["capped"] = (
    "SELECT q.*, threshold, least(price, threshold) AS y FROM quoted q JOIN caps USING (insurer)"
)
BLOCKS["edges"] = """
SELECT DISTINCT insurer, edge FROM (
  SELECT insurer, unnest(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge,
    min(y) AS low FROM capped GROUP BY insurer) WHERE edge > low"""
BLOCKS["edge_lists"] = "SELECT insurer, list(edge) AS cuts FROM edges GROUP BY insurer"
BLOCKS["binned"] = """
SELECT c.*, CAST(coalesce(len(list_filter(cuts, lambda e: e < y)), 0) AS INTEGER) AS bin
FROM capped c LEFT JOIN edge_lists USING (insurer)"""
BLOCKS["folded"] = """
SELECT *, CAST((row_number() OVER (PARTITION BY insurer, bin
    ORDER BY md5('42|' || CAST(quote_id AS VARCHAR)), quote_id) - 1) % 5 AS INTEGER) AS fold
FROM binned"""
BLOCKS["priors"] = "SELECT insurer, avg(y) AS prior FROM folded GROUP BY insurer"

# Both stand-in models: smoothed means by maker (a) and by municipality (b).
for _letter, _column in (("a", "vehicle_maker"), ("b", "municipality")):
    BLOCKS[f"sums_{_letter}"] = (
        f"SELECT insurer, {_column}, fold, sum(y) AS s, count(*) AS n FROM folded "
        f"GROUP BY insurer, {_column}, fold"
    )
    BLOCKS[f"totals_{_letter}"] = (
        f"SELECT insurer, {_column}, sum(s) AS s, sum(n) AS n FROM sums_{_letter} "
        f"GROUP BY insurer, {_column}"
    )
BLOCKS["oof"] = """
SELECT f.quote_id, f.insurer, f.fold, f.y, f.price, f.municipality, f.coverage_x_age_bucket,
  CASE WHEN ta.n > sa.n THEN (ta.s - sa.s + 20 * prior) / (ta.n - sa.n + 20) ELSE prior END AS pred_a,
  CASE WHEN tb.n > sb.n THEN (tb.s - sb.s + 20 * prior) / (tb.n - sb.n + 20) ELSE prior END AS pred_b
FROM folded f JOIN priors p USING (insurer)
JOIN sums_a sa ON sa.insurer = f.insurer AND sa.vehicle_maker = f.vehicle_maker AND sa.fold = f.fold
JOIN totals_a ta ON ta.insurer = f.insurer AND ta.vehicle_maker = f.vehicle_maker
JOIN sums_b sb ON sb.insurer = f.insurer AND sb.municipality = f.municipality AND sb.fold = f.fold
JOIN totals_b tb ON tb.insurer = f.insurer AND tb.municipality = f.municipality"""
BLOCKS["scored"] = """
SELECT c.quote_id, c.block, c.insurer, c.price, c.coverage_x_age_bucket,
  coalesce((ta.s + 20 * prior) / (ta.n + 20), prior) AS pred_a,
  coalesce((tb.s + 20 * prior) / (tb.n + 20), prior) AS pred_b
FROM cells c JOIN priors p USING (insurer)
LEFT JOIN totals_a ta ON ta.insurer = c.insurer AND ta.vehicle_maker = c.vehicle_maker
LEFT JOIN totals_b tb ON tb.insurer = c.insurer AND tb.municipality = c.municipality"""

_grid = ", ".join(f"{k * 5 / 100:.2f}::DOUBLE" for k in range(21))
BLOCKS["blend_scores"] = f"""
SELECT insurer, w, avg(abs(w * pred_a + (1 - w) * pred_b - y)) AS mae, count(*) AS n
FROM oof, (SELECT unnest([{_grid}]) AS w) GROUP BY insurer, w"""
BLOCKS["blend_best"] = """
SELECT insurer, w AS weight, mae, n FROM (
  SELECT *, row_number() OVER (PARTITION BY insurer ORDER BY round(mae, 9), w) AS pos
  FROM blend_scores) WHERE pos = 1"""

# Ridge on a, b, d = |a - b| by Cramer's rule on the centred normal equations.
BLOCKS["moments"] = """
SELECT insurer, avg(pred_a) ma, avg(pred_b) mb, avg(abs(pred_a - pred_b)) md, avg(y) my,
  var_pop(pred_a) * count(*) + 1 aa, var_pop(pred_b) * count(*) + 1 bb,
  var_pop(abs(pred_a - pred_b)) * count(*) + 1 dd,
  covar_pop(pred_a, pred_b) * count(*) ab,
  covar_pop(pred_a, abs(pred_a - pred_b)) * count(*) ad,
  covar_pop(pred_b, abs(pred_a - pred_b)) * count(*) bd,
  covar_pop(pred_a, y) * count(*) ay, covar_pop(pred_b, y) * count(*) by_,
  covar_pop(abs(pred_a - pred_b), y) * count(*) dy
FROM oof GROUP BY insurer"""
BLOCKS["ridge_w"] = """
SELECT *, (ay * (bb * dd - bd * bd) - ab * (by_ * dd - bd * dy) + ad * (by_ * bd - bb * dy)) / det wa,
  (aa * (by_ * dd - bd * dy) - ay * (ab * dd - bd * ad) + ad * (ab * dy - by_ * ad)) / det wb,
  (aa * (bb * dy - by_ * bd) - ab * (ab * dy - by_ * ad) + ay * (ab * bd - bb * ad)) / det wd
FROM (SELECT *, aa * (bb * dd - bd * bd) - ab * (ab * dd - bd * ad) + ad * (ab * bd - bb * ad) AS det
  FROM moments)"""
BLOCKS["ridge"] = (
    "SELECT insurer, wa, wb, wd, my - wa * ma - wb * mb - wd * md AS w0 FROM ridge_w"
)


def _needs(text: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_]\w*", text))
    found = {n for n in BLOCKS if n in words}
    for n in list(found):
        found |= _needs(BLOCKS[n])
    return found


def sql(text: str) -> str:
    need = _needs(text)
    ctes = ", ".join(f"{n} AS ({body})" for n, body in BLOCKS.items() if n in need)
    return f"WITH {ctes} {text}" if ctes else text
