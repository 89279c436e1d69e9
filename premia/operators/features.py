"""Row-local features: dates, ages, ratios, deductible statistics.

Everything is a column expression; one call adds all columns in at most three
projections, which the optimizer merges. A formula is left out when a column it
needs is absent from the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions.dates import days_after, days_before, parse_date
from premia.functions.numbers import (
    at_least,
    flag,
    log1p_floor0,
    row_max,
    row_mean,
    row_min,
    row_std,
)
from premia.roles import (
    DAYS_PER_YEAR,
    INSURERS,
    MISSING,
    REFERENCE_DATE,
    ROLES,
    ColumnRoles,
    deductible_col,
)

# Right-closed age bands.
AGE_BANDS = ((25, "very_young"), (35, "young"), (50, "mid"), (65, "senior"), (120, "elderly"))

# Feature families. ``dates`` is the plain one; ``blend`` adds the actuarial formulas;
# ``full`` adds second-driver, ratio and composite formulas on top.
FAMILIES = ("dates", "blend", "full")

# Derived column -> source date, as years back from the reference date.
YEARS_SINCE = {
    "contractor_age": "contractor_birthdate",
    "second_driver_age": "second_driver_birthdate",
    "years_since_last_registration": "vehicle_last_registration_date",
    "years_since_first_registration": "vehicle_first_registration_date",
    "years_since_country_first_reg": "vehicle_country_first_registration_date",
}


def date_features(df: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for name, source in YEARS_SINCE.items():
        if source in types:
            out[name] = days_before(reference, F.col(source), types[source]) / DAYS_PER_YEAR
    second = "second_driver_birthdate"
    if second in types:
        out["has_second_driver"] = (
            parse_date(F.col(second), types[second]).isNotNull().cast("int")
        )
    report = "vehicle_inspection_report_date"
    if report in types:
        out["days_since_inspection"] = days_before(reference, F.col(report), types[report])
    expiry = "vehicle_inspection_expiry_date"
    if expiry in types:
        out["inspection_days_remaining"] = days_after(reference, F.col(expiry), types[expiry])
    return df.withColumns(out)


def age_bucket(age: Column) -> Column:
    """Band of an age; ages outside (0, 120] and missing ages get the missing label."""
    banded = F.when(age.isNull() | (age <= 0), MISSING)
    for upper, label in AGE_BANDS:
        banded = banded.when(age <= upper, label)
    return banded.otherwise(MISSING)


def _driver_features(has, full: bool) -> dict[str, Column]:
    out: dict[str, Column] = {}
    age = F.col("contractor_age")
    second_age = F.col("second_driver_age")
    if has("contractor_age"):
        out["contractor_age_sq"] = age * age
        out["contractor_age_bucket"] = age_bucket(age)
    if has("second_driver_age"):
        out["second_driver_age_sq"] = second_age * second_age

    claim_free = F.col("claim_free_years") if has("claim_free_years") else F.lit(0.0)
    if has("contractor_age"):
        out["claim_free_x_age"] = claim_free * age
        if full:
            out["claim_free_per_age"] = F.try_divide(claim_free, at_least(age, 18))
    if has("vehicle_age"):
        out["claim_free_x_vehicle_age"] = claim_free * F.col("vehicle_age")
    if full and has("second_driver_claim_free_years", "second_driver_age"):
        second = F.col("second_driver_claim_free_years")
        first0, second0 = F.coalesce(claim_free, F.lit(0.0)), F.coalesce(second, F.lit(0.0))
        out["second_driver_claim_free_x_age"] = second * second_age
        out["total_claim_free_years"] = first0 + second0
        out["claim_free_diff"] = first0 - second0
    return out


def _vehicle_features(has, full: bool) -> dict[str, Column]:
    out: dict[str, Column] = {}
    power, weight = F.col("vehicle_power"), F.col("vehicle_net_weight")
    value = F.col("vehicle_value_new")
    if has("vehicle_power", "vehicle_net_weight"):
        out["weight_per_power"] = F.try_divide(weight, power + 1)
        if full:
            out["power_per_weight"] = F.try_divide(power, weight + 1)
    if has("vehicle_value_new"):
        vehicle_age = F.col("vehicle_age") if has("vehicle_age") else F.lit(1.0)
        out["value_per_age"] = value / at_least(vehicle_age, 0.5)
        out["log_vehicle_value"] = log1p_floor0(value)
    if full and has("vehicle_value_new", "vehicle_power"):
        out["value_per_power"] = F.try_divide(value, power + 1)
    if has("postal_code_address_density"):
        out["log_address_density"] = log1p_floor0(F.col("postal_code_address_density"))
    if has("vehicle_planned_annual_mileage"):
        out["log_mileage"] = log1p_floor0(F.col("vehicle_planned_annual_mileage"))
    if has("vehicle_inspection_number_of_deficiencies_found"):
        out["has_deficiencies"] = flag(
            F.col("vehicle_inspection_number_of_deficiencies_found") > 0
        )
    return out


def _composites(has, insurers, deductibles, full: bool) -> dict[str, Column]:
    """Formulas over columns the earlier projections added."""
    out: dict[str, Column] = {}
    if has("mean_deductible"):
        out["std_deductible"] = row_std(deductibles, "mean_deductible")
    own = [(i, deductible_col(i)) for i in insurers if has(deductible_col(i))]
    if has("mean_deductible"):
        mean = F.col("mean_deductible")
        for insurer, name in own:
            out[f"{insurer}_ded_vs_mean"] = F.col(name) - mean
        if full and has("vehicle_value_new"):
            value = at_least(F.col("vehicle_value_new"), 1)
            out["mean_deductible_ratio"] = mean / value
            for insurer, name in own:
                out[f"{insurer}_ded_ratio"] = F.col(name) / value
    if full and has("coverage", "contractor_age_bucket"):
        coverage = F.coalesce(F.col("coverage").cast("string"), F.lit(MISSING))
        out["coverage_x_age_bucket"] = F.concat_ws("_", coverage, "contractor_age_bucket")
    return out


def engineer_features(
    df: DataFrame,
    family: str = "full",
    insurers=INSURERS,
    roles: ColumnRoles = ROLES,
    reference: str = REFERENCE_DATE,
) -> DataFrame:
    """All row-local features of a family. Text that holds numbers must be cast before."""
    if family not in FAMILIES:
        raise ValueError(f"unknown feature family {family!r}, expected one of {FAMILIES}")
    dated = date_features(df, reference)
    if family == "dates":
        return dated
    full = family == "full"

    def has_in(columns):
        known = set(columns)
        return lambda *names: known.issuperset(names)

    has = has_in(dated.columns)
    deductibles = [c for c in roles.deductibles if has(c)]
    derived = {**_driver_features(has, full), **_vehicle_features(has, full)}
    if deductibles:
        derived["mean_deductible"] = row_mean(deductibles)
        derived["max_deductible"] = row_max(deductibles)
        derived["min_deductible"] = row_min(deductibles)
    rich = dated.withColumns(derived)
    extra = _composites(has_in([*dated.columns, *derived]), insurers, deductibles, full)
    return rich.withColumns(extra) if extra else rich
