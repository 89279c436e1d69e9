"""Names of the quote model: insurers, column roles and fixed vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data model, in their natural order.
INSURERS = tuple("ABCDEFGHIJK")

DATE_COLS = (
    "contractor_birthdate",
    "second_driver_birthdate",
    "vehicle_first_registration_date",
    "vehicle_country_first_registration_date",
    "vehicle_last_registration_date",
    "vehicle_inspection_report_date",
    "vehicle_inspection_expiry_date",
)

CATEGORICAL_COLS = (
    "coverage",
    "payment_frequency",
    "is_driver_owner",
    "usage",
    "vehicle_maker",
    "vehicle_model",
    "vehicle_fuel_type",
    "vehicle_primary_color",
    "vehicle_odometer_verdict_code",
    "vehicle_is_imported",
    "vehicle_is_imported_within_last_12_months",
    "vehicle_can_be_registered",
    "vehicle_has_open_recall",
    "vehicle_is_marked_for_export",
    "vehicle_is_taxi",
    "postal_code",
    "province",
    "municipality",
    "postal_code_urban_category",
)

DERIVED_CATEGORICALS = ("contractor_age_bucket", "coverage_x_age_bucket", "risk_zone")

# Categories that get a smoothed target mean per insurer.
TARGET_ENCODED = (
    "postal_code",
    "municipality",
    "province",
    "vehicle_maker",
    "vehicle_model",
    "coverage_x_age_bucket",
    "risk_zone",
)

# Categories that get their count in the training block.
FREQUENCY_ENCODED = ("postal_code", "municipality", "vehicle_maker", "vehicle_model")

MISSING = "_MISSING_"
REFERENCE_DATE = "2025-01-01"
DAYS_PER_YEAR = 365.25
PRICE_FLOOR = 1.0
CLIP_QUANTILE = 0.995
SMOOTHING = 20.0
N_FOLDS = 5
SEED = 42


def price_col(insurer: str) -> str:
    return f"Insurer_{insurer}_price"


def display_price_col(insurer: str) -> str:
    return f"Insurer {insurer} price"


def deductible_col(insurer: str) -> str:
    return f"Insurer_{insurer}_deductible"


PRICE_COLS = tuple(price_col(i) for i in INSURERS)
DISPLAY_PRICE_COLS = tuple(display_price_col(i) for i in INSURERS)
DEDUCTIBLE_COLS = tuple(deductible_col(i) for i in INSURERS)


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns of a block identify, price, date or categorise a quote.

    ``order_key`` must be unique per row: it is the time order that a file's row
    position would carry elsewhere. ``context`` columns are neither features nor ids.
    """

    key: str = "quote_id"
    order_key: tuple[str, ...] = ("quote_ts", "quote_id")
    context: tuple[str, ...] = ("quote_ts", "block")
    ids: tuple[str, ...] = ("quote_id", "vehicle_number_plate", "Unnamed: 0")
    targets: tuple[str, ...] = PRICE_COLS
    deductibles: tuple[str, ...] = DEDUCTIBLE_COLS
    dates: tuple[str, ...] = DATE_COLS
    categoricals: tuple[str, ...] = CATEGORICAL_COLS
    derived_categoricals: tuple[str, ...] = DERIVED_CATEGORICALS

    @property
    def non_features(self) -> frozenset[str]:
        return frozenset(self.ids + self.targets + self.dates + self.context)


ROLES = ColumnRoles()
