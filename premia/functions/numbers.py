"""Column helpers for numbers; all of them keep null as null unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.roles import PRICE_FLOOR

# A plain or scientific decimal number. The cast alone would also take Java forms
# such as '1d'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a finite number is null."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def at_least(x: Column, low: float) -> Column:
    """Lower bound that keeps null (``greatest`` alone would return the bound)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def at_most(x: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(x, high))


def log1p_floor0(x: Column) -> Column:
    return F.log1p(at_least(x, 0.0))


def flag(condition: Column) -> Column:
    """0/1, where an undecided comparison counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def floor_price(price: Column) -> Column:
    return at_least(price, PRICE_FLOOR)


def round_price(price: Column, digits: int = 3) -> Column:
    """Round half to even on the scaled value."""
    scale = float(10**digits)
    return F.rint(price * scale) / scale


def log_price(price: Column) -> Column:
    return F.log1p(price)


def unlog_price(value: Column) -> Column:
    return F.expm1(value)


def by_key(key: Column, values: dict, default=None) -> Column:
    """Look ``key`` up in a small fitted dictionary, as a literal."""
    fallback = F.lit(default).cast("double")
    if not values:
        return fallback
    pairs = [F.lit(part) for k, v in values.items() for part in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), fallback)


def _sum_of(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def _present(names) -> str:
    return _sum_of(f"IF(`{c}` IS NULL, 0, 1)" for c in names)


def row_mean(names) -> Column:
    """Mean of the non-null columns; null when all are null."""
    total = _sum_of(f"coalesce(`{c}`, 0D)" for c in names)
    return F.expr(f"try_divide({total}, {_present(names)})")


def row_std(names, mean: str) -> Column:
    """Sample deviation of the non-null columns around their mean; null below two values."""
    squares = _sum_of(f"coalesce((`{c}` - `{mean}`) * (`{c}` - `{mean}`), 0D)" for c in names)
    n = _present(names)
    return F.expr(f"sqrt({squares} / IF({n} > 1, {n} - 1, NULL))")


def row_max(names) -> Column:
    return F.greatest(*names) if len(names) > 1 else F.col(names[0])


def row_min(names) -> Column:
    return F.least(*names) if len(names) > 1 else F.col(names[0])
