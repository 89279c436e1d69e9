"""Typing, cleaning and column roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.dates import parse_date
from premia.functions.numbers import parse_number
from premia.roles import MISSING, ROLES, ColumnRoles

NUMERIC_SHARE = 0.8


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares above every number here; a missing value must not."""
    floats = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


@dataclass(frozen=True)
class NumericText:
    """Which text columns hold numbers, with the counts that decided it."""

    counts: dict[str, tuple[int, int]]  # column -> (non-null, parsed)

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(
            c for c, (seen, parsed) in self.counts.items() if seen and parsed / seen > NUMERIC_SHARE
        )

    def transform(self, df: DataFrame) -> DataFrame:
        text = set(string_columns(df))
        found = {c: parse_number(F.col(f"`{c}`")) for c in self.numeric if c in text}
        return df.withColumns(found) if found else df


def infer_numeric(df: DataFrame, roles: ColumnRoles = ROLES) -> NumericText:
    """Find text columns of which more than four fifths of the values are numbers.

    One aggregation over all candidates; ids, dates and listed categoricals are not tried.
    """
    skip = set(roles.ids + roles.dates + roles.categoricals + roles.derived_categoricals)
    skip |= set(roles.context)
    names = [c for c in string_columns(df) if c not in skip]
    if not names:
        return NumericText({})
    aggs = []
    for n, c in enumerate(names):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"seen{n}"))
        aggs.append(F.count(parse_number(F.col(f"`{c}`"))).alias(f"parsed{n}"))
    row = df.agg(*aggs).first()
    return NumericText({c: (row[f"seen{n}"], row[f"parsed{n}"]) for n, c in enumerate(names)})


def parse_dates(df: DataFrame, roles: ColumnRoles = ROLES) -> DataFrame:
    found = {
        f.name: parse_date(F.col(f.name), f.dataType)
        for f in df.schema.fields
        if f.name in roles.dates
    }
    return df.withColumns(found) if found else df


@dataclass(frozen=True)
class FeatureList:
    """Features of a model in order, and those of them that are categories."""

    features: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def numeric(self) -> tuple[str, ...]:
        cats = set(self.categorical)
        return tuple(c for c in self.features if c not in cats)


def feature_list(df: DataFrame, roles: ColumnRoles = ROLES) -> FeatureList:
    """All columns but ids, targets, raw dates and context; text ones are categories."""
    text = set(string_columns(df))
    listed = set(roles.categoricals + roles.derived_categoricals)
    features = tuple(c for c in df.columns if c not in roles.non_features)
    return FeatureList(features, tuple(c for c in features if c in listed or c in text))


def column_roles(df: DataFrame, roles: ColumnRoles = ROLES) -> DataFrame:
    """Role of every column as rows ``(name, role)``, after numeric inference."""
    typed = infer_numeric(df, roles).transform(df)
    features = feature_list(typed, roles)
    cats = set(features.categorical)

    def role(name: str) -> str:
        if name in roles.ids:
            return "id"
        if name in roles.targets:
            return "target"
        if name in roles.dates:
            return "date"
        if name in roles.context:
            return "context"
        return "categorical" if name in cats else "numeric"

    rows = [(c, role(c)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "name string, role string")


def fill_categorical(df: DataFrame, columns) -> DataFrame:
    found = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns if c in df.columns
    }
    return df.withColumns(found) if found else df


def align_schema(df: DataFrame, features: FeatureList, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the features a model expects, in its order and types."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cats = set(features.categorical)

    def aligned(name: str):
        if name in cats:
            value = F.col(name).cast("string") if name in types else F.lit(None).cast("string")
            return F.coalesce(value, F.lit(MISSING)).alias(name)
        if name not in types:
            return F.lit(None).cast("double").alias(name)
        if isinstance(types[name], T.StringType):
            return parse_number(F.col(name)).alias(name)
        return F.col(name).try_cast("double").alias(name)

    return df.select(*keep, *[aligned(c) for c in features.features])


def project_features(df: DataFrame, columns, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *columns)
