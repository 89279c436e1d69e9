"""Statistics fitted on the training block and applied unchanged to later blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.functions.numbers import at_most, by_key, flag
from premia.operators.quantiles import column_quantiles, exact_quantiles
from premia.roles import CLIP_QUANTILE, FREQUENCY_ENCODED, SEED
from premia.session import looked_up, write_table


def rows_per_column(table: DataFrame) -> dict[str, int]:
    """Size of each column's part of a fitted table, counted once at fitting."""
    return {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}


@dataclass(frozen=True)
class CrimeThreshold:
    """Upper quartile of the crime rate on the training block."""

    value: float | None
    column: str = "municipality_crimes_per_1000"

    def transform(self, df: DataFrame) -> DataFrame:
        limit = F.lit(self.value).cast("double")
        return df.withColumn("high_crime_area", flag(F.col(self.column) > limit))


def fit_high_crime_area(
    train: DataFrame, column: str = "municipality_crimes_per_1000"
) -> CrimeThreshold:
    found = exact_quantiles(train, column, [0.75])
    return CrimeThreshold(found[()].values[0] if found else None, column)


@dataclass(frozen=True)
class Frequencies:
    """Rows per category of the training block: ``(column, category, n)``."""

    table: DataFrame
    columns: tuple[str, ...]
    sizes: dict[str, int]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_freq``; a missing or unseen category counts as 1."""
        out = looked_up(
            df,
            [
                (f"{c}_freq", [F.col(c).cast("string")], self.table.where(F.col("column") == c), ["category"], "n", self.sizes.get(c, 0))
                for c in self.columns
            ],
        )
        filled = {f"{c}_freq": F.coalesce(F.col(f"{c}_freq"), F.lit(1)) for c in self.columns}
        return out.withColumns(filled).select(*df.columns, *filled)


def fit_frequencies(train: DataFrame, columns=FREQUENCY_ENCODED) -> Frequencies:
    """Count all listed columns in one pass."""
    columns = tuple(c for c in columns if c in train.columns)
    long = train.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "category"
    )
    counts = (
        long.where(F.col("category").isNotNull())
        .groupBy("column", "category")
        .agg(F.count("*").alias("n"))
    )
    table = write_table(counts, "frequencies")
    return Frequencies(table, columns, rows_per_column(table))


@dataclass(frozen=True)
class Medians:
    """Median per numeric column; columns without any value are dropped."""

    values: dict[str, float]
    empty: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {
            c: F.coalesce(F.col(c).cast("double"), F.lit(m))
            for c, m in self.values.items()
            if c in df.columns
        }
        return df.drop(*self.empty).withColumns(filled) if filled else df.drop(*self.empty)


def fit_medians(train: DataFrame, columns) -> Medians:
    columns = list(columns)
    found = column_quantiles(train, columns, [0.5])
    values = {c: found[c].values[0] for c in columns if c in found}
    return Medians(values, tuple(c for c in columns if c not in found))


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per column; a constant column is divided by 1."""

    moments: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {
            c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in self.moments.items()
        }
        return df.withColumns(scaled) if scaled else df


def fit_scaling(train: DataFrame, columns) -> Scaling:
    columns = list(columns)
    if not columns:
        return Scaling({})
    aggs = []
    for n, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"m{n}"), F.stddev_pop(c).alias(f"s{n}")]
    row = train.agg(*aggs).first()
    moments = {}
    for n, c in enumerate(columns):
        mean, std = row[f"m{n}"], row[f"s{n}"]
        if mean is not None:
            # Rounding leaves a constant column with a tiny deviation instead of zero.
            constant = std <= 10 * math.ulp(abs(mean))
            moments[c] = (mean, 1.0 if constant else std)
    return Scaling(moments)


@dataclass(frozen=True)
class TargetCap:
    """Cap of the target per insurer."""

    thresholds: dict[str, float]

    def transform(self, quoted: DataFrame, target: str = "price", name: str = "y") -> DataFrame:
        cap = by_key(F.col("insurer"), self.thresholds)
        return quoted.withColumn(name, at_most(F.col(target), F.coalesce(cap, F.col(target))))

    def report(self, quoted: DataFrame, target: str = "price") -> DataFrame:
        cap = by_key(F.col("insurer"), self.thresholds)
        return quoted.groupBy("insurer").agg(
            F.max(cap).alias("threshold"),
            F.sum((F.col(target) > cap).cast("int")).alias("n_clipped"),
        )


def fit_target_cap(quoted: DataFrame, target: str = "price", q: float = CLIP_QUANTILE) -> TargetCap:
    found = exact_quantiles(quoted, target, [q], by=["insurer"])
    return TargetCap({k[0]: v.values[0] for k, v in found.items()})


@dataclass(frozen=True)
class RiskZones:
    """Geographic clusters: median fill, then nearest of the fitted centres."""

    medians: Medians
    model: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"_{c}" for c in self.medians.values]
        coords = df.withColumns(
            {
                f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(m))
                for c, m in self.medians.values.items()
            }
        )
        scored = self.model.transform(coords)
        return scored.withColumn("risk_zone", F.col("_zone").cast("string")).drop(
            *names, "_point", "_zone"
        )

    def centres(self) -> list[list[float]]:
        return [list(map(float, c)) for c in self.model.stages[-1].clusterCenters()]


def fit_risk_zones(
    train: DataFrame,
    k: int = 50,
    columns=("postal_code_latitude", "postal_code_longitude"),
    seed: int = SEED,
    max_iter: int = 20,
) -> RiskZones:
    """k-means over the coordinates; never more clusters than distinct points."""
    medians = fit_medians(train, columns)
    names = [f"_{c}" for c in medians.values]
    # Many quotes share a postal code: cluster the distinct points, weighted by their rows.
    points = (
        train.select(
            *[
                F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(f"_{c}")
                for c, m in medians.values.items()
            ]
        )
        .groupBy(*names)
        .agg(F.count("*").cast("double").alias("_weight"))
    )
    points = write_table(points, "points")
    distinct = points.limit(k).count()
    assembler = VectorAssembler(inputCols=names, outputCol="_point")
    kmeans = KMeans(
        k=max(2, min(k, distinct)),
        seed=seed,
        maxIter=max_iter,
        featuresCol="_point",
        predictionCol="_zone",
        weightCol="_weight",
    )
    return RiskZones(medians, Pipeline(stages=[assembler, kmeans]).fit(points))


@dataclass(frozen=True)
class PrincipalComponents:
    medians: Medians
    scaling: Scaling
    assembler: VectorAssembler
    model: object
    signs: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``pca_0 ..`` of the filled and scaled columns, which stay as they are."""
        names = list(self.scaling.moments)
        scaled = {
            f"_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(self.medians.values[c])) - m) / s
            for c, (m, s) in self.scaling.moments.items()
        }
        wide = self.model.transform(self.assembler.transform(df.withColumns(scaled)))
        parts = vector_to_array(F.col("_pca"))
        found = {f"pca_{n}": parts[n] * s for n, s in enumerate(self.signs)}
        return wide.withColumns(found).drop(*[f"_{c}" for c in names], "_scaled", "_pca")

    def loadings(self) -> list[list[float]]:
        pc = self.model.pc.toArray()
        return [[float(x) * s for x in pc[:, n]] for n, s in enumerate(self.signs)]


def fit_pca(train: DataFrame, columns, n_components: int = 15) -> PrincipalComponents:
    """Principal components of filled, scaled columns; largest loading is positive."""
    medians = fit_medians(train, columns)
    names = list(medians.values)
    filled = medians.transform(train.select(*names))
    scaling = fit_scaling(filled, names)
    assembler = VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="_scaled")
    scaled = filled.select(
        *[((F.col(c) - m) / s).alias(f"_{c}") for c, (m, s) in scaling.moments.items()]
    )
    pca = PCA(k=min(n_components, len(names)), inputCol="_scaled", outputCol="_pca")
    model = pca.fit(assembler.transform(scaled))
    signs = []
    for column in model.pc.toArray().T:
        signs.append(1.0 if column[abs(column).argmax()] >= 0 else -1.0)
    return PrincipalComponents(medians, scaling, assembler, model, tuple(signs))
