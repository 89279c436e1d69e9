"""Prediction files: semicolon separated, decimal point, one header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.roles import DISPLAY_PRICE_COLS, PRICE_COLS


def submission_schema(columns, key_type: T.DataType | None = None) -> T.StructType:
    """Prices are numbers; everything else is the key."""
    prices = set(PRICE_COLS + DISPLAY_PRICE_COLS)
    key = key_type or T.LongType()
    return T.StructType(
        [T.StructField(c, T.DoubleType() if c in prices else key) for c in columns]
    )


def read_submission(
    spark: SparkSession, path: str, columns=("quote_id", *PRICE_COLS), key_type=None
) -> DataFrame:
    """Read with a given schema: no extra pass to infer types."""
    schema = submission_schema(columns, key_type)
    return spark.read.csv(path, sep=";", header=True, schema=schema, enforceSchema=False)


def write_submission(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of part files; one file only when asked, which one task must write."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").csv(path, sep=";", header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON record per insurer."""
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.json(path, schema=schema)


class PredictionStore:
    """Predictions per insurer that survive an aborted run.

    Each insurer has a folder of its own, replaced as a whole, so insurers can be saved at
    the same time. One counts as done once its completion record is written, which happens
    after its predictions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def save(self, insurer: str, preds: DataFrame) -> None:
        own = preds.where(F.col("insurer") == insurer).drop("insurer")
        own.write.mode("overwrite").parquet(f"{self.path}/predictions/insurer={insurer}")
        rows = self.spark.read.parquet(f"{self.path}/predictions/insurer={insurer}")
        record = rows.agg(F.count("*").alias("n_rows"))
        record.write.mode("overwrite").json(f"{self.path}/completed/insurer={insurer}")

    def _exists(self, folder: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return target.getFileSystem(conf).exists(target)

    def completed(self) -> DataFrame:
        if not self._exists("completed"):
            return self.spark.createDataFrame([], "insurer string")
        records = self.spark.read.json(
            f"{self.path}/completed", schema="n_rows long, insurer string"
        )
        return records.select("insurer").distinct()

    def pending(self, insurers: DataFrame) -> DataFrame:
        """Insurers (with any further columns) that still have to be predicted."""
        return insurers.join(self.completed(), "insurer", "left_anti")

    def predictions(self) -> DataFrame:
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/predictions")
        return stored.join(self.completed(), "insurer", "left_semi")
