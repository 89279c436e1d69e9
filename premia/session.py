"""Session settings and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A quote block has 155 columns and gains about 70, more than the default of 100 fields that whole-stage
# codegen allows. A projection that generates more than 8000 bytes of code is not compiled by the JVM, only
# interpreted; such a one runs without whole-stage codegen instead, which is about four times faster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Fitted tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000

_written: dict[str, list[str]] = {}


def build_session(app: str = "premia", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="premia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/premia-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    The result has no lineage beyond its files, so lost executors cost only the tasks
    they held, and values that depend on the physical layout are computed exactly once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table when its counted size is small; else it is joined by shuffle."""
    rows = table.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(table) if rows <= limit else table


def looked_up(df: DataFrame, lookups, drop=()) -> DataFrame:
    """Add columns by left joins with fitted tables: ``(name, keys, table, columns, value, rows)`` each.

    ``keys`` are expressions over ``df``, compared null-safe with the table's ``columns``. Through the joins a row
    travels as one value: a join copies it as a block, where it would copy hundreds of columns one by one. Spark
    takes the value apart again before the joins if some of its columns are never used; ``drop`` leaves such out.
    """
    lookups = list(lookups)
    kept = [c for c in df.columns if c not in set(drop)]
    inputs = [k.alias(f"_k{n}_{j}") for n, (_, keys, *_) in enumerate(lookups) for j, k in enumerate(keys)]
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *inputs)
    for n, (_, _, table, columns, value, rows) in enumerate(lookups):
        side = table.select(*[F.col(c).alias(f"_t{n}_{j}") for j, c in enumerate(columns)], F.col(value).alias(f"_v{n}"))
        same = [F.col(f"_k{n}_{j}").eqNullSafe(F.col(f"_t{n}_{j}")) for j in range(len(columns))]
        out = out.join(small_side(side, rows), same, "left").drop(*[f"_{x}{n}_{j}" for j in range(len(columns)) for x in "kt"])
    return out.select("_row.*", *[F.col(f"_v{n}").alias(name) for n, (name, *_) in enumerate(lookups)])


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediates this application wrote; returns how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
