"""Scoring blocks as they arrive.

Blocks come weekly as new files. A file stream picks each one up once; a micro-batch is
scored with fitted models and statistics exactly as a block is in a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from premia.sources.submissions import write_submission


def read_arrivals(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Unbounded table of the parquet files that land in ``path``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def score_arrivals(
    arrivals: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    finish: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Write one submission folder per micro-batch and stop when no file is left.

    A batch that is run again after a failure replaces its own folder, so every quote is
    written once.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        write_submission(finish(score(batch)), f"{target}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
