"""Exact quantiles without sorting or gathering the data.

The value at a rank is found by counting. Each pass splits the interval that still
holds a wanted rank into equal bins, counts the rows per bin (pre-aggregated before the
shuffle, so a group that holds a third of all rows costs no more than another) and keeps
the bin of the rank. When few enough values remain, their counts give the exact answer.
Only ``groups x ranks`` rows reach the driver. How small the last intervals are changes the
number of passes, never a value: there is one way to count and one interpolation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed work bounds: rows an interval may still hold when values are counted one by one,
# bins per pass, groups whose intervals the driver keeps.
EXACT_ROWS = 1_000_000
BINS = 4096
MAX_GROUPS = 20_000


@dataclass
class Interval:
    """Closed value interval of one group that holds the wanted ranks."""

    group: tuple
    low: float
    high: float
    below: int
    count: int
    ranks: tuple[int, ...]


@dataclass(frozen=True)
class GroupQuantiles:
    count: int
    minimum: float
    maximum: float
    values: tuple[float, ...]


def _interval_table(spark, by, types, intervals):
    """Small local table, one row per interval and wanted rank."""
    rows = [
        (*i.group, n, i.low, i.high, rank - i.below)
        for n, i in enumerate(intervals)
        for rank in i.ranks
    ]
    schema = [f"`{c}` {t}" for c, t in zip(by, types)]
    schema += ["_iv int", "_low double", "_high double", "_rank long"]
    frame = pd.DataFrame(rows, columns=[*by, "_iv", "_low", "_high", "_rank"])
    return spark.createDataFrame(frame, ", ".join(schema))


def _inside(values: DataFrame, by, table: DataFrame) -> DataFrame:
    """Rows within an interval, tagged with it. Intervals of a group do not overlap."""
    bounds = table.select(*by, "_iv", "_low", "_high").distinct()
    within = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    # Bounded by MAX_GROUPS times the number of ranks.
    return values.join(F.broadcast(bounds), list(by)).where(within)


def _at_ranks(counted: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``counted`` (with ``_iv, _n``, sorted by ``_v``) that hold a wanted rank."""
    running = Window.partitionBy("_iv").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_n").over(running))
    wanted = F.broadcast(table.select("_iv", "_rank"))
    holds = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    return upto.join(wanted, "_iv").where(holds)


def _refine(values, by, types, intervals, bins):
    """Shrink every interval to the bins that hold its ranks."""
    table = _interval_table(values.sparkSession, by, types, intervals)
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    binned = (
        _inside(values, by, table)
        .groupBy("_iv", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin"))
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_v"), F.max("_v").alias("_top"))
    )
    found = _at_ranks(binned, table).select("_iv", "_v", "_top", "_upto", "_n", "_rank")
    shrunk: dict[tuple, Interval] = {}
    for r in found.collect():
        parent = intervals[r["_iv"]]
        at = (r["_iv"], r["_v"])
        rank = r["_rank"] + parent.below
        if at in shrunk:
            shrunk[at].ranks = tuple(sorted({*shrunk[at].ranks, rank}))
        else:
            below = parent.below + r["_upto"] - r["_n"]
            shrunk[at] = Interval(parent.group, r["_v"], r["_top"], below, r["_n"], (rank,))
    return list(shrunk.values())


def _exact(values, by, types, intervals):
    """Value at every wanted rank, from the counts of the remaining distinct values."""
    table = _interval_table(values.sparkSession, by, types, intervals)
    counted = _inside(values, by, table).groupBy("_iv", "_v").agg(F.count("*").alias("_n"))
    found = _at_ranks(counted, table).select("_iv", "_rank", "_v").collect()
    return {
        (intervals[r["_iv"]].group, r["_rank"] + intervals[r["_iv"]].below): r["_v"] for r in found
    }


def exact_quantiles(
    df: DataFrame,
    value,
    probs,
    by=(),
    exact_rows: int = EXACT_ROWS,
    bins: int = BINS,
) -> dict[tuple, GroupQuantiles]:
    """Linearly interpolated quantiles of the non-null values, per group of ``by``.

    ``by`` must name a bounded set of groups (insurers, columns, tree leaves).
    """
    column = F.col(value) if isinstance(value, str) else value
    by = list(by)
    values = df.select(*by, column.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not by:
        by = ["_all"]
        values = values.select(F.lit(0).alias("_all"), "_v")
    types = [values.schema[c].dataType.simpleString() for c in by]

    summary = (
        values.groupBy(*by)
        .agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(summary) > MAX_GROUPS:
        raise ValueError(f"exact_quantiles supports up to {MAX_GROUPS} groups")

    need: dict[tuple, list[tuple[int, float]]] = {}
    pending, done = [], {}
    for r in summary:
        group = tuple(r[c] for c in by)
        need[group] = []
        ranks = set()
        for p in probs:
            at = p * (r["n"] - 1)
            rank = min(math.floor(at), r["n"] - 1)
            need[group].append((rank, at - rank))
            ranks |= {rank, min(rank + 1, r["n"] - 1)}
        inner = tuple(sorted(ranks - {0, r["n"] - 1}))
        done[group, 0], done[group, r["n"] - 1] = r["low"], r["high"]
        if inner:
            pending.append(Interval(group, r["low"], r["high"], 0, r["n"], inner))

    small = []
    while pending:
        wide = []
        for i in pending:
            if i.low == i.high:
                done.update({(i.group, rank): i.low for rank in i.ranks})
            elif i.count <= exact_rows:
                small.append(i)
            else:
                wide.append(i)
        pending = _refine(values, by, types, wide, bins) if wide else []
    if small:
        done.update(_exact(values, by, types, small))

    out = {}
    for r in summary:
        group = tuple(r[c] for c in by)
        points = []
        for rank, part in need[group]:
            low = done[group, rank]
            high = done[group, min(rank + 1, r["n"] - 1)]
            points.append(low + (high - low) * part)
        key = group if by != ["_all"] else ()
        out[key] = GroupQuantiles(r["n"], r["low"], r["high"], tuple(points))
    return out


def column_quantiles(df: DataFrame, columns, probs) -> dict[str, GroupQuantiles]:
    """Quantiles of many numeric columns together; all-null columns are left out."""
    columns = list(columns)
    if not columns:
        return {}
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    return {k[0]: v for k, v in exact_quantiles(long, "value", probs, by=["column"]).items()}
