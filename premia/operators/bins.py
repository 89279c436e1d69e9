"""Feature values as bytes: found once, shared by all models, rounds and scores.

A number's bin counts the edges below it; edges are quantiles of the training rows. A category's bin
is its own if it is among the most frequent, else that of the rest. Bin 0 stands for a missing value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MISSING, REST = 0, 1
# A bin is a byte.
MOST_BINS = 256


@dataclass(frozen=True)
class Binning:
    """Per feature its edges, or for a category (``nominal``) the codes with bins of their own."""

    features: tuple[str, ...]
    nominal: tuple[bool, ...]
    values: tuple[tuple[float, ...], ...]

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of the feature columns (NaN: missing), one row of bytes per row."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, (column, nominal, values) in enumerate(zip(columns, self.nominal, self.values, strict=True)):
            known = np.array(values)
            if nominal:
                at = np.minimum(np.searchsorted(known, column), max(len(known) - 1, 0))
                hit = known[at] == column if len(known) else np.zeros(len(column), bool)
                out[:, k] = np.where(hit, at + 2, REST)
            else:
                out[:, k] = 1 + np.searchsorted(known, column)
            out[np.isnan(column), k] = MISSING
        return out

    def widths(self) -> tuple[int, ...]:
        """How many bins each feature has."""
        return tuple(len(v) + 2 for v in self.values)

    def packed(self, df: DataFrame, keep, name: str = "_x") -> DataFrame:
        """The kept columns and the bins of each row as bytes."""
        keep = list(keep)
        inputs = [number(c).alias(f"_in{k}") for k, c in enumerate(self.features)]
        flat = df.select(*keep, *inputs)
        schema = [f"`{c}` {flat.schema[c].dataType.simpleString()}" for c in keep]
        width = len(self.features)

        def pack(batches):
            for batch in batches:
                columns = [batch.column(len(keep) + k).to_numpy(zero_copy_only=False) for k in range(width)]
                made = self.of([np.asarray(c, np.float64) for c in columns])
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
                buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(made.tobytes())]
                cells = pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers)
                kept = [batch.column(k) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, cells], [*keep, name])

        return flat.mapInArrow(pack, ", ".join([*schema, f"{name} binary"]))


def number(name: str):
    """A feature as a double; null comes to tasks as NaN, so both are missing alike."""
    return F.col(f"`{name}`").cast("double")


# Rows that are summed up at once, and points that stand for them.
SKETCH_ROWS, POINTS = 262_144, 2048


def fewer(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their weights; beyond ``most`` those at even ranks stand for their neighbours."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values)).astype(np.int64)
    if len(values) <= most:
        return values, weights
    ranks = np.arange(1, most + 1) * int(weights.sum()) // most
    at, first = np.unique(np.searchsorted(np.cumsum(weights), ranks), return_index=True)
    upto = np.append(ranks[first[1:] - 1], ranks[-1])
    return values[at], np.diff(upto, prepend=0)


def column_edges(df: DataFrame, columns: list[str], room: int) -> list[tuple[float, ...]]:
    """Per column the distinct values at ``room`` even ranks, each off by about one in 2,048 of the rows at most.

    Tasks sum up their rows by points; those of a column meet in one task. Columns of few distinct values
    have exact edges.
    """
    width = len(columns)

    def sketch(batches):
        held, count = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
            if count >= SKETCH_ROWS:
                yield summed(held)
                held, count = [], 0
        if count:
            yield summed(held)

    def summed(held):
        blobs = []
        for k in range(width):
            values = np.concatenate([b[k] for b in held])
            values = values[~np.isnan(values)]
            blobs.append(blob(*fewer(values, np.ones(len(values)), POINTS)))
        return pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(blobs, pa.binary())], ["c", "points"])

    def blob(values, weights):
        return np.concatenate([values, weights.astype(np.float64)]).tobytes()

    def edges(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for c, points in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(c, [])
                own.append(np.frombuffer(points).reshape(2, -1))
                if sum(p.shape[1] for p in own) > 128 * POINTS:
                    held[c] = [np.stack(fewer(*np.concatenate(own, 1), 16 * POINTS))]
        for c, own in held.items():
            values, weights = fewer(*np.concatenate(own, 1), 1 << 62)
            upto, found = np.cumsum(weights), []
            if len(values):
                wanted = np.ceil(np.arange(1, room + 1) / (room + 1) * upto[-1] - 1e-6)
                found = np.unique(values[np.searchsorted(upto, wanted)]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([found], pa.list_(pa.float64()))], ["c", "edges"])

    points = df.select(*[number(c).alias(f"_in{k}") for k, c in enumerate(columns)]).mapInArrow(sketch, "c int, points binary")
    tasks = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), width)
    rows = points.repartition(tasks, "c").mapInArrow(edges, "c int, edges array<double>").collect()
    found_ = {r["c"]: tuple(r["edges"]) for r in rows}
    return [found_.get(k, ()) for k in range(width)]


def fit_bins(df: DataFrame, features, max_bins: int, nominal=()) -> Binning:
    """Edges and categories from the rows of ``df``: one aggregation for each of the two kinds."""
    features, nominal = tuple(features), set(nominal)
    room = min(max_bins, MOST_BINS) - 2
    found: dict[str, tuple[float, ...]] = {}
    numeric = [c for c in features if c not in nominal]
    if numeric:
        found = dict(zip(numeric, column_edges(df, numeric, room), strict=True))
    names = [c for c in features if c in nominal]
    if names:
        long = df.select(*[number(c).alias(c) for c in names]).unpivot([], names, "_c", "_v")
        counts = long.where("_v IS NOT NULL AND NOT isnan(_v)").groupBy("_c", "_v").count()
        rank = F.row_number().over(Window.partitionBy("_c").orderBy(F.desc("count"), "_v"))
        top = counts.withColumn("_rank", rank).where(F.col("_rank") <= room)
        for r in top.collect():
            found.setdefault(r["_c"], ())
            found[r["_c"]] += (r["_v"],)
    values = tuple(tuple(sorted(found.get(c, ()))) for c in features)
    return Binning(features, tuple(c in nominal for c in features), values)
