"""Words, their hashes, and joins with whole texts, shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.session import apply_settings, write_table

__all__ = [
    "LOWER", "Lexicon", "Stretches", "WordHashes", "column", "give_back", "join_texts", "minimisers", "mixed", "printed", "read", "rows",
    "settings", "write_table",
]

# Per-document side tables up to this many bytes are sent to all executors; larger ones are joined by shuffle.
SENT_BYTES = 64 << 20

# Lower-cases A to Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Words whose hashes a task remembers, and how long they may be.
REMEMBERED, LONG = 200_000, 64


def settings(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: whole texts go to Python in batches of bounded size."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and others of its executor need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def longer(values: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` after the used ones; its room doubles when it is full."""
    if used + len(more) > len(values):
        values = np.concatenate([values[:used], np.empty(used + len(more), values.dtype)])
    values[used : used + len(more)] = more
    return values


class Lexicon(dict):
    """Token ids of keys, each found once while it is remembered, gathered for many keys at a time.

    ``find`` takes a list of keys and gives their ids, one after another, and how many each has. Keys have
    numbers in the order in which they were met. Beyond ``most`` keys or ``most_bytes`` of them all are
    forgotten, so memory is bounded whatever the texts hold.
    """

    def __init__(self, find: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int, most_bytes: int = 64 << 20):
        self.find, self.most, self.most_bytes = find, most, most_bytes
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new, self.size, self.found = [], 0, 0
        # Ids one after another, and by number where those of a key start and how many there are.
        self.ids, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        self.size += len(key)
        return number

    def of(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``keys``, one after another, and how many each has."""
        if len(self) > self.most or self.size > self.most_bytes:
            self.forget()
        numbers = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.new:
            new, self.new = self.new, []
            ids, lengths = self.find(new)
            first = len(self) - len(new)
            self.starts = longer(self.starts, first, self.found + np.cumsum(lengths) - lengths)
            self.lengths = longer(self.lengths, first, lengths)
            self.ids = longer(self.ids, self.found, ids)
            self.found += len(ids)
        lengths = self.lengths[numbers].astype(np.int64)
        before = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[numbers] - before, lengths)
        at += np.arange(len(at))
        return self.ids[at], lengths


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches:
    """Hashes of any stretch of consecutive codes; ``seed`` (odd) selects an independent hash."""

    def __init__(self, codes: np.ndarray, seed: int):
        n = len(codes)
        down = np.full(n, np.uint64(pow(seed, -1, 1 << 64)))
        down[:1] = 1
        self.up = np.full(n + 1, np.uint64(seed))
        self.up[:1] = 1
        self.up = np.multiply.accumulate(self.up)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * np.multiply.accumulate(down), out=self.sums[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.up[starts])

    def every(self, length: int) -> np.ndarray:
        """Of every ``length`` consecutive codes."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length : length + n] - self.sums[:n]) * self.up[:n])


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive hashes, the position of the smallest (the first of equal ones)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # Smallest of growing power-of-two stretches; two of them cover the width.
    best, reach = np.arange(len(hashes)), 1
    while reach * 2 <= width:
        left, right = best[:-reach], best[reach:]
        best = np.where(hashes[right] < hashes[left], right, left)
        reach *= 2
    left, right = best[:n], best[width - reach : width - reach + n]
    return np.where(hashes[right] < hashes[left], right, left)


def column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, kind)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a slice of a batch at a time.

    What earlier tasks of the worker, and at the end this one, have freed goes back to the system.
    """
    give_back()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
    give_back()


def join_texts(texts: DataFrame, per_document: DataFrame, size: int, how: str, on=("doc_id", "print")) -> DataFrame:
    """Join whole texts with one row per document.

    ``size`` is the counted size of ``per_document`` in bytes. Up to SENT_BYTES it is sent to
    all executors and the texts stay where they are; beyond that both sides are shuffled.
    """
    side = F.broadcast(per_document) if size <= SENT_BYTES else per_document
    return texts.join(side, list(on), how)


def printed(documents: DataFrame, *more: Column) -> DataFrame:
    """``doc_id``, ``text`` and a fingerprint of the text, which tells apart rows that share an id."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text"), F.hash("text").alias("print"), *more)
