"""Removal of passages that an earlier document already holds, by level-wise doubling.

A window of ``length`` words can only occur twice if the half-length windows inside it do. Level one
looks at half-length windows, of which every full window holds at least one that its content selects
(the smallest hash). Only the selected windows that occur in several documents are extended: first to
the whole stretch of words whose windows selected them, which settles copied passages in one step, and
where a stretch as a whole is new, to each window of the full length. Longer windows consist of windows
of that length, so the levels end there or when no candidate survives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import Stretches, WordHashes, column, join_texts, minimisers, printed, rows, write_table

# Odd multipliers of two independent hashes.
HALF, WHOLE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def selected(codes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Half-length windows that windows of ``length`` select: hash, first and last window that did."""
    half = length // 2
    hashes = Stretches(codes, HALF).every(half)
    chosen = minimisers(hashes, length - half + 1)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen)) - 1
    return hashes[chosen[first]], first, last


def level_half(documents: DataFrame, length: int) -> DataFrame:
    """Selected half-length windows of every document, each hash once per document."""

    def work(batches):
        memo = WordHashes()
        for batch in batches:
            keys, docs, prints = [], [], []
            for doc, mark, text in rows([batch], "doc_id", "print", "text"):
                found = np.unique(selected(memo.of(text.encode().split()), length)[0])
                keys.append(found)
                docs.append(np.full(len(found), doc))
                prints.append(np.full(len(found), mark, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [column(np.concatenate(keys), pa.int64()), column(np.concatenate(docs), pa.int64()),
                     column(np.concatenate(prints), pa.int32())],
                    ["key", "doc_id", "print"],
                )

    return documents.mapInArrow(work, "key long, doc_id long, print int")


def level_stretch(candidates: DataFrame, length: int) -> DataFrame:
    """The stretch of windows around each candidate half window: its hash, first and last window."""

    def work(batches):
        memo = WordHashes()
        for doc, mark, text, wanted in rows(batches, "doc_id", "print", "text", "keys"):
            codes = memo.of(text.encode().split())
            keys, first, last = selected(codes, length)
            take = np.isin(keys, np.array(wanted, np.int64).view(np.uint64))
            keys, first, last = keys[take], first[take], last[take]
            whole = Stretches(codes, WHOLE).between(first, last + length)
            yield pa.RecordBatch.from_arrays(
                [column(keys, pa.int64()), column(whole + (last - first).astype(np.uint64), pa.int64()),
                 column(first, pa.int32()), column(last, pa.int32()),
                 pa.array([doc] * len(keys), pa.int64()), pa.array([mark] * len(keys), pa.int32())],
                ["key", "stretch", "first", "last", "doc_id", "print"],
            )

    return candidates.mapInArrow(work, "key long, stretch long, first int, last int, doc_id long, print int")


def level_window(candidates: DataFrame, length: int) -> DataFrame:
    """Every window of the full length in the stretches that are still open."""

    def work(batches):
        memo = WordHashes()
        for doc, mark, text, stretches in rows(batches, "doc_id", "print", "text", "stretches"):
            hashes = Stretches(memo.of(text.encode().split()), WHOLE).every(length)
            starts = [np.arange(s["first"], s["last"] + 1) for s in stretches]
            keys = [np.full(len(x), s["key"]) for x, s in zip(starts, stretches, strict=True)]
            start = np.concatenate(starts)
            yield pa.RecordBatch.from_arrays(
                [column(np.concatenate(keys), pa.int64()), column(hashes[start], pa.int64()),
                 column(start, pa.int32()),
                 pa.array([doc] * len(start), pa.int64()), pa.array([mark] * len(start), pa.int32())],
                ["key", "window", "start", "doc_id", "print"],
            )

    return candidates.mapInArrow(work, "key long, window long, start int, doc_id long, print int")


def per_document(df: DataFrame, name: str, item, width: int) -> tuple[DataFrame, int]:
    """One row per document with a list of ``item``, written; and its size in bytes."""
    table = write_table(df.groupBy("doc_id", "print").agg(F.collect_list(item).alias(name)), name)
    count = table.agg(F.coalesce(F.sum(F.size(name) * width + 48), F.lit(0))).first()[0]
    return table, count


def held_by_several(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several documents hold, with the smallest of them as ``holder``."""
    found = df.groupBy(*keys).agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
    return found.where("holder < last").drop("last")


def repeated_spans(documents: DataFrame, length: int = 50) -> tuple[DataFrame, int]:
    """Spans of words to remove: ``doc_id``, ``print``, ``spans`` (start and end); and their size.

    A span is one or more windows of ``length`` words that also start in a document of a smaller id.
    """
    texts = printed(documents).where("doc_id is not null and text is not null")
    halves = write_table(level_half(texts, length), "halves")
    shared = write_table(held_by_several(halves, ["key"]), "shared").select("key")
    open_, size = per_document(halves.join(shared, "key").select("doc_id", "print", "key"), "keys", F.col("key"), 8)

    stretches = write_table(level_stretch(join_texts(texts, open_, size, "inner"), length), "stretches")
    holders = write_table(held_by_several(stretches, ["key", "stretch"]), "holders")
    held = write_table(stretches.join(holders, ["key", "stretch"], "left"), "held")
    copied = held.where("holder < doc_id")
    # One document of each kind of stretch stands for it; keys with one kind only are settled.
    kinds = held.where("holder is null or holder = doc_id").drop("holder")
    several = write_table(held_by_several(kinds, ["key"]), "several").select("key")
    item = F.struct("key", "first", "last")
    open_, size = per_document(kinds.join(several, "key"), "stretches", item, 24)

    full = write_table(level_window(join_texts(texts, open_, size, "inner"), length), "windows")
    earlier = write_table(held_by_several(full, ["key", "window"]), "earlier")
    single = full.join(earlier, ["key", "window"]).where("holder < doc_id")
    spans = copied.select("doc_id", "print", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    spans = spans.union(single.select("doc_id", "print", "start", (F.col("start") + length).alias("end")))
    return per_document(spans, "spans", F.struct("start", "end"), 16)


def remove_repeats(documents: DataFrame, length: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the words that windows of an earlier document cover.

    Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space).
    Words are runs of characters other than ASCII white space. A null text has no words, a text of fewer
    than ``length`` words keeps all. Equal windows inside one document, or in rows that share a ``doc_id``,
    do not count; repeated rows are answered each. Rows with a null ``doc_id`` keep all their words and
    take none from others. Of other columns those named in ``carry`` come along, the rest is ignored; an
    empty table gives an empty result.
    """
    spans, size = repeated_spans(documents, length)
    kept_fields = [documents.schema[c] for c in carry]

    def work(batches):
        for batch in batches:
            out = []
            for doc, text, found in rows([batch], "doc_id", "text", "spans"):
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in found or ():
                    edge[s["start"]] += 1
                    edge[s["end"]] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                kept = words if stays.all() else [words[i] for i in np.flatnonzero(stays)]
                out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            names = ["doc_id", "n_words", "n_removed", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            made = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            carried = [batch.column(batch.schema.get_field_index(f"_{c}")) for c in carry]
            yield pa.RecordBatch.from_arrays([*made, *carried], [*names, *carry])

    source = printed(documents, *(F.col(f"`{c}`").alias(f"_{c}") for c in carry))
    joined = join_texts(source, spans, size, "left").drop("print")
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept_fields)
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string" + more)
