"""Repeated passages by a sparse suffix array.

Only suffixes that start at positions their content selects are kept: the smallest hash among the
half-length windows of a passage. Suffixes that share their first words are sorted by what follows them
(and once by what stands before them); neighbours in that order are compared word by word and their match
is extended to the right and to the left. What the neighbours on either side leave open, a passage that
needs words on both sides of a key which many others share in part, is settled by the hashes of the single
windows around that key. Matches of one document that touch make one passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import Stretches, WordHashes, column, join_texts, minimisers, printed, rows, write_table

SEED = 0x9E3779B97F4A7C15


def retained(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions kept in the sparse suffix array, and the hash of the half passage that starts there."""
    half = length // 2
    hashes = Stretches(codes, SEED).every(half)
    at = np.unique(minimisers(hashes, length - half + 1))
    return at, hashes[at]


def suffix_keys(texts: DataFrame, length: int) -> DataFrame:
    """Hashes at the retained positions, each once per document."""

    def work(batches):
        memo = WordHashes()
        for batch in batches:
            keys, docs = [], []
            for doc, text in rows([batch], "doc_id", "text"):
                found = np.unique(retained(memo.of(text.encode().split()), length)[1])
                keys.append(found)
                docs.append(np.full(len(found), doc))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [column(np.concatenate(keys), pa.int64()), column(np.concatenate(docs), pa.int64())], ["key", "doc_id"]
                )

    return texts.mapInArrow(work, "key long, doc_id long")


def suffixes(texts: DataFrame, length: int) -> DataFrame:
    """Suffixes whose first words several documents hold, with the words beside them as 32-bit hashes.

    ``after`` are the words that follow the shared ones, ``before`` those in front, nearest first; both
    reach as far as a passage that selected the position can. Positions of a document with the same words
    all around are one suffix, so text that repeats a few words over and over gives few.
    """
    half = length // 2
    reach = length - half

    def work(batches):
        memo = WordHashes()
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, mark, text, wanted in rows([batch], "doc_id", "print", "text", "keys"):
                codes = memo.of(text.encode().split())
                at, keys = retained(codes, length)
                take = np.isin(keys, np.array(wanted, np.int64).view(np.uint64))
                # Big-endian, so that sorting the bytes sorts the words.
                words = (codes >> np.uint64(32)).astype(">u4")
                alike: dict[tuple, list[int]] = {}
                for p, key in zip(at[take].tolist(), keys[take].view(np.int64).tolist(), strict=True):
                    after = words[p + half : p + half + reach].tobytes()
                    alike.setdefault((key, after, words[max(0, p - reach) : p][::-1].tobytes()), []).append(p)
                for (key, after, before), places in alike.items():
                    for values_of, value in zip(out, (key, doc, mark, places, after, before), strict=True):
                        values_of.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = ["key", "doc_id", "print", "at", "after", "before"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return texts.mapInArrow(work, "key long, doc_id long, print int, at array<int>, after binary, before binary")


def common(a: bytes, b: bytes) -> int:
    """Number of leading words that two runs of 32-bit hashes share."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, np.uint32, n), np.frombuffer(b, np.uint32, n)
    return int(np.argmax(x != y))


# A match: the positions of a suffix, how many words it covers to the left and right of them, and where else.
FOUND = "doc_id long, print int, at array<int>, left int, right int, other_doc_id long, other_start int"
FIELDS = ["doc_id", "print", "at", "left", "right", "other_doc_id", "other_start"]
KINDS = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
SUFFIX = ["key", "doc_id", "print", "at", "after", "before"]
SUFFIX_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
# What the neighbours of a suffix leave open: its key, document and first position, and the bound they set.
OPEN = ["key", "doc_id", "print", "first", "bound"]
OPEN_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def compared(suffix, length: int, ahead: bool):
    """Matches of neighbouring suffixes, from an iterator of sorted suffixes, for both of the two, and bounds.

    Neighbours of the same document are passed over: each suffix meets the nearest ones before and after it
    that stand in other documents. Of all suffixes of other documents these share most with it on the side
    the order goes by: what follows if ``ahead``, else what stands before. A window with ``j`` words before
    the position can so repeat only from a least ``j`` on (``ahead``) or up to a largest one; those that the
    match with the nearest neighbour covers are done. The bound of a suffix is the first or last ``j`` left
    open by its order. The first and last document's suffixes of the iterator may have nearer neighbours
    outside, so all is open for them.
    """
    half = length // 2
    reach = length - half
    out, open_ = [[] for _ in FIELDS], [[] for _ in OPEN]
    run: list[list] = []  # suffixes of one key and document, each with the most it shares with a neighbour
    last = None  # nearest suffix before the run, of another document
    outermost = True

    def match(x, y):
        a, b = x[0], y[0]
        right, left = common(a[4], b[4]), common(a[5], b[5])
        best = (right, left) if ahead else (left, right)
        x[1], y[1] = max(x[1], best), max(y[1], best)
        if left + right >= reach:
            for own, other in ((a, b), (b, a)):
                found = (own[1], own[2], own[3], left, half + right, other[1], other[3][0] - left)
                for values, value in zip(out, found, strict=True):
                    values.append(value)

    def close(unsure: bool):
        for s, (near, far) in run:
            if unsure:
                bound = 1 if ahead else reach - 1
            else:
                bound = max(reach - near, far + 1) if ahead else min(near, reach - far - 1)
            if 0 < bound < reach:
                for values, value in zip(open_, (s[0], s[1], s[2], s[3][0], bound), strict=True):
                    values.append(value)

    for s in suffix:
        entry = [s, (0, 0)]
        if run and s[0] != run[-1][0][0]:
            close(outermost)
            run, last, outermost = [], None, False
        if run and s[1] != run[-1][0][1]:
            # Every suffix of the run meets the first one after it, and that one meets the run's last.
            for r in run:
                match(r, entry)
            close(outermost)
            last, run, outermost = run[-1], [entry], False
        else:
            if last is not None and run:
                match(entry, last)
            run.append(entry)
    close(True)
    return out, open_


def neighbour_matches(table: DataFrame, length: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Matches of suffixes that are neighbours when sorted by ``key`` and ``order``, and what they leave open.

    Suffixes are sorted across all tasks, so a key with very many of them is spread over many tasks; the
    first and the last ones of each task meet those of the tasks beside it in a second step, by key. Spark's
    ranges come from a sample, so the outcome is written once.
    """
    by = ["key", *order, "doc_id", "print"]
    ahead = order[0] == "after"

    def work(batches):
        first: list[tuple] = []
        last: list[tuple] = []

        def stream():
            """Passes suffixes on; keeps the first and the last run of a document, and the one beside each."""
            open_, run = True, []
            for s in rows(batches, *SUFFIX):
                if run and s[:2] != run[-1][:2]:
                    last[:] = run[-1:]
                    if open_:
                        first.extend([*run, s])
                        open_ = False
                    run = []
                run.append(s)
                yield s
            last.extend(run)
            if open_:
                first.extend(run)

        found, bounds = compared(stream(), length, ahead)
        edges = list({(*e[:3], *e[4:]): e for e in [*first, *last]}.values())
        sides = [[e[i] for e in edges] for i in range(len(SUFFIX))]
        # Matches, then bounds, then edges: each fills its own columns.
        parts = [(FIELDS, "", found, KINDS), (OPEN, "open_", bounds, OPEN_KINDS), (SUFFIX, "edge_", sides, SUFFIX_KINDS)]
        total, before, names, columns = sum(len(v[0]) for _, _, v, _ in parts), 0, [], []
        for fields, prefix, values, kinds in parts:
            n = len(values[0])
            names += [prefix + f for f in fields]
            columns += [
                pa.chunked_array([pa.nulls(before, k), pa.array(v, k), pa.nulls(total - before - n, k)]).combine_chunks()
                for v, k in zip(values, kinds, strict=True)
            ]
            before += n
        yield pa.RecordBatch.from_arrays(columns, names)

    def edge_work(batches):
        out, _ = compared(rows(batches, *SUFFIX), length, ahead)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, KINDS, strict=True)], FIELDS)

    bound = "open_key long, open_doc_id long, open_print int, open_first int, open_bound int"
    edge = "edge_key long, edge_doc_id long, edge_print int, edge_at array<int>, edge_after binary, edge_before binary"
    partitions = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = table.select(*SUFFIX).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    made = write_table(ranged.mapInArrow(work, f"{FOUND}, {bound}, {edge}"), "neighbours")
    inside = made.where("doc_id is not null").select(*FIELDS)
    # Few suffixes of each task, whatever their number.
    edges = made.where("edge_doc_id is not null").select(*(F.col(f"edge_{c}").alias(c) for c in SUFFIX)).distinct()
    beside = edges.repartition("key").sortWithinPartitions(*by).mapInArrow(edge_work, FOUND)
    open_ = made.where("open_doc_id is not null").select(*(F.col(f"open_{c}").alias(c) for c in OPEN))
    return inside.union(beside), open_


def open_windows(table: DataFrame, least: DataFrame, most: DataFrame, length: int) -> DataFrame:
    """Matches of single windows that neighbours in both orders leave open.

    A suffix is open between the bounds of the two orders. Every suffix of a key with an open one gives the
    hashes of its windows with as many words before the position as some open one of the key has; windows
    of more than one document repeat. Hashes are counted by their smallest and largest document, so a key
    of very many suffixes is neither gathered nor paired. Only windows between the bounds of their own suffix
    are looked up among those that repeat: the neighbours have covered the others.
    """
    half = length // 2
    reach = length - half
    suffix = OPEN[:4]
    bounds = least.select(*suffix, F.col("bound").alias("least"), F.lit(None).cast("int").alias("most")).union(
        most.select(*suffix, F.lit(None).cast("int"), F.col("bound"))
    )
    spans = bounds.groupBy(*suffix).agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <= most")
    spans = write_table(spans, "open-suffixes")
    keys = write_table(spans.groupBy("key").agg(F.min("least").alias("low"), F.max("most").alias("high")), "open-keys")

    def work(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for key, doc, mark, at, after, before, low, high, first, last in rows([batch], *SUFFIX, "low", "high", "least", "most"):
                # As many words before and after as there are.
                for j in range(max(low, reach - len(after) // 4), min(high, len(before) // 4) + 1):
                    code = xxhash.xxh3_64_intdigest(before[: 4 * j] + after[: 4 * (reach - j)], seed=(key + j) % 2**64)
                    own = (mark, at, j) if first is not None and first <= j <= last else (None, None, None)
                    for values, value in zip(out, (code, doc, at[0] - j, *own), strict=True):
                        values.append(value)
            windows = column(np.array(out[0], np.uint64), pa.int64())
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32()]
            names = ["window", "doc_id", "start", "print", "at", "left"]
            yield pa.RecordBatch.from_arrays([windows, *(pa.array(v, k) for v, k in zip(out[1:], kinds, strict=True))], names)

    candidates = table.join(keys, "key").withColumn("first", F.col("at")[0]).join(spans, suffix, "left")
    made = candidates.mapInArrow(work, "window long, doc_id long, start int, print int, at array<int>, left int")
    made = write_table(made, "open-windows")
    place = F.struct("doc_id", "start")
    several = made.groupBy("window").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low.doc_id < high.doc_id")
    joined = made.where("left is not null").drop("start").join(write_table(several, "shared-windows"), "window")
    other = F.when(F.col("low.doc_id") == F.col("doc_id"), F.col("high")).otherwise(F.col("low"))
    return joined.withColumn("other", other).select(
        "doc_id", "print", "at", "left", (F.lit(length) - F.col("left")).cast("int").alias("right"),
        F.col("other.doc_id").alias("other_doc_id"), F.col("other.start").cast("int").alias("other_start"),
    )


def repeated_passages(documents: DataFrame, length: int = 50) -> DataFrame:
    """Passages of at least ``length`` words that also stand in another document.

    Returns ``doc_id``, ``start`` and ``n_words`` of each maximal run of words that matches cover, and
    ``other_doc_id`` and ``other_start`` of the match it begins with (the smallest document of several).
    Words are runs of characters other than ASCII white space. A null text, one of fewer words, or one that
    repeats only itself has no passages. Rows with a null ``doc_id`` are left out, repeated rows count once.
    Documents without a repeated passage give no row. Other columns are ignored.
    """
    texts = printed(documents).where("doc_id is not null and text is not null")
    keys = write_table(suffix_keys(texts, length), "suffix-keys")
    several = keys.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    wanted = keys.join(write_table(several, "shared-keys"), "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    wanted = write_table(wanted, "wanted-keys")
    size = wanted.agg(F.coalesce(F.sum(F.size("keys") * 8 + 40), F.lit(0))).first()[0]
    table = write_table(suffixes(join_texts(texts, wanted, size, "inner", ["doc_id"]), length), "suffixes")
    following, least = neighbour_matches(table, length, ["after", "before"])
    preceding, most = neighbour_matches(table, length, ["before", "after"])
    found = following.union(preceding).union(open_windows(table, least, most, length))
    spans = found.groupBy("doc_id", "print", "at", "left", "right").agg(
        F.min(F.struct("other_doc_id", "other_start")).alias("other")
    ).groupBy("doc_id", "print").agg(F.collect_list(F.struct("at", "left", "right", "other")).alias("matches"))

    def work(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc, matches in rows([batch], "doc_id", "matches"):
                # By start; of equal starts the longest first, then the smallest other document.
                spans = sorted(
                    (p - m["left"], -p - m["right"], m["other"]["other_doc_id"], m["other"]["other_start"])
                    for m in matches for p in m["at"]
                )
                merged: list[list] = []
                for start, end, *other in spans:
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], -end)
                    else:
                        merged.append([start, -end, *other])
                for start, end, *other in merged:
                    for values_of, value in zip(out, (doc, start, end - start, *other), strict=True):
                        values_of.append(value)
            names = ["doc_id", "start", "n_words", "other_doc_id", "other_start"]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names)

    return spans.mapInArrow(work, "doc_id long, start long, n_words long, other_doc_id long, other_start long")
