"""Near-duplicate documents by HyperMinHash sketches.

A sketch has 128 registers of 16 bits: the number of leading zeros of a minimum hash and its next bits
(the mantissa). Bands of four registers find documents that may be alike; the share of equal registers,
corrected for collisions of the compressed registers, estimates the similarity of a pair and keeps the
unlikely ones out. What remains hangs together in families of candidates, and links are confirmed on the
full shingle sets, family by family, in blocks of bounded size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import LOWER, WordHashes, column, join_texts, mixed, rows, write_table
from premia.llm.components import components

SHINGLE = 5
SEEDS, BUCKETS, MANTISSA = 16, 8, 10
# Sets up to SMALL shingles put all of them into every register; larger ones deal them into buckets.
# Below the border both sketches are made, so that two alike sets always share a kind.
SMALL = 57
# Documents of a block, and shingles of a block of a family.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
# Standard errors by which an estimate may miss a pair that is alike.
ERRORS = 5.0


def bands() -> np.ndarray:
    """32 bands of four registers. Each takes half of the buckets from one seed, two bands the two halves."""
    halves = [h for h in combinations(range(BUCKETS), BUCKETS // 2) if 0 in h][: 2 * SEEDS : 2]
    out = []
    for seed, half in enumerate(halves):
        other = tuple(b for b in range(BUCKETS) if b not in half)
        out += [[seed * BUCKETS + b for b in h] for h in (half, other)]
    return np.array(out)


BANDS = bands()
STEPS = (np.arange(1, SEEDS * BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima."""
    value = least | np.uint64(1)
    # Position of the highest bit; the conversion to a float can round it up by one.
    high = np.minimum(np.frexp(value.astype(np.float64))[1] - 1, 63).astype(np.uint64)
    high -= (value >> high) == 0
    zeros = np.uint64(63) - high
    mantissa = ((value << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def collision() -> float:
    """Chance that registers of two unrelated minima are equal: the sum of squared cell probabilities."""
    total = 0.0
    for zeros in range(60):
        cell = 2.0 ** -(zeros + 1)
        edge = cell * (1 + np.arange(2**MANTISSA + 1) / 2**MANTISSA)
        total += float((np.diff(-np.exp(-64 * edge)) ** 2).sum())
    return total


COLLISION = collision()


def lowest_estimate(share: float) -> float:
    """The corrected estimate above which a pair of this similarity stays, but for ERRORS errors."""
    return share - ERRORS * math.sqrt(share * (1 - share) / (SEEDS * BUCKETS))


def shingles(text: str, memo: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter sequence of words is one shingle."""
    codes = memo.of(text.encode().translate(LOWER).split())
    if not len(codes):
        return codes
    size = min(SHINGLE, len(codes))
    out = np.full(len(codes) - size + 1, np.uint64(size))
    for k in range(size):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + codes[k : len(codes) - size + 1 + k])
    return np.unique(out)


def sketch(found: np.ndarray, dealt: bool) -> np.ndarray:
    if not dealt:
        return registers(mixed(found[None, :] ^ STEPS[:, None]).min(1))
    bucket = (found * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(61)
    order = np.argsort(bucket, kind="stable")
    full, start = np.unique(bucket[order], return_index=True)
    least = np.minimum.reduceat(mixed(found[order][None, :] ^ STEPS[:SEEDS, None]), start, axis=1)
    # An empty bucket borrows from the next full one.
    source = np.searchsorted(full, np.arange(BUCKETS)) % len(full)
    return registers(least[:, source]).ravel()


def sketches(documents: DataFrame, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit digest of the set, and one or two sketches with their kind."""

    # A smaller set is not alike to one of more than SMALL.
    both = SMALL * percent // 100

    def work(batches):
        memo = WordHashes()
        for batch in batches:
            out = []
            for doc, text in rows([batch], "doc_id", "text"):
                found = shingles(text or "", memo)
                n = len(found)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if n else None
                kinds = [k for k, fits in ((0, n <= SMALL), (1, n >= both)) if fits and n]
                out.append((doc, n, digest, [{"kind": k, "registers": sketch(found, bool(k)).tobytes()} for k in kinds]))
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("registers", pa.binary())]))
            names = ["doc_id", "n_shingles", "digest", "sketches"]
            kinds = [pa.int64(), pa.int64(), pa.binary(), kind]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    schema = "doc_id long, n_shingles long, digest binary, sketches array<struct<kind:int,registers:binary>>"
    return documents.mapInArrow(work, schema)


def band_keys(sets: DataFrame) -> DataFrame:
    """One row per band of each sketch: its key, and the document."""

    def work(batches):
        for batch in batches:
            keys, docs, kinds = [], [], []
            for doc, found in rows([batch], "doc_id", "sketches"):
                for one in found:
                    values = np.frombuffer(one["registers"], np.uint16).astype(np.uint64)[BANDS]
                    key = np.arange(len(BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(one["kind"])
                    for k in range(values.shape[1]):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
                    keys.append(key)
                    docs.append(np.full(len(BANDS), doc))
                    kinds.append(np.full(len(BANDS), one["kind"], np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [column(np.concatenate(keys), pa.int64()), column(np.concatenate(docs), pa.int64()),
                     column(np.concatenate(kinds), pa.int32())],
                    ["key", "doc_id", "kind"],
                )

    return sets.mapInArrow(work, "key long, doc_id long, kind int")


def in_blocks(members: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """Members of a group dealt into blocks of bounded size: a row for each pair of blocks they belong to.

    Adds ``pair`` (a number of the pair of blocks), ``side`` (0 or 1, or 0 when both are one block).
    Only groups larger than a block have more than one, and their members are repeated once per block.
    """
    sums = [F.ceil(F.count("*") / BLOCK)]
    if weight:
        sums.append(F.ceil(F.sum(weight) / BLOCK_SHINGLES))
    sizes = members.groupBy(group).agg((F.greatest(*sums) if weight else sums[0]).cast("int").alias("_n"), F.count("*").alias("_m"))
    own = F.pmod(F.hash("doc_id"), F.col("_n"))
    dealt = members.join(sizes.where("_m > 1").drop("_m"), group).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select(
        *members.columns,
        (low.cast("long") * F.col("_n") + high).alias("pair"),
        (F.col("own") != low).cast("int").alias("side"),
    )


def spanning(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs of numbers, those that connect what the pairs before left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def candidate_links(blocks: DataFrame, share: float) -> DataFrame:
    """Links that span the documents of each pair of blocks whose estimated similarity may reach ``share``."""
    least = lowest_estimate(share)

    def work(batches):
        for batch in batches:
            a, b = [], []
            for members in (r[0] for r in rows([batch], "members")):
                docs = sorted({(m["doc_id"], m["registers"], m["side"]) for m in members})
                values = np.frombuffer(b"".join(d[1] for d in docs), np.uint16).reshape(len(docs), -1)
                sides = np.array([d[2] for d in docs])
                two = sides.any()
                found = []
                for i in range(len(docs) - 1):
                    equal = (values[i + 1 :] == values[i]).mean(1)
                    near = (equal - COLLISION) / (1 - COLLISION) >= least
                    if two:
                        near &= sides[i + 1 :] != sides[i]
                    found.append(np.column_stack([np.full(near.sum(), i), i + 1 + np.flatnonzero(near)]))
                for x, y in spanning(np.concatenate(found)) if found else ():
                    a.append(docs[x][0])
                    b.append(docs[y][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocks.mapInArrow(work, "a long, b long")


def family_sets(texts: DataFrame) -> DataFrame:
    """Full shingle sets of the documents of families, one row for each pair of blocks."""

    def work(batches):
        memo = WordHashes()
        for batch in batches:
            for doc, text, places in rows([batch], "doc_id", "text", "places"):
                found = shingles(text, memo).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([p[c] for p in places], k) for c, k in
                       (("family", pa.int64()), ("pair", pa.int64()), ("side", pa.int32()))),
                     pa.array([doc] * len(places), pa.int64()), pa.array([found] * len(places), pa.binary())],
                    ["family", "pair", "side", "doc_id", "found"],
                )

    return texts.mapInArrow(work, "family long, pair long, side int, doc_id long, found binary")


def alike(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets (of the two sides, if there are two) with 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets])
    if len(sets) <= 4:
        common = np.zeros((len(sets), len(sets)))
        for i, j in combinations(range(len(sets)), 2):
            common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(where, kind="stable")
        owner, where = owner[order], where[order]
        common = np.zeros((len(sets), len(sets)))
        for start in range(0, len(values), 8192):
            a, b = np.searchsorted(where, [start, start + 8192])
            held = np.zeros((len(sets), min(8192, len(values) - start)), np.float32)
            held[owner[a:b], where[a:b] - start] = 1
            common += held @ held.T
    union = size[:, None] + size[None, :] - common
    good = np.triu(100 * common >= percent * union, 1)
    if sides.any():
        good &= sides[:, None] != sides[None, :]
    return np.argwhere(good)


def confirmed_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links confirmed on full sets that span what is connected within each pair of blocks."""

    def work(batches):
        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                members = batch.column(batch.schema.get_field_index("members")).slice(row, 1).to_pylist()[0]
                sets = [np.frombuffer(m["found"], np.uint64) for m in members]
                sides = np.array([m["side"] for m in members])
                for x, y in spanning(alike(sets, sides, percent)):
                    a.append(members[x]["doc_id"])
                    b.append(members[y]["doc_id"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocks.mapInArrow(work, "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """Groups of documents whose five-word shingle sets are alike: 100 * intersection >= percent * union.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (smallest document that links lead to, itself
    included) and ``kept`` (it is that document). Words are runs of characters other than ASCII white
    space, A to Z lower-cased. A text of fewer words is one shingle; a null text or one without words has
    no shingles and no links. Equal sets are one class, whatever their number; links are searched between
    classes. Rows that share a ``doc_id`` are answered each, by their own texts; where the id stands for
    its class, links of either text count. A row with a null ``doc_id`` links with nothing unless others hold
    the same set, and is kept as no one. Other columns are ignored.
    """
    share = percent / 100
    share = percent / 100
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = write_table(sketches(texts, percent), "sketches")
    usable = made.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = write_table(classes, "classes")
    mine = (usable.digest == classes.digest) & (usable.doc_id == classes.class_id)
    sets = write_table(usable.join(classes, mine, "left_semi").dropDuplicates(["doc_id", "digest"]), "sets")

    # Buckets of several classes, each list of members once, with the registers of its members.
    keys = write_table(band_keys(sets), "bands")
    many = keys.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    many = write_table(many, "shared-bands")
    bucketed = in_blocks(write_table(keys.join(many, "key").distinct(), "buckets"), "key")
    lists = bucketed.groupBy("key", "pair").agg(
        F.sort_array(F.collect_set(F.struct("doc_id", "kind", "side"))).alias("members")
    )
    lists = lists.select("members").distinct().select(F.xxhash64("members").alias("block"), F.explode("members").alias("m"))
    each = sets.select("doc_id", F.explode("sketches").alias("s")).select("doc_id", "s.kind", "s.registers")
    blocks = lists.select("block", "m.*").join(each, ["doc_id", "kind"]).groupBy("block").agg(
        F.collect_list(F.struct("doc_id", "side", "registers")).alias("members")
    )
    family = components(write_table(candidate_links(blocks, share).distinct(), "candidates"))

    # Full sets of each family, in pairs of blocks.
    family = family.select(F.col("node").alias("doc_id"), F.col("component_id").alias("family"))
    sized = sets.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    places = in_blocks(write_table(family.join(sized, "doc_id"), "families"), "family", "n")
    places = places.groupBy("doc_id").agg(F.collect_list(F.struct("family", "pair", "side")).alias("places"))
    places = write_table(places, "places")
    size = places.agg(F.coalesce(F.sum(F.size("places") * 24 + 40), F.lit(0))).first()[0]
    full = family_sets(join_texts(texts.where("text is not null"), places, size, "inner", ["doc_id"]))
    blocks = full.groupBy("family", "pair").agg(F.collect_set(F.struct("doc_id", "side", "found")).alias("members"))
    linked = components(confirmed_links(blocks, percent))

    copies = classes.where("copies > 1").select("digest", "class_id")
    out = made.join(copies, "digest", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component_id", "class_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
