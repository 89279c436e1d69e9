"""Near-duplicate embeddings by NN-descent.

A graph of near neighbours starts from buckets of random hyperplanes and is refined round by round: the
neighbours of a node are compared with each other, and each keeps the nearest it has met. A list whose
last entry is still a link is saturated and may grow. When rounds bring no new connections, links are
counted exactly inside each connected group, in blocks, and the recall is audited on a sample against all.

A pair without common neighbours meets in the first tables only. Their number follows from the hyperplanes
that tell vectors of a label apart, so that a pair at the threshold is met with the same probability however
large the label is. The audit grows until it has seen enough links, and new tables are added until it passes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.llm.common import mixed, rows, write_table
from premia.llm.components import components

# Neighbours a node keeps, and how many when all of them are links; they say where to look next, not what is linked.
NEAREST, MOST = 6, 64
# Vectors a bucket of a random table should hold, least number of tables, and the probability with which a
# pair at the threshold shares a bucket of one of them.
BUCKET, TABLES, MET = 16, 6, 0.999
# Members compared with each other in one place.
TOGETHER = 64
# Vectors of a block when links are counted.
BLOCK = 256
# Vectors of the first audit and of the largest, and links an audit should see.
AUDITED, MOST_AUDITED, LINKS = 256, 1 << 15, 200
RECALL, ROUNDS, RESTARTS = 0.99, 8, 12


def unit(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All vectors, one row per ``vec_id``, and the classes of equal ones that can be linked."""
    vectors = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    one = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good &= F.exists("embedding", lambda x: x != 0)
    one = write_table(one.withColumn("usable", F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))), "vectors")
    classes = one.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = classes.withColumn("space", F.xxhash64("label", F.size("embedding")))
    return one, write_table(classes, "vector-classes")


def tables_for(bits: int, share: float) -> int:
    """Tables of ``bits`` random hyperplanes in which a pair of cosine ``share`` meets with probability MET."""
    together = (1 - math.acos(min(max(share, -1.0), 1.0)) / math.pi) ** bits
    return TABLES if together >= MET else max(TABLES, math.ceil(math.log(1 - MET) / math.log1p(-together)))


def hyperplane_buckets(classes: DataFrame, sizes: DataFrame, start: int, share: float) -> DataFrame:
    """``pivot`` and ``node``: buckets of the random tables of a start, large ones dealt into several."""

    def work(batches):
        for batch in batches:
            alike: dict[tuple, list] = {}
            for node, space, bits, vector in rows([batch], "node", "space", "bits", "embedding"):
                alike.setdefault((space, bits, len(vector)), []).append((node, vector))
            for (space, bits, dims), found in alike.items():
                vectors = unit([v for _, v in found])
                nodes = np.array([n for n, _ in found], np.int64)
                tables = tables_for(bits, share)
                for table in range(start * tables, (start + 1) * tables):
                    planes = np.random.default_rng([table, dims]).standard_normal((dims, max(bits, 1)))
                    signs = (vectors @ planes > 0) if bits else np.zeros((len(found), 1), bool)
                    code = np.full(len(found), np.uint64(space % 2**64) ^ np.uint64(table))
                    for column in signs.T:
                        code = mixed(code * np.uint64(2) + column.astype(np.uint64) + np.uint64(1))
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(nodes)], ["pivot", "node"])

    sized = classes.join(sizes, "space")
    found = write_table(sized.select("node", "space", "bits", "embedding").mapInArrow(work, "pivot long, node long"), "buckets")
    many = write_table(found.groupBy("pivot").count().where("count > 1"), "bucket-sizes")
    part = F.pmod(F.hash("node", "pivot"), F.ceil(F.col("count") / TOGETHER).cast("int"))
    return found.join(many, "pivot").select(F.xxhash64("pivot", part).alias("pivot"), "node", F.lit(True).alias("fresh"))


def compared(places: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Pairs ``a`` < ``b`` of the members of a pivot that are near for one of them, with their cosine.

    Of two members one at least must be fresh there. Each member reports its NEAREST and all its links.
    """
    vectors = classes.select("node", "embedding")
    groups = places.join(vectors, "node").groupBy("pivot").agg(
        F.collect_list(F.struct("node", "fresh", "embedding")).alias("members")
    )

    def work(batches):
        for batch in batches:
            a, b, c = [], [], []
            for (members,) in rows([batch], "members"):
                if len(members) < 2:
                    continue
                nodes = np.array([m["node"] for m in members])
                fresh = np.array([m["fresh"] for m in members])
                x = unit([m["embedding"] for m in members])
                near = x @ x.T
                near[~(fresh[:, None] | fresh[None, :])] = -2
                near[nodes[:, None] == nodes[None, :]] = -2
                last = np.sort(near, axis=1)[:, -min(NEAREST, len(nodes) - 1)]
                take = (near > -2) & ((near >= last[:, None]) | (near >= last[None, :]))
                take |= near >= share
                i, j = np.nonzero(np.triu(take, 1))
                a.append(np.minimum(nodes[i], nodes[j]))
                b.append(np.maximum(nodes[i], nodes[j]))
                c.append(near[i, j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, c)], ["a", "b", "cosine"])

    return groups.mapInArrow(work, "a long, b long, cosine double")


def kept_lists(edges: DataFrame, share: float) -> DataFrame:
    """Of all pairs met, those that are among the nearest of one of the two; saturated lists may be longer."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", "round"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    near = both.withColumn("rank", rank).where((F.col("rank") <= NEAREST) | ((F.col("rank") <= MOST) & (F.col("cosine") >= share)))
    return near.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.first("cosine").alias("cosine"), F.min("round").alias("round")
    ).select(F.col("x").alias("a"), F.col("y").alias("b"), "cosine", "round")


def neighbourhoods(edges: DataFrame, newest: int) -> DataFrame:
    """``pivot`` and ``node``: for each node with a new neighbour, its neighbours either way, at most TOGETHER."""
    fresh = F.col("round") == newest
    both = edges.select(F.col("a").alias("pivot"), F.col("b").alias("node"), fresh.alias("fresh"))
    both = both.union(edges.select(F.col("b").alias("pivot"), F.col("a").alias("node"), fresh.alias("fresh")))
    order = Window.partitionBy("pivot").orderBy(F.desc("fresh"), F.xxhash64("node", "pivot", F.lit(newest)))
    ranked = both.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("any", F.max("fresh").over(Window.partitionBy("pivot"))).where(
        (F.col("rank") <= TOGETHER) & F.col("any")
    ).select("pivot", "node", "fresh")


def counted_links(classes: DataFrame, groups: DataFrame, share: float) -> DataFrame:
    """``node``, ``n_links`` to vectors of other classes, and how links connect: exact, within each group."""
    sizes = groups.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    dealt = groups.join(write_table(sizes, "group-sizes"), "component_id").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        "node", "component_id", (low.cast("long") * F.col("blocks") + high).alias("pair"), (F.col("own") != low).alias("side")
    )
    member = F.struct("node", "side", "copies", "embedding")
    pairs = dealt.join(classes.select("node", "copies", "embedding"), "node").groupBy("component_id", "pair").agg(
        F.collect_list(member).alias("members")
    )

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (members,) = batch.column(batch.schema.get_field_index("members")).slice(row, 1).to_pylist()
                nodes = np.array([m["node"] for m in members])
                side = np.array([m["side"] for m in members])
                copies = np.array([m["copies"] for m in members])
                x = unit([m["embedding"] for m in members])
                link = x @ x.T >= share
                np.fill_diagonal(link, False)
                if side.any():
                    link &= side[:, None] != side[None, :]
                nearest = np.where(link, nodes[None, :], nodes[:, None]).min(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(link @ copies), pa.array(nearest)], ["node", "n_links", "smallest"]
                )

    return pairs.mapInArrow(work, "node long, n_links long, smallest long")


def audited(classes: DataFrame, found: DataFrame, share: float, most: int) -> tuple[int, int, int]:
    """Of a sample of at most ``most`` vectors, compared with all others: how many, their links, and those found."""
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(most).select("node", "space", "embedding").collect()
    spaces: dict[int, tuple] = {}
    for space in {r["space"] for r in sample}:
        own = [r for r in sample if r["space"] == space]
        spaces[space] = (np.array([r["node"] for r in own], np.int64), unit([r["embedding"] for r in own]))
    sent = classes.sparkSession.sparkContext.broadcast(spaces)

    def work(batches):
        true = {space: np.zeros(len(nodes), np.int64) for space, (nodes, _) in sent.value.items()}
        for batch in batches:
            by_space: dict[int, list] = {}
            for row in rows([batch], "node", "space", "copies", "embedding"):
                if row[1] in true:
                    by_space.setdefault(row[1], []).append(row)
            for space, others in by_space.items():
                nodes, x = sent.value[space]
                y = unit([o[3] for o in others])
                for k in range(0, len(others), BLOCK):
                    part = others[k : k + BLOCK]
                    link = x @ y[k : k + BLOCK].T >= share
                    link &= nodes[:, None] != np.array([o[0] for o in part])[None, :]
                    true[space] += link @ np.array([o[2] for o in part])
        for space, links in true.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[space][0]), pa.array(links)], ["node", "links"])

    true = classes.mapInArrow(work, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    both = true.join(found.select("node", "n_links"), "node", "left")
    links, met = both.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("n_links"), F.lit(0))).first()
    return len(sample), links, met


def audit(classes: DataFrame, found: DataFrame, share: float) -> float:
    """Share of the links of a bounded sample of vectors, compared with all others, that were found."""
    _, links, met = audited(classes, found, share, AUDITED)
    return met / links if links else 1.0


def passes(classes: DataFrame, found: DataFrame, share: float, start: int) -> bool:
    """Whether enough links were found, by an audit that grows until it has seen enough of them.

    An audit that covers all vectors settles the matter. One that is as large as it may get and has still
    seen few links passes only after a second set of tables, when a pair at the threshold is missed with
    probability (1 - MET) squared.
    """
    most = AUDITED
    while True:
        sample, links, met = audited(classes, found, share, most)
        if met < RECALL * links:
            return False
        if links >= LINKS or sample < most:
            return True
        if most >= MOST_AUDITED:
            return start > 0
        most = min(4 * most, MOST_AUDITED)


def near_vectors(embeddings: DataFrame, share: float = 0.93) -> DataFrame:
    """Links between vectors of equal label whose cosine, in double precision, is at least ``share``.

    Returns ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest ``vec_id``
    that links lead to, itself included) and ``kept`` (it is that vector). Vectors with a null label, that
    are null, empty, zero or hold null or non-finite components link with nothing, vectors of different
    length neither. Equal vectors are one class and are not expanded into pairs. Rows that share a
    ``vec_id`` count once, with the smallest label and vector; rows with a null id give one row without
    links. Other columns are ignored; an empty table gives an empty result. A result whose audit stays below
    RECALL after RESTARTS sets of tables is an error, not an answer.
    """
    vectors, classes = classes_of(embeddings)
    sizes = classes.groupBy("space").agg(F.greatest(F.ceil(F.log2(F.count("*") / BUCKET)), F.lit(0)).cast("int").alias("bits"))
    sizes = write_table(sizes, "spaces")
    edges, groups, newest = None, None, 0
    for start in range(RESTARTS):
        met = compared(hyperplane_buckets(classes, sizes, start, share), classes, share)
        state = None
        for _ in range(ROUNDS):
            newest += 1
            met = met.withColumn("round", F.lit(newest))
            every = met if edges is None else edges.union(met)
            every = every.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.min("round").alias("round"))
            every = write_table(every, "met")
            edges = write_table(kept_lists(every, share), "edges")
            # Every link met counts, whether a list keeps it or not; those met before are in the groups.
            linked = every.where(F.col("cosine") >= share).select("a", "b")
            if groups is not None:
                linked = linked.union(groups.select("node", "component_id"))
            groups = write_table(components(linked), "groups")
            new = groups.agg(F.count("*"), F.countDistinct("component_id")).first()
            if new == state:
                break
            state = new
            met = compared(neighbourhoods(edges, newest), classes, share)
        counts = counted_links(classes, groups, share).groupBy("node").agg(F.sum("n_links").alias("n_links"))
        counts = write_table(counts, "link-counts")
        if passes(classes, counts, share, start):
            break
    else:
        raise RuntimeError(f"recall stayed below {RECALL} after {RESTARTS} sets of tables")
    of_class = classes.join(counts, "node", "left").join(groups, "node", "left").select(
        F.col("label").alias("of_label"), F.col("embedding").alias("of_embedding"), "node",
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "node").alias("component_id"),
    )
    mine = F.col("usable") & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_embedding"))
    out = vectors.join(of_class, mine, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )
