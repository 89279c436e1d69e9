"""Merkle manifest of a table, stored as van Emde Boas blocks.

Leaves of a group ascend by key. Every 2^height consecutive nodes form an aligned block: a subtree that
is stored in one row, its nodes in van Emde Boas order (the upper half of the levels first, then the
lower subtrees, each laid out the same way). The roots of the blocks are the nodes of the next stage,
until one node per group remains; the roots of the groups form a last tree of the same kind. Where a
node stands in its block is arithmetic on depth and index, for construction and for siblings alike.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.operators.order import row_index
from premia.session import small_side, write_table

# Levels of a block above its lowest one.
HEIGHT = 8


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, concatenated; a null part counts as empty."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"), 256)


def record_digest(fields: list[Column]) -> Column:
    """Digest of a record: each value with its length in bytes before it, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    sized = (F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts)
    return digest(*(F.coalesce(s, F.lit("-")) for s in sized))


def address(levels: int, depth: int, index):
    """Position of node ``index`` of a depth (0: root) in a tree of so many levels; ``index`` may be an array."""
    at = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = depth - top
        tree = index >> below
        at = at + (1 << top) - 1 + tree * ((1 << (levels - top)) - 1)
        index, levels, depth = index & ((1 << below) - 1), levels - top, below
    return at


def laid_out(nodes: list[str], height: int) -> bytes:
    """The block above up to 2^height digests; nodes that do not exist are zero."""
    block = np.zeros(((2 << height) - 1, 32), np.uint8)
    for depth in range(height, -1, -1):
        data = np.frombuffer(bytes.fromhex("".join(nodes)), np.uint8).reshape(-1, 32)
        block[address(height + 1, depth, np.arange(len(nodes)))] = data
        pairs = ("".join(nodes[k : k + 2]) for k in range(0, len(nodes), 2))
        nodes = [hashlib.sha256(p.encode()).hexdigest() for p in pairs] if depth else nodes
    return block.tobytes()


def siblings_in(block: bytes, height: int, count: int) -> list[list[str | None]]:
    """For each of the ``count`` lowest nodes its siblings from below, null where it has none."""
    text, index = block.hex(), np.arange(count)
    rows = []
    for level in range(height):
        other, there = (index >> level) ^ 1, -(-count // (1 << level))
        at = address(height + 1, height - level, other) * 64
        rows.append([text[a : a + 64] if o < there else None for a, o in zip(at.tolist(), other.tolist(), strict=True)])
    return [list(r) for r in zip(*rows, strict=True)] if rows else [[] for _ in range(count)]


def folded(leaf: Column, siblings: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    start = F.struct(leaf.alias("digest"), path.cast("long").alias("turns"))

    def up(state: Column, other: Column) -> Column:
        own, right = state["digest"], state["turns"].bitwiseAND(F.lit(1)) == 1
        both = F.when(right, F.concat(F.coalesce(other, F.lit("")), own)).otherwise(F.concat(own, F.coalesce(other, F.lit(""))))
        return F.struct(digest(both).alias("digest"), F.shiftright(state["turns"], 1).alias("turns"))

    return F.aggregate(siblings, start, up, lambda state: state["digest"])


@dataclass(frozen=True)
class Manifest:
    """``blocks`` of the stages of the groups and of ``tops``, the tree above them, lowest first.

    A block has ``part`` (the group, with a sign before its name; empty if null), ``block``, ``levels``
    above its lowest nodes, ``nodes``, and ``members``, what stands below each of its lowest nodes.
    """

    blocks: list[DataFrame]
    tops: list[DataFrame]
    height: int
    names: tuple[str, ...]

    def proofs(self) -> DataFrame:
        """One row per leaf: key, kept columns, ``leaf``, ``subroot``, ``root``, ``siblings``, ``path``.

        ``siblings`` go from the leaf up to the root, null where a node is alone. Bit k of ``path`` tells
        whether the node on level k is the right one of its two. The blocks above are unfolded first and
        joined with those below them, block by block; the rows themselves are not shuffled again.
        """
        above = self.tops[-1].select(
            "part",
            "block",
            _root_of("nodes").alias("root"),
            F.lit(None).cast("string").alias("subroot"),
            F.array().cast("array<string>").alias("siblings"),
            F.lit(0).cast("long").alias("path"),
        )
        for stage in reversed(self.tops):
            above = self._below(stage, above)
        above = above.select(
            F.col("name").alias("part"), F.lit(0).cast("long").alias("block"), "root",
            F.col("digest").alias("subroot"), "siblings", "path",
        )
        for stage in reversed(self.blocks):
            above = self._below(stage, above)
        own = [F.col(f"kept{k}").alias(name) for k, name in enumerate(self.names)]
        return above.select(*own, F.col("digest").alias("leaf"), "subroot", "root", "siblings", "path")

    def _below(self, stage: DataFrame, above: DataFrame) -> DataFrame:
        """What stands below the blocks of a stage, with siblings and path up to the root."""
        joined = stage.join(above.select("part", "block", "root", "subroot", "siblings", "path"), ["part", "block"])
        below = [f for f in joined.schema["members"].dataType.elementType.fields if f.name != "_pos"]
        named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in below)
        schema = f"part string, block long, root string, subroot string, siblings array<string>, path long, {named}"
        shift = self.height

        def expand(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 8):
                    rows = batch.slice(start, 8)
                    read = ("block", "levels", "nodes", "siblings", "path")
                    values = list(zip(*(rows.column(n).to_pylist() for n in read), strict=True))
                    fields = rows.column("members").flatten()
                    counts = rows.column("members").value_lengths().to_numpy()
                    parent = pa.array(np.repeat(np.arange(rows.num_rows), counts))
                    siblings, paths, places = [], [], []
                    for (number, levels, nodes, upper, turns), n in zip(values, counts.tolist(), strict=True):
                        siblings += [s + upper for s in siblings_in(nodes, levels, n)]
                        paths.append(np.arange(n) | (turns << levels))
                        places.append(np.arange(n) + (number << shift))
                    columns = {
                        "part": rows.column("part").take(parent),
                        "block": pa.array(np.concatenate(places), pa.int64()),
                        "root": rows.column("root").take(parent),
                        "subroot": rows.column("subroot").take(parent),
                        "siblings": pa.array(siblings, pa.list_(pa.string())),
                        "path": pa.array(np.concatenate(paths), pa.int64()),
                    }
                    names = [f.name for f in fields.type]
                    columns |= {f: fields.field(k) for k, f in enumerate(names) if f != "_pos"}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        inputs = ("part", "block", "levels", "nodes", "root", "subroot", "siblings", "path", "members")
        return joined.select(*inputs).mapInArrow(expand, schema)


def _root_of(nodes: str) -> Column:
    return F.lower(F.hex(F.substring(nodes, 1, 32)))


def _stages(nodes: DataFrame, most: int, height: int, name: str) -> list[DataFrame]:
    """Written blocks of every stage over ``part``, ``n``, ``_pos``, ``digest`` and what goes with them.

    ``most`` is the largest ``n``, the nodes of one part.
    """
    stages = []
    while True:
        more = [c for c in nodes.columns if c not in ("part", "n")]
        gathered = nodes.groupBy("part", "n", F.shiftright("_pos", height).alias("block")).agg(
            # At most 2^height members: a block is bounded, however large its part.
            F.sort_array(F.collect_list(F.struct("_pos", *[c for c in more if c != "_pos"]))).alias("members")
        )
        kind = gathered.schema["members"].dataType.simpleString()

        def build(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 8):
                    rows = batch.slice(start, 8)
                    digests = rows.column("members").flatten().field("digest").to_pylist()
                    counts = rows.column("members").value_lengths().to_pylist()
                    levels, made, at = [], [], 0
                    for n, count in zip(rows.column("n").to_pylist(), counts, strict=True):
                        levels.append(min(height, (n - 1).bit_length()))
                        made.append(laid_out(digests[at : at + count], levels[-1]))
                        at += count
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(rows.column(c) for c in ("part", "n", "block", "members")),
                            pa.array(levels, pa.int32()),
                            pa.array(made, pa.binary()),
                        ],
                        ["part", "n", "block", "members", "levels", "nodes"],
                    )

        schema = f"part string, n long, block long, members {kind}, levels int, nodes binary"
        stages.append(write_table(gathered.select("part", "n", "block", "members").mapInArrow(build, schema), name))
        if most <= 1 << height:
            return stages
        most = -(-most >> height)
        nodes = stages[-1].select(
            "part",
            F.ceil(F.col("n") / (1 << height)).cast("long").alias("n"),
            F.col("block").alias("_pos"),
            _root_of("nodes").alias("digest"),
        )


def build_manifest(
    leaves: DataFrame, group: str = "lang", key: str = "doc_id", leaf: str = "leaf", keep=(), height: int = HEIGHT
) -> Manifest:
    """Manifest of rows with a ``leaf`` digest; ``keep`` names columns that proofs give back.

    Leaves of a group ascend by ``key``, a null one first, equal keys by digest; rows that repeat both are
    leaves of their own, side by side; a null leaf
    counts as the digest of nothing. Groups ascend bytewise as UTF-8, the null group first and apart
    from an empty name. While several nodes remain, every two consecutive ones become their digest, a last
    one alone too. One leaf is its own root. Without rows there are no blocks and no root. Columns that are
    not named are not read, whatever they are called. Any group may hold most of the rows: positions come
    from a range partitioning, and blocks hold 2^height rows at most.
    """
    names = (key, *keep)
    if taken := {"leaf", "subroot", "root", "siblings", "path"} & set(names):
        raise ValueError(f"rename {sorted(taken)}: proofs have columns of these names")
    part = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    own = leaves.select(
        part.alias("part"),
        F.coalesce(F.col(f"`{leaf}`"), digest(F.lit(""))).alias("digest"),
        *(F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(names)),
        # Rows that are alike in all else: apart, so that a range can end between them.
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = row_index(own, ["kept0", "digest", "_row"], ["part"], "_pos").drop("_row")
    sizes = write_table(placed.groupBy("part").agg(F.count("*").alias("n")), "merkle-sizes")
    found = sizes.agg(F.max("n").alias("most"), F.count("*").alias("parts")).first()
    nodes = placed.join(small_side(sizes, found["parts"]), "part")
    blocks = _stages(nodes, found["most"] or 1, height, "merkle")
    # A group whose stages end early goes through the later ones as a single node.
    subroots = blocks[-1].select(F.col("part").alias("name"), _root_of("nodes").alias("digest"))
    ranked = row_index(subroots, ["name"], name="_pos")
    over = ranked.select(F.lit("").alias("part"), F.lit(found["parts"]).cast("long").alias("n"), "_pos", "digest", "name")
    return Manifest(blocks, _stages(over, found["parts"], height, "merkle-top"), height, names)
