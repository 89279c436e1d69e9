"""Gradient boosted trees with pluggable losses, grown for all models at once.

The rows of all models (insurers, folds) lie in files, written once: target, weight and, feature by feature,
bins as bytes. Models that differ only in which rows they train on share them. Each round a model whose rows
one task can go through has its tree grown by that task; the trees of larger models are grown level by level,
all of them in one pass: tasks sum gradients by node, feature and bin, the sums of a node meet where its best
split is found, the driver receives one split per node. How many jobs a round has depends on the depth, not
on the number of models or rows. Trees are appended to a store every few rounds, so a fit that was stopped
goes on from there, and scoring reads the trees where it runs.
"""

from __future__ import annotations

import hashlib
import json
import math
import pickle
import uuid
from dataclasses import asdict, dataclass, field, replace
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from premia.operators.bins import Binning, fit_bins, number
from premia.operators.trees import BINS, NODE, Forest, best_splits, crossing, leaf, shrunk
from premia.session import scratch_path

OBJECTIVES = ("squared", "absolute", "huber", "tweedie")


@dataclass(frozen=True)
class BoostParams:
    objective: str = "squared"
    rounds: int = 20
    learning_rate: float = 0.2
    max_depth: int = 5
    min_leaf: int = 20
    max_bins: int = 64
    row_share: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    huber_delta: float = 15.0
    tweedie_power: float = 1.5
    early_stop: int = 0
    seed: int = 42
    log_target: bool = False
    # Whether categories are split by sets of them, not by a threshold on their codes.
    nominal: bool = False
    # Shares of the features that a tree, and each level of it, may split on.
    tree_share: float = 1.0
    level_share: float = 1.0
    # Rounds between written score tables, from which a fit can go on.
    write_every: int = 4

    def __post_init__(self):
        if self.objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.objective!r}, expected one of {OBJECTIVES}")


# Hyperparameters of the model presets.
PRESETS = {
    "mae": BoostParams("absolute", 5000, 0.05, 7, 1, 254, l2=5, early_stop=200, nominal=True),
    "rmse": BoostParams("squared", 10000, 0.05, 6, 50, 254, l2=10, early_stop=300, nominal=True),
    "huber": BoostParams(
        "huber", 10000, 0.05, 8, 30, 63, 0.9, l1=0.5, l2=3, early_stop=300, tree_share=0.8
    ),
    "l1_quick": BoostParams("absolute", 100, 0.05, 5, 20, 255),
    "tweedie_a": BoostParams(
        "tweedie", 8000, 0.05, 8, 25, 255, 0.85, l1=0.8, l2=4, early_stop=300, tree_share=0.7
    ),
    "tweedie_b": BoostParams(
        "tweedie", 8000, 0.05, 8, 20, 256, 0.85, l1=0.8, l2=4, early_stop=300, tree_share=0.7, level_share=0.8
    ),
    "tweedie_bagged": BoostParams("tweedie", 8000, 0.03, 8, 20, 254, l2=4, early_stop=300),
    "mae_fold": BoostParams("absolute", 6000, 0.05, 8, 25, 254, l2=5, early_stop=250, nominal=True),
    "insample_a": BoostParams("tweedie", 3000, 0.05, 8, 25, 255, 0.85, l1=0.8, l2=4, tree_share=0.7),
    "insample_b": BoostParams("tweedie", 3000, 0.05, 8, 20, 256, 0.85, l1=0.8, l2=4, tree_share=0.7),
    "scout": BoostParams("absolute", 1200, 0.1, 6, 1, 254, l2=3, early_stop=100, nominal=True),
}


def preset(name: str, **changes) -> BoostParams:
    """A preset, with settings such as the number of rounds changed for the data at hand."""
    return replace(PRESETS[name], **changes)


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model; its trees lie in a store and are read where they are applied."""

    binning: Binning
    params: BoostParams
    start: float
    store: str
    name: str
    importances: tuple[float, ...]
    best_iteration: int
    history: tuple[dict, ...] = field(default=())

    @property
    def features(self) -> tuple[str, ...]:
        return self.binning.features

    def transform(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return df.withColumn(name, score_models({name: self})[name])


def to_price(raw: Column, params: BoostParams) -> Column:
    value = F.exp(raw) if params.objective == "tweedie" else raw
    return F.expm1(value) if params.log_target else value


# --- losses on arrays -----------------------------------------------------------------


def gradients(params: BoostParams, f: np.ndarray, y: np.ndarray):
    """Gradient, curvature and loss at score ``f`` and target ``y``."""
    residual, one = f - y, np.ones(len(f))
    if params.objective == "squared":
        return residual, one, residual * residual / 2
    if params.objective == "absolute":
        return np.sign(residual), one, np.abs(residual)
    if params.objective == "huber":
        d, size = params.huber_delta, np.abs(residual)
        return np.clip(residual, -d, d), one, np.where(size <= d, residual * residual / 2, d * (size - d / 2))
    p = params.tweedie_power
    low, high = np.exp((1 - p) * f), np.exp((2 - p) * f)
    return high - y * low, (2 - p) * high - (1 - p) * y * low, high / (2 - p) - y * low / (1 - p)


def prices(params: BoostParams, raw: np.ndarray) -> np.ndarray:
    value = np.exp(raw) if params.objective == "tweedie" else raw
    return np.expm1(value) if params.log_target else value


def leaf_value(g: float, h: float, params: BoostParams) -> float:
    return float(-shrunk(g, params.l1) / (h + params.l2)) if h + params.l2 > 0 else 0.0


def in_bag(hashes: np.ndarray, params: BoostParams, round_: int) -> np.ndarray:
    """Row sample of a round by hash of the key: the same after a lost executor."""
    if params.row_share >= 1:
        return np.ones(len(hashes), bool)
    x = hashes.view(np.uint64) ^ np.uint64(int(hashlib.sha256(f"{params.seed}:{round_}".encode()).hexdigest()[:16], 16))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) < params.row_share * 2.0**53


def drawn(features, share: float, *salt) -> list[int]:
    """Places of a share of the features, one at least, drawn by hash."""
    n = max(1, math.ceil(share * len(features) - 1e-9))
    ranked = sorted(features, key=lambda k: hashlib.sha256(f"{salt}:{k}".encode()).digest())
    return sorted(ranked[:n])


# --- rows as files --------------------------------------------------------------------

# Rows of a file, rows a task holds before it writes files, rows of a model that one task goes through.
BLOCK_ROWS, WAITING_ROWS, PIECE_ROWS = 131_072, 524_288, 2_500_000
# Bytes of bins that a task keeps from level to level; others are read again.
KEPT_BINS = 64 << 20
# What a row is to a model: none of its rows, one to train on, one held out.
ABSENT, TRAIN, HELD = 0, 1, 2


def located(path: str):
    """File system and path within it, for files that tasks write and read themselves."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file" and rest.startswith("//"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def write_block(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays, each line of a matrix compressed for itself, under a name of its own; returns the path.

    An attempt of a task that was lost leaves a file that nobody names.
    """
    head, cells = {}, []
    for name, a in arrays.items():
        lines = [pa.compress(pa.py_buffer(np.ascontiguousarray(x)), codec="zstd", asbytes=True) for x in a.reshape(-1, a.shape[-1])]
        head[name] = (a.dtype.str, a.shape[-1], [len(c) for c in lines])
        cells += lines
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    name, said = uuid.uuid4().hex, json.dumps(head).encode()
    with system.open_output_stream(f"{path}/{name}") as out:
        for c in (len(said).to_bytes(8, "little"), said, *cells):
            out.write(c)
    return f"{folder}/{name}"


class Block:
    """A file of arrays, held as it is written; lines are unpacked when asked for."""

    def __init__(self, path: str):
        system, place = located(path)
        with system.open_input_file(place) as file:
            self.data = memoryview(file.read())
        end = 8 + int.from_bytes(self.data[:8], "little")
        self.at = {}
        for name, (kind, n, sizes) in json.loads(bytes(self.data[8:end])).items():
            self.at[name] = (np.dtype(kind), n, [(end + a, end + b) for a, b in pairwise([0, *np.cumsum(sizes).tolist()])])
            end += sum(sizes)

    def __contains__(self, name: str) -> bool:
        return name in self.at

    def line(self, name: str, k: int = 0) -> np.ndarray:
        kind, n, bounds = self.at[name]
        a, b = bounds[k]
        return np.frombuffer(pa.decompress(self.data[a:b], n * kind.itemsize, codec="zstd"), kind)


BLOCKS = "grp int, place long, path string, n long, trained array<long>, held array<long>, w array<double>, wy array<double>"


def write_blocks(rows: DataFrame, store: str, members: int, log_target: bool, hashes: bool):
    """Rows of each group as files of up to ``BLOCK_ROWS``; one record per file, with counts and sums of its members.

    ``rows`` has ``_m`` (group), ``_y``, ``_w``, ``_role`` (a byte per member), ``_h`` and ``_x``. Rows are not moved:
    a task writes what it reads.
    """

    def write(batches):
        waiting: dict[int, list] = {}
        counts: dict[int, int] = {}
        # Where files stand among all, the same in every run over the same partitions.
        places = count(TaskContext.get().partitionId() << 32)

        def flush(group):
            held, n = waiting.pop(group), counts.pop(group)
            role, y, w, h, x = (np.concatenate([b[k] for b in held]) for k in range(5))
            arrays = {"y": y, "role": np.ascontiguousarray(role.T), "x": np.ascontiguousarray(x.T)}
            if not (w == 1).all():
                arrays["w"] = w
            if hashes:
                arrays["h"] = h
            path = write_block(f"{store}/rows", arrays)
            trained = role == TRAIN
            sums = [trained.sum(0).tolist(), (role == HELD).sum(0).tolist(), (w @ trained).tolist(), ((w * y) @ trained).tolist()]
            cells = [pa.array([c], f.type) for c, f in zip([group, next(places), path, n, *sums], BLOCK_FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays(cells, schema=BLOCK_FIELDS)

        for batch in batches:
            if not batch.num_rows:
                continue
            m, y, w, h = (batch.column(c).to_numpy() for c in ("_m", "_y", "_w", "_h"))
            role, x = (bytes_of(batch.column(c)) for c in ("_role", "_x"))
            y = np.log1p(y) if log_target else y
            order = np.argsort(m, kind="stable")
            starts = np.flatnonzero(np.diff(m[order], prepend=-1))
            for a, b in pairwise([*starts.tolist(), len(m)]):
                own, group = order[a:b], int(m[order[a]])
                waiting.setdefault(group, []).append((role[own], y[own], w[own], h[own], x[own]))
                counts[group] = counts.get(group, 0) + b - a
                if counts[group] >= BLOCK_ROWS:
                    yield flush(group)
            while sum(counts.values()) > WAITING_ROWS:
                yield flush(max(counts, key=counts.get))
        for group in sorted(counts):
            yield flush(group)

    return rows.select("_m", "_y", "_w", "_role", "_h", "_x").mapInArrow(write, BLOCKS).collect()


LONGS, DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
BLOCK_FIELDS = pa.schema(
    [("grp", pa.int32()), ("place", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("trained", LONGS), ("held", LONGS), ("w", DOUBLES), ("wy", DOUBLES)]
)


def bytes_of(column: pa.Array) -> np.ndarray:
    """Binary values of equal length as a matrix."""
    wide = 4 if pa.types.is_binary(column.type) else 8
    offsets = np.frombuffer(column.buffers()[1], f"<i{wide}", len(column) + 1, column.offset * wide)
    data = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return data.reshape(len(column), -1)


@dataclass(frozen=True)
class Piece:
    """Rows of a model that one task goes through: files, and the one of their scores (none before the first tree)."""

    model: int
    member: int
    start: float
    blocks: tuple[str, ...]
    scores: str | None = None

    def parts(self, params: BoostParams, features=()) -> list[Part]:
        out, at, room = [], 0, KEPT_BINS
        f = Block(self.scores).line("f") if self.scores else None
        for path in self.blocks:
            part = Part(path, self.member, features, room)
            room -= part.kept
            n = len(part.y)
            part.f = np.full(n, self.start) if f is None else f[at : at + n]
            at += n
            if n:
                out.append(part)
        return out


class Part:
    """A model's rows of one file."""

    def __init__(self, path: str, member: int, features, room: int):
        self.block = Block(path)
        role = self.block.line("role", member)
        self.rows = None if role.all() else np.flatnonzero(role)
        self.role, self.y = self._own(role), self._own(self.block.line("y"))
        self.w = self._own(self.block.line("w")) if "w" in self.block else None
        self.train = self.role == TRAIN
        self.features, self.x = list(features), None
        size = len(self.y) * (max(self.features, default=-1) + 1)
        self.kept = size if size <= room else 0

    def _own(self, a: np.ndarray) -> np.ndarray:
        return a if self.rows is None else a[self.rows]

    def bins(self) -> np.ndarray:
        """Bins by feature; only lines of the features asked for are filled."""
        if self.x is not None:
            return self.x
        x = np.empty((max(self.features, default=0) + 1, len(self.y)), np.uint8)
        for k in self.features:
            x[k] = self._own(self.block.line("x", k))
        if self.kept:
            self.x = x
        return x

    def weights(self) -> np.ndarray:
        return np.ones(len(self.y)) if self.w is None else self.w

    def bag(self, params: BoostParams, round_: int) -> np.ndarray:
        """Places of the rows a round draws."""
        if params.row_share >= 1:
            return np.flatnonzero(self.train)
        return np.flatnonzero(self.train & in_bag(self._own(self.block.line("h")), params, round_))


# --- trees ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Setting:
    """What all tasks of a round are told."""

    params: BoostParams
    round: int
    # Bins of each feature, and which of them are categories.
    widths: tuple[int, ...]
    nominal: frozenset[int]
    # Features of this round's trees.
    own: tuple[int, ...]
    store: str

    def level(self, level: int, may) -> list[int]:
        """Features that a level may split on."""
        drawn_ = drawn(self.own, self.params.level_share, self.params.seed, self.round, level)
        return [k for k in drawn_ if may is None or may[k]]


def tallied(parts, slots: np.ndarray, nodes: int, features, setting: Setting) -> dict[int, np.ndarray]:
    """Counts and sums of gradient and curvature by open node and bin, per feature.

    Parts have ``chosen`` rows with their nodes ``at``, gradients ``g`` and curvatures ``h`` (none: all one).
    """
    widths = setting.widths
    out = {k: np.zeros((3, nodes * widths[k])) for k in features}
    unit = all(p.h is None for p in parts)
    for p in parts:
        slot = slots[p.at[p.chosen]]
        some = np.flatnonzero(slot >= 0)
        if not len(some) or not features:
            continue
        rows, slot = p.chosen[some], slot[some].astype(np.int64)
        g, h, x = p.g[rows], None if p.h is None else p.h[rows], p.bins()
        whole, bases, cell = len(rows) == len(p.y), {}, np.empty(len(rows), np.int64)
        for k in features:
            width = widths[k]
            if width not in bases:
                bases[width] = slot * width
            np.add(bases[width], x[k] if whole else x[k][rows], out=cell)
            size, mine = nodes * width, out[k]
            n = np.bincount(cell, minlength=size)
            mine[0] += n
            mine[1] += np.bincount(cell, g, size)
            if not unit:
                mine[2] += n if h is None else np.bincount(cell, h, size)
    for a in out.values():
        if unit:
            a[2] = a[0]
    return {k: a.reshape(3, nodes, widths[k]) for k, a in out.items()}


def best_of(tables: dict[int, np.ndarray], features, nodes: int, setting: Setting) -> list[dict]:
    """Best split of each node over the features; of equal gains the first feature wins."""
    params, best, gains = setting.params, [None] * nodes, np.full(nodes, -np.inf)
    for k in sorted(features):
        n, g, h = tables[k]
        gain, bins, masks, left, whole = best_splits(n, g, h, k in setting.nominal, params.min_leaf, params.l1, params.l2)
        for s in np.flatnonzero(gain > gains).tolist():
            best[s] = {
                "gain": float(gain[s]), "feature": k, "bin": int(bins[s]), "mask": masks[s].tobytes(),
                "nl": float(left[0][s]), "gl": float(left[1][s]), "hl": float(left[2][s]),
                "n": float(whole[0][s]), "g": float(whole[1][s]), "h": float(whole[2][s]),
            }
        gains = np.maximum(gains, gain)
    return best


def with_splits(tree: np.ndarray, nodes: list[int], best: list[dict | None], gains: np.ndarray, params: BoostParams):
    """The tree with the best splits of its open nodes, and per split the place among them, left and open children."""
    made = []
    for place, (node, r) in enumerate(zip(nodes, best, strict=True)):
        if r is None:
            continue
        tree[node]["value"] = leaf_value(r["g"], r["h"], params)
        if r["gain"] > 0:
            gains[r["feature"]] += r["gain"]
            tree, children = parted(tree, node, r, params)
            made.append((place, len(tree) - 2, r["nl"] * 2 <= r["n"], children))
    return tree, made


def grown_here(parts, setting: Setting, may) -> tuple[np.ndarray, np.ndarray]:
    """A tree over rows that one task goes through, and the gains of the features.

    Of two children only the smaller is summed; the other is the rest of their parent.
    """
    params, tree, gains = setting.params, leaf(), np.zeros(len(setting.widths))
    able = [k for k in setting.own if may is None or may[k]]
    nodes, tables = [0], tallied(parts, np.zeros(1, np.int64), 1, able, setting)
    for level in range(params.max_depth):
        best = best_of(tables, setting.level(level, may), len(nodes), setting)
        tree, made = with_splits(tree, nodes, best, gains, params)
        if not made:
            break
        forest = Forest([tree])
        for p in parts:
            p.at = forest.descend(p.at, p.bins().T)
        made = [s for s in made if s[3]]
        if not made or level + 1 == params.max_depth:
            break
        slots = np.full(len(tree), -1)
        small = [left if left_smaller else left + 1 for _, left, left_smaller, _ in made]
        slots[small] = np.arange(len(made))
        own, places = tallied(parts, slots, len(made), able, setting), [s[0] for s in made]
        keep, nodes = [], []
        for k, (_, left, left_smaller, children) in enumerate(made):
            for child in children:
                keep.append(k if (child == left) == left_smaller else len(made) + k)
                nodes.append(child)
        for k in able:
            rest = tables[k][:, places] - own[k]
            rest[1:, rest[0] == 0] = 0.0  # what rounding leaves of empty bins
            tables[k] = np.concatenate([own[k], rest], 1)[:, keep]
    return tree, gains


def medians_here(parts, params: BoostParams, l1: float, l2: float) -> dict[int, float]:
    """Per node the weighted median of the residuals of its chosen rows, as ``weighted_medians``."""
    cells = []
    for p in parts:
        w = p.weights()
        rows = p.chosen[w[p.chosen] > 0]
        cells.append((p.at[rows], p.y[rows] - p.f[rows], w[rows]))
    node, r, w = (np.concatenate(c) for c in zip(*cells, strict=True))
    if l1:
        zeros = np.unique(node)
        node, r, w = np.append(node, zeros), np.append(r, np.zeros(len(zeros))), np.append(w, np.full(len(zeros), l1))
    order = np.lexsort((r, node))
    node, r, w = node[order], r[order], w[order]
    out = {}
    for a, b in pairwise([*np.flatnonzero(np.diff(node, prepend=-1)).tolist(), len(node)]):
        total = w[a:b].sum()
        value, _ = crossing(r[a:b], r[a:b], w[a:b], 0.0, total, np.inf)
        out[int(node[a])] = stepped(value, total, l1, l2)
    return out


def stepped(median: float, total: float, l1: float, l2: float) -> float:
    """A median with the second penalty: shrunk by the share of the weight in weight and penalty."""
    own = total - l1
    return float(median * (own / (own + l2))) if own else 0.0


def aim(parts, setting: Setting, forest: Forest | None = None) -> None:
    """Give parts their drawn rows with node, gradient and curvature; with a forest the nodes rows come to."""
    params = setting.params
    for p in parts:
        p.chosen = p.bag(params, setting.round)
        g, h, _ = gradients(params, p.f, p.y)
        curved = params.objective == "tweedie"
        p.g = g if p.w is None else g * p.w
        p.h = (h if p.w is None else h * p.w) if curved or p.w is not None else None
        start = np.zeros(len(p.y), np.int64)
        p.at = start if forest is None else forest.descend(start, p.bins().T)


def score_sums(parts, params: BoostParams) -> list[float]:
    """Loss of the training rows and absolute error of the price of those held out, summed."""
    loss = error = 0.0
    for p in parts:
        loss += float((p.weights() * gradients(params, p.f, p.y)[2])[p.train].sum())
        gap = np.abs(prices(params, p.f) - (np.expm1(p.y) if params.log_target else p.y))
        error += float(gap[~p.train].sum())
    return [loss, error]


def moved(parts, tree: np.ndarray, setting: Setting) -> str:
    """Add a tree to the scores of rows that have come to its leaves, and write them."""
    for p in parts:
        p.f = p.f + setting.params.learning_rate * tree["value"][p.at]
    return write_block(f"{setting.store}/scores/{setting.round + 1:06d}", {"f": np.concatenate([p.f for p in parts])})


def start_here(piece: Piece, setting: Setting) -> float:
    """Weighted median of the targets of the training rows."""
    parts = piece.parts(setting.params)
    for p in parts:
        p.f, p.chosen, p.at = np.zeros(len(p.y)), np.flatnonzero(p.train), np.zeros(len(p.y), np.int64)
    return medians_here(parts, setting.params, 0.0, 0.0).get(0, 0.0)


def round_here(piece: Piece, setting: Setting, may) -> dict:
    """A round of a model whose rows one task goes through."""
    params = setting.params
    parts = piece.parts(params, [k for k in setting.own if may is None or may[k]])
    aim(parts, setting)
    tree, gains = grown_here(parts, setting, may)
    if params.objective == "absolute":
        steps = medians_here(parts, params, params.l1, params.l2)
        for node in np.flatnonzero(tree["feature"] < 0).tolist():
            tree[node]["value"] = steps.get(node, 0.0)
    path = moved(parts, tree, setting)
    return {"tree": tree.tobytes(), "gains": gains.tolist(), "path": path, "sums": score_sums(parts, params)}


def score_piece(piece: Piece, setting: Setting, tree: bytes | None) -> dict:
    """Scores of a piece after a tree, and what they lose."""
    nodes = None if tree is None else np.frombuffer(tree, NODE)
    used = () if nodes is None else sorted(set(nodes["feature"].tolist()) - {-1})
    parts, path = piece.parts(setting.params, used), None
    if nodes is not None:
        forest = Forest([nodes])
        for p in parts:
            p.at = forest.descend(np.zeros(len(p.y), np.int64), p.bins().T)
        path = moved(parts, nodes, setting)
    return {"path": path, "sums": score_sums(parts, setting.params)}


def each(spark: SparkSession, work, specs: list[tuple[Piece, object]]) -> list:
    """``work`` on every piece and what is told of it, each in a task of its own; results with their numbers."""
    if not specs:
        return []
    told = [(k, tuple(vars(piece).values()), more) for k, (piece, more) in enumerate(specs)]
    return spark.sparkContext.parallelize(told, len(told)).map(lambda s: (s[0], work(Piece(*s[1]), s[2]))).collect()


# --- trees over many tasks ------------------------------------------------------------

# Nodes whose sums meet in one piece; leaves whose medians do.
NODES_TOGETHER, LEAVES_TOGETHER = 8, 64
# Histograms of a node and feature that make a task worth starting.
HISTOGRAMS_PER_TASK = 1024
# Bins into which a pass parts the interval that holds a median.
MEDIAN_BINS = 1024
SUM = np.dtype([("at", "<i4"), ("n", "<u4"), ("g", "<f8"), ("h", "<f8")])
SPAN = np.dtype([("at", "<i4"), ("w", "<f8"), ("low", "<f8"), ("high", "<f8")])
PIECE = "kind int, part int, blob binary"


def dealt(spark: SparkSession, pieces: list[Piece]) -> DataFrame:
    """One row and one task for each of the pieces."""
    told = [(pickle.dumps(tuple(vars(p).values())),) for p in pieces]
    return spark.createDataFrame(spark.sparkContext.parallelize(told, len(told)), "piece binary")


def pieces_in(batches):
    for batch in batches:
        for told in batch.column(0).to_pylist():
            yield Piece(*pickle.loads(told))


def pieces_of(batch_rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, blob = zip(*batch_rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["kind", "part", "blob"])


def grouped_blobs(batches):
    """Blobs of equal kind and part, which arrive one after another."""
    at, blobs = None, []
    for batch in batches:
        for kind, part, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if at != (kind, part):
                if blobs:
                    yield *at, blobs
                at, blobs = (kind, part), []
            blobs.append(blob)
            if len(blobs) >= 64:
                blobs = [b"".join(blobs)]
    if blobs:
        yield *at, blobs


SPLIT = "model int, slot int, gain double, feature int, bin int, mask binary, nl double, gl double, hl double, n double, g double, h double"


def met(pieces: DataFrame, tasks: int) -> DataFrame:
    """Pieces of one kind and part side by side in a task."""
    most = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(max(1, min(most, tasks)), "kind", "part").sortWithinPartitions("kind", "part")


def level_splits(spark: SparkSession, pieces: list[Piece], growing, nodes, setting: Setting, level: int, allowed) -> list:
    """Best split of every open node (``nodes`` by model) of the growing trees of models with many pieces.

    Tasks sum gradients of a piece by node, feature and bin; the sums of a few nodes of a model meet in one
    task, which knows all features of these nodes.
    """
    place = {m: setting.level(level, allowed[m] if allowed is not None else None) for m in growing}

    def sums(batches):
        for piece in pieces_in(batches):
            m = piece.model
            tree, features = growing[m], place[m]
            slots = np.full(len(tree), -1)
            slots[nodes[m]] = np.arange(len(nodes[m]))
            used = set(tree["feature"].tolist()) - {-1}
            parts = piece.parts(setting.params, sorted(used | set(features)))
            aim(parts, setting, Forest([tree]))
            tables = tallied(parts, slots, len(nodes[m]), features, setting)
            del parts
            for first in range(0, len(nodes[m]), NODES_TOGETHER):
                cells = []
                for f, k in enumerate(features):
                    n, g, h = (a[first : first + NODES_TOGETHER] for a in tables[k])
                    slot, bin_ = np.nonzero(n)
                    made = np.empty(len(slot), SUM)
                    made["at"] = (slot * len(features) + f) * BINS + bin_
                    made["n"], made["g"], made["h"] = n[slot, bin_], g[slot, bin_], h[slot, bin_]
                    cells.append(made)
                if cells:
                    yield pieces_of([(m, first, np.concatenate(cells).tobytes())])

    def splits(batches):
        names = [c.split()[0] for c in SPLIT.split(", ")]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), *[pa.float64()] * 6]
        for m, first, blobs in grouped_blobs(batches):
            features, cells = place[m], np.frombuffer(b"".join(blobs), SUM)
            size = NODES_TOGETHER * len(features) * BINS
            sums_ = [np.bincount(cells["at"], cells[c], size).reshape(NODES_TOGETHER, len(features), BINS) for c in ("n", "g", "h")]
            tables = {k: np.stack([a[:, f, : setting.widths[k]] for a in sums_]) for f, k in enumerate(features)}
            best = best_of(tables, features, NODES_TOGETHER, setting)
            rows = [(m, first + s, *(r[c] for c in names[2:])) for s, r in enumerate(best) if r is not None and r["n"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    work = sum(-(-len(nodes[m]) // NODES_TOGETHER) for m in growing)
    most = max(len(place[m]) for m in growing)
    tasks = max(1, -(-work * NODES_TOGETHER * most // HISTOGRAMS_PER_TASK))
    return met(dealt(spark, pieces).mapInArrow(sums, PIECE), tasks).mapInArrow(splits, SPLIT).collect()


def weighted_medians(spark: SparkSession, pieces: list[Piece], growing, setting: Setting, l1: float, l2: float) -> dict[int, dict[int, float]]:
    """Per model and leaf the weighted median of the residuals, exactly, by counting.

    Each pass parts the interval that holds the median, sums weights by bin and keeps the bin; the driver
    has one interval per node. The first penalty acts like one more residual of zero with its weight, the
    second shrinks the step by the share of the node's weight in both, as it does for the other losses.
    """
    slots, where = numbered(growing, {m: np.flatnonzero(t["feature"] < 0).tolist() for m, t in growing.items()})
    most = len(where)
    low, high = np.full(most, -np.inf), np.full(most, np.inf)
    below, total, after, done = np.zeros(most), np.full(most, np.nan), np.full(most, np.inf), {}
    open_ = np.ones(most, bool)

    def one_pass():
        def spans(batches):
            for piece in pieces_in(batches):
                tree = growing[piece.model]
                parts = piece.parts(setting.params, sorted(set(tree["feature"].tolist()) - {-1}))
                forest = Forest([tree])
                for p in parts:
                    w = p.weights()
                    own = p.bag(setting.params, setting.round)
                    own = own[w[own] > 0]
                    slot = slots[piece.model][forest.descend(np.zeros(len(own), np.int64), p.bins()[:, own].T)]
                    r = p.y[own] - p.f[own]
                    inside = open_[slot] & (r >= low[slot]) & (r <= high[slot])
                    yield from pieces_at(slot[inside], r[inside], w[own[inside]])

        def pieces_at(slot, r, w):
            cells = summed(slot * MEDIAN_BINS + binned(slot, r), r, r, w)
            part = cells["at"] // (MEDIAN_BINS * LEAVES_TOGETHER)
            bounds = np.searchsorted(part, np.arange(most // LEAVES_TOGETHER + 2))
            out = [(0, p, cells[a:b].tobytes()) for p, (a, b) in enumerate(pairwise(bounds)) if b > a]
            if out:
                yield pieces_of(out)

        def binned(slot, r):
            known = np.isfinite(low[slot]) & (high[slot] > low[slot])
            start, span = np.where(known, low[slot], 0.0), np.where(known, high[slot] - low[slot], np.inf)
            return np.clip(((r - start) / span * MEDIAN_BINS).astype(np.int64), 0, MEDIAN_BINS - 1)

        def summed(at, lowest, highest, w):
            order = np.argsort(at, kind="stable")
            at, lowest, highest, w = at[order], lowest[order], highest[order], w[order]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            cells = np.zeros(len(starts), SPAN)
            if len(starts):
                cells["at"], cells["w"] = at[starts], np.add.reduceat(w, starts)
                cells["low"], cells["high"] = np.minimum.reduceat(lowest, starts), np.maximum.reduceat(highest, starts)
            return cells

        def places(batches):
            for _, _, blobs in grouped_blobs(batches):
                cells = np.frombuffer(b"".join(blobs), SPAN)
                at, lowest, highest, w = cells["at"].astype(np.int64), cells["low"], cells["high"], cells["w"]
                if l1:
                    nodes = np.unique(at // MEDIAN_BINS)
                    nodes = nodes[(low[nodes] <= 0) & (high[nodes] >= 0)]
                    zero = np.zeros(len(nodes))
                    at = np.append(at, nodes * MEDIAN_BINS + binned(nodes, zero))
                    lowest, highest, w = np.append(lowest, zero), np.append(highest, zero), np.append(w, zero + l1)
                cells = summed(at, lowest, highest, w)
                node = cells["at"] // MEDIAN_BINS
                out = []
                for s in np.unique(node).tolist():
                    own = cells[node == s]
                    weight = own["w"].sum() if np.isnan(total[s]) else total[s]
                    value, left = crossing(own["low"], own["high"], own["w"], below[s], weight, after[s])
                    out.append((s, value, *(left or (0.0, 0.0, 0.0, 0.0)), weight))
                kinds = [pa.int32(), *[pa.float64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], PLACE_NAMES)

        schema = "slot int, value double, low double, high double, below double, after double, total double"
        some = {where[s][0] for s in np.flatnonzero(open_).tolist()}
        state = dealt(spark, [p for p in pieces if p.model in some])
        return met(state.mapInArrow(spans, PIECE), -(-most // LEAVES_TOGETHER)).mapInArrow(places, schema).collect()

    while open_.any():
        found = one_pass()
        seen = {r["slot"] for r in found}
        for r in found:
            s = r["slot"]
            if r["value"] is not None:
                done[s], open_[s] = stepped(r["value"], r["total"], l1, l2), False
            low[s], high[s], below[s], after[s], total[s] = r["low"], r["high"], r["below"], r["after"], r["total"]
        for s in np.flatnonzero(open_).tolist():
            if s not in seen:  # a node without rows in the bag
                done[s], open_[s] = 0.0, False
    out: dict[int, dict[int, float]] = {m: {} for m in growing}
    for s, (m, node) in where.items():
        out[m][node] = done[s]
    return out


PLACE_NAMES = ["slot", "value", "low", "high", "below", "after", "total"]


# --- rounds ---------------------------------------------------------------------------


@dataclass
class Progress:
    """What a fit knows of one model: all but its trees."""

    start: float
    rows: int
    held: int
    importances: np.ndarray
    history: list[dict] = field(default_factory=list)
    best: tuple[float, int] = (float("inf"), 0)
    active: bool = True
    # How much of the history the store has.
    recorded: int = 0
    # Its rows, each piece with the file of its scores.
    pieces: list[Piece] = field(default_factory=list)

    def note(self, done: int, sums: list, early_stop: int) -> None:
        """Record the scores of ``done`` trees; the model stops when its error has not fallen for long."""
        loss, error = (math.fsum(s) for s in zip(*sums, strict=True))
        mean = error / self.held if self.held else None
        self.history.append({"round": done, "loss": loss / self.rows, "valid_mae": mean})
        if mean is not None and mean < self.best[0]:
            self.best = (mean, done)
        if mean is not None and early_stop and done - self.best[1] >= early_stop:
            self.active = False


class Rounds:
    """A fit of several models at once, round by round, over files of rows that are written once.

    ``store`` gets the rows (``rows``), after each round their scores (``scores``), and every few rounds the
    trees (``trees``) and what is known of the models (``done``, written last). The trees since then and the
    one being grown are all the driver holds. Rows and scores go when the fit has ended.

    A model whose rows one task can go through has its tree grown there, the others level by level over the
    tasks of their pieces.
    """

    def __init__(
        self, rows: DataFrame, names: list[str], members: int, binning: Binning, params: BoostParams, store: str, allowed: np.ndarray | None
    ):
        self.allowed = allowed
        self.spark, self.names, self.members, self.binning = rows.sparkSession, names, members, binning
        self.params, self.store = params, store
        self.pending: list[dict[int, np.ndarray]] = []
        self.round = self.written = 0
        if not self._resume():
            self._begin(rows)

    def _setting(self) -> Setting:
        own = drawn(range(len(self.binning.features)), self.params.tree_share, self.params.seed, self.round)
        nominal = frozenset(k for k, n in enumerate(self.binning.nominal) if n)
        return Setting(self.params, self.round, self.binning.widths(), nominal, tuple(own), self.store)

    def _may(self, m: int):
        return None if self.allowed is None else self.allowed[m].tolist()

    def _begin(self, rows: DataFrame) -> None:
        spark, params, width = self.spark, self.params, len(self.binning.features)
        found = sorted(write_blocks(rows, self.store, self.members, params.log_target, params.row_share < 1), key=lambda r: (r["grp"], r["place"]))
        self.progress: dict[int, Progress] = {}
        for group in sorted({r["grp"] for r in found}):
            own = [r for r in found if r["grp"] == group]
            for j in range(self.members):
                n, held, w, wy = (math.fsum(r[c][j] for r in own) for c in ("trained", "held", "w", "wy"))
                if not n:
                    continue
                m, start = group * self.members + j, wy / w if w else 0.0
                if params.objective == "tweedie":
                    start = math.log(max(start, 1e-12))
                dealt_ = [Piece(m, j, start, tuple(paths)) for paths in in_pieces([(r["path"], r["n"]) for r in own], PIECE_ROWS)]
                self.progress[m] = Progress(start, int(n), int(held), np.zeros(width), pieces=dealt_)
        if params.objective == "absolute":
            # All rows count for the start value, whatever share a round draws.
            setting = replace(self._setting(), params=replace(params, row_share=1.0))
            here, wide = self._sorted()
            starts = {here[at]: v for at, v in each(spark, lambda p, _: start_here(p, setting), [(self.progress[m].pieces[0], None) for m in here])}
            if wide:
                zeros = [replace(p, start=0.0) for m in wide for p in self.progress[m].pieces]
                medians = weighted_medians(spark, zeros, {m: leaf() for m in wide}, setting, 0.0, 0.0)
                starts |= {m: medians[m][0] for m in wide}
            for m, value in starts.items():
                p = self.progress[m]
                p.start, p.pieces = value, [replace(x, start=value) for x in p.pieces]
        self._scored({m: None for m in self.progress}, 0)

    def _sorted(self) -> tuple[list[int], list[int]]:
        """Models to go on with: those whose rows one task goes through, largest first, and the others."""
        active = sorted((m for m, p in self.progress.items() if p.active), key=lambda m: -self.progress[m].rows)
        return [m for m in active if len(self.progress[m].pieces) == 1], [m for m in active if len(self.progress[m].pieces) > 1]

    def _scored(self, trees: dict[int, bytes | None], done: int) -> None:
        """Write the scores of all pieces after a tree of each model, and note what they lose."""
        setting = self._setting()
        specs = [(p, trees[m]) for m in trees for p in self.progress[m].pieces]
        found = dict(each(self.spark, lambda p, tree: score_piece(p, setting, tree), specs))
        at = 0
        for m in trees:
            p, n = self.progress[m], len(self.progress[m].pieces)
            own, at = [found[k] for k in range(at, at + n)], at + n
            p.pieces = [replace(x, scores=r["path"]) for x, r in zip(p.pieces, own, strict=True)]
            p.note(done, [r["sums"] for r in own], self.params.early_stop)

    def _resume(self) -> bool:
        """Go on from the last record in the store, if there is one."""
        records = f"{self.store}/done"
        if not exists(self.spark, records):
            return False
        for r in sorted(self.spark.read.json(records, schema=RECORD).collect(), key=lambda r: r["round"]):
            known = json.loads(r["models"])
            if self.round == 0:
                self.progress = {int(m): Progress(k["start"], k["rows"], k["held"], np.array(k["importances"])) for m, k in known.items()}
            for m, k in known.items():
                p = self.progress[int(m)]
                p.history += k["history"]
                p.recorded = len(p.history)
                p.importances, p.best, p.active = np.array(k["importances"]), tuple(k["best"]), k["active"]
                p.pieces = [Piece(int(m), int(m) % self.members, p.start, tuple(b), s) for b, s in k["pieces"]]
            self.round = self.written = r["round"]
        return True

    def grow(self) -> None:
        """One round: a tree for every model that has not stopped."""
        params, setting = self.params, self._setting()
        here, wide = self._sorted()
        specs = [(self.progress[m].pieces[0], self._may(m)) for m in here]
        grown: dict[int, np.ndarray] = {}
        for at, r in each(self.spark, lambda p, may: round_here(p, setting, may), specs):
            m, p = here[at], self.progress[here[at]]
            grown[m] = np.frombuffer(r["tree"], NODE)
            p.importances = p.importances + np.array(r["gains"])
            p.pieces = [replace(p.pieces[0], scores=r["path"])]
            p.note(self.round + 1, [r["sums"]], params.early_stop)
        if wide:
            trees = self._grow_wide(wide, setting)
            self._scored({m: t.tobytes() for m, t in trees.items()}, self.round + 1)
            grown |= trees
        self.pending.append({m: grown[m] for m in sorted(grown)})
        self.round += 1
        if self.round - 1 > self.written:
            delete(self.spark, f"{self.store}/scores/{self.round - 1:06d}")

    def _grow_wide(self, models: list[int], setting: Setting) -> dict[int, np.ndarray]:
        """Trees of models with many pieces, level by level."""
        params = self.params
        growing, nodes = {m: leaf() for m in models}, {m: [0] for m in models}
        for level in range(params.max_depth):
            some = [m for m in models if nodes[m] and setting.level(level, self._may(m))]
            if not some:
                break
            pieces = [p for m in some for p in self.progress[m].pieces]
            rows = level_splits(self.spark, pieces, {m: growing[m] for m in some}, nodes, setting, level, self.allowed)
            # Shuffled sums stay on the executors' disks until the driver has forgotten them.
            self.spark.sparkContext._jvm.System.gc()
            for m in some:
                best: list = [None] * len(nodes[m])
                for r in rows:
                    if r["model"] == m:
                        best[r["slot"]] = r
                growing[m], made = with_splits(growing[m], nodes[m], best, self.progress[m].importances, params)
                nodes[m] = [c for s in made for c in s[3]]
        if params.objective == "absolute":
            pieces = [p for m in models for p in self.progress[m].pieces]
            for m, steps in weighted_medians(self.spark, pieces, growing, setting, params.l1, params.l2).items():
                for node, value in steps.items():
                    growing[m][node]["value"] = value
        return growing

    def commit(self, over: bool = False) -> None:
        """Write trees and the record that makes them count; drop scores that no record names."""
        if self.pending:
            first, spark = self.round - len(self.pending), self.spark
            cells = [
                (self.names[m], first + k, tree.tobytes()) for k, trees in enumerate(self.pending) for m, tree in trees.items()
            ]
            made = spark.createDataFrame(cells, TREES).coalesce(1).sortWithinPartitions("round", "name")
            made.write.mode("overwrite").parquet(f"{self.store}/trees/upto={self.round:06d}")
            known = {
                m: {
                    "start": p.start, "rows": p.rows, "held": p.held, "importances": p.importances.tolist(), "best": p.best,
                    "active": p.active, "history": p.history[p.recorded :], "pieces": [(x.blocks, x.scores) for x in p.pieces],
                }
                for m, p in self.progress.items()
            }
            for p in self.progress.values():
                p.recorded = len(p.history)
            record = spark.createDataFrame([(self.round, json.dumps(known))], RECORD)
            record.coalesce(1).write.mode("append").json(f"{self.store}/done")
            self.pending = []
            if self.written:
                delete(spark, f"{self.store}/scores/{self.written:06d}")
            self.written = self.round
        if over:
            for folder in ("rows", "scores"):
                delete(self.spark, f"{self.store}/{folder}")

    def run(self) -> None:
        while self.round < self.params.rounds and any(p.active for p in self.progress.values()):
            self.grow()
            if self.round % self.params.write_every == 0:
                self.commit()
        self.commit(over=True)

    def models(self) -> dict[str, BoostedTrees]:
        out = {}
        for m, p in self.progress.items():
            total = p.importances.sum()
            kept = p.best[1] if p.held else self.round
            shares = p.importances / total if total else p.importances
            out[self.names[m]] = BoostedTrees(
                self.binning, self.params, p.start, self.store, self.names[m], tuple(shares.tolist()), kept, tuple(p.history)
            )
        return out


RECORD = "round int, models string"
TREES = "name string, round int, nodes binary"


def in_pieces(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Files dealt to as few even pieces as hold up to about ``most`` rows each."""
    total = sum(n for _, n in files)
    pieces = max(1, -(-total // most))
    out, at = [[] for _ in range(pieces)], 0
    for path, n in files:
        out[min(pieces - 1, at * pieces // total)].append(path)
        at += n
    return [p for p in out if p]


def numbered(trees: dict[int, np.ndarray], nodes: dict[int, list[int]]):
    """Numbers for the given nodes: per tree an array over its nodes (-1: none), and the node of each number."""
    slots = {m: np.full(len(t), -1) for m, t in trees.items()}
    where = {}
    for m, some in nodes.items():
        for node in some:
            slots[m][node] = len(where)
            where[len(where)] = (m, node)
    return slots, where


def parted(tree: np.ndarray, node: int, r, params: BoostParams) -> tuple[np.ndarray, list[int]]:
    """The tree with a split at ``node``, and those of its children that may be split again."""
    first, children = len(tree), []
    tree = np.concatenate([tree, leaf(), leaf()])
    tree[node]["feature"], tree[node]["bin"] = r["feature"], r["bin"]
    tree[node]["left"], tree[node]["right"] = first, first + 1
    tree[node]["mask"] = np.frombuffer(r["mask"], np.uint8)
    sides = ((r["gl"], r["hl"], r["nl"]), (r["g"] - r["gl"], r["h"] - r["hl"], r["n"] - r["nl"]))
    for k, (g, h, n) in enumerate(sides):
        tree[first + k]["value"] = leaf_value(g, h, params)
        if n >= 2 * max(params.min_leaf, 1):
            children.append(first + k)
    return tree, children


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fit_rows(
    rows: DataFrame, names, binning: Binning, params: BoostParams, store: str | None = None, name: str = "insurer",
    allowed: dict[str, tuple[str, ...]] | None = None, members=None,
) -> dict[str, BoostedTrees]:
    """Train on packed rows: ``name``, ``_y``, ``_w``, ``_valid``, ``_h`` (hash of the key) and ``_x``.

    Names without training rows get no model. ``allowed`` names the features on which a model may split.
    With ``members`` each name has several models on its rows, called ``name|member``; instead of ``_valid``
    rows have ``_role``, a byte for each of them (``ABSENT``, ``TRAIN`` or ``HELD``).
    A ``store`` that holds a stopped fit of the same rows and settings is gone on from.
    """
    groups = list(names)
    models = groups if members is None else [f"{g}|{j}" for g in groups for j in members]
    may = None
    if allowed is not None:
        may = np.array([[c in set(allowed.get(n, ())) for c in binning.features] for n in models])
    numbers = F.create_map(*[x for k, n in enumerate(groups) for x in (F.lit(n), F.lit(k))])
    role = F.expr(f"CASE WHEN _valid THEN X'{HELD:02x}' ELSE X'{TRAIN:02x}' END") if members is None else F.col("_role")
    found = rows.withColumns({"_m": numbers[F.col(name)], "_role": role}).where("_m IS NOT NULL AND _y IS NOT NULL")
    fit = Rounds(found, models, 1 if members is None else len(members), binning, params, store or scratch_path(rows.sparkSession, "model"), may)
    fit.run()
    return fit.models()


def packed_rows(
    df: DataFrame, binning: Binning, label: str = "y", weight: str | None = None, valid: Column | None = None,
    key: str = "quote_id", keep=(),
) -> DataFrame:
    """Rows as ``fit_rows`` takes them; null labels are left out."""
    held = F.coalesce(valid if valid is not None else F.lit(False), F.lit(False))
    cells = df.where(F.col(label).isNotNull()).withColumns(
        {
            "_y": F.col(label).cast("double"),
            "_w": F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0),
            "_valid": held,
            "_h": F.xxhash64(key),
        }
    )
    return binning.packed(cells, [*keep, "_y", "_w", "_valid", "_h"])


def fit_boosted(
    df: DataFrame,
    features,
    params: BoostParams,
    label: str = "y",
    weight: str | None = None,
    valid: Column | None = None,
    key: str = "quote_id",
    nominal=(),
    store: str | None = None,
) -> BoostedTrees | None:
    """Train one model on the rows where ``valid`` is not true; none if there are no such rows.

    With validation rows the model stops early and keeps the rounds of lowest mean absolute error on
    the price scale. A null weight counts as none.
    """
    held = F.coalesce(valid if valid is not None else F.lit(False), F.lit(False))
    binning = fit_bins(df.where(~held & F.col(label).isNotNull()), features, params.max_bins, nominal)
    rows = packed_rows(df, binning, label, weight, held, key).withColumn("insurer", F.lit("model"))
    return fit_rows(rows, ["model"], binning, params, store).get("model")


# --- scores ---------------------------------------------------------------------------

# Bytes of trees a worker keeps at hand; what a store holds beyond that is read again for every batch of rows.
KEPT_TREES = 64 << 20


def read_trees(store: str, name: str, rounds: int):
    """Trees of a model, read one piece after another from its store."""
    from pyarrow import dataset

    system, path = located(store)
    found = dataset.dataset(f"{path}/trees", filesystem=system, format="parquet")
    wanted = (dataset.field("name") == name) & (dataset.field("round") < rounds)
    for batch in found.to_batches(columns=["nodes"], filter=wanted, batch_size=256, batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            trees = [np.frombuffer(b, NODE) for b in batch.column(0).to_pylist()]
            yield Forest(trees)


class Shelf:
    """Trees of models, kept up to a number of bytes, else read anew."""

    def __init__(self, most: int):
        self.most, self.size, self.kept = most, 0, {}

    def of(self, store: str, name: str, rounds: int):
        at = (store, name, rounds)
        if at in self.kept:
            yield from self.kept[at]
            return
        some: list | None = []
        for forest in read_trees(store, name, rounds) if rounds else ():
            self.size += len(forest.value) * NODE.itemsize
            if self.size > self.most:
                some = None
            if some is not None:
                some.append(forest)
            yield forest
        if some is not None:
            self.kept[at] = some


def score_own(models: dict[str, BoostedTrees], name="insurer", binned: Binning | None = None) -> Column:
    """Price of each row by the model that ``name`` (a column) names; null where there is none.

    With ``binned``, the binning of all models, rows have their features as bytes ``_x``.
    """
    if not models:
        return F.lit(None).cast("double")
    name = F.col(name) if isinstance(name, str) else name
    inputs = list(dict.fromkeys(c for m in models.values() for c in m.features))
    plans = [(m.binning, m.start, m.params.learning_rate, m.store, m.name, m.best_iteration) for m in models.values()]
    trees, packed = Shelf(KEPT_TREES), binned is not None

    @F.arrow_udf("double")
    def score(which: pa.Array, *values: pa.Array) -> pa.Array:
        n, which = len(which), which.to_numpy(zero_copy_only=False)
        x = bytes_of(values[0]) if packed and n else None
        columns = {} if packed else {c: v.to_numpy(zero_copy_only=False) for c, v in zip(inputs, values, strict=True)}
        out = np.full(n, np.nan)
        for k, (binning, start, rate, store, model, rounds) in enumerate(plans):
            own = np.flatnonzero(which == k)
            if not len(own):
                continue
            bins = x[own] if packed else binning.of([columns[c][own] for c in binning.features])
            total = np.full(len(own), start)
            for forest in trees.of(store, model, rounds):
                for root in forest.roots.tolist():
                    total += rate * forest.value[forest.descend(np.full(len(own), root), bins)]
            out[own] = total
        return pa.array(out)

    numbers = F.create_map(*[x for k, n in enumerate(models) for x in (F.lit(n), F.lit(k))])
    rows = [F.col("_x")] if packed else [number(c) for c in inputs]
    raw = F.nanvl(score(F.coalesce(numbers[name], F.lit(-1)), *rows), F.lit(None).cast("double"))
    (params,) = {m.params for m in models.values()}
    return to_price(raw, params)


def score_models(models: dict[str, BoostedTrees]) -> dict[str, Column]:
    """Price expression per model; all models share one Arrow pass over the rows.

    Tasks read the trees from the stores, a bounded piece at a time; neither the driver nor the query
    holds them.
    """
    inputs = list(dict.fromkeys(c for m in models.values() for c in m.features))
    plans = [(m.binning, m.start, m.params.learning_rate, m.store, m.name, m.best_iteration) for m in models.values()]
    height = len(plans)
    trees = Shelf(KEPT_TREES)

    @F.arrow_udf("array<double>")
    def score(*values: pa.Array) -> pa.Array:
        n = len(values[0])
        columns = {c: v.to_numpy(zero_copy_only=False) for c, v in zip(inputs, values, strict=True)}
        bins: dict = {}
        out = np.empty((n, height))
        for k, (binning, start, rate, store, name, rounds) in enumerate(plans):
            if id(binning) not in bins:
                bins[id(binning)] = binning.of([columns[c] for c in binning.features])
            out[:, k] = start
            for forest in trees.of(store, name, rounds):
                for root in forest.roots.tolist():
                    out[:, k] += rate * forest.value[forest.descend(np.full(n, root), bins[id(binning)])]
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * height)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    raw = score(*[number(c) for c in inputs])
    return {name: to_price(raw[n], m.params) for n, (name, m) in enumerate(models.items())}


# --- stored models ---------------------------------------------------------------

META_SCHEMA = (
    "insurer string, binning string, params string, start double, importances array<double>, "
    "best_iteration int, history string"
)


def save_models(spark: SparkSession, models: dict[str, BoostedTrees], path: str) -> None:
    """The trees of all models as one table, copied from their stores, and one record of settings each."""
    trees = None
    for name, m in models.items():
        stored = spark.read.parquet(f"{m.store}/trees") if m.best_iteration else spark.createDataFrame([], TREES)
        own = stored.where((F.col("name") == m.name) & (F.col("round") < m.best_iteration))
        own = own.select(F.lit(name).alias("name"), "round", "nodes")
        trees = own if trees is None else trees.unionByName(own)
    if trees is None:
        trees = spark.createDataFrame([], TREES)
    trees.write.mode("overwrite").parquet(f"{path}/trees")
    meta = [
        (
            name,
            json.dumps(asdict(m.binning)),
            json.dumps(asdict(m.params)),
            m.start,
            list(m.importances),
            m.best_iteration,
            json.dumps(list(m.history)),
        )
        for name, m in models.items()
    ]
    spark.createDataFrame(meta, META_SCHEMA).write.mode("overwrite").json(f"{path}/meta")


def load_models(spark: SparkSession, path: str, insurers=None) -> dict[str, BoostedTrees]:
    """Handles of stored models; their trees stay where they are."""
    meta = spark.read.json(f"{path}/meta", schema=META_SCHEMA)
    if insurers is not None:
        meta = meta.where(F.col("insurer").isin(list(insurers)))

    def binning(text: str) -> Binning:
        found = json.loads(text)
        return Binning(tuple(found["features"]), tuple(found["nominal"]), tuple(map(tuple, found["values"])))

    return {
        r["insurer"]: BoostedTrees(
            binning(r["binning"]),
            BoostParams(**json.loads(r["params"])),
            r["start"],
            path,
            r["insurer"],
            tuple(r["importances"]),
            r["best_iteration"],
            tuple(json.loads(r["history"])),
        )
        for r in meta.collect()
    }


# --- feature choice -------------------------------------------------------------------


def importance_table(spark: SparkSession, models: dict[str, BoostedTrees]) -> DataFrame:
    """One row per model and feature; ``place`` is the feature's position among the inputs."""
    rows = [
        (name, place, feature, float(share))
        for name, m in sorted(models.items())
        for place, (feature, share) in enumerate(zip(m.features, m.importances, strict=True))
    ]
    return spark.createDataFrame(rows, "insurer string, place int, feature string, importance double")


def top_features(spark: SparkSession, models: dict[str, BoostedTrees], top_n: int = 20) -> DataFrame:
    """The most important features of each model; of equal ones the earlier input comes first."""
    order = Window.partitionBy("insurer").orderBy(F.desc("importance"), "place")
    ranked = importance_table(spark, models).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_n).select("insurer", "rank", "feature", "importance")


def select_features(
    df: DataFrame,
    features,
    categorical=(),
    params: BoostParams | None = None,
    top_n: int = 80,
    valid: Column | None = None,
    label: str = "y",
) -> tuple[list[str], list[str]]:
    """Names of the most important features of a scout model, and the categories of them."""
    params = params or PRESETS["scout"]
    scout = fit_boosted(df, features, params, label, valid=valid, nominal=categorical if params.nominal else ())
    if scout is None:
        return [], []
    best = top_features(df.sparkSession, {"scout": scout}, top_n).orderBy("rank").collect()
    chosen = [r["feature"] for r in best]
    return chosen, [c for c in categorical if c in set(chosen)]
