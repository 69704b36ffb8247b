"""Trees grown from histograms: second-order boosting and forests, many models side by side.

Features are binned once. A model's next splits are found from sums of gradient, curvature and rows for each node and
bin. Sums are whole numbers, so they do not depend on how rows lie in blocks, and neither do the trees. Rows are kept in
blocks of bounded size. With several blocks all models take a level together. Tasks that run side by side keep the blocks,
hand each other the sums of a level and choose its splits, each for its share of the features, so no job is started for a
level. Where they cannot, a level is one pass over the blocks and one aggregate by model, node and bin. What a single block
holds needs no sums of others, so its models grow there, dealt over the tasks.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections import OrderedDict, deque
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from hashlib import blake2b
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.operators.ordering import row_hash
from wardlight.plans import exchange
from wardlight.session import materialise, remove, scratch_path

BINS = 255
BLOCK_ROWS = 1 << 20  # sums of a block stay below 2^53
BLOCK_BYTES = 128 << 20  # of its bins
LEAST_BLOCK_ROWS = 1 << 14
CHUNKS_PER_CORE = 4
SMALL_ROWS = 1 << 17  # of a block that many chunks may copy
OPEN_BYTES = 256 << 20  # that a task holds for trees on their way
KEPT_BYTES = 256 << 20  # of blocks that a Python worker keeps between passes
SIDE_BYTES = 1 << 30  # of blocks in one of the tasks that grow trees in step
MARGIN_TREES = 50  # of a model, until its margins are written
ONE = float(1 << 30)  # gradients and curvatures are summed as multiples of 2^-30
LEAST_GAIN = 1e-9
CODES = 256  # of neighbouring features that are counted together
OCCURRING = 512  # codes of features that are counted together, by a sample of a block's rows
SAMPLED = 1 << 12
FEW_FEATURES = 128  # more are put together by neighbours


@dataclass(frozen=True)
class Growth:
    """How a model's trees grow.

    ``max_leaves`` are taken best gain first; ``subsample`` and ``columns`` are the shares of rows and features of a tree. A forest's
    trees see rows as often as a Poisson draw says and ``node_columns`` features at each node; its leaves are shares.
    """

    trees: int
    learning_rate: float = 0.1
    max_depth: int = 6
    max_leaves: int = 1 << 30
    min_rows: int = 1
    min_curvature: float = 1e-3
    subsample: float = 1.0
    columns: float = 1.0
    alpha: float = 0.0
    lam: float = 0.0
    forest: bool = False
    node_columns: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class Fit:
    """One model to grow: weights of the two classes, and the fold that is held out (none: all rows train)."""

    growth: Growth
    weights: tuple[float, float] = (1.0, 1.0)
    fold: int | None = None


@dataclass
class Coded:
    """Features of a block that are counted together: a row's code, and what bin of each feature a code stands for."""

    features: list[int]
    code: np.ndarray
    bins: np.ndarray  # (features, codes)
    order: np.ndarray  # codes by feature and bin
    starts: np.ndarray  # where a bin's codes begin in that order
    found: np.ndarray  # these bins

    @property
    def size(self) -> int:
        return self.bins.shape[1]


def _joined(code: np.ndarray, bins: np.ndarray, start: int, size: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Codes and a feature's bins as one code without gaps, the number of codes, and each one's ``old code * size + bin``."""
    joint = code * size + (bins.astype(np.int64) - start)
    present = np.zeros(int(joint.max(initial=0)) + 1, bool)
    present[joint] = True
    origin = np.flatnonzero(present)
    return (np.cumsum(present) - 1)[joint], len(origin), origin


def _coded_together(features: list[int], code: np.ndarray, bins: np.ndarray) -> Coded:
    kind = np.uint8 if bins.shape[1] <= 1 << 8 else np.uint16 if bins.shape[1] <= 1 << 16 else np.int32
    order = np.argsort(bins, axis=1, kind="stable")
    sorted_bins = np.take_along_axis(bins, order, axis=1).ravel()
    starts = np.flatnonzero(np.diff(sorted_bins, prepend=-1))
    return Coded(list(features), code.astype(kind), bins, order.ravel(), starts, sorted_bins[starts])


@dataclass
class Layout:
    """Bins of all features, numbered one feature after the other."""

    features: list[str]
    thresholds: list[np.ndarray]  # a bin ends at its threshold; the last one is open

    def __post_init__(self) -> None:
        sizes = np.array([len(t) + 1 for t in self.thresholds], np.int64)
        self.total = int(sizes.sum())
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.last = np.zeros(self.total, bool)
        self.last[self.starts + sizes - 1] = True
        self.kind = np.uint16 if self.total <= 1 << 16 else np.int32  # of bins in a table of blocks
        # Neighbouring features of few bins are counted together, as the digits of one number.
        self.groups: list[tuple[int, int]] = []
        first, product = 0, 1
        for f, n in enumerate(sizes.tolist()):
            if f > first and product * n > CODES:
                self.groups.append((first, f))
                first, product = f, 1
            product *= n
        if len(sizes):
            self.groups.append((first, len(sizes)))
        self.sizes = sizes.tolist()

    def codes(self, bins: np.ndarray) -> list[Coded]:
        """The features put together by the bins that occur side by side in a block. One that follows from others adds no
        code, flags of one category add few. A sample of rows says what goes where; the codes are those of all rows."""
        units = [(f, f + 1) for f in range(len(self.sizes))] if len(self.sizes) <= FEW_FEATURES else self.groups
        sample = bins[:: max(1, len(bins) // SAMPLED)]
        held: list[tuple[list[int], np.ndarray, int]] = []
        for unit in sorted(units, key=lambda u: -int(np.prod(self.sizes[u[0]:u[1]]))):
            own, n = np.zeros(len(sample), np.int64), 1
            for f in range(*unit):
                own, n, _ = _joined(own, sample[:, f], self.starts[f], self.sizes[f])
            tried = [(*_joined(code, own, 0, n)[:2], k) for k, (_, code, _) in enumerate(held)]
            fit = [(m / held[k][2], k, code, m) for code, m, k in tried if m <= OCCURRING]
            if fit:
                _, k, code, m = min(fit, key=lambda x: x[:2])
                held[k] = (held[k][0] + list(range(*unit)), code, m)
            else:
                held.append((list(range(*unit)), own, max(1, n)))
        out = []
        for features, _, _ in held:
            code, n, of = np.zeros(len(bins), np.int64), 1, np.zeros((0, 1), np.int64)
            taken: list[int] = []
            for f in features:
                joint, m, origin = _joined(code, bins[:, f], self.starts[f], self.sizes[f])
                if taken and m > 4 * OCCURRING:  # rows beside the sample hold more
                    out.append(_coded_together(taken, code, of))
                    taken, of = [], np.zeros((0, 1), np.int64)
                    joint, m, origin = _joined(np.zeros(len(bins), np.int64), bins[:, f], self.starts[f], self.sizes[f])
                of = np.concatenate([of[:, origin // self.sizes[f]], origin[None] % self.sizes[f] + self.starts[f]])
                code, n = joint, m
                taken.append(f)
            out.append(_coded_together(taken, code, of))
        return out

    def bin(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        bins = [np.searchsorted(t, x, "left") + s for t, x, s in zip(self.thresholds, columns, self.starts, strict=True)]
        return np.stack(bins, axis=1).astype(np.int32) if bins else np.zeros((0, 0), np.int32)


@dataclass
class Block:
    bins: np.ndarray
    label: np.ndarray
    hash: np.ndarray
    fold: np.ndarray
    codes: list[Coded] | None = None

    def coded(self, layout: Layout) -> list[Coded]:
        if self.codes is None:
            self.codes = layout.codes(self.bins)
        return self.codes


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Rows at or below the threshold go left. ``cover`` is the number of rows a node was grown on."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of feature values."""
        node = np.zeros(len(rows), np.int64)
        inner = np.flatnonzero(self.feature[node] >= 0)
        while len(inner):
            at = node[inner]
            low = rows[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(low, self.left[at], self.right[at])
            inner = inner[self.feature[node[inner]] >= 0]
        return node


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(*parts: int) -> np.uint64:
    out = np.array([0], np.uint64)
    for p in parts:
        out = _mixed(out + np.array([p], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out[0]


def _uniform(hashes: np.ndarray, *salt: int) -> np.ndarray:
    return (_mixed(hashes ^ _salt(*salt)) >> np.uint64(11)) / float(1 << 53)


_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def _drawn(block: Block, fit: Fit, tree: int) -> np.ndarray:
    """How often each row takes part in a tree."""
    g = fit.growth
    if g.forest:
        times = np.searchsorted(_POISSON, _uniform(block.hash, g.seed, tree, 1), "right").astype(np.float64)
    else:
        times = (_uniform(block.hash, g.seed, tree, 1) < g.subsample).astype(np.float64) if g.subsample < 1 else np.ones(len(block.label))
    return times if fit.fold is None else times * (block.fold != fit.fold)


def _gradients(block: Block, fit: Fit, margins: np.ndarray | None, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight = np.where(block.label == 1, fit.weights[1], fit.weights[0]) * times
    if fit.growth.forest:
        g, h = -weight * block.label, weight
    else:
        p = 1.0 / (1.0 + np.exp(-margins))
        g, h = weight * (p - block.label), weight * p * (1.0 - p)
    return np.rint(g * ONE), np.rint(h * ONE)


def _tree_columns(fit: Fit, tree: int, features: int) -> np.ndarray:
    g = fit.growth
    wanted = max(1, round(g.columns * features))
    if wanted >= features:
        return np.arange(features)
    return np.sort(np.argsort(_mixed(np.arange(features, dtype=np.uint64) ^ _salt(g.seed, tree, 2)), kind="stable")[:wanted])


def _node_columns(fit: Fit, tree: int, nodes: np.ndarray, features: int) -> np.ndarray:
    key = nodes.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(features, dtype=np.uint64)
    return np.argsort(_mixed(key ^ _salt(fit.growth.seed, tree, 3)), axis=1, kind="stable")[:, :fit.growth.node_columns]


def _seen(fit: Fit, tree: int, nodes: Sequence[int], features: int) -> np.ndarray:
    """``(nodes, features)``: which features a forest's node looks at."""
    out = np.zeros((len(nodes), features), bool)
    np.put_along_axis(out, _node_columns(fit, tree, np.array(nodes), features), True, axis=1)
    return out


def histograms(codes: Sequence[Coded], layout: Layout, wanted: np.ndarray, rows: np.ndarray, slot: np.ndarray, slots: int,
                       g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``(3, slots, total)`` sums of gradient, curvature and rows over ``rows`` of a block, whose features come in coded groups.

    Features that are not ``wanted`` stay 0."""
    out = np.zeros((3, slots, layout.total))
    for c in codes:
        if not len(rows) or not wanted[c.features].any():
            continue
        key = c.code.take(rows).astype(np.intp)
        if slots > 1:
            key += slot * c.size
        for n, weight in enumerate((g, h, None)):
            sums = np.bincount(key, weight, slots * c.size).reshape(slots, c.size)
            out[n][:, c.found] = np.add.reduceat(sums[:, c.order], c.starts, axis=1)
    out[:, :, ~wanted[layout.owner]] = 0.0
    return out


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) if alpha else g


def best_splits(sums: np.ndarray, totals: np.ndarray, layout: Layout, growth: Growth) -> tuple[np.ndarray, ...]:
    """For each slot gain, bin of the best split (rows of its feature up to it go left) and the three sums on the left.

    ``totals`` are ``(3, slots)``. Of equal gains the first feature and lowest bin count; -inf where no split is allowed.
    """
    upto = np.cumsum(sums.astype(np.int64, copy=False), axis=2)  # over all features it may pass 2^53
    before = np.where(layout.starts > 0, upto[:, :, layout.starts - 1], 0)
    left = upto - before[:, :, layout.owner]
    right = totals[:, :, None] - left

    def worth(part):
        return _shrunk(part[0] / ONE, growth.alpha) ** 2 / np.maximum(part[1] / ONE + growth.lam, 1e-300)

    few = max(1, growth.min_rows)
    allowed = ~layout.last & (left[2] >= few) & (right[2] >= few) & (np.minimum(left[1], right[1]) >= max(growth.min_curvature * ONE, 1.0))
    gain = np.where(allowed, worth(left) + worth(right) - worth(totals)[:, None], -inf)
    at = np.argmax(gain, axis=1)
    every = np.arange(len(at))
    return gain[every, at], at, left[:, every, at]


@dataclass
class Growing:
    """A tree on its way: splits known for some nodes, taken best gain first."""

    growth: Growth
    sums: list = field(default_factory=list)  # (gradient, curvature, rows) of each node
    depth: list = field(default_factory=list)
    split: list = field(default_factory=list)  # (gain, bin, left sums), None: not known yet
    children: list = field(default_factory=list)

    def add(self, sums, depth: int) -> int:
        self.sums.append(tuple(float(x) for x in sums))
        self.depth.append(depth)
        closed = self.depth[-1] >= self.growth.max_depth or self.sums[-1][2] < 2 * max(1, self.growth.min_rows)
        self.split.append((-inf, 0, None) if closed else None)
        self.children.append(None)
        return len(self.sums) - 1

    def fresh(self) -> list[int]:
        return [k for k, s in enumerate(self.split) if s is None]

    def taken(self) -> list[int]:
        """Nodes that are split if only known nodes count. More knowledge never puts a node ahead of its place, so
        what is taken last of all is what a queue over the whole tree takes."""
        queue, out = [(-self.split[0][0], 0)], []
        while queue and len(out) < self.growth.max_leaves - 1:
            gain, node = heapq.heappop(queue)
            if -gain <= LEAST_GAIN:
                break
            out.append(node)
            for child in self.children[node] or ():
                if self.split[child] is not None:
                    heapq.heappush(queue, (-self.split[child][0], child))
        return out

    def expand(self) -> list[int]:
        """Give children to the nodes taken; returns these nodes, none when the tree is complete."""
        new = [k for k in self.taken() if self.children[k] is None]
        for k in new:
            low = self.split[k][2]
            self.children[k] = (self.add(low, self.depth[k] + 1), self.add(np.subtract(self.sums[k], low), self.depth[k] + 1))
        return new

    def tree(self, layout: Layout) -> tuple[Tree, np.ndarray]:
        """The finished tree, and the node of it that each node of this one ends in."""
        kept = set(self.taken())
        number, home, order = {0: 0}, np.zeros(len(self.sums), np.int64), [0]
        for k in order:
            for child in self.children[k] if k in kept else ():
                number[child] = len(order)
                order.append(child)
        for k in range(len(self.sums)):  # parents come before children
            home[k] = number.get(k, home[k])
            for child in self.children[k] or ():
                home[child] = home[k] if k not in kept else number[child]
        n = len(order)
        feature, threshold, left, right = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for k in kept:
            at, b = number[k], self.split[k][1]
            feature[at] = layout.owner[b]
            threshold[at] = layout.thresholds[layout.owner[b]][b - layout.starts[layout.owner[b]]]
            left[at], right[at] = (number[c] for c in self.children[k])
        sums = np.array([self.sums[k] for k in order])
        value = -_shrunk(sums[:, 0] / ONE, self.growth.alpha) / np.maximum(sums[:, 1] / ONE + self.growth.lam, 1e-300)
        return Tree(feature, threshold, left, right, value * (1.0 if self.growth.forest else self.growth.learning_rate), sums[:, 2]), home

    def moves(self, layout: Layout, nodes: Sequence[int]) -> np.ndarray:
        """``(4, nodes)``: feature, bin, left and right child of split nodes; feature -1 elsewhere."""
        out = np.full((4, len(self.sums)), -1, np.int64)
        for k in nodes:
            out[:, k] = layout.owner[self.split[k][1]], self.split[k][1], *self.children[k]
        return out


def _move(bins: np.ndarray, node: np.ndarray, moves: np.ndarray) -> None:
    at = np.flatnonzero(moves[0][node] >= 0)
    here = node[at]
    low = bins[at, moves[0][here]] <= moves[1][here]
    node[at] = np.where(low, moves[2][here], moves[3][here])


# -- one block ---------------------------------------------------------------------


class Rows:
    """A block's rows by node of a tree on its way: those that take part, and the others, which only follow the splits."""

    def __init__(self, block: Block, layout: Layout, fit: Fit, tree: int, margins: np.ndarray | None) -> None:
        features = len(layout.features)
        self.layout, self.codes = layout, block.coded(layout)
        self.place = {f: (c, k) for c in self.codes for k, f in enumerate(c.features)}
        times = _drawn(block, fit, tree)
        self.g, self.h = _gradients(block, fit, margins, times)
        self.wanted = np.zeros(features, bool)
        self.wanted[np.arange(features) if _per_node(fit, features) else _tree_columns(fit, tree, features)] = True
        self.of = {0: (np.flatnonzero(times > 0), np.flatnonzero(times <= 0))}

    def totals(self) -> tuple:
        used = self.of[0][0]
        return self.g[used].sum(), self.h[used].sum(), len(used)

    def count(self, nodes: Sequence[int]) -> np.ndarray:
        """``(3, nodes, total)`` sums of gradient, curvature and rows."""
        here = np.concatenate([self.of[k][0] for k in nodes])
        slot = np.repeat(np.arange(len(nodes)), [len(self.of[k][0]) for k in nodes])
        return histograms(self.codes, self.layout, self.wanted, here, slot, len(nodes), self.g.take(here), self.h.take(here))

    def split(self, node: int, cut: int, children: Sequence[int]) -> None:
        """A row's code says whether it goes left."""
        c, at = self.place[int(self.layout.owner[cut])]
        parts = []
        for own in self.of.pop(node):
            low = (c.bins[at] <= cut).take(c.code.take(own))
            parts.append((own[low], own[~low]))
        for n, child in enumerate(children):
            self.of[child] = (parts[0][n], parts[1][n])

    def leaves(self, home: np.ndarray) -> np.ndarray:
        """The node of the finished tree that each row ends in."""
        leaf = np.zeros(len(self.g), np.int64)
        for k, both in self.of.items():
            for own in both:
                leaf[own] = home[k]
        return leaf


def _per_node(fit: Fit, features: int) -> bool:
    return bool(fit.growth.node_columns and fit.growth.node_columns < features)


def _to_count(grow: Growing, new: Sequence[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Of the children of ``new`` nodes those to count, and ``(large, small, parent)``: the larger one is what is left of the parent."""
    counted, rest = [], []
    for parent in new:
        small, large = sorted(grow.children[parent], key=lambda c: grow.sums[c][2])
        if grow.split[small] is None or grow.split[large] is None:
            counted.append(small)
            rest.append((large, small, parent))
    return counted, rest


def _grow_here(block: Block, layout: Layout, fit: Fit, tree: int, margins: np.ndarray | None) -> tuple[Tree, np.ndarray]:
    """One tree on the rows of one block, and the leaf of each row, also of those that took no part."""
    features, growth = len(layout.features), fit.growth
    rows = Rows(block, layout, fit, tree, margins)
    grow = Growing(growth)
    grow.add(rows.totals(), 0)
    kept: dict[int, np.ndarray] = {}  # sums of nodes that are not split yet
    counted, rest = grow.fresh(), []
    while True:
        if counted:
            kept.update(zip(counted, np.moveaxis(rows.count(counted), 1, 0), strict=True))
        for large, small, parent in rest:
            kept[large] = kept[parent] - kept[small]
        for _, _, parent in rest:
            kept.pop(parent, None)
        fresh = grow.fresh()
        if fresh:
            sums = np.stack([kept[k] for k in fresh], axis=1)
            if _per_node(fit, features):
                sums = sums * _seen(fit, tree, fresh, features)[:, layout.owner]
            gain, at, left = best_splits(sums, np.array([grow.sums[k] for k in fresh]).T, layout, growth)
            for n, k in enumerate(fresh):
                grow.split[k] = (float(gain[n]), int(at[n]), left[:, n])
        new = grow.expand()
        if not new:
            out, home = grow.tree(layout)
            return out, rows.leaves(home)
        for k in new:
            rows.split(k, grow.split[k][1], grow.children[k])
        counted, rest = _to_count(grow, new)


def _fit_here(block: Block, layout: Layout, fit: Fit, first: int, last: int) -> tuple[list[Tree], np.ndarray]:
    """Trees ``first`` to ``last`` of a model on one block, and the sum of their values for each row. Boosting starts at its first tree."""
    total = np.zeros(len(block.label))
    out = []
    for tree in range(first, last):
        grown, leaf = _grow_here(block, layout, fit, tree, total)
        out.append(grown)
        total += grown.value[leaf]
    return out, total


# -- tables of blocks ----------------------------------------------------------------


def fit_layout(df: DataFrame, features: Sequence[str], bins: int = BINS) -> Layout:
    """Thresholds from the quantiles of all rows, in one pass; every value has its own bin where there are few."""
    shares = [k / bins for k in range(bins + 1)]
    row = df.agg(*[F.percentile_approx(f"`{f}`", shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return Layout(list(features), [np.unique(np.array(row[f"q{i}"] or [], float))[:-1] for i in range(len(features))])


_BLOCKS = "block bigint, rows int, bins binary, label binary, hash binary, fold binary"


def to_blocks(df: DataFrame, layout: Layout, label: str, ids: Sequence[str], fold: str | None = None, block_rows: int = BLOCK_ROWS,
              rows: int | None = None, folder: str | None = None) -> tuple[DataFrame, int]:
    """The rows as a written table of blocks of at most ``block_rows`` rows, and the number of blocks."""
    count = rows if rows is not None else df.count()
    block_rows = min(block_rows, max(1, BLOCK_BYTES // max(1, len(layout.features) * np.dtype(layout.kind).itemsize)))
    parts = max(1, -(-count // block_rows))
    if parts > 1:  # every core has as many blocks, if they do not get too small
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = max(parts, min(-(-parts // cores) * cores, count // LEAST_BLOCK_ROWS))
    listed = df.select(F.col(label).cast("double").alias("y"), row_hash(ids, 7).cast("bigint").alias("r"),
                       (F.col(fold).cast("int") if fold else F.lit(-1)).alias("f"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(layout.features)])
    listed = listed.repartition(parts, "r") if parts > 1 else listed

    def numbered(columns: Sequence[bytes], rows: int) -> pa.RecordBatch:
        number = int.from_bytes(blake2b(b"".join(columns), digest_size=8).digest()) >> 1  # of the block, from its rows
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]],
                                          [c.split()[0] for c in _BLOCKS.split(", ")])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            yield numbered([b"".join(r[c] for r in rows) for c in ("bins", "label", "hash", "fold")], sum(r["rows"] for r in rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(held)
            y, r, f, *x = (c.to_numpy() for c in t.columns)
            columns = (layout.bin(x).astype(layout.kind).tobytes(), y.tobytes(), r.view(np.uint64).tobytes(), f.astype(np.int32).tobytes())
            return numbered(columns, t.num_rows)

        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            while size >= block_rows:
                t = pa.concat_tables(held)
                yield packed([t.slice(0, block_rows)])
                held, size = [t.slice(block_rows)], size - block_rows
        if size:
            yield packed(held)

    binned = listed.mapInArrow(run, _BLOCKS)
    if parts == 1:  # binned where the rows are, then put together
        binned = binned.repartition(1).mapInArrow(one, _BLOCKS)
    blocks = materialise(binned, "blocks", folder)
    return blocks, blocks.count()


def _block(row: Mapping[str, object], features: int) -> Block:
    read = lambda c, kind: np.frombuffer(row[c], kind)
    kind = np.uint16 if len(row["bins"]) == 2 * features * row["rows"] else np.int32
    return Block(read("bins", kind).reshape(-1, features), read("label", np.float64), read("hash", np.uint64), read("fold", np.int32))


@dataclass
class Grown:
    """Models grown together: their trees by name (where asked for), and ``(model, p, label)`` of the rows each held out."""

    trees: dict[str, list[Tree]]
    scores: DataFrame | None


def grow(fits: Mapping[str, Fit], blocks: DataFrame, number: int, layout: Layout, scores: bool = False, folder: str | None = None) -> Grown:
    """Grow all models on a table of blocks; with ``scores`` the held-out rows are scored and no trees are returned."""
    if not number:
        raise ValueError("no rows to grow trees on")
    names = sorted(fits, key=lambda n: (-fits[n].growth.trees * min(fits[n].growth.max_depth, 16), n))
    ordered = {n: fits[n] for n in names}
    if number == 1:
        return _grow_dealt(ordered, blocks, layout, scores, folder)
    tasks = min(number, exchange.side_by_side(blocks.sparkSession))
    if tasks:
        rows = blocks.agg(F.sum("rows")).first()[0]
        widest = max(min(1 << min(f.growth.max_depth, 12), f.growth.max_leaves) for f in fits.values())
        room = OPEN_BYTES // (40 * -(-rows // tasks) + 48 * layout.total * widest)
        messages = f"{folder}/steps-{uuid.uuid4().hex}" if folder else scratch_path(blocks.sparkSession, "steps")
        if room and rows // tasks * (2 * len(layout.features) + 80) <= SIDE_BYTES and (address := exchange.opened(blocks.sparkSession, messages)):
            try:
                return _grow_in_step(ordered, blocks, layout, scores, folder, tasks, room, address)
            finally:
                remove(blocks.sparkSession, messages)
    return _grow_together(ordered, blocks, layout, scores, folder)


def _held_out(model: str, fit: Fit, block: Block, total: np.ndarray) -> pa.RecordBatch:
    out = np.flatnonzero(block.fold == fit.fold)
    p = total[out] / fit.growth.trees if fit.growth.forest else 1.0 / (1.0 + np.exp(-total[out]))
    return pa.RecordBatch.from_arrays([pa.array([model] * len(out), pa.string()), pa.array(p), pa.array(block.label[out].astype(np.int32))], ["model", "p", "label"])


def _grow_dealt(fits: Mapping[str, Fit], blocks: DataFrame, layout: Layout, scores: bool, folder: str | None) -> Grown:
    """All models on the only block, dealt over the tasks; the trees of a forest are dealt one by one unless its rows are scored."""
    spark, features = blocks.sparkSession, len(layout.features)
    cores = spark.sparkContext.defaultParallelism
    pieces = []
    for name, fit in fits.items():
        step = max(1, fit.growth.trees // (CHUNKS_PER_CORE * cores)) if fit.growth.forest and not scores else fit.growth.trees
        pieces += [(name, a, min(a + step, fit.growth.trees)) for a in range(0, fit.growth.trees, step)]
    chunks = min(len(pieces), cores * (CHUNKS_PER_CORE if blocks.agg(F.sum("rows")).first()[0] <= SMALL_ROWS else 1))  # each gets a copy
    dealt = [pieces[k::chunks] for k in range(chunks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _block(row, features)
                for name, first, last in dealt[row["chunk"]]:
                    trees, total = _fit_here(block, layout, fits[name], first, last)
                    if scores:
                        yield _held_out(name, fits[name], block, total)
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([pickle.dumps(trees)], pa.binary())], ["model", "first", "trees"])

    # One partition for each chunk, so that none waits for another's models.
    copies = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartitionByRange(chunks, "chunk")
    if scores:
        return Grown({}, materialise(copies.mapInArrow(run, "model string, p double, label int"), "held-out", folder))
    found = copies.mapInArrow(run, "model string, first bigint, trees binary").collect()
    out: dict[str, list[Tree]] = {name: [] for name in fits}
    for r in sorted(found, key=lambda r: (r["model"], r["first"])):
        out[r["model"]] += pickle.loads(r["trees"])
    return Grown(out, None)


# -- many blocks -----------------------------------------------------------------------


class _Part:
    """One task's side of a tree: its rows of each block, and the sums of all tasks for its share of the bins."""

    def __init__(self, blocks: Sequence[Block], layout: Layout, fit: Fit, tree: int, margins: Sequence[np.ndarray] | None) -> None:
        self.fit, self.tree, self.layout = fit, tree, layout
        self.grow = Growing(fit.growth)
        self.rows = [Rows(b, layout, fit, tree, None if margins is None else margins[n]) for n, b in enumerate(blocks)]
        self.kept: dict[int, np.ndarray] = {}
        self.counted, self.rest = [0], []

    def totals(self) -> np.ndarray:
        out = np.zeros(3, np.int64)
        for r in self.rows:
            out += np.array(r.totals()).astype(np.int64)
        return out

    def count(self) -> np.ndarray:
        out = np.zeros((3, len(self.counted), self.layout.total), np.int64)
        for r in self.rows if self.counted else ():
            out += r.count(self.counted).astype(np.int64)
        return out

    def best(self, sums: np.ndarray, own: Layout, first: int) -> np.ndarray:
        """For each node whose split is not known the best one of the task's own bins, which begin at ``first``: gain, bin, left sums."""
        self.kept.update(zip(self.counted, np.moveaxis(sums, 1, 0), strict=True))
        for large, small, parent in self.rest:
            self.kept[large] = self.kept[parent] - self.kept[small]
        for _, _, parent in self.rest:
            self.kept.pop(parent, None)
        fresh = self.grow.fresh()
        if not fresh or not own.total:
            return np.zeros((len(fresh), 5))
        sums = np.stack([self.kept[k] for k in fresh], axis=1)
        if _per_node(self.fit, len(self.layout.features)):
            seen = _seen(self.fit, self.tree, fresh, len(self.layout.features))
            sums = sums * seen[:, self.layout.owner[first:first + own.total]]
        gain, at, left = best_splits(sums, np.array([self.grow.sums[k] for k in fresh]).T, own, self.fit.growth)
        return np.stack([gain, at + first, *left], axis=1)

    def proceed(self, splits: np.ndarray) -> bool:
        """Take the splits of the nodes that had none; whether the tree grows on."""
        for k, (gain, at, *left) in zip(self.grow.fresh(), splits.tolist(), strict=True):
            self.grow.split[k] = (gain, int(at), np.array(left))
        new = []
        while now := self.grow.expand():
            for k in now:
                for r in self.rows:
                    r.split(k, self.grow.split[k][1], self.grow.children[k])
            new += now
            if self.grow.fresh():
                break
        self.counted, self.rest = _to_count(self.grow, new)
        return bool(self.counted)


def _shares(layout: Layout, tasks: int) -> list[tuple[int, int]]:
    """Features from and to, of each task: neighbours with about as many bins."""
    edges = np.searchsorted(layout.starts, [layout.total * k / tasks for k in range(tasks)] + [layout.total])
    return [(int(a), int(b)) for a, b in zip(edges, edges[1:])]


def _grow_in_step(fits: Mapping[str, Fit], blocks: DataFrame, layout: Layout, scores: bool, folder: str | None, tasks: int, room: int,
                  address: str) -> Grown:
    """Tasks that run side by side hold the blocks and grow all models, ``room`` trees at a time.

    A level has two steps. Each task counts its rows and hands the sums of every feature's bins to the task that has the
    feature; this one adds them, which makes the same whole numbers in any order, and hands all tasks the best split of each
    node among its features. The best of these is that of all features. So all tasks know the trees, and their rows' margins.
    """
    spark, features = blocks.sparkSession, len(layout.features)
    files = sorted(blocks.inputFiles())
    shares = _shares(layout, tasks)
    layouts = [Layout(layout.features[a:b], layout.thresholds[a:b]) for a, b in shares]
    firsts = np.append(layout.starts, layout.total)[[a for a, _ in shares]].tolist()
    units = [(n, 0) for n, f in fits.items() if not f.growth.forest and f.growth.trees]
    units += [(n, tree) for n, f in fits.items() if f.growth.forest for tree in range(f.growth.trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        context = BarrierTaskContext.get()
        me = context.partitionId()
        attempt = context.allGather(uuid.uuid4().hex)[0]  # a stage that runs again has a folder of its own
        line = exchange.Exchange(f"{address}/{attempt}", me, tasks)
        held: list[Block] = []
        for row in exchange.rows_of(files[me::tasks], ["rows", "bins", "label", "hash", "fold"]):
            held.append(_block(row, features))
            held[-1].coded(layout)
            held[-1].bins = None  # codes tell all
        margins: dict[str, list[np.ndarray]] = {}
        early: dict[str, dict[int, list[np.ndarray]]] = {n: {} for n in fits}  # a forest's trees are added in order
        added = dict.fromkeys(fits, 0)
        done: dict[str, dict[int, Tree]] = {n: {} for n in fits}
        waiting, going = deque(units), {}

        def start(name: str, tree: int) -> None:
            fit = fits[name]
            if name not in margins and (scores or not fit.growth.forest):
                margins[name] = [np.zeros(len(b.label)) for b in held]
            going[name, tree] = _Part(held, layout, fit, tree, None if fit.growth.forest else margins[name])

        def finish(name: str, tree: int) -> None:
            part = going.pop((name, tree))
            done[name][tree], home = part.grow.tree(layout)
            if name in margins:
                early[name][tree] = [done[name][tree].value[r.leaves(home)] for r in part.rows]
                while added[name] in early[name]:
                    for total, values in zip(margins[name], early[name].pop(added[name]), strict=True):
                        total += values
                    added[name] += 1
            if not fits[name].growth.forest and tree + 1 < fits[name].growth.trees:
                start(name, tree + 1)

        while going or waiting:
            while waiting and len(going) < room:
                start(*waiting.popleft())
            now = list(going.items())
            roots = [part.totals() for _, part in now if not part.grow.sums]
            counts = np.concatenate([part.count() for _, part in now], axis=1)
            n, head = counts.shape[1], 24 * len(roots)
            line.put(b"".join([np.array(roots, np.int64).tobytes(), *[counts[:, :, a:a + own.total].tobytes() for a, own in zip(firsts, layouts)]]))
            totals, sums = np.zeros((len(roots), 3), np.int64), np.zeros((3, n, layouts[me].total), np.int64)
            for top, own in line.parts((0, head), (head + 24 * n * firsts[me], 24 * n * layouts[me].total)):
                if top:
                    totals += np.frombuffer(top, np.int64).reshape(totals.shape)
                if own:
                    sums += np.frombuffer(own, np.int64).reshape(sums.shape)
            answers, place, known = [], 0, iter(totals.tolist())
            for _, part in now:
                if not part.grow.sums:
                    part.grow.add(next(known), 0)
                answers.append(part.best(sums[:, place:place + len(part.counted)], layouts[me], firsts[me]))
                place += len(part.counted)
            asked = np.concatenate(answers)
            line.put(asked.tobytes() if layouts[me].total else b"")
            best = np.full(asked.shape, -inf)
            for (message,) in line.parts():
                if message:
                    other = np.frombuffer(message).reshape(asked.shape)
                    best = np.where(other[:, :1] > best[:, :1], other, best)  # of equal gains the first feature's
            best[~np.isfinite(best[:, 0])] = (-inf, 0, 0, 0, 0)
            place = 0
            for (name, tree), part in now:
                open_nodes = len(part.grow.fresh())
                more = part.proceed(best[place:place + open_nodes])
                place += open_nodes
                if not more:
                    finish(name, tree)
                    if scores and len(done[name]) == fits[name].growth.trees:
                        totals_of = margins.pop(name)
                        for b, total in zip(held, totals_of, strict=True):
                            yield _held_out(name, fits[name], b, total)
        if scores:
            for name, fit in fits.items():
                for b in held if not fit.growth.trees else ():
                    yield _held_out(name, fit, b, np.zeros(len(b.label)))
        elif me == 0:
            for name, own in done.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pickle.dumps([own[k] for k in sorted(own)])], pa.binary())], ["model", "trees"])

    side = spark.range(0, tasks, 1, tasks)
    if scores:
        return Grown({}, materialise(side.mapInArrow(run, "model string, p double, label int", barrier=True), "held-out", folder))
    return Grown({r["model"]: pickle.loads(r["trees"]) for r in side.mapInArrow(run, "model string, trees binary", barrier=True).collect()}, None)


_kept: OrderedDict[tuple[str, int], tuple[Block, np.ndarray, list[int]]] = OrderedDict()


def _caught_up(run: str, batch: pa.RecordBatch, at: int, features: int, written: Sequence[int], late: Sequence[Sequence[tuple]]) -> tuple[Block, np.ndarray]:
    """A block and its margins, a row for each boosted model. The table has those of the first ``written`` trees of each, ``late``
    are the trees since. What a worker still knows of a block, it goes on from; that saves time and changes nothing."""
    key, read = (run, batch.column("block")[at].as_py()), lambda c: batch.column(c)[at].as_py()
    block, margins, known = _kept.pop(key, (None, None, None))
    if block is None or any(k < w for k, w in zip(known, written, strict=True)):
        block = block or _block({c: read(c) for c in ("rows", "bins", "label", "hash", "fold")}, features)
        stored = read("margins")
        margins = np.frombuffer(stored).reshape(len(written), -1).copy() if stored else np.zeros((len(written), len(block.label)))
        known = list(written)
    for n, trees in enumerate(late):
        for moves, home, value in trees[known[n] - written[n]:]:
            node = np.zeros(len(block.label), np.int64)
            for m in moves:
                _move(block.bins, node, m)
            margins[n] += value[home[node]]
        known[n] = written[n] + len(trees)
    _kept[key] = (block, margins, known)
    size = sum(b.bins.nbytes + 20 * len(b.label) + m.nbytes for b, m, _ in _kept.values())
    while size > KEPT_BYTES:
        b, m, _ = _kept.popitem(last=False)[1]
        size -= b.bins.nbytes + 20 * len(b.label) + m.nbytes
    return block, margins


def _grow_together(fits: Mapping[str, Fit], blocks: DataFrame, layout: Layout, scores: bool, folder: str | None) -> Grown:
    """All models take a level at a time: one pass over the blocks counts, each node's sums meet in one group, which chooses its split.

    The trees of a forest do not depend on each other and grow side by side, as many as a task has room to count for. A boosted model's
    margins follow from its trees; every ``MARGIN_TREES`` trees a table that has them beside the blocks is written.
    """
    spark, features, run = blocks.sparkSession, len(layout.features), uuid.uuid4().hex
    boosted = [n for n, f in fits.items() if not f.growth.forest]
    place = {n: k for k, n in enumerate(boosted)}
    done: dict[str, dict[int, Tree]] = {n: {} for n in fits}
    going: dict[tuple[str, int], Growing] = {(n, 0): Growing(fits[n].growth) for n in boosted if fits[n].growth.trees}
    waiting = [(n, tree) for n, f in fits.items() if f.growth.forest for tree in range(f.growth.trees)][::-1]
    widest = max((1 << min(f.growth.max_depth - 1, 12) for f in fits.values() if f.growth.forest), default=1)
    room = max(1, OPEN_BYTES // (24 * layout.total * max(1, widest)))

    state = blocks.withColumn("margins", F.lit(None).cast("binary"))
    kinds = "block bigint, rows int, bins binary, label binary, hash binary, fold binary, margins binary"
    written, late = [0] * len(boosted), [[] for _ in boosted]

    while going or waiting:
        for _ in range(min(len(waiting), room - sum(fits[n].growth.forest for n, _ in going))):
            name, tree = waiting.pop()
            going[name, tree] = Growing(fits[name].growth)
        asked = {key: (np.array(g.fresh()), [g.moves(layout, level) for level in _levels(g)]) for key, g in going.items()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    block, margins = _caught_up(run, batch, at, features, written, late)
                    for (name, tree), (fresh, moves) in asked.items():
                        fit = fits[name]
                        times = _drawn(block, fit, tree)
                        g, h = _gradients(block, fit, None if fit.growth.forest else margins[place[name]], times)
                        node = np.zeros(len(block.label), np.int64)
                        for m in moves:
                            _move(block.bins, node, m)
                        wanted = fresh if len(fresh) else np.array([0])  # a new tree asks for its root
                        slots = np.full(max(int(node.max(initial=0)), int(wanted.max())) + 1, -1, np.int64)
                        slots[wanted] = np.arange(len(wanted))
                        rows = np.flatnonzero((times > 0) & (slots[node] >= 0))
                        per_node = fit.growth.node_columns and fit.growth.node_columns < features
                        seen = np.zeros((len(wanted), features), bool)
                        if per_node:
                            np.put_along_axis(seen, _node_columns(fit, tree, wanted, features), True, axis=1)
                        else:
                            seen[:, _tree_columns(fit, tree, features)] = True
                        sums = histograms(block.coded(layout), layout, seen.any(axis=0), rows, slots[node[rows]], len(wanted), g[rows], h[rows]).astype(np.int64)
                        if per_node:
                            sums *= seen[:, layout.owner]
                        held[name, tree] = held[name, tree] + sums if (name, tree) in held else sums
            for (name, tree), sums in held.items():
                out = []
                for n, k in enumerate((asked[name, tree][0] if len(asked[name, tree][0]) else np.array([0])).tolist()):
                    at = np.flatnonzero(sums[2, n])
                    if len(at):
                        out.append((k, np.concatenate([at[None], sums[:, n, at]]).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(out)), pa.array(np.full(len(out), tree)), pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())],
                        ["model", "tree", "node", "sums"])

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            # A group is one node: a row for each task that has rows of it.
            name = key[0].as_py()
            whole = np.zeros((3, layout.total), np.int64)
            for part in table.column("sums"):
                at, *rest = np.frombuffer(part.as_buffer(), np.int64).reshape(4, -1)
                whole[:, at] += rest
            one = layout.owner[np.flatnonzero(whole[2])[0]]
            totals = whole[:, layout.owner == one].sum(axis=1).astype(np.float64)
            gain, best, left = best_splits(whole[:, None], totals[:, None], layout, fits[name].growth)
            values = [gain[0], float(best[0]), *left[:, 0].astype(np.float64), *totals]
            return pa.table([pa.array([k.as_py()]) for k in key] + [pa.array([values], pa.list_(pa.float64()))], ["model", "tree", "node", "found"])

        counted = state.mapInArrow(count, "model string, tree bigint, node bigint, sums binary")
        found = counted.groupBy("model", "tree", "node").applyInArrow(choose, "model string, tree bigint, node bigint, found array<double>").collect()
        seen = {(r["model"], r["tree"], r["node"]): r["found"] for r in found}  # one row for each open node
        finished = []
        for (name, tree), g in list(going.items()):
            if not g.sums:
                root = seen.get((name, tree, 0))
                g.add(root[5:8] if root else (0.0, 0.0, 0), 0)
            for k in g.fresh():
                v = seen.get((name, tree, k))
                g.split[k] = (v[0], int(v[1]), np.array(v[2:5])) if v else (-inf, 0, None)
            if not g.expand() or not g.fresh():
                while g.expand():  # children that are all closed
                    pass
                finished.append((name, tree))
        for name, tree in finished:
            g = going.pop((name, tree))
            done[name][tree], home = g.tree(layout)
            if not fits[name].growth.forest:
                late[place[name]].append(([g.moves(layout, level) for level in _levels(g)], home, done[name][tree].value))
                if tree + 1 < fits[name].growth.trees:
                    going[name, tree + 1] = Growing(fits[name].growth)
        if any(len(x) >= MARGIN_TREES for x in late) and (scores or going):
            def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(batch.num_rows):
                        margins = _caught_up(run, batch, at, features, written, late)[1]
                        yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, 1) for c in batch.schema.names[:-1]], pa.array([margins.tobytes()], pa.binary())], batch.schema.names)

            state = materialise(state.mapInArrow(apply, kinds), "margins", folder)
            written, late = [w + len(x) for w, x in zip(written, late, strict=True)], [[] for _ in boosted]
    trees = {n: [done[n][k] for k in sorted(done[n])] for n in fits}
    if not scores:
        return Grown(trees, None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block, margins = _caught_up(run, batch, at, features, written, late)
                codes = block.bins - layout.starts
                for name, fit in fits.items():
                    if fit.growth.forest:
                        total = np.zeros(len(block.label))
                        for t in trees[name]:
                            total += t.value[_coded(t, layout).leaves(codes)]
                    else:
                        total = margins[place[name]]
                    yield _held_out(name, fit, block, total)

    return Grown(trees, materialise(state.mapInArrow(score, "model string, p double, label int"), "held-out", folder))


def _coded(tree: Tree, layout: Layout) -> Tree:
    """The tree over bin numbers within a feature instead of values."""
    inner = tree.feature >= 0
    cut = np.zeros(len(tree.feature))
    for k in np.flatnonzero(inner):
        cut[k] = np.searchsorted(layout.thresholds[tree.feature[k]], tree.threshold[k], "left")
    return replace(tree, threshold=cut)


def _levels(g: Growing) -> list[list[int]]:
    """Split nodes by depth: rows move through them level by level."""
    out: dict[int, list[int]] = {}
    for k, c in enumerate(g.children):
        if c:
            out.setdefault(g.depth[k], []).append(k)
    return [out[d] for d in sorted(out)]
