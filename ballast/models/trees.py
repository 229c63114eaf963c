"""Forests and boosted trees grown from counts over binned rows.

What grows a tree only ever asks for sums over blocks of rows and learns nothing else of the table. A table
that fits a task is one block and is grown in one task, without a job for each level; a larger one answers
every question with a job over all its blocks. The sums are of whole numbers, so both give the same trees,
however the rows lie (boosted trees up to 2 million rows; beyond, up to the last digits of sums).

The trees are those of Spark's estimators, with their parameters, and the fitted model is Spark's own.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.session import materialize, scratch_path

TASK_BYTES = 64 << 20  # of features of a table grown in one task
TREES_AT_ONCE = 10  # of a forest grown by jobs
NODES_AT_ONCE = 2048  # of one tree whose counts are laid out at a time
ROWS_AT_ONCE = 4096  # of a block counted over all features at a time
CUT_LINEAGE = 10  # boosted trees between two checkpoints
SCALE = float(1 << 30)  # residuals are counted in this fraction of 1
OPEN, LEAF = -2, -1
NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
    "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)
BLOCKS = "bins binary, label binary, key binary, margin binary"


@dataclass
class Ask:
    """A question to every block; the answers are added up."""

    of: Callable
    add: Callable = add


@dataclass
class Change:
    """What every block has to do before the next question."""

    of: Callable


@dataclass
class Block:
    """Rows as bin numbers, with their labels and hashed ids; ``memo`` is only there to save work."""

    bins: np.ndarray
    label: np.ndarray
    key: np.ndarray
    margin: np.ndarray | None = None
    memo: dict = field(default_factory=dict)


@dataclass
class Tree:
    """Nodes in the order they were made; a right child follows its left one."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    left: np.ndarray  # the left child, or OPEN or LEAF
    gain: np.ndarray
    stats: np.ndarray  # rows of each class, or rows and the sum of their residuals

    @staticmethod
    def root(width: int) -> Tree:
        return Tree(np.zeros(1, int), np.zeros(1, int), np.full(1, OPEN), np.full(1, -1.0), np.zeros((1, width)))

    def open(self) -> np.ndarray:
        return np.flatnonzero(self.left == OPEN)

    def split(self, nodes: np.ndarray, split: Split, open_child: Callable) -> None:
        """Make children of the nodes that gain; the others become leaves."""
        self.stats[nodes] = split.stats
        self.left[nodes] = LEAF
        at = np.flatnonzero(split.gains)
        chosen, n = nodes[at], len(self.left)
        self.feature[chosen], self.cut[chosen], self.gain[chosen] = split.feature[at], split.cut[at], split.gain[at]
        self.left[chosen] = n + 2 * np.arange(len(at))
        stats = np.stack([split.below[at], split.stats[at] - split.below[at]], axis=1).reshape(2 * len(at), self.stats.shape[1])
        self.feature, self.cut = (np.concatenate([a, np.zeros(2 * len(at), int)]) for a in (self.feature, self.cut))
        self.left = np.concatenate([self.left, np.where(open_child(stats), OPEN, LEAF)])
        self.gain = np.concatenate([self.gain, np.full(2 * len(at), -1.0)])
        self.stats = np.concatenate([self.stats, stats])


def pruned(tree: Tree, prediction: np.ndarray) -> Tree:
    """Without splits whose two leaves predict the same, as Spark prunes them."""
    left = tree.left.copy()
    while True:
        inner = np.flatnonzero(left >= 0)
        a, b = left[inner], left[inner] + 1
        same = (left[a] < 0) & (left[b] < 0) & (prediction[a] == prediction[b])
        if not same.any():
            break
        left[inner[same]] = LEAF
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for node in np.flatnonzero(left >= 0):  # children come after their parents
        kept[left[node]] = kept[left[node] + 1] = kept[node]
    place = np.cumsum(kept) - 1
    left = np.where(left >= 0, place[left], LEAF)
    gain = np.where(left >= 0, tree.gain, -1.0)
    return Tree(tree.feature[kept], tree.cut[kept], left[kept], gain[kept], tree.stats[kept])


@dataclass
class Split:
    """The best split of each node."""

    gains: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    below: np.ndarray
    stats: np.ndarray


# Where the bins end


def keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def values(key: np.ndarray) -> np.ndarray:
    return np.where(key >> np.uint64(63) == 1, key & np.uint64((1 << 63) - 1), ~key).view(np.float64)


def few_values(x: np.ndarray, most: int) -> list:
    """The different values of each column, None where there are more than ``most``."""
    found = [np.unique(column + 0.0) for column in x.T]
    return [v if len(v) <= most else None for v in found]


def joined(a: list, b: list, most: int) -> list:
    both = [None if v is None or w is None else np.union1d(v, w) for v, w in zip(a, b)]
    return [v if v is None or len(v) <= most else None for v in both]


def byte_counts(x: np.ndarray, shift: int, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Rows by the next byte of their key, for each wanted beginning of a key."""
    out = {}
    for j, starts in wanted.items():
        key = keys(np.ascontiguousarray(x[:, j]))
        start = key >> np.uint64(shift + 8) if shift < 56 else np.zeros(len(key), np.uint64)
        at = np.minimum(np.searchsorted(starts, start), len(starts) - 1)
        hit = starts[at] == start
        cells = at[hit] * 256 + (key[hit] >> np.uint64(shift) & np.uint64(255)).astype(int)
        out[j] = np.bincount(cells, minlength=len(starts) * 256).reshape(-1, 256)
    return out


def added(a: dict, b: dict) -> dict:
    return {j: a[j] + b[j] for j in a}


def ranked(ranks: list[tuple[int, int]], ordered: np.ndarray | None) -> Generator:
    """By (column, rank): the value at the rank (from 1), the rows below it and the rows that have it."""
    if ordered is not None:
        out = {}
        for j, rank in ranks:
            v = ordered[rank - 1, j]
            below, upto = (int(np.searchsorted(ordered[:, j], v, side)) for side in ("left", "right"))
            out[j, rank] = float(v), below, upto - below
        return out
    found = {(j, rank): (0, rank, 0) for j, rank in ranks}  # beginning of the key, rank within it, rows
    for shift in range(56, -1, -8):
        wanted: dict[int, set] = {}
        for (j, _), (start, _, _) in found.items():
            wanted.setdefault(j, set()).add(start)
        starts = {j: np.array(sorted(s), np.uint64) for j, s in wanted.items()}
        counts = yield Ask(partial(byte_counts, shift=shift, wanted=starts), added)
        for (j, rank), (start, within, _) in found.items():
            row = counts[j][np.searchsorted(starts[j], np.uint64(start))]
            upto = np.cumsum(row)
            byte = int(np.searchsorted(upto, within))
            found[j, rank] = start << 8 | byte, within - int(upto[byte] - row[byte]), int(row[byte])
    return {(j, rank): (float(values(np.array([key], np.uint64))[0]), rank - within, n) for (j, rank), (key, within, n) in found.items()}


def middle(a: float, b: float) -> float:
    return m if a <= (m := a / 2 + b / 2) < b else a


def find_cuts(n: int, width: int, bins: int, ordered: np.ndarray | None = None) -> Generator:
    """At most ``bins - 1`` cuts a column: between all values where there are few, else between equal shares of the rows."""
    few = yield Ask(partial(few_values, most=bins), partial(joined, most=bins))
    cuts = {j: [middle(a, b) for a, b in zip(v, v[1:])] for j, v in enumerate(few) if v is not None}
    many = [j for j in range(width) if j not in cuts]
    goals = [i * n / bins for i in range(1, bins)]
    at = yield from ranked([(j, math.ceil(g)) for j in many for g in goals], ordered)
    edges: dict[int, set] = {j: set() for j in many}  # rows below a cut
    for (j, _), goal in zip(((j, g) for j in many for g in goals), goals * len(many)):
        _, below, same = at[j, math.ceil(goal)]
        edges[j].add(min((e for e in (below, below + same) if 0 < e < n), key=lambda e: (abs(e - goal), -e)))
    near = yield from ranked([(j, r) for j in many for e in sorted(edges[j]) for r in (e, e + 1)], ordered)
    for j in many:
        cuts[j] = [middle(near[j, e][0], near[j, e + 1][0]) for e in sorted(edges[j])]
    return [np.array(cuts[j], float) for j in range(width)]


def binned(x: np.ndarray, label: np.ndarray, key: np.ndarray, cuts: list[np.ndarray]) -> Block:
    small = np.uint8 if all(len(c) < 256 for c in cuts) else np.uint16
    bins = np.stack([np.searchsorted(c, np.ascontiguousarray(column)).astype(small) for c, column in zip(cuts, x.T)], axis=1)
    return Block(bins, label.astype(np.int64), key.view(np.uint64))


# Chance, which follows from the ids of the rows


def uniform(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row and tree."""
    with np.errstate(over="ignore"):
        z = key ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def drawn(key: np.ndarray, seed: int, tree: int, rate: float, replace: bool) -> np.ndarray:
    """The places of the rows a tree is grown on, as often as it is."""
    if not replace:
        return np.arange(len(key)) if rate >= 1 else np.flatnonzero(uniform(key, seed, tree) < rate)
    terms = np.cumprod([1.0, *rate / np.arange(1.0, 30)])
    times = np.searchsorted(np.cumsum(terms) * np.exp(-rate), uniform(key, seed, tree), side="right")
    return np.repeat(np.arange(len(key)), times)


def features_per_node(strategy: str, width: int, trees: int) -> int:
    """How many features a node chooses from, by the names Spark gives."""
    strategy = {"auto": "sqrt" if trees > 1 else "all"}.get(strategy, strategy)
    named = {"all": width, "sqrt": np.ceil(np.sqrt(width)), "log2": max(1, np.ceil(np.log2(width))), "onethird": np.ceil(width / 3)}
    if strategy in named:
        return int(named[strategy])
    return min(width, int(strategy)) if strategy.isdigit() else int(np.ceil(float(strategy) * width))


# Growing


def settled(block: Block, tree: Tree, number: int, draw: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The drawn rows that are still in open nodes, and those nodes."""
    rows, node = block.memo.get(number) or (drawn(block.key, tree=number, **draw), None)
    node = np.zeros(len(rows), int) if node is None else node
    while len(rows):
        child = tree.left[node]
        moving = child >= 0
        if not moving.any():
            break
        node = np.where(moving, child + (block.bins[rows, tree.feature[node]] > tree.cut[node]), node)
        stays = tree.left[node] != LEAF
        rows, node = rows[stays], node[stays]
    block.memo[number] = rows, node
    return rows, node


def among(nodes: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows are in one of the nodes, and in which."""
    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
    here = nodes[at] == node
    return here, at[here]


def class_counts(block: Block, asked: list[tuple], bins: int, classes: int, draw: dict) -> np.ndarray:
    """For each tree, class, node and feature the node chooses from: rows by bin."""
    for number in set(block.memo) - {a[0] for a in asked}:
        del block.memo[number]
    out = []
    for number, tree, nodes, chosen in asked:
        rows, node = settled(block, tree, number, draw)
        here, at = among(nodes, node)
        rows, width = rows[here], chosen.shape[1]
        cells = (at[:, None] * width + np.arange(width)) * bins + block.bins[rows[:, None], chosen[at]]
        size = len(nodes) * width * bins
        cells += block.label[rows][:, None] * size
        out.append(np.bincount(cells.ravel(), minlength=size * classes))
    return np.concatenate(out)


def best_of_classes(counts: np.ndarray, chosen: np.ndarray, least: int, least_gain: float) -> Split:
    """By Gini impurity."""
    upto = np.cumsum(counts, axis=3, dtype=float)
    total, below = upto[:, :, :1, -1:], upto[..., :-1]
    above = total - below
    n, low, high = total.sum(0), below.sum(0), above.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((below * below).sum(0) / low + (above * above).sum(0) / high - (total * total).sum(0) / n) / n
    gain[(low < least) | (high < least)] = -1.0
    return chosen_split(gain, np.moveaxis(below, 0, -1), total[:, :, 0, 0].T, chosen, 1e-12, least_gain)


def chosen_split(gain: np.ndarray, below: np.ndarray, stats: np.ndarray, chosen: np.ndarray | None, floor, least_gain: float) -> Split:
    nodes, cuts = np.arange(len(gain)), gain.shape[2]
    best = gain.reshape(len(gain), -1).argmax(1) if cuts else np.zeros(len(gain), int)
    feature, cut = np.divmod(best, max(1, cuts))
    most = gain[nodes, feature, cut] if cuts else np.full(len(gain), -1.0)
    under = below[nodes, feature, cut] if cuts else stats
    return Split((most > floor) & (most >= least_gain), feature if chosen is None else chosen[nodes, feature], cut, most, under, stats)


def grow_forest(p: dict, width: int, classes: int, at_once: int) -> Generator:
    """A forest; trees grown together do not change each other."""
    m, bins = features_per_node(p["featureSubsetStrategy"], width, p["numTrees"]), p["maxBins"]
    draw = {"seed": p["seed"], "rate": p["subsamplingRate"], "replace": p["bootstrap"]}

    def open_child(depth: int):
        return lambda stats: (depth < p["maxDepth"]) & (stats.max(1) < stats.sum(1)) & (stats.sum(1) >= 2 * p["minInstancesPerNode"])

    trees = []
    for first in range(0, p["numTrees"], at_once):
        group = [(t, Tree.root(classes), np.random.default_rng([p["seed"] & (1 << 64) - 1, t])) for t in range(first, min(first + at_once, p["numTrees"]))]
        for depth in range(p["maxDepth"] + 1):
            waiting = {t: tree.open() for t, tree, _ in group}
            while any(len(nodes) for nodes in waiting.values()):
                asked = []
                for t, tree, chance in group:
                    nodes, waiting[t] = waiting[t][:NODES_AT_ONCE], waiting[t][NODES_AT_ONCE:]
                    if len(nodes):
                        chosen = np.sort(np.argsort(chance.random((len(nodes), width)), axis=1)[:, :m], axis=1) if m < width else np.tile(np.arange(width), (len(nodes), 1))
                        asked.append((t, tree, nodes, chosen))
                counts, start = (yield Ask(partial(class_counts, asked=asked, bins=bins, classes=classes, draw=draw))), 0
                for _, tree, nodes, chosen in asked:
                    size = len(nodes) * m * bins * classes
                    own = counts[start : start + size].reshape(classes, len(nodes), m, bins)
                    start += size
                    split = best_of_classes(own, chosen, p["minInstancesPerNode"], p["minInfoGain"])
                    split.gains &= depth < p["maxDepth"]
                    tree.split(nodes, split, open_child(depth + 1))
        trees += [tree for _, tree, _ in group]
    return trees


def residuals(block: Block) -> np.ndarray:
    """What the next tree is to tell: the label as 1 or -1 at first, then the slope of the logistic loss."""
    if "residuals" not in block.memo:
        y = 2.0 * block.label - 1
        left = y if block.margin is None else 4 * y / (1 + np.exp(np.minimum(2 * y * block.margin, 700)))
        block.memo["residuals"] = np.rint(left * SCALE)
    return block.memo["residuals"]


def residual_sums(block: Block, number: int, tree: Tree, nodes: np.ndarray, bins: int, draw: dict) -> np.ndarray:
    """For each node and feature: rows and the sum of their residuals by bin."""
    rows, node = settled(block, tree, number, draw)
    here, at = among(nodes, node)
    rows, left, width = rows[here], residuals(block), block.bins.shape[1]
    if "cells" not in block.memo:
        block.memo["cells"] = block.bins + (np.arange(width) * bins).astype(np.int32)
    out = np.zeros((2, len(nodes) * width * bins))
    for start in range(0, len(rows), ROWS_AT_ONCE):
        some = rows[start : start + ROWS_AT_ONCE]
        cells = (at[start : start + ROWS_AT_ONCE, None] * (width * bins) + block.memo["cells"][some]).ravel()
        out[0] += np.bincount(cells, minlength=out.shape[1])
        out[1] += np.bincount(cells, np.repeat(left[some], width), out.shape[1])
    return out.reshape(2, len(nodes), width, bins)


def add_tree(block: Block, tree: Tree, weight: float) -> Block:
    """Move every row by what the tree says."""
    node = np.zeros(len(block.label), int)
    while ((child := tree.left[node]) >= 0).any():
        node = np.where(child >= 0, child + (block.bins[np.arange(len(node)), tree.feature[node]] > tree.cut[node]), node)
    block.margin = (0.0 if block.margin is None else block.margin) + weight * told(tree)[node]
    block.memo = {k: v for k, v in block.memo.items() if k == "cells"}
    return block


def told(tree: Tree) -> np.ndarray:
    """The mean residual of each node."""
    return tree.stats[:, 1] / np.maximum(tree.stats[:, 0], 1) / SCALE


def best_of_sums(sums: np.ndarray, usable: np.ndarray | None, least: int, least_gain: float) -> Split:
    """By variance."""
    upto = np.cumsum(np.moveaxis(sums, 0, -1), axis=2)
    total, below = upto[:, :1, -1:], upto[:, :, :-1]
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = total[..., 1] ** 2 / total[..., 0]
        gain = below[..., 1] ** 2 / below[..., 0] + above[..., 1] ** 2 / above[..., 0] - whole
        gain = np.where((below[..., 0] >= least) & (above[..., 0] >= least) & (gain > 1e-12 * whole), gain / total[..., 0] / SCALE**2, -1.0)
    if usable is not None:
        gain = np.where(usable[:, :, None], gain, -1.0)
    return chosen_split(gain, below, total[:, 0, 0], None, 0.0, least_gain)


def grow_boosted(p: dict, width: int) -> Generator:
    """Trees one after the other, each on what the ones before leave."""
    m, bins = features_per_node(p["featureSubsetStrategy"], width, 1), p["maxBins"]
    draw, trees = {"seed": p["seed"], "rate": p["subsamplingRate"], "replace": False}, []
    for number in range(p["maxIter"]):
        tree, chance, known = Tree.root(2), np.random.default_rng([p["seed"] & (1 << 64) - 1, number]), {}
        for depth in range(p["maxDepth"] + 1):
            nodes = tree.open()
            if not len(nodes):
                break
            if not depth:
                sums = yield Ask(partial(residual_sums, number=number, tree=tree, nodes=nodes, bins=bins, draw=draw))
            else:
                sums = yield from level_sums(tree, nodes, known, partial(residual_sums, number=number, tree=tree, bins=bins, draw=draw))
            usable = None
            if m < width:
                usable = np.argsort(np.argsort(chance.random((len(nodes), width)), axis=1), axis=1) < m
            split = best_of_sums(sums, usable, p["minInstancesPerNode"], p["minInfoGain"])
            split.gains &= depth < p["maxDepth"]
            deeper = depth + 1 < p["maxDepth"]
            tree.split(nodes, split, lambda stats: deeper & (stats[:, 0] >= 2 * p["minInstancesPerNode"]))
            known = {int(tree.left[n]): sums[:, i] for i, n in enumerate(nodes) if tree.left[n] >= 0}
        trees.append(tree)
        if number + 1 < p["maxIter"]:
            yield Change(partial(add_tree, tree=tree, weight=p["stepSize"] if number else 1.0))
    return trees


def level_sums(tree: Tree, nodes: np.ndarray, known: dict[int, np.ndarray], of: Callable) -> Generator:
    """Sums of each open node: of two children the smaller is counted, the other is what the parent has more."""
    is_open = set(nodes.tolist())
    pairs = [(a, a + 1) if tree.stats[a, 0] <= tree.stats[a + 1, 0] else (a + 1, a) for a in known if a in is_open or a + 1 in is_open]
    # A closed child has no rows left to count, so its sibling is counted itself.
    counted = np.array(sorted(s if s in is_open and b in is_open else (s if s in is_open else b) for s, b in pairs))
    sums = yield Ask(partial(of, nodes=counted))
    place = {int(n): i for i, n in enumerate(counted)}
    out = []
    for n in nodes.tolist():
        if n in place:
            out.append(sums[:, place[n]])
        else:
            sibling = n + 1 if n in known else n - 1
            out.append(known[min(n, sibling)] - sums[:, place[sibling]])
    return np.stack(out, axis=1)


# Answering


def answered(growing: Generator, blocks: list) -> object:
    """Let blocks at hand answer; returns what has grown."""
    try:
        asked = next(growing)
        while True:
            if isinstance(asked, Change):
                blocks[:] = [asked.of(b) for b in blocks]
                asked = growing.send(None)
            else:
                asked = growing.send(reduce(asked.add, [asked.of(b) for b in blocks]))
    except StopIteration as end:
        return end.value


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, label, key = batch.columns
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), label.to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False)


def grown_in_task(batches: Iterable[pa.RecordBatch], grow: Callable, n: int, width: int, bins: int, laid_out: Callable) -> Iterator[pa.RecordBatch]:
    read = [arrays(b) for b in batches if b.num_rows]
    if not read:
        return
    x, label, key = (np.concatenate(parts) for parts in zip(*read))
    del read
    cuts = answered(find_cuts(n, width, bins, np.sort(x, axis=0)), [x])
    block = binned(x, label, key, cuts)
    del x
    for number, tree in enumerate(answered(grow(at_once=1), [block])):
        yield laid_out(number, tree, cuts)


def packed(block: Block) -> list[bytes]:
    return [a.tobytes() for a in (block.bins, block.label, block.key, np.zeros(0) if block.margin is None else block.margin)]


def unpacked(row: dict, width: int) -> Block:
    label = np.frombuffer(row["label"], np.int64)
    bins = np.frombuffer(row["bins"], np.uint8 if len(row["bins"]) == len(label) * width else np.uint16).reshape(-1, width)
    margin = np.frombuffer(row["margin"], float)
    return Block(bins, label, np.frombuffer(row["key"], np.uint64), margin if len(margin) else None)


def as_rows(blocks: Iterable[Block]) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in packed(block)], names=[f.split()[0] for f in BLOCKS.split(", ")])


def summed(frame: DataFrame, read: Callable, asked: Ask) -> object:
    """The answers of all blocks, added up in each task first."""
    def answer(batches):
        found = [asked.of(b) for batch in batches for b in read(batch)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(reduce(asked.add, found))], pa.binary())], names=["sums"])

    return reduce(asked.add, [cloudpickle.loads(r.sums) for r in frame.mapInArrow(answer, "sums binary").toLocalIterator()])


def grown_by_jobs(rows: DataFrame, grow: Callable, n: int, width: int, bins: int) -> tuple[list[Tree], list[np.ndarray]]:
    growing, cuts = find_cuts(n, width, bins), None
    try:
        asked = next(growing)
        while True:
            asked = growing.send(summed(rows, lambda batch: [arrays(batch)[0]] if batch.num_rows else [], asked))
    except StopIteration as end:
        cuts = end.value
    held = rows.mapInArrow(lambda batches: as_rows(binned(*arrays(b), cuts) for b in batches if b.num_rows), BLOCKS).persist()

    def read(batch):
        return [unpacked(row, width) for row in batch.to_pylist()]

    growing, changes = grow(at_once=TREES_AT_ONCE), 0
    try:
        asked = next(growing)
        while True:
            if isinstance(asked, Change):
                before, changes, of = held, changes + 1, asked.of
                moved = held.mapInArrow(lambda batches, of=of: as_rows(of(b) for batch in batches for b in read(batch)), BLOCKS)
                held = materialize(moved) if changes % CUT_LINEAGE == 0 else moved.persist()
                held.count()
                before.unpersist()
                asked = growing.send(None)
            else:
                asked = growing.send(summed(held, read, asked))
    except StopIteration as end:
        return end.value, cuts
    finally:
        held.unpersist()


# The model


def node_rows(number: int, tree: Tree, cuts: list[np.ndarray], prediction: np.ndarray, impurity: np.ndarray, stats: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """The nodes of a tree as Spark stores them."""
    n, inner = len(tree.left), tree.left >= 0

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.float64()))

    limit = np.array([cuts[f][c] for f, c in zip(tree.feature[inner], tree.cut[inner])], float)
    ints = partial(pa.array, type=pa.int32())
    split = pa.StructArray.from_arrays(
        [ints(np.where(inner, tree.feature, -1)), lists(limit, inner.astype(int)), ints(np.full(n, -1))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"]
    )
    fields = {
        "id": ints(np.arange(n)),
        "prediction": pa.array(prediction, pa.float64()),
        "impurity": pa.array(impurity, pa.float64()),
        "impurityStats": lists(stats.ravel(), np.full(n, stats.shape[1])),
        "rawCount": pa.array(count.astype(np.int64)),
        "gain": pa.array(tree.gain),
        "leftChild": ints(np.where(inner, tree.left, -1)),
        "rightChild": ints(np.where(inner, tree.left + 1, -1)),
        "split": split,
    }
    nodes = pa.StructArray.from_arrays([*fields.values()], [*fields])
    return pa.RecordBatch.from_arrays([ints(np.full(n, number)), nodes], ["treeID", "nodeData"])


def forest_nodes(number: int, tree: Tree, cuts: list[np.ndarray]) -> pa.RecordBatch:
    tree = pruned(tree, tree.stats.argmax(1))
    n = tree.stats.sum(1)
    gini = 1 - ((tree.stats / n[:, None]) ** 2).sum(1)
    return node_rows(number, tree, cuts, tree.stats.argmax(1), gini, tree.stats, n)


def boosted_nodes(number: int, tree: Tree, cuts: list[np.ndarray]) -> pa.RecordBatch:
    """The variance within a node is not kept."""
    tree = pruned(tree, told(tree))
    n, mean = tree.stats[:, 0], told(tree)
    return node_rows(number, tree, cuts, mean, np.zeros(len(n)), np.stack([n, n * mean, n * mean**2], axis=1), n)


def fitted(estimator, dataset: DataFrame, grower: Callable, laid_out: Callable, model: type, tree_class: str, weight: Callable) -> object:
    """Grow the trees and hand them to Spark in the files in which it stores a model."""
    spark, uses = dataset.sparkSession, estimator.isDefined(estimator.weightCol)
    if uses and estimator.getWeightCol():
        raise ValueError("trees are grown without weights")
    p = {param.name: value for param, value in estimator.extractParamMap().items()}
    x, label = vector_to_array(estimator.getFeaturesCol()), F.col(estimator.getLabelCol()).cast("double")
    key = F.xxhash64("row_id") if "row_id" in dataset.columns else F.xxhash64(x)
    rows = dataset.select(x.alias("x"), label.alias("label"), key.alias("key"))
    odd = F.col("label").isNull() | (F.col("label") < 0) | (F.col("label") % 1 != 0)
    n, width, top, unusable = rows.agg(F.count("*"), F.max(F.size("x")), F.max("label"), F.count_if(odd)).first()
    if not n or unusable or (top > 1 and model is GBTClassificationModel):
        raise ValueError("trees need rows, with labels that count from 0; boosted trees know 0 and 1 only")
    p["maxBins"] = bins = max(2, min(p["maxBins"], n))
    classes, count = int(top) + 1, p["numTrees"] if "numTrees" in p else p["maxIter"]
    grow = partial(grower, p, width, classes)
    if n * width * 8 <= TASK_BYTES:
        nodes = rows.coalesce(1).mapInArrow(partial(grown_in_task, grow=grow, n=n, width=width, bins=bins, laid_out=laid_out), NODES)
    else:
        trees, cuts = grown_by_jobs(rows, grow, n, width, bins)
        nodes = spark.createDataFrame(pa.Table.from_batches([laid_out(i, t, cuts) for i, t in enumerate(trees)]), NODES)
    path = scratch_path(spark, "trees")
    nodes.write.parquet(f"{path}/data")
    common = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    whole = common | {"class": f"org.apache.spark.ml.classification.{model.__name__}", "uid": estimator.uid}
    whole |= {"paramMap": {q.name: v for q, v in estimator._paramMap.items()}, "defaultParamMap": {q.name: v for q, v in estimator._defaultParamMap.items()}}
    whole |= {"numFeatures": width, "numClasses": classes, "numTrees": count}
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(whole)).alias("value")).write.text(f"{path}/metadata")
    each = json.dumps(common | {"class": tree_class, "uid": f"{estimator.uid}_tree", "paramMap": {}, "defaultParamMap": {}})
    about = spark.range(0, count, 1, 1).select(F.col("id").cast("int").alias("_1"), F.lit(each).alias("_2"), weight(F.col("id")).alias("_3"))
    about.write.parquet(f"{path}/treesMetadata")
    return estimator._copyValues(model.load(path))


def forest_grower(p: dict, width: int, classes: int, at_once: int) -> Generator:
    return grow_forest(p, width, classes, at_once)


def boosted_grower(p: dict, width: int, classes: int, at_once: int) -> Generator:
    return grow_boosted(p, width)


class Forest(RandomForestClassifier):
    """Spark's random forest, grown as said above; features choose their cuts over all rows."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        kind = "org.apache.spark.ml.classification.DecisionTreeClassificationModel"
        return fitted(self, dataset, forest_grower, forest_nodes, RandomForestClassificationModel, kind, lambda i: F.lit(1.0))


class BoostedTrees(GBTClassifier):
    """Spark's boosted trees, grown as said above."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        kind, step = "org.apache.spark.ml.regression.DecisionTreeRegressionModel", float(self.getStepSize())
        return fitted(self, dataset, boosted_grower, boosted_nodes, GBTClassificationModel, kind, lambda i: F.when(i == 0, 1.0).otherwise(step))
