"""A random forest whose nodes stay in a table.

Spark's own forest holds all nodes on the driver, and unlimited trees grow with the rows. Here each tree is cut into pieces of
some 262,144 sampled rows; a task grows a piece, writes its nodes and forgets them. Only where more rows than that reach a node
are its splits chosen by sums over all tasks, and these few upper nodes are all that the driver holds.

The method is that of ``RandomForestClassifier``: 32 bins per feature, rows drawn with replacement (Poisson), at each node the
square root of the number of features, Gini impurity, leaves of one parent that predict the same class merged, votes weighed by the shares in
the leaves. Draws are hashes of the seed, the tree and the row or the node, so they do not depend on where a tree is cut; they are not Spark's draws.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.session import materialise

# As in pyspark.ml.
BINS = 32
# Sampled rows that one task grows a piece of a tree from; rows of a block; nodes whose sums a task holds at once.
PIECE_ROWS = 1 << 18
BLOCK_ROWS = 4096
NODES_AT_ONCE = 4096
# A gain below this is rounding.
LEAST_GAIN = 1e-12

_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SENT = "tree int, node int, kind int, block long, payload binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _roots(seed: int, trees: int) -> np.ndarray:
    """One random number per tree; what is drawn for its rows and nodes follows from it."""
    return _mixed((np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed & 0xFFFFFFFF) * np.uint64(1 << 20)) * _ODD)


def _draws(root: np.uint64, first: int, n: int) -> np.ndarray:
    """How often the rows ``first`` to ``first + n - 1`` are drawn for a tree."""
    number = np.arange(n, dtype=np.uint64) + np.uint64(first)
    chance = (_mixed(_mixed(number * _ODD) ^ root) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(_DRAWN, chance, side="right").astype(np.uint8)


def _children(names: np.ndarray) -> np.ndarray:
    """The random numbers of both children of each node, side by side."""
    return _mixed(np.repeat(names, 2) * _ODD + np.tile(np.array([1, 2], dtype=np.uint64), len(names)))


def _candidates(names: np.ndarray, features: int) -> np.ndarray:
    """The features that each node may split by, in ascending order."""
    chance = _mixed(names[:, None] + np.arange(1, features + 1, dtype=np.uint64) * _ODD)
    return np.sort(np.argsort(chance, axis=1, kind="stable")[:, :math.ceil(math.sqrt(features))], axis=1)


def _sums(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, label: np.ndarray, weight: np.ndarray, chosen: np.ndarray,
          classes: int) -> Iterator[np.ndarray]:
    """For each candidate in turn the weights by (node, bin, class)."""
    size = len(chosen) * BINS * classes
    for j in range(chosen.shape[1]):
        place = (node * BINS + bins[chosen[node, j], rows]) * classes + label
        yield np.bincount(place, weight, size).reshape(len(chosen), BINS, classes)


def _best(sums: Iterator[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin on the left of the best split of each node."""
    nodes = np.arange(len(chosen))
    gain, feature, cut = np.full(len(nodes), -np.inf), np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    for j, table in enumerate(sums):
        left = table.cumsum(axis=1)
        whole, left = left[:, -1:], left[:, :-1]
        right = whole - left
        n_left, n_right, n = left.sum(axis=2), right.sum(axis=2), whole.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            purer = (left ** 2).sum(axis=2) / n_left + (right ** 2).sum(axis=2) / n_right - (whole ** 2).sum(axis=2) / n
            purer = np.where((n_left > 0) & (n_right > 0), purer / n, -np.inf)
        at = purer.argmax(axis=1)
        better = purer[nodes, at] > gain
        gain[better], feature[better], cut[better] = purer[nodes, at][better], chosen[better, j], at[better]
    return gain, feature, cut


@dataclass
class Nodes:
    """Nodes of a tree or a piece, parents first: ``feature`` is -1 at leaves, ``left`` the first of two children side by side, ``counts`` the
    weights by class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray
    gain: np.ndarray

    def pruned(self) -> Nodes:
        """Two leaves of one parent that predict the same are one; nodes out of reach are dropped."""
        feature, said = self.feature.copy(), self.counts.argmax(axis=1)
        reached = np.zeros(len(feature), dtype=bool)
        reached[0] = True
        for node in np.flatnonzero(feature >= 0)[::-1]:
            left = self.left[node]
            if feature[left] == -1 and feature[left + 1] == -1 and said[left] == said[left + 1]:
                feature[node] = -1
        for node in np.flatnonzero(feature >= 0):
            if reached[node]:
                reached[self.left[node]:self.left[node] + 2] = True
        number = np.cumsum(reached) - 1
        return Nodes(feature[reached], self.cut[reached], np.where(feature >= 0, number[self.left], 0)[reached], self.counts[reached], self.gain[reached])

    def importance(self, features: int) -> np.ndarray:
        inner = self.feature >= 0
        return np.bincount(self.feature[inner], (self.gain * self.counts.sum(axis=1))[inner], features)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; ``bins`` has a line per feature."""
        at = np.zeros(bins.shape[1], dtype=np.int64)
        rows = np.flatnonzero(self.feature[at] >= 0)
        while len(rows):
            node = at[rows]
            at[rows] = self.left[node] + (bins[self.feature[node], rows] > self.cut[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return at

    def votes(self, leaves: np.ndarray) -> np.ndarray:
        held = self.counts[leaves]
        return held / np.maximum(held.sum(axis=1, keepdims=True), 1)

    def dump(self) -> bytes:
        return _packed(self.feature.astype("<i4"), self.cut.astype("<u1"), self.left.astype("<i4"), self.counts.astype("<f8"), self.gain.astype("<f8"))

    @staticmethod
    def load(data: bytes, classes: int) -> Nodes:
        feature, cut, left, counts, gain = _unpacked(data, "<i4", "<u1", "<i4", "<f8", "<f8")
        return Nodes(feature.astype(np.int64), cut.astype(np.int64), left.astype(np.int64), counts.reshape(-1, classes), gain)


def _packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(a.tobytes()) for a in arrays], dtype="<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    ends = np.cumsum([8 * len(types), *np.frombuffer(data, "<i8", len(types))])
    return [np.frombuffer(data[a:b], kind) for a, b, kind in zip(ends, ends[1:], types)]


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, name: np.uint64, depth: int, classes: int) -> Nodes:
    """The nodes below one of random number ``name``, one level after the other, ``depth`` levels at most."""
    label = label.astype(np.int64)
    rows, node = np.arange(len(label)), np.zeros(len(label), dtype=np.int64)
    names = np.array([name], dtype=np.uint64)
    counts = np.bincount(label, weight, classes)[None]
    levels, total = [], 1
    while True:
        feature, cut, left = (np.full(len(names), value, dtype=np.int64) for value in (-1, 0, 0))
        gain = np.zeros(len(names))
        mixed = np.flatnonzero((counts > 0).sum(axis=1) > 1) if len(levels) < depth else np.array([], dtype=np.int64)
        number = np.full(len(names), -1)
        number[mixed] = np.arange(len(mixed))
        held = number[node] >= 0
        rows, node = rows[held], node[held]
        order = np.argsort(number[node], kind="stable")
        rows, node = rows[order], node[order]
        bounds = np.searchsorted(number[node], np.arange(0, len(mixed) + NODES_AT_ONCE, NODES_AT_ONCE))
        for first, start, stop in zip(range(0, len(mixed), NODES_AT_ONCE), bounds, bounds[1:]):
            some, mine = mixed[first:first + NODES_AT_ONCE], rows[start:stop]
            chosen = _candidates(names[some], len(bins))
            sums = _sums(bins, mine, number[node[start:stop]] - first, label[mine], weight[mine], chosen, classes)
            found, by, at = _best(sums, chosen)
            good = found > LEAST_GAIN
            feature[some[good]], cut[some[good]], gain[some[good]] = by[good], at[good], found[good]
        split = np.flatnonzero(feature >= 0)
        left[split] = total + 2 * np.arange(len(split))
        levels.append((feature, cut, left, counts, gain))
        if not len(split):
            break
        number[:] = -1
        number[split] = np.arange(len(split))
        held = number[node] >= 0
        rows, node = rows[held], node[held]
        node = 2 * number[node] + (bins[feature[node], rows] > cut[node])
        names = _children(names[split])
        counts = np.bincount(node * classes + label[rows], weight[rows], len(names) * classes).reshape(-1, classes)
        total += len(names)
    return Nodes(*(np.concatenate(part) for part in zip(*levels)))


def _binned(batch: pa.RecordBatch, thresholds: list[np.ndarray]) -> np.ndarray:
    """A line per feature: how many thresholds a value is above."""
    lines = []
    for i, cuts in enumerate(thresholds):
        values = batch.column(i).to_numpy(zero_copy_only=False)
        if np.isnan(values).any():
            raise ValueError("features must be numbers: a null or NaN was found")
        lines.append(np.searchsorted(cuts, values, side="left").astype(np.uint8))
    return np.array(lines, dtype=np.uint8).reshape(len(thresholds), batch.num_rows)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(start, BLOCK_ROWS)


def _doubles(columns: Sequence[str]) -> list:
    return [F.col(f"`{name}`").cast("double").alias(f"c{i}") for i, name in enumerate(columns)]


def _thresholds(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Where each feature is cut: between all values if there are few, at quantiles if not."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([])] * width
        for batch in batches:
            for i, values in enumerate(held):
                if values is not None:
                    values = np.union1d(values, batch.column(i).to_numpy(zero_copy_only=False))
                    held[i] = values if len(values) <= BINS else None
        found = [(i, value) for i, values in enumerate(held) for value in ([None] if values is None else values.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([v for _, v in found], pa.float64())], names=["i", "value"])

    names = [f"c{i}" for i in range(width)]
    listed = rows.select(names).mapInArrow(few, "i int, value double").distinct().groupBy("i")
    listed = listed.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("full"), F.slice(F.array_sort(F.collect_list("value")), 1, BINS).alias("all"))
    exact = {row["i"]: row["all"] for row in listed.filter(f"n = full AND n <= {BINS}").collect()}
    shares = [k / BINS for k in range(1, BINS)]
    other = [i for i in range(width) if i not in exact]
    row = rows.agg(*[F.percentile_approx(f"c{i}", shares, 10_000) for i in other], *[F.max(f"c{i}") for i in other]).first() if other else []
    cuts = {i: np.array(values)[:-1] / 2 + np.array(values)[1:] / 2 for i, values in exact.items()}
    for k, i in enumerate(other):
        values = np.unique(row[k] or [])
        cuts[i] = values[values < row[len(other) + k]] if len(values) else values
    return [cuts[i] for i in range(width)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """(kind, block, payload) of each (tree, node), from rows sorted by it."""
    key, held = None, []
    for batch in batches:
        for tree, node, *rest in zip(*(column.to_pylist() for column in batch.columns)):
            if (tree, node) != key and held:
                yield key, held
                held = []
            key = (tree, node)
            held.append(tuple(rest))
    if held:
        yield key, held


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tree", "node", "kind", "block", "payload"])


def _gathered(df: DataFrame, keys: int) -> DataFrame:
    """All rows of a (tree, node) in one task, in a fixed order."""
    return df.repartition(max(1, keys), "tree", "node").sortWithinPartitions("tree", "node", "kind", "block")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Tops:
    """The upper nodes of all trees while they are chosen; ``open`` nodes still have too many rows for one task."""

    def __init__(self, roots: np.ndarray, classes: int, is_open: bool):
        none = np.array([-1])
        self.nodes = [Nodes(none.copy(), np.zeros(1, int), np.zeros(1, int), np.zeros((1, classes)), np.zeros(1)) for _ in roots]
        self.names = [np.array([root], dtype=np.uint64) for root in roots]
        self.depths = [[0] for _ in roots]
        self.open = {tree: [0] for tree in range(len(roots)) if is_open}
        self.leaves: set[tuple[int, int]] = set()

    def split(self, tree: int, node: int, gain: float, feature: int, cut: int, sides: np.ndarray, large: int, depth: int) -> None:
        top = self.nodes[tree]
        top.counts[node] = sides.sum(axis=0)
        if gain <= LEAST_GAIN:
            self.leaves.add((tree, node))
            return
        left, below = len(top.feature), self.depths[tree][node] + 1
        top.feature[node], top.cut[node], top.left[node], top.gain[node] = feature, cut, left, gain
        self.nodes[tree] = Nodes(*(np.concatenate(pair) for pair in zip(
            (top.feature, top.cut, top.left, top.counts, top.gain), ([-1, -1], [0, 0], [0, 0], sides, [0.0, 0.0]))))
        self.names[tree] = np.concatenate([self.names[tree], _children(self.names[tree][node:node + 1])])
        self.depths[tree] += [below, below]
        for child, held in zip((left, left + 1), sides):
            if (held > 0).sum() < 2 or below >= depth:
                self.leaves.add((tree, child))
            elif held.sum() > large:
                self.open.setdefault(tree, []).append(child)


def _split_tops(blocks: DataFrame, tops: _Tops, roots: np.ndarray, width: int, classes: int, large: int, depth: int) -> None:
    """Splits nodes with too many rows for one task by sums over all tasks, one level per pass."""
    while tops.open:
        nodes, names, wanted = tops.nodes, tops.names, {tree: np.array(held) for tree, held in tops.open.items()}
        chosen = {tree: _candidates(names[tree][held], width) for tree, held in wanted.items()}

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for first, bins, label in _blocks(batches, width):
                for tree, mine in wanted.items():
                    number = np.full(len(nodes[tree].feature), -1)
                    number[mine] = np.arange(len(mine))
                    weight, node = _draws(roots[tree], first, len(label)), number[nodes[tree].place(bins)]
                    rows = np.flatnonzero((weight > 0) & (node >= 0))
                    sums = np.array(list(_sums(bins, rows, node[rows], label[rows].astype(np.int64), weight[rows], chosen[tree], classes)))
                    held[tree] = held[tree] + sums if tree in held else sums
            for tree, sums in held.items():
                yield _rows([(tree, int(node), 0, 0, sums[:, i].tobytes()) for i, node in enumerate(wanted[tree])])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (tree, node), held in _keyed(batches):
                by = chosen[tree][np.flatnonzero(wanted[tree] == node)]
                sums = sum(np.frombuffer(payload) for _, _, payload in held).reshape(by.shape[1], 1, BINS, classes)
                gain, feature, cut = (value[0] for value in _best(iter(sums), by))
                table = sums[np.flatnonzero(by[0] == feature)[0] if gain > LEAST_GAIN else 0, 0]
                sides = np.array([table[:cut + 1].sum(axis=0), table[cut + 1:].sum(axis=0)])
                yield _rows([(tree, node, int(feature), int(cut), _packed(np.array([gain]), sides))])

        keys = sum(map(len, wanted.values()))
        found = _gathered(blocks.mapInArrow(add, _SENT), min(keys, _tasks(blocks.sparkSession))).mapInArrow(choose, _SENT).collect()
        tops.open = {}
        for row in sorted(found, key=lambda r: (r["tree"], r["node"])):
            gain, sides = _unpacked(row["payload"], "<f8", "<f8")
            tops.split(row["tree"], row["node"], float(gain[0]), row["kind"], row["block"], sides.reshape(2, classes), large, depth)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first, bins, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield first, np.frombuffer(bins, np.uint8).reshape(width, -1), np.frombuffer(label, np.uint8)


def fit_forest(train: DataFrame, columns: Sequence[str], n_trees: int, max_depth: int, seed: int, label: str = "label",
               piece_rows: int = PIECE_ROWS) -> ForestModel:
    """Trees of any size over the numeric ``columns``; labels are 0, 1, 2 and so on.

    Stage ``train`` first: it is read three times. Rows are numbered in hash order, so the same rows give the same forest.
    """
    spark, width = train.sparkSession, len(columns)
    known = [F.col(f"`{name}`") for name, kind in train.dtypes if "map<" not in kind]
    rows = train.select(*_doubles(columns), F.col(f"`{label}`").cast("double").alias("_label"), F.xxhash64(*known).alias("_h"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_label").alias("top"),
                    F.count_if(F.expr("_label IS NULL OR _label < 0 OR _label > 254 OR _label <> floor(_label)")).alias("bad")).first()
    if not seen["n"] or seen["bad"]:
        raise ValueError(f"{seen['bad']} of {seen['n']} rows have no label from 0 to 254")
    classes = max(2, int(seen["top"]) + 1)
    thresholds = _thresholds(rows, width)
    roots = _roots(seed, n_trees)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in _slices(batches):
            label = batch.column(width).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([_binned(batch, thresholds).tobytes()]), pa.array([label.tobytes()])],
                                             names=["first", "bins", "label"])
            first += batch.num_rows

    placed = rows.repartition(_tasks(spark), "_h").sortWithinPartitions("_h", *rows.columns[:-1])
    blocks = materialise(placed.mapInArrow(pack, "first long, bins binary, label binary"))
    tops = _Tops(roots, classes, is_open=seen["n"] > piece_rows and max_depth > 0)
    _split_tops(blocks, tops, roots, width, classes, piece_rows, max_depth)
    nodes, leaves = tops.nodes, tops.leaves

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, bins, label in _blocks(batches, width):
            out = []
            for tree, top in enumerate(nodes):
                weight = _draws(roots[tree], first, len(label))
                rows = np.flatnonzero(weight)
                for node, mine in _parted(top.place(bins[:, rows]), rows):
                    if (tree, node) not in leaves:
                        out.append((tree, node, 1, first, _packed(np.ascontiguousarray(bins[:, mine]), label[mine], weight[mine])))
            yield _rows(out)

    names, depths = tops.names, tops.depths

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, node), held in _keyed(batches):
            parts = [_unpacked(payload, "u1", "u1", "u1") for _, _, payload in held]
            del held
            bins = np.concatenate([part[0].reshape(width, -1) for part in parts], axis=1)
            label, weight = (np.concatenate([part[i] for part in parts]) for i in (1, 2))
            del parts
            piece = grow(bins, label, weight, names[tree][node], max_depth - depths[tree][node], classes).pruned()
            # What the driver has to know of a piece is short: the root's weights, whether it is a leaf, and its share of the importances.
            yield _rows([(tree, node, 0, 0, piece.dump()), (tree, node, 1, len(piece.feature), _packed(piece.counts[0], piece.importance(width)))])

    pieces = sum(int((top.feature < 0).sum()) for top in nodes) - len(leaves)
    made = materialise(_gathered(blocks.mapInArrow(send, _SENT), pieces).mapInArrow(grown, _SENT))
    importance = np.zeros((n_trees, width))
    whole = set()
    for row in made.filter("kind = 1").toLocalIterator():
        counts, share = _unpacked(row["payload"], "<f8", "<f8")
        nodes[row["tree"]].counts[row["node"]] = counts
        importance[row["tree"]] += share
        if row["block"] > 1:
            whole.add((row["tree"], row["node"]))
    heads = []
    for tree, top in enumerate(nodes):
        # A piece's root is marked as node -2 - its number, so that it is not taken for a leaf.
        marked = np.array([-2 - node if (tree, node) in whole else f for node, f in enumerate(top.feature)])
        heads.append(Nodes(marked, top.cut, top.left, top.counts, top.gain).pruned())
        importance[tree] += heads[-1].importance(width)
    each = importance.sum(axis=1, keepdims=True)
    shares = np.divide(importance, each, out=np.zeros_like(importance), where=each > 0).sum(axis=0)
    return ForestModel(made.filter("kind = 0"), heads, thresholds, columns, classes, shares / (shares.sum() or 1.0))


def _parted(node: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(node, kind="stable")
    bounds = np.flatnonzero(np.diff(node[order], prepend=-1))
    for start, stop in zip(bounds, [*bounds[1:], len(order)]):
        yield int(node[order[start]]), rows[order[start:stop]]


class ForestModel(Transformer, MLWritable, MLReadable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``. ``pieces`` is the node table, ``heads`` the upper nodes of each tree."""

    def __init__(self, pieces: DataFrame, heads: list[Nodes], thresholds: list[np.ndarray], columns: Sequence[str], classes: int, importances: np.ndarray):
        super().__init__()
        self.pieces, self.heads, self.thresholds = pieces, heads, thresholds
        self.columns, self.numClasses, self.featureImportances = list(columns), classes, Vectors.dense(importances)

    def getNumTrees(self) -> int:
        return len(self.heads)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows go to the pieces that hold their leaves, the votes back to their blocks; ``dataset`` is staged once."""
        heads, thresholds, width, classes = self.heads, self.thresholds, len(self.columns), self.numClasses
        staged = materialise(dataset.withColumn("_row", F.monotonically_increasing_id()))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                ids, bins = batch.column(width).to_numpy().astype("<i8"), _binned(batch, thresholds)
                block, votes, out = int(ids[0]), np.zeros((len(ids), classes)), []
                for tree, head in enumerate(heads):
                    for node, rows in _parted(head.place(bins), np.arange(len(ids))):
                        if head.feature[node] == -1:
                            votes[rows] += head.votes(np.array([node]))
                        else:
                            out.append((tree, int(-2 - head.feature[node]), 1, block, _packed(rows.astype("<u2"), np.ascontiguousarray(bins[:, rows]))))
                # What the upper nodes say, with the ids, goes to no tree but straight to the block.
                yield _rows([*out, (-1, block % 64, 1, block, _packed(ids, votes))])

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            piece = None
            for batch in batches:
                for tree, node, kind, block, payload in zip(*(column.to_pylist() for column in batch.columns)):
                    if tree < 0:
                        yield _rows([(tree, 0, 0, block, payload)])
                    elif kind == 0:
                        piece = Nodes.load(payload, classes)
                    else:
                        rows, bins = _unpacked(payload, "<u2", "u1")
                        yield _rows([(tree, node, 1, block, _packed(rows, piece.votes(piece.place(bins.reshape(width, -1)))))])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def result(ids: np.ndarray, votes: np.ndarray) -> pa.RecordBatch:
                raw = pa.ListArray.from_arrays(pa.array(np.arange(0, votes.size + 1, classes, dtype=np.int32)), pa.array(votes.ravel()))
                return pa.RecordBatch.from_arrays([pa.array(ids), raw], names=["_row", "_raw"])

            ids = votes = None
            for batch in batches:
                for tree, payload in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                    if tree < 0:
                        if ids is not None:
                            yield result(ids, votes)
                        ids, votes = _unpacked(payload, "<i8", "<f8")
                        votes = votes.reshape(-1, classes).copy()
                    else:
                        rows, more = _unpacked(payload, "<u2", "<f8")
                        votes[rows] += more.reshape(-1, classes)
            if ids is not None:
                yield result(ids, votes)

        rows = staged.select(*_doubles(self.columns), "_row").mapInArrow(send, _SENT)
        keys = sum(int((head.feature < -1).sum()) for head in heads)
        voted = _gathered(self.pieces.unionByName(rows), keys + 64).mapInArrow(vote, _SENT)
        by_block = voted.repartition(_tasks(dataset.sparkSession), "block").sortWithinPartitions("block", "tree", "node")
        summed = by_block.mapInArrow(add, "_row long, _raw array<double>")
        total = F.aggregate("_raw", F.lit(0.0), lambda a, b: a + b)
        return staged.join(summed, "_row").select(
            *[F.col(f"`{name}`") for name in dataset.columns], array_to_vector("_raw").alias("rawPrediction"),
            array_to_vector(F.transform("_raw", lambda v: v / F.greatest(total, F.lit(1e-300)))).alias("probability"),
            (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double").alias("prediction"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        heads = [{name: values.tolist() for name, values in asdict(head).items()} for head in model.heads]
        held = {"heads": heads, "thresholds": [cuts.tolist() for cuts in model.thresholds], "columns": model.columns,
                "classes": model.numClasses, "importances": model.featureImportances.toArray().tolist()}
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, extraMetadata={"forest": json.dumps(held)})
        model.pieces.write.parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        held = json.loads(metadata["forest"])
        heads = [Nodes(np.array(h["feature"]), np.array(h["cut"]), np.array(h["left"]), np.array(h["counts"], dtype=float), np.array(h["gain"]))
                 for h in held["heads"]]
        pieces = self.sparkSession.read.schema(_SENT).parquet(f"{path}/nodes")
        model = ForestModel(pieces, heads, [np.array(cuts) for cuts in held["thresholds"]], held["columns"], held["classes"], np.array(held["importances"]))
        model._resetUid(metadata["uid"])
        return model
