"""Fitted tree ensembles as flat node tables: margins of rows, after every round, or under many changes of a few features at once.

A table is bounded by the training parameters (trees x 2^depth nodes), not by data, so tasks get it whole. Rows go through in batches;
all work is on arrays of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import fresh_path

#: Rows whose leaves are looked up at once: rows x trees places.
PLACES = 1 << 20
WORD = 64
NODES = "tree int, node int, feature int, threshold double, below int, above int, value double, count double, gain double"


@dataclass
class Trees:
    """Nodes of all trees one after the other. A row goes to ``below`` if its feature is at most the threshold, else to ``above``; a leaf has feature -1
    and its value on the margin scale."""

    tree: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    count: np.ndarray
    gain: np.ndarray
    n_features: int

    @property
    def roots(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.tree, prepend=-1))

    @property
    def n_trees(self) -> int:
        return len(self.roots)

    def cuts(self) -> list[np.ndarray]:
        """The distinct thresholds of each feature, in order."""
        return [np.unique(self.threshold[self.feature == f]) for f in range(self.n_features)]

    def first(self, rounds: int) -> Trees:
        """The ensemble after its first ``rounds`` rounds."""
        keep = slice(0, int(np.searchsorted(self.tree, rounds)))
        return Trees(*(getattr(self, f)[keep] for f in ("tree", "feature", "threshold", "below", "above", "value", "count", "gain")), self.n_features)

    def table(self, spark: SparkSession) -> DataFrame:
        columns = (self.tree, np.arange(len(self.tree)), self.feature, self.threshold, self.below, self.above, self.value, self.count, self.gain)
        kinds = [c.split() for c in NODES.split(", ")]
        return spark.createDataFrame(pa.table({name: pa.array(c, pa.int32() if kind == "int" else pa.float64()) for (name, kind), c in zip(kinds, columns, strict=True)}), NODES)

    @staticmethod
    def from_table(nodes: DataFrame, n_features: int) -> Trees:
        held = nodes.orderBy("node").toArrow()
        ints, floats = (lambda c: held[c].to_numpy().astype(np.int64)), (lambda c: held[c].to_numpy().astype(float))
        return Trees(ints("tree"), ints("feature"), floats("threshold"), ints("below"), ints("above"), floats("value"), floats("count"), floats("gain"), n_features)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node of every row in every tree (rows x trees)."""
        at = np.broadcast_to(self.roots, (len(x), self.n_trees)).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.below[at], self.above[at]), at)

    def _chunks(self, n: int) -> Iterator[slice]:
        step = max(1, PLACES // max(1, self.n_trees))
        return (slice(k, k + step) for k in range(0, n, step))

    def _alike(self, x: np.ndarray, unread: Iterable[int] = (), whole: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Rows that no split tells apart: the first of each such group, and the group of every row.

        A feature counts as the number of its thresholds below the value; one in ``whole`` counts as its value, one in ``unread`` not at all.
        """
        key, span = np.zeros(len(x), dtype=np.int64), 1
        for f in np.unique(self.feature[self.feature >= 0]).tolist():
            if f in unread:
                continue
            if f in whole:
                values, code = np.unique(x[:, f], return_inverse=True)
                kinds = len(values)
            else:
                cuts = np.unique(self.threshold[self.feature == f])
                code, kinds = np.searchsorted(cuts, x[:, f], side="left"), len(cuts) + 1
            if span * kinds >= 1 << 62:
                key, span = np.unique(key, return_inverse=True)[1].astype(np.int64), len(x)
            key, span = key * kinds + code, span * kinds
        first, group = np.unique(key, return_index=True, return_inverse=True)[1:]
        return first, group

    def margins(self, x: np.ndarray) -> np.ndarray:
        first, group = self._alike(x)
        return self._margins(x[first])[group]

    def _margins(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.value[self.leaves(x[c])].sum(axis=1) for c in self._chunks(len(x))] or [np.zeros(0)])

    def staged(self, x: np.ndarray) -> np.ndarray:
        """Margins after each round (rows x rounds)."""
        return np.concatenate([np.cumsum(self.value[self.leaves(x[c])], axis=1) for c in self._chunks(len(x))] or [np.zeros((0, self.n_trees))])

    def importance(self) -> np.ndarray:
        """Share of each feature in the gain of all splits, weighted by their rows."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], weights=(self.gain * self.count)[inner], minlength=self.n_features)
        return total / (total.sum() or 1.0)

    def cell_margins(self, x: np.ndarray, replace: dict[int, np.ndarray], add: dict[int, np.ndarray], n_cells: int) -> np.ndarray:
        """Margins of every row under every cell (rows x cells). A cell replaces some features by its own values and adds to others.

        Cells walk down a tree together as the bits of one word for each row: a split on a replaced feature parts the word by a mask that holds for all
        rows, one on an added feature by a mask for each row, any other split sends the word to one side whole. Where no cell differs, a
        row passes a subtree once. Rows that no split tells apart are worked out once.
        """
        first, group = self._alike(x, replace, add)
        x = x[first]
        return np.concatenate([self._words(x, {f: v[k : k + WORD] for f, v in replace.items()}, {f: v[k : k + WORD] for f, v in add.items()}, min(WORD, n_cells - k)) for k in range(0, n_cells, WORD)], axis=1)[group]

    def _words(self, x: np.ndarray, replace: dict[int, np.ndarray], add: dict[int, np.ndarray], n: int) -> np.ndarray:
        bit = np.uint64(1) << np.arange(n, dtype=np.uint64)
        full = np.bitwise_or.reduce(bit)
        amounts = {f: [(a, np.bitwise_or.reduce(bit[v == a])) for a in np.unique(v)] for f, v in add.items()}
        same, out = np.zeros(len(x)), np.zeros((len(x), n))
        for root in self.roots:
            stack = [(int(root), np.arange(len(x)), np.full(len(x), full))]
            while stack:
                node, rows, word = stack.pop()
                f = int(self.feature[node])
                if f < 0:
                    whole = word == full
                    same[rows[whole]] += self.value[node]
                    part = ~whole
                    if part.any():
                        out[rows[part]] += np.where((word[part][:, None] & bit) != 0, self.value[node], 0.0)
                    continue
                cut = self.threshold[node]
                if f in replace:
                    low = np.full(len(rows), np.bitwise_or.reduce(bit[replace[f] <= cut], initial=np.uint64(0)))
                elif f in amounts:
                    low = np.zeros(len(rows), dtype=np.uint64)
                    for a, bits in amounts[f]:
                        low |= np.where(x[rows, f] + a <= cut, bits, np.uint64(0))
                else:
                    low = np.where(x[rows, f] <= cut, full, np.uint64(0))
                for child, side in ((self.below[node], word & low), (self.above[node], word & ~low)):
                    some = side != 0
                    if some.any():
                        stack.append((int(child), rows[some], side[some]))
        return out + same[:, None]


def read_trees(model, spark: SparkSession) -> Trees:
    """Node table of a fitted boosted model (classifier: log-odds) or forest (mean), read from the model saved to the shared folder. Nodes come to the driver as columns."""
    path = fresh_path(spark, "tree-model")
    model.write().save(path)
    scale = 2.0 if hasattr(model, "numClasses") else 1.0
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if not hasattr(model, "numClasses") and type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(weights)] * len(weights)
    cells = {c: f"nodeData.{c}" for c in ("id", "leftChild", "rightChild", "prediction", "rawCount", "gain")} | {"feature": "nodeData.split.featureIndex", "kinds": "nodeData.split.numCategories"}
    cut = F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")
    held = spark.read.parquet(f"{path}/data").select("treeID", *[F.col(v).alias(k) for k, v in cells.items()], cut).toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    ints, floats = (lambda c: held[c].to_numpy().astype(np.int64)), (lambda c: held[c].fill_null(0.0).to_numpy().astype(float))
    tree, node, left, right = (ints(c) for c in ("treeID", "id", "leftChild", "rightChild"))
    leaf = left < 0
    if not np.isin(ints("kinds")[~leaf], (-1, 0)).all():
        raise ValueError("only continuous splits are read; encode categories as numbers")
    span = int(node.max(initial=0)) + 1
    below, above = (np.where(leaf, -1, np.searchsorted(tree * span + node, tree * span + child)) for child in (left, right))
    return Trees(
        tree, np.where(leaf, -1, ints("feature")), np.where(leaf, 0.0, floats("cut")), below, above, scale * np.array(weights, dtype=float)[tree] * floats("prediction"),
        floats("rawCount"), np.where(leaf, 0.0, floats("gain")), model.numFeatures,
    )


def matrix(columns: Sequence, n: int) -> np.ndarray:
    """Arrow columns as a matrix, nulls as not-a-number."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if columns else np.zeros((n, 0))
