"""Operator 6, near-duplicate vectors by a forest of random projection trees: splits with spill, comparison within leaves, union of links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import components, lookup, stored
from creditloom.llm.hashed import bounded_sample

COSINE = 0.93
TREES = 8
#: Vectors that a leaf should hold, and that one side of a comparison holds at most in the mean.
LEAF = 512
BLOCK = 1024
#: Splits are fitted on about so many vectors; every vector is indexed.
SAMPLE = 32_768
LEAST_SAMPLE = 16
#: Share of a node's sample on either side of the split that goes both ways.
SPILL = 0.08
#: Share of a node's near pairs that a split may part; the best of so many drawn splits is taken, estimated on so many vectors of the node.
PARTED = 0.05
DRAWS = 8
PROBE = 512


@dataclass
class Forest:
    """Trees as heaps: node k has the children 2k + 1 and 2k + 2. ``low`` and ``high`` bound the projections that go both ways.
    A node that is ``whole`` has no children."""

    directions: np.ndarray  # tree, node, dimension
    low: np.ndarray
    high: np.ndarray
    whole: np.ndarray
    depth: int

    def route(self, unit: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and key of every leaf that each vector falls into. A tree is left at the row's own depth; at depth 0 one tree is enough."""
        rows, keys = [], []
        for t in range(len(self.directions)):
            row = np.arange(len(unit)) if t == 0 else np.flatnonzero(depth > 0)
            node = np.zeros(len(row), dtype=np.int64)
            for level in range(self.depth):
                deeper = (depth[row] > level) & ~self.whole[t][node]
                done_row, done_node, row, node = row[~deeper], node[~deeper], row[deeper], node[deeper]
                at = np.einsum("ij,ij->i", unit[row], self.directions[t][node])
                left, right = at <= self.high[t][node], at >= self.low[t][node]
                row = np.concatenate([done_row, row[left], row[right]])
                node = np.concatenate([done_node, 2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            keys.append((np.int64(t) << np.int64(40)) + node)
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        return row[order], key[order]


def near_pairs(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.triu(unit @ unit.T >= cosine, 1))


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 7, cosine: float = COSINE) -> Forest:
    """Random directions; each split lies at a random rank between 40 and 60 per cent of the node's part of the sample.

    Of several drawn splits the one that parts the fewest pairs of ``cosine`` is taken. A node in which all of them part more than ``PARTED``, as in a
    dense group of near copies, is not split, so the group is compared whole. A tree without a split compares all and is enough."""
    depth = max(0, min(depth, int(np.log2(max(1, len(sample) / LEAST_SAMPLE)))))
    n_nodes, dim = (1 << depth) - 1, sample.shape[1]
    rng = np.random.default_rng(seed)
    shape = (trees, max(1, n_nodes))
    directions = np.zeros((*shape, dim))
    low, high, whole = np.full(shape, -np.inf), np.full(shape, np.inf), np.zeros(shape, dtype=bool)
    for t in range(trees):
        held = {0: np.arange(len(sample))}
        for node in range(n_nodes):
            if node not in held:
                continue
            own = held.pop(node)
            probe = rng.choice(own, min(len(own), PROBE), replace=False)
            a, b = near_pairs(sample[probe], cosine)
            best = np.inf
            for _ in range(DRAWS):
                direction = rng.normal(size=dim)
                direction /= np.linalg.norm(direction)
                at = sample[own] @ direction
                share = rng.uniform(0.4, 0.6)
                limits = np.quantile(at, [share - spill, share, share + spill]) if len(at) else np.zeros(3)
                tried = sample[probe] @ direction
                left, right = tried <= limits[2], tried >= limits[0]
                parted = 1 - ((left[a] & left[b]) | (right[a] & right[b])).mean() if len(a) else 0.0
                if parted < best:
                    best, directions[t][node], (low[t][node], split, high[t][node]), projected = parted, direction, limits, at
                if not best:
                    break
            if best > PARTED:
                whole[t][node] = True
            else:
                held[2 * node + 1], held[2 * node + 2] = own[projected <= split], own[projected > split]
    needed = [int(np.argmax(whole[:, 0]))] if whole[:, 0].any() else list(range(trees))
    return Forest(directions[needed], low[needed], high[needed], whole[needed], depth)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a binary column of doubles."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def coded(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, cid, vec``: cid numbers the pair of label and vector, null if the row can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, vecs = [], []
            for v, lab in zip(batch.column(1), batch.column(2), strict=True):
                flat = None if v.as_py() is None or lab.as_py() is None or v.values.null_count or not len(v.values) else np.asarray(v.values.to_numpy(zero_copy_only=False), dtype="<f8") + 0.0
                if flat is not None and np.isfinite(flat).all() and flat.any() and not 1e-200 < (flat * flat).sum() < 1e200:
                    flat = np.ldexp(flat, -int(np.frexp(np.abs(flat).max())[1]))  # the cosine stays, squares no longer leave the range of doubles
                if flat is None or not np.isfinite(flat).all() or not flat.any():
                    cids.append(None)
                    vecs.append(None)
                else:
                    vecs.append(flat.tobytes())
                    cids.append(hashlib.blake2b(vecs[-1] + str(lab.as_py()).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cids, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "cid", "vec"])

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).cast("string").alias("label"))
    return source.mapInArrow(run, "vec_id long, label string, cid binary, vec binary")


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links within one leaf, or between two blocks of a large one: for each vector with links its copies linked here for the first time, and the
    smallest class it reaches here. A pair that shares several leaves counts in the one with the smallest key."""
    table = table.combine_chunks()
    schema = pa.schema([("cid", pa.binary()), ("added", pa.int64()), ("root", pa.binary())])
    vec = table.column("vec").combine_chunks() if table.num_rows else None
    if table.num_rows < 2:
        return schema.empty_table()
    dim = len(vec[0].as_py()) // 8
    same = pc.equal(pc.binary_length(vec), dim * 8).to_numpy(zero_copy_only=False)
    if not same.all():
        # vectors of different lengths have no cosine
        parts = [compare(table.filter(pc.equal(pc.binary_length(table.column("vec")), int(k))), threshold) for k in np.unique(pc.binary_length(vec).to_numpy())]
        return pa.concat_tables(parts)
    unit, key = matrix(vec, dim), table.column("key")[0].as_py()
    first, second = table.column("first").to_numpy(), table.column("second").to_numpy()
    times = table.column("times").to_numpy()
    keys = table.column("keys").to_pylist()
    width = max(map(len, keys))
    own = np.full((len(keys), width), -1, dtype=np.int64)
    for i, k in enumerate(keys):
        own[i, : len(k)] = k
    block = table.column("block").to_numpy()
    left = np.flatnonzero(block == first)
    right = np.flatnonzero(block == second)
    a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
    a, b = left[a], right[b]
    once = a < b if first[0] == second[0] else np.ones(len(a), dtype=bool)
    a, b = a[once], b[once]
    added = np.zeros(len(unit), dtype=np.int64)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        earlier = np.zeros(len(x), dtype=bool)
        for k in range(width):
            mine = own[x, k]
            earlier |= (mine >= 0) & (mine < key) & (own[y] == mine[:, None]).any(axis=1)
        np.add.at(added, x[~earlier], times[y[~earlier]])
        np.add.at(added, y[~earlier], times[x[~earlier]])
    order = np.argsort(np.argsort(np.array(table.column("cid").to_pylist(), dtype=object), kind="stable"), kind="stable")
    low = order.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            break
    at_rank = np.argsort(order)
    linked = np.zeros(len(unit), dtype=bool)
    linked[a] = linked[b] = True
    some = np.flatnonzero(linked)
    cid = table.column("cid").combine_chunks()
    return pa.Table.from_arrays([cid.take(pa.array(some)), pa.array(added[some]), cid.take(pa.array(at_rank[low[some]]))], schema=schema)


def _leaves(classes: DataFrame, forest: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = forest.value.directions.shape[2]
            fits = pc.equal(pc.binary_length(batch.column(3)), dim * 8).to_numpy(zero_copy_only=False)
            depth = np.where(fits, batch.column(4).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            unit = np.zeros((batch.num_rows, dim))
            unit[fits] = matrix(batch.column(3).filter(pa.array(fits)), dim)
            row, key = forest.value.route(unit, depth)
            n = np.bincount(row, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(key))
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), batch.column(2).take(index), batch.column(3).take(index), pa.array(key), lists.take(index)],
                names=["cid", "label", "times", "vec", "key", "keys"],
            )

    return classes.select("cid", "label", "times", "vec", "depth").mapInArrow(run, "cid binary, label string, times long, vec binary, key long, keys array<long>")


def linked_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two vectors link if their labels are equal and not null and their cosine reaches ``cosine``. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest vec_id reachable, ``kept`` whether that is the row's own.

    Equal vectors of a label are one class with a number of copies. Splits are fitted on about ``sample`` classes, then all classes are routed; how deep follows
    from the size of the label, so a label of up to ``leaf`` vectors is compared whole. A group too dense to be split, or a leaf that is still large, is compared in blocks, one task for
    each pair of blocks. No pair leaves its task: each pair counts in its first common leaf, and links are handed on as a forest.

    Null, zero, empty and non-finite vectors, and rows without label, have no links. Vectors of different lengths do not link. Rows that repeat
    a vec_id count as rows. A row with null vec_id takes part; its component_id is the smallest id that is not null. An empty table gives an
    empty result. Only the three named columns are read.
    """
    spark = vectors.sparkSession
    rows = stored(coded(vectors, vec_id, embedding, label), "vectors")
    classes = stored(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec")), "classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / leaf))).cast("int"))
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    chosen = bounded_sample(classes.select("cid", "vec"), ["cid"], sample).select("vec").toArrow().column("vec").combine_chunks() if deepest else pa.array([], pa.binary())
    length = max((len(x) for x in chosen.to_pylist()), default=8) if deepest else 8
    held = matrix(chosen.filter(pc.equal(pc.binary_length(chosen), length)), length // 8) if deepest else np.zeros((1, 1))
    forest = spark.sparkContext.broadcast(fit_forest(held, deepest, trees if deepest else 1, cosine=cosine))
    leaves = _leaves(lookup(classes, sizes.select("label", "depth"), "label", "cid"), forest)
    large = leaves.groupBy("label", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    large = large.select("label", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = leaves.join(large, ["label", "key"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("blocks", "other")
    found = dealt.groupBy("label", "key", "first", "second").applyInArrow(lambda t: compare(t, cosine), "cid binary, added long, root binary")
    found = stored(found, "links")
    groups = components(classes.select(F.col("cid").alias("id")), found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    groups = stored(classes.select("cid", "low", "times").join(groups.withColumnRenamed("id", "cid"), "cid"), "groups")
    named = groups.join(groups.groupBy("component_id").agg(F.min("low").alias("lowest")), "component_id")
    named = named.join(found.groupBy("cid").agg(F.sum("added").alias("added")), "cid", "left")
    named = named.select("cid", (F.coalesce("added", F.lit(0)) + F.col("times") - 1).alias("n_links"), "lowest")
    out = lookup(rows.select("vec_id", "cid"), named, "cid", "vec_id")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
