"""Operator 13, trie of conversation prefixes: adaptive radix trees over fixed-width turn ids, one for each range of keys, joined along the ranges' borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import partitions_of, stored

#: Bytes of a turn's id: the first of its SHA-256, compared as a big-endian number.
WIDTH = 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Bytes of keys that one tree holds, about.
RANGE_BYTES = 8 << 20


# ----------------------------------------------------------------------------------------------------------
# The tree
# ----------------------------------------------------------------------------------------------------------
class Node:
    """One node: the bytes of its compressed path, the row of the key that ends here, and children in one of four layouts.

    Up to 4 and up to 16 children are two short lists in order of their byte; up to 48, a table of 256 places into a list of
    children; above that, a table of 256 children.
    """

    __slots__ = ("children", "end", "index", "path", "size")

    def __init__(self, path: bytes, end: int = -1):
        self.path, self.end = path, end
        self.size = 4
        self.index: list | bytearray | None = []
        self.children: list = []

    def get(self, byte: int) -> Node | None:
        if self.size <= 16:
            return self.children[self.index.index(byte)] if byte in self.index else None
        if self.size == 48:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Set a child; a full layout grows to the next one."""
        if self.size <= 16:
            if byte in self.index:
                self.children[self.index.index(byte)] = child
                return
            if len(self.index) == 16:
                table = bytearray(256)
                for i, b in enumerate(self.index):
                    table[b] = i + 1
                self.size, self.index = 48, table
                self.put(byte, child)
                return
            if len(self.index) == 4:
                self.size = 16
            at = sum(b < byte for b in self.index)
            self.index.insert(at, byte)
            self.children.insert(at, child)
        elif self.size == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.index[byte] = len(self.children)
            else:
                full: list = [None] * 256
                for b in range(256):
                    if self.index[b]:
                        full[b] = self.children[self.index[b] - 1]
                self.size, self.index, self.children = 256, None, full
                full[byte] = child
        else:
            self.children[byte] = child

    def ordered(self) -> list[Node]:
        if self.size <= 16:
            return self.children
        if self.size == 48:
            return [self.children[i - 1] for i in self.index if i]
        return [c for c in self.children if c is not None]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def insert(root: Node, key: bytes, row: int) -> None:
    """Add one key. A path that a key leaves in its middle is split there."""
    node, at = root, 0
    while True:
        common = shared(node.path, key[at : at + len(node.path)])
        if common < len(node.path):
            rest = Node(node.path[common:], node.end)
            rest.size, rest.index, rest.children = node.size, node.index, node.children
            node.path, node.end, node.size, node.index, node.children = node.path[:common], -1, 4, [], []
            node.put(rest.path[0], rest)
        at += common
        if at == len(key):
            node.end = row
            return
        child = node.get(key[at])
        if child is None:
            node.put(key[at], Node(key[at:], row))
            return
        node = child


def postorder(root: Node) -> Iterator[tuple[Node, int, int]]:
    """Every node after its children, with the byte depths at which its path starts and ends. No recursion: chains may be as long as a conversation."""
    stack = [(root, 0, False)]
    while stack:
        node, start, done = stack.pop()
        end = start + len(node.path)
        if done:
            yield node, start, end
        else:
            stack.append((node, start, True))
            stack.extend((c, end, False) for c in reversed(node.ordered()))


# ----------------------------------------------------------------------------------------------------------
# Trie nodes of one range of keys
# ----------------------------------------------------------------------------------------------------------
NODES = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, spread long, own long, ends string, border boolean"


def _named(key: bytes, upto: int) -> list[bytes]:
    """Names of the prefixes of a key, root first: each a digest of the one above and the next turn."""
    names = [b"root"]
    for at in range(0, upto * WIDTH, WIDTH):
        names.append(hashlib.sha256(names[-1] + key[at : at + WIDTH]).digest()[:WIDTH])
    return names


def trie_rows(keys: list[bytes], chars: list[list[int]], n: list[int], low: list[int], ends: list[str], before: int, after: int) -> dict[str, list]:
    """Trie nodes of the sorted ``keys`` of one range. ``before`` and ``after`` are the turns that its first and last key share with the neighbouring ranges (-1: none there).

    Only byte depths that are whole turns give rows. Nodes on a border (the root, the first ``before`` turns of the first key, the
    first ``after`` of the last) hold this range's part. A node, its text and its place among its parent's children count in the first
    range that holds it.
    """
    root = Node(b"")
    for row, key in enumerate(keys):
        insert(root, key, row)
    first, last = _named(keys[0], max(before, 0)), _named(keys[-1], max(after, 0))
    final = len(keys) - 1
    continued = after * WIDTH == len(keys[-1])  # the next range goes on from the last key
    columns = [f.split(" ")[0] for f in NODES.split(", ")]
    rows: list[list] = []
    # what hangs below a tree node: first and last key, members, smallest id, leaves, spread, own, children counted for the next whole turn, their rows
    below: dict[int, tuple] = {}
    for node, start, end in postorder(root):
        parts = [below.pop(id(c)) for c in node.ordered()]
        members, leaves, spread, own, children = (sum(p[k] for p in parts) for k in (2, 4, 5, 6, 7))
        waiting = [r for p in parts for r in p[8]]
        least = [p[3] for p in parts]
        low_key, high_key = (parts[0][0], parts[-1][1]) if parts else (node.end, node.end)
        if node.end >= 0:
            low_key = node.end
            members += n[node.end]
            least.append(low[node.end])
        least = min(least)
        for depth in range(end // WIDTH, start // WIDTH if node is not root else -1, -1):
            on_first, on_last = depth <= before and low_key == 0, depth <= after and high_key == final
            border = on_first or on_last or not depth
            if depth * WIDTH == end and not parts:
                leaves = 0 if continued and low_key == final else 1
            text = chars[low_key][depth - 1] if depth else 0
            spread += members * text
            own += 0 if on_first else text
            name = None if not border else b"root" if not depth else first[depth] if on_first else last[depth]
            ended = ends[node.end] if node.end >= 0 and depth * WIDTH == end else None
            for child in waiting:
                child[1], child[4] = name, None if border else least
            row = [name, None, depth, least, None, members, children, leaves, spread, own, ended, border]
            rows.append(row)
            waiting, children = [row], 0 if on_first else 1
        below[id(node)] = (low_key, high_key, members, least, leaves, spread, own, children, waiting)
    return {c: [r[i] for r in rows] for i, c in enumerate(columns)}


# ----------------------------------------------------------------------------------------------------------
# Tables
# ----------------------------------------------------------------------------------------------------------
def rebuilt(turns: DataFrame, step: int = 100, most: int = 6) -> DataFrame:
    """``conv_id, digest, key, chars`` of every conversation with the beginning that it shares: the key is its turns' ids one after the other."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 2 * WIDTH)
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), name.alias("id"), F.length(text).alias("chars")).alias("t"))
    own = stored(ids.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "turns")
    starts = own.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("start"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    none = F.slice("turns", 1, 0)
    both = F.concat(F.slice(F.coalesce("start", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    rows = own.withColumn("h", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % step).join(starts, "base", "left").select("conv_id", both.alias("turns"))
    keyed = rows.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    return stored(keyed.select("conv_id", F.unhex(F.sha2("key", 256)).alias("digest"), "key", "chars"), "rebuilt")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (digest, conv_id): number, smallest id and digest of the ids for each digest. Ids stream through the hash, so a group of any size needs no room."""
    held, count, least, state = None, 0, None, hashlib.sha256()

    def row(digest: bytes, count: int, least: int, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([count], pa.int64()), pa.array([least], pa.int64()), pa.array([state.hexdigest()])], ["digest", "n", "low", "ends"])

    for batch in batches:
        digests, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        done: list[pa.RecordBatch] = []
        at = 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and digests[to] == digests[at]:
                to += 1
            if digests[at] != held:
                if held is not None:
                    done.append(row(held, count, least, state))
                held, count, least, state = digests[at], 0, ids[at], hashlib.sha256()
            state.update((("," if count else "") + ",".join(map(str, ids[at:to]))).encode())
            count += to - at
            at = to
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if held is not None:
        yield row(held, count, least, state)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the first and last keys of the ranges, in order: the turns shared with the range before and with the one behind."""
    held: list | None = None
    out: list[tuple[int, int, int]] = []
    for batch in batches:
        for part, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            common = -1
            if held is not None:
                common = shared(held[2], first) // WIDTH
                out.append((held[0], held[1], common))
            held = [part, common, last]
    if held is not None:
        out.append((held[0], held[1], -1))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32()) for k in range(3)], ["part", "before", "after"])


def sequences(conversations: DataFrame) -> DataFrame:
    """``key, chars, n, low, ends``: one row for each distinct conversation, with the number, smallest and digest of the ids that are it."""
    rows = conversations
    counted = rows.select("digest", "conv_id").repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(_hashed, "digest binary, n long, low long, ends string")
    keys = rows.groupBy("digest").agg(F.first("key").alias("key"), F.first("chars").alias("chars"))
    return counted.join(keys, "digest").select("key", "chars", "n", "low", "ends")


def in_ranges(distinct: DataFrame, ranges: int | None = None) -> DataFrame:
    """``distinct`` with ``part``, its range of keys, and the turns that the range's ends share with its neighbours.

    Keys are distinct, so a beginning that many of them share is cut like any other.
    """
    distinct = stored(distinct, "sequences")
    if ranges is None:
        ranges = max(partitions_of(distinct.sparkSession) // 4, int((distinct.agg(F.sum(F.length("key") + 64)).first()[0] or 0) // RANGE_BYTES), 1)
    dealt = stored(distinct.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    return dealt.join(ends.repartition(1).sortWithinPartitions("part").mapInArrow(_borders, "part int, before int, after int"), "part")


def trie(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Turns with equal (or null) number go by their id, repeated rows
    are turns of their own, a null role or text is empty, rows without conv_id are left out, and an empty table has no nodes, not even a
    root. A conversation is one row of 20 bytes a turn, whatever its texts' length. Turns count as equal when 128 bits of their digest are.
    """
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        made = trie_rows(*(rows[c].to_pylist() for c in ("key", "chars", "n", "low", "ends")), rows["before"][0].as_py(), rows["after"][0].as_py())
        kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        return pa.table({name: pa.array(made[name], kinds[kind]) for name, kind in (f.split(" ") for f in NODES.split(", "))})

    nodes = stored(in_ranges(sequences(rebuilt(turns)), ranges).groupBy("part").applyInArrow(run, NODES), "nodes")
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spread", "own")]
    border = nodes.where("border").groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *added, F.max("ends").alias("ends"))
    border = stored(border, "border")
    fields = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "spread", "own", "ends"]
    inner = nodes.where(~F.col("border"))
    open_rows = inner.where(F.col("parent").isNotNull()).select("parent", *fields).unionByName(border.select("parent", *fields))
    above = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    every = open_rows.join(above, "parent", "left").drop("parent").unionByName(inner.where(F.col("parent").isNull()).select("parent_conv_id", *fields))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("spread") - F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
