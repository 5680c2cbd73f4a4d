"""Operator 5, near duplicates by ProbMinHash: exponential arrivals of weighted shingles with early end, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import components, slices, small_batches, stored, trim, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
#: Bits of a shingle's number; its count within the text stands above them.
SHINGLE_BITS = 44
#: A shingle that comes more often stands several times.
MOST = (1 << (63 - SHINGLE_BITS)) - 1
#: Registers two texts must have in common before their shingles are compared: six deviations below what a similarity of 0.8 makes
#: likely, so a link is missed here with a chance below 1 in 10^7.
DEVIATIONS = 6
#: Bytes of text that are sketched at once.
SLICE = 3 << 20
#: Places for flags of wanted documents.
FLAGS = 1 << 20
#: Members of a bucket, and classes and bytes of shingles of a family, in one side of a comparison inside a task.
BUCKET_ROWS, FAMILY_ROWS, FAMILY_BYTES = 2048, 512, 16 << 20
#: Pairs that are compared one by one, and columns of the matrices that compare more at once.
FEW, COLUMNS = 64, 4096

_ONE, _TWO, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of a 64-bit split-mix generator."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of their numbers: text's row, shingle, times in the text. A text of fewer words is one shingle."""
    words = words_of(texts)
    if not len(words.codes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    own = pd.util.hash_array(np.array(words.vocabulary.to_pylist(), dtype=object), categorize=False).astype(np.uint64)[words.codes]
    starts, ends = words.starts, words.ends
    at = np.arange(len(own))
    row = words.rows
    end = ends[row]
    whole = at + n <= end
    begins = whole | ((at == starts[row]) & (words.counts[row] < n))
    at, row, end = at[begins], row[begins], end[begins]
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        here = np.minimum(at + k, len(own) - 1)
        value = np.where(at + k < end, mixed(value + own[here] + _STEP), value)
    key = np.sort((row.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (value >> np.uint64(64 - SHINGLE_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(SHINGLE_BITS)).astype(np.int64), key & np.uint64((1 << SHINGLE_BITS) - 1), times


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """ProbMinHash: each item arrives as a Poisson process whose rate is its weight; every arrival falls into one of ``size`` registers,
    and a register keeps the item that came first. An item stops once its next arrival is later than all registers of its text."""
    first = np.full((n_rows, size), np.inf)
    held = np.zeros((n_rows, size), dtype=np.uint64)
    latest = np.full(n_rows, np.inf)
    time, seed = np.zeros(len(row)), mixed(item + _STEP)
    while len(row):
        seed = seed + _STEP
        draw = mixed(seed)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        going = time < latest[row]
        row, item, weight, time, seed, draw = (x[going] for x in (row, item, weight, time, seed, draw))
        if not len(row):
            break
        slot = row * size + (mixed(draw) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first.reshape(-1), slot, time)
        won = time == first.reshape(-1)[slot]
        held.reshape(-1)[slot[won]] = item[won]
        some = row[np.concatenate([[True], row[1:] != row[:-1]])]
        latest[some] = first[some].max(axis=1)
    return held


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    n, size = signature.shape
    bands = signature.reshape(n, size // rows, rows)
    key = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        key = mixed(key * _STEP + bands[:, :, k])
    return key


def packed(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with their counts above them, one text after the other, and how many numbers each text has.

    A shingle that comes more than ``MOST`` times stands several times, with counts that add up to its own.
    """
    row, item, times = shingles(texts, n)
    if len(times) and times.max() > MOST:
        again = -(-times // MOST)
        last = np.zeros(int(again.sum()), dtype=bool)
        last[np.cumsum(again) - 1] = True
        rest = np.repeat(times - (again - 1) * MOST, again)
        row, item, times = np.repeat(row, again), np.repeat(item, again), np.where(last, rest, MOST)
    return (times.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | item, np.bincount(row, minlength=len(texts))


def unpacked(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, each once and in order, and their counts."""
    item, times = both & np.uint64((1 << SHINGLE_BITS) - 1), (both >> np.uint64(SHINGLE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, dtype=np.int64)
    return (item, times) if len(first) == len(item) else (item[first], np.add.reduceat(times, first))


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum over common items d of 1 / sum over all items e of max(wa(e) / wa(d), wb(e) / wb(d)), weights being counts."""
    (ia, wa), (ib, wb) = unpacked(a), unpacked(b)
    wa, wb = wa.astype(float), wb.astype(float)
    _, at_a, at_b = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
    if not len(at_a):
        return 0.0
    xa, xb = wa[at_a], wb[at_b]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    # with t = wb(d) / wa(d), an item counts wa(e) while wb(e) / wa(e) <= t, and wb(e) / t beyond
    ratio = xb / xa
    order = np.argsort(ratio, kind="stable")
    r, below, above = ratio[order], np.cumsum(xa[order]), np.cumsum(xb[order][::-1])[::-1]
    upto = np.searchsorted(r, ratio, side="right")
    tail = np.append(above, 0.0)[upto]
    return float((xa / (only_a + below[upto - 1] + (only_b + tail) / ratio)).sum())


def sketches(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, cls, bands, registers``. ``cls`` is a digest of the multiset of shingles (null without words); ``bands`` are the keys,
    ``registers`` two bytes of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows.column(0), *sketch(rows.column(1))], names=["doc_id", "cls", "bands", "registers"])
                trim()

    return docs.mapInArrow(run, "doc_id long, cls binary, bands array<long>, registers binary")


def _sketched(docs: DataFrame) -> DataFrame:
    with small_batches(docs.sparkSession):
        return stored(sketches(docs), "sketches")


def _digests(row: np.ndarray, item: np.ndarray, times: np.ndarray, n_rows: int) -> list[bytes | None]:
    n = np.bincount(row, minlength=n_rows)
    both = np.stack([item, times.astype(np.uint64)], axis=1)
    return [hashlib.blake2b(both[e - c : e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]


def sketch(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    row, item, times = shingles(texts)
    signature = signatures(row, item, times.astype(float), len(texts), BANDS * ROWS)
    keys = band_keys(signature).view(np.int64)
    short = mixed(signature).astype("<u2")
    held = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.arange(0, short.nbytes + 1, 2 * BANDS * ROWS, dtype=np.int32)), pa.py_buffer(short)])
    return pa.array(_digests(row, item, times, len(texts)), pa.binary()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel())), held


def least_common(similarity: float, size: int = BANDS * ROWS) -> int:
    """Common registers that a pair of this similarity has but for a chance below that of ``DEVIATIONS`` deviations."""
    return int(size * similarity - DEVIATIONS * (size * similarity * (1 - similarity)) ** 0.5)


def alike(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of class numbers that have enough registers in common to be compared in full."""
    least = least_common(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    left, right = (classes.select(F.col("num").alias(c), F.col("registers").alias(f"r_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of class numbers whose probability Jaccard reaches ``similarity``. ``held(num, items)`` has their packed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(k).to_pylist() for k in (2, 3))
            good = [probability_jaccard(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) >= similarity - 1e-12 for x, y in zip(*sides, strict=True)]
            trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (held.select(F.col("num").alias(c), F.col("items").alias(f"items_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packed shingles of the classes ``wanted(num, cls, rep)``, read from the documents with these ids: ``num, items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                texts = batch.column(0).slice(part.start, part.stop - part.start)
                row, item, times = shingles(texts)
                flat, n = packed(texts)
                items = [flat[e - c : e].tobytes() for e, c in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays([pa.array(_digests(row, item, times, len(texts)), pa.binary()), pa.array(items, pa.binary())], names=["cls", "items"])
                del texts, row, item, times, flat, n, items
                yield out
                del out
                trim()

    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    rows = docs.where(_flagged(ids)).join(ids, docs["doc_id"].eqNullSafe(ids["_rep"]), "left_semi").select("text")
    return rows.mapInArrow(run, "cls binary, items binary").join(wanted.select("num", "cls"), "cls").dropDuplicates(["num"]).select("num", "items")


def _flagged(ids: DataFrame) -> Column:
    """True for all of ``ids(_rep)`` and for few other doc_ids: 2^20 flags at hashed places keep most texts out of the shuffle that follows."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FLAGS)).cast("int")
    flags = np.zeros(FLAGS, dtype=bool)
    flags[ids.select(place("_rep").alias("p")).distinct().toArrow().column("p").to_numpy()] = True
    held = ids.sparkSession.sparkContext.broadcast(flags)

    @F.arrow_udf("boolean")
    def flagged(places: pa.Array) -> pa.Array:
        return pa.array(held.value[places.to_numpy(zero_copy_only=False)])

    return flagged(place("doc_id"))


def duplicate_classes(docs: DataFrame, sketched: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``cls, component`` for every class of equal shingles that shares a bucket with another one.

    Classes that share a band's key meet in a bucket. First every member is paired with the bucket's smallest; members of buckets that still
    hold several groups are compared inside tasks. A pair's registers are compared before its shingles are fetched.
    """
    classes = sketched.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("registers").alias("registers"))
    classes = stored(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
    members = classes.select("num", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.min("num").alias("low"), F.max("num").alias("high")).where("low <> high").drop("high")
    members = stored(members.join(several, "bucket"), "members")
    met = members.select("num").distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        close = stored(alike(pairs, classes, similarity), "close")
        ends = close.select(F.col("a").alias("num")).union(close.select("b")).distinct()
        return stored(verified(close, shingles_of(docs, classes.join(ends, "num", "left_semi").select("num", "cls", "rep")), similarity), "links")

    links = linked(members.where("num <> low").select(F.col("low").alias("a"), F.col("num").alias("b")).distinct())
    grouped = stored(_grouped(met, links), "groups")
    open_ = stored(_several_groups(members, grouped), "open")
    if not open_.isEmpty():
        grouped = _grouped(met, links.union(_within_families(docs, classes, open_, similarity)))
    return classes.select("num", "cls").join(grouped, "num").select("cls", "component")


def _several_groups(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Members, with their ``component``, of the buckets that hold more than one."""
    rows = members.join(grouped, "num")
    parts = rows.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
    return rows.join(parts, "bucket", "left_semi")


def _grouped(met: DataFrame, links: DataFrame) -> DataFrame:
    return components(met.select(F.col("num").alias("id")), links).select(F.col("id").alias("num"), F.col("component_id").alias("component"))


def _cells(rows: DataFrame, family: str, most_rows: int, most_bytes: int | None = None) -> DataFrame:
    """``rows`` dealt into parts of bounded rows (and bytes of ``items``) within each family, and repeated for every cell: each two parts of a family meet in one.

    A cell is named by its smaller and its larger part.
    """
    size = F.ceil(F.count("*") / most_rows)
    if most_bytes:
        size = F.greatest(size, F.ceil(F.sum(F.length("items")) / most_bytes))
    parts = rows.groupBy(family).agg(size.cast("int").alias("parts"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("x"), F.greatest(q, F.col("part")).alias("y")))
    dealt = rows.join(parts, family).withColumn("part", F.pmod(F.xxhash64("num"), F.col("parts")).cast("int"))
    return dealt.withColumn("cell", F.explode(cells)).drop("parts")


class _Groups:
    """Groups of one cell, joined as links come up."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, g: int) -> int:
        while (above := self.up.get(g, g)) != g:
            self.up[g] = self.up.get(above, above)
            g = above
        return g

    def join(self, a: int, b: int) -> None:
        self.up[self.top(a)] = self.top(b)


def _close_pairs(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell that are of different groups and have at least so many registers in common, the most alike first."""
    x, y = table["cell"][0].as_py().values()
    part, group = table["part"].to_numpy(), table["component"].to_numpy()
    registers = np.frombuffer(b"".join(table["registers"].to_pylist()), dtype="<u2").reshape(table.num_rows, -1)
    left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
    found_i, found_j, found_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left:
        other = right[right > i] if x == y else right
        other = other[group[other] != group[i]]
        common = (registers[other] == registers[i]).sum(axis=1)
        good = common >= least
        found_i.append(np.full(int(good.sum()), i))
        found_j.append(other[good])
        found_n.append(common[good])
    order = np.argsort(-np.concatenate(found_n), kind="stable")
    return np.concatenate(found_i)[order], np.concatenate(found_j)[order]


def _similarities(items: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Probability Jaccard of many pairs of one cell at once, where common items have equal counts: their sum c over a + b - c. Others are not-a-number.

    Common items are counted by products of presence matrices, a few columns at a time; items of one text only are left out.
    """
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    held = [unpacked(np.frombuffer(items[r], dtype="<u8")) for r in rows.tolist()]
    total = np.array([t.sum() for _, t in held], dtype=float)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _ in held])
    times = np.concatenate([t for _, t in held])
    column, often = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True, return_counts=True)[1:]
    some = often[column] > 1
    owner, times, column = owner[some], times[some], np.unique(column[some], return_inverse=True)[1]
    plain = not (times > 1).any()
    left, right = np.unique(at[: len(i)], return_inverse=True), np.unique(at[len(i) :], return_inverse=True)
    place = np.full((2, len(rows)), -1)
    place[0, left[0]], place[1, right[0]] = np.arange(len(left[0])), np.arange(len(right[0]))
    # an item with another count is another column
    exact = column if plain else np.unique(np.stack([column, times]), axis=1, return_inverse=True)[1].ravel()

    def common(column: np.ndarray, weight: np.ndarray) -> np.ndarray:
        order = np.argsort(column, kind="stable")
        out = np.zeros((len(left[0]), len(right[0])))
        ends = np.searchsorted(column[order], np.arange(0, (column.max() + 1 if len(column) else 0) + COLUMNS, COLUMNS))
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            own = order[low:high]
            sides = []
            for side, w in ((0, weight), (1, None)):
                use = own[place[side, owner[own]] >= 0]
                m = np.zeros((out.shape[side], COLUMNS), dtype=np.float64 if not plain else np.float32)
                m[place[side, owner[use]], column[use] % COLUMNS] = 1.0 if w is None else w[use]
                sides.append(m)
            out += sides[0] @ sides[1].T
        return out

    one = np.ones(len(column))
    same = common(exact, times.astype(float))
    c = same[left[1], right[1]]
    out = c / (total[at[: len(i)]] + total[at[len(i) :]] - c)
    if not plain:
        uneven = common(column, one) != common(exact, one)
        out[uneven[left[1], right[1]]] = np.nan
    return out


def _links_table(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _within_families(docs: DataFrame, classes: DataFrame, open_: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between groups that meet in a bucket.

    First the registers of a bucket's members are compared in tasks; of the pairs with enough in common a spanning forest goes on, and what it connects is a
    family. Then families are compared in tasks, every two parts in a cell: of the pairs close enough, the most alike first, the shingles are compared, and a link
    joins its groups at once. What is handed out spans the groups found; a pair within one group costs nothing.
    """
    least = least_common(similarity)
    registers = classes.select("num", "registers")

    def near(table: pa.Table) -> pa.Table:
        num, seen, a, b = table["num"].to_pylist(), _Groups(), [], []
        for i, j in zip(*(v.tolist() for v in _close_pairs(table, least)), strict=True):
            if seen.top(num[i]) != seen.top(num[j]):
                seen.join(num[i], num[j])
                a.append(num[i])
                b.append(num[j])
        return _links_table(a, b)

    met = _cells(open_.select("bucket", "num", "component").join(registers, "num"), "bucket", BUCKET_ROWS)
    forest = stored(met.groupBy("bucket", "cell").applyInArrow(near, "a long, b long"), "forest")
    nums = forest.select(F.col("a").alias("num")).union(forest.select("b")).distinct()
    family = components(nums.select(F.col("num").alias("id")), forest).select(F.col("id").alias("num"), F.col("component_id").alias("family"))
    wanted = stored(classes.select("num", "cls", "rep", "registers").join(family, "num").join(open_.select("num", "component").distinct(), "num"), "families")
    held = shingles_of(docs, wanted.select("num", "cls", "rep")).join(wanted.select("num", "registers", "component", "family"), "num")

    def link(table: pa.Table) -> pa.Table:
        num, group, items, seen, a, b = table["num"].to_pylist(), table["component"].to_pylist(), table["items"].to_pylist(), _Groups(), [], []
        left, right = _close_pairs(table, least)
        known = _similarities(items, left, right) if len(left) > FEW else np.full(len(left), np.nan)
        for i, j, value in zip(left.tolist(), right.tolist(), known.tolist(), strict=True):
            if seen.top(group[i]) == seen.top(group[j]):
                continue
            if value != value:
                value = probability_jaccard(*(np.frombuffer(items[r], dtype="<u8") for r in (i, j)))
            if value >= similarity - 1e-12:
                seen.join(group[i], group[j])
                a.append(num[i])
                b.append(num[j])
        return _links_table(a, b)

    return stored(_cells(stored(held, "held"), "family", FAMILY_ROWS, FAMILY_BYTES).groupBy("family", "cell").applyInArrow(link, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` for every row: documents linked by a probability Jaccard of their weighted five-word shingles of ``similarity``
    or more, over any chain of links, share a class, whose id is the smallest doc_id in it; ``kept`` marks that document.

    Texts with equal shingles in equal numbers are one class from the start. A text without words (null, empty, white space) is a class by itself. Rows that repeat a doc_id
    with the same text are all kept or all not. A null doc_id belongs to its text's class; if all ids of a class are
    null so is its class_id, and its rows are kept. A text of any length is sketched and compared whole. An empty table gives an empty result. Only the two named columns are read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = _sketched(source)
    return _decided(sketched, duplicate_classes(source, sketched, similarity)).select("doc_id", "class_id", "kept")


def _decided(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """Adds ``class_id, kept`` to ``rows(doc_id, cls, ..)``. The table of classes has each once, so the adaptive skew join splits one that most rows belong to."""
    ids = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low")).join(grouped, "cls", "left")
    alone = ids.where("component IS NULL").select("cls", F.col("low").alias("class_id"))
    ids = ids.where("component IS NOT NULL")
    named = ids.join(ids.groupBy("component").agg(F.min("low").alias("class_id")), "component").select("cls", "class_id").unionByName(alone)
    out = rows.drop("bands", "registers").join(named, "cls", "left")
    out = out.withColumn("class_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    return out.withColumn("kept", F.col("class_id").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, the one with the smallest doc_id (nulls last, then the table's order). Texts without words all stay."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("id"), whole.alias("doc")), "documents", "zstd")
    source = held.select(F.col("rid").alias("doc_id"), F.col("doc")[text].alias("text"))
    sketched = _sketched(source)
    grouped = duplicate_classes(source, sketched, similarity)
    place = F.struct(F.col("id").isNull(), "id", "rid")
    rows = held.select("rid", "id").join(sketched.where("cls IS NOT NULL").select(F.col("doc_id").alias("rid"), "cls"), "rid")
    lowest = rows.groupBy("cls").agg(F.min(place).alias("low")).join(grouped, "cls", "left").groupBy("component", F.when(F.col("component").isNull(), F.col("cls")).alias("g")).agg(F.min("low").alias("low"))
    gone = stored(rows.select("rid").join(lowest.select(F.col("low.rid").alias("rid")), "rid", "left_anti"), "gone")
    return held.join(gone, "rid", "left_anti").select("doc.*")
