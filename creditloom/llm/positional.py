"""Operator 12, benchmark decontamination: a distributed positional inverted index, phrases by intersecting lists from the rarest term on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import Words, slices, stored, words_of
from creditloom.session import small_side

WINDOW = 10
#: Words of test items that meet a block's lists at once; more are dealt out over several passes of that block.
CHUNK_WORDS = 1 << 19
#: Places compared at once inside a task.
STEP = 1 << 20
SHIFT = np.int64(1 << 32)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)], dtype=np.uint8)
INDEX = "block long, term string, n long, gaps binary, docs array<struct<doc_id: {key}, n_words: long>>"


def terms_of(texts: pa.Array) -> Words:
    """Words of letters, digits and characters beyond ASCII, A-Z in lower case. Each byte is mapped by a table, so UTF-8 sequences stay whole."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return words_of(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(_LOWER[data])))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of up to 35 bits as bytes of seven bits, low ones first, the last byte of each below 128; and the length of each."""
    size = 1 + sum((values >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        has = size > k
        out[(ends - size)[has] + k] = ((values[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(5):
        has = ends - starts >= k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of all texts, one row for each term and block of documents: ``n`` places as gaps.

    A block is a slice of a task's texts (6 MB, one document at least). Places count words through the block, with one number left
    out between documents, so no phrase runs over their border. One more row of each block, without a term, lists its documents in order.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch.column(1)):
                words = terms_of(batch.column(1)[part])
                order = np.argsort(words.codes, kind="stable")
                place = (np.arange(len(words.codes)) + words.rows)[order]
                n = np.bincount(words.codes, minlength=len(words.vocabulary))
                first = np.cumsum(n) - n
                gap = np.diff(place, prepend=0)
                gap[first] = place[first]
                data, size = packed(gap)
                cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.add.reduceat(size, first))]) if len(first) else np.zeros(1, np.int64)
                gaps = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).cast(pa.binary())
                ids = batch.column(0)[part]
                listed = pa.StructArray.from_arrays([ids, pa.array(words.counts, pa.int64())], ["doc_id", "n_words"])
                meta = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), listed)
                none = pa.nulls(len(n), meta.type)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n) + 1, block)),
                        pa.concat_arrays([words.vocabulary.cast(pa.string()), pa.nulls(1, pa.string())]),
                        pa.array(np.append(n, len(ids)), pa.int64()),
                        pa.concat_arrays([gaps, pa.nulls(1, pa.binary())]),
                        pa.concat_arrays([none, meta]),
                    ],
                    ["block", "term", "n", "gaps", "docs"],
                )
                block += 1

    return stored(docs.select(key, text).mapInArrow(run, INDEX.format(key=kind)), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """``block, row, doc_id, n_words`` of every document of an index."""
    return index.where(F.col("term").isNull()).select("block", F.posexplode("docs").alias("row", "d")).select("block", "row", "d.doc_id", "d.n_words")


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, words`` of the test items that have words, numbered by ``iid``."""
    kind = benchmark.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = terms_of(batch.column(1)[part])
                words = pa.ListArray.from_arrays(pa.array(np.append(found.starts, len(found.codes)), pa.int32()), found.vocabulary.cast(pa.string()).take(pa.array(found.codes)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], words], ["item_id", "words"])

    rows = benchmark.select(key, text).mapInArrow(run, f"item_id {kind}, words array<string>").where(F.size("words") > 0)
    return stored(rows.withColumn("iid", F.monotonically_increasing_id()), "items")


def windows_at(words: Column, width: int = WINDOW) -> Column:
    """First words of the windows: every run of ``width`` words, or the whole of a shorter item."""
    return F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))


def lists_of(index: DataFrame, items: DataFrame) -> DataFrame:
    """The lists of the items' terms, and every block's row of documents. One pass over the index; all that follows reads these lists only."""
    terms = small_side(stored(items.select(F.explode("words").alias("term")).distinct(), "terms"))
    wanted = index.where(F.col("term").isNotNull()).join(terms, "term", "left_semi").select(*index.columns)
    return stored(wanted.union(index.where(F.col("term").isNull())), "lists")


def _meetings(lists: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """``block, iid``: the blocks that hold the rarest term of one of an item's windows. A window with a term that no block holds meets none."""
    spread = items.select("iid", F.posexplode("words").alias("pos", "term"))
    totals = lists.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("total"))
    rated = spread.join(totals, "term", "left").groupBy("iid").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("total", F.lit(0)).alias("total"), "term"))).alias("r"))
    keyed = rated.select("iid", F.transform("r", lambda c: F.struct(c["total"].alias("total"), c["term"].alias("term"))).alias("r"))
    rarest = F.array_distinct(F.transform(windows_at(F.col("r"), width), lambda s: F.array_min(F.slice("r", s, width))))
    wanted = keyed.select("iid", F.explode(rarest).alias("w")).where("w.total > 0").select("iid", F.col("w.term").alias("term"))
    return lists.select("block", "term").join(wanted, "term").select("block", "iid").distinct()


class Block:
    """The lists of one block. ``keys`` holds (term, place) as one number, in order, so a lookup of many places is one binary search."""

    def __init__(self, lists: pa.Table):
        meta = lists.filter(pc.is_null(lists["term"]))["docs"].to_pylist()[0]
        self.n_words = np.array([d["n_words"] for d in meta], dtype=np.int64)
        self.starts = np.cumsum(self.n_words) - self.n_words + np.arange(len(meta))
        held = lists.filter(pc.is_valid(lists["term"]))
        self.terms = held["term"].combine_chunks()
        self.n = held["n"].to_numpy()
        self.first = np.cumsum(self.n) - self.n
        gaps = unpacked(np.frombuffer(b"".join(held["gaps"].to_pylist()), dtype=np.uint8))
        run = np.cumsum(gaps)
        rows = np.repeat(np.arange(len(self.n)), self.n)
        self.places = run - (run[self.first] - gaps[self.first])[rows] if len(gaps) else gaps
        self.keys = rows * SHIFT + self.places

    def from_place(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """First place of a term that is not below ``place``, or a huge number."""
        at = np.searchsorted(self.keys, code * SHIFT + np.maximum(place, 0))
        found = np.append(self.keys, -1)[at]
        return np.where(found // SHIFT == code, found % SHIFT, SHIFT)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows (rows of ``codes``) with every place of their rarest term, a bounded number at once: window, its codes and offsets from the rarest on, place."""
        rank = np.argsort(self.n[codes], axis=1, kind="stable")
        ranked = np.take_along_axis(codes, rank, axis=1)
        count = self.n[ranked[:, 0]]
        ends = np.cumsum(count)
        total, low = int(ends[-1]) if len(ends) else 0, 0
        for low in range(0, total, STEP):
            k = np.arange(low, min(low + STEP, total))
            window = np.searchsorted(ends, k, side="right")
            yield window, ranked, rank, self.places[self.first[ranked[window, 0]] + k - (ends - count)[window]]

    def phrases(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) of every occurrence of the windows, as lists taken together one after the other at their offsets."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, ranked, rank, place in self.candidates(codes):
            start = place - rank[window, 0]
            for j in range(1, codes.shape[1]):
                if not len(window):
                    break
                wanted = ranked[window, j] * SHIFT + start + rank[window, j]
                ok = (self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted) & (start >= 0)
                window, start = window[ok], start[ok]
            out.append((window, start))
        return np.concatenate([w for w, _ in out]), np.concatenate([s for _, s in out])

    def near(self, codes: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, first place of the stretch) of every stretch of ``within`` words of one document that holds all words of a window in any order."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, ranked, _, place in self.candidates(codes):
            doc = self.document(place)
            low, high = self.starts[doc], self.starts[doc] + self.n_words[doc]
            for j in range(1, codes.shape[1]):  # each other word lies close to the rarest one
                ok = self.from_place(ranked[window, j], np.maximum(place - within + 1, low)) < np.minimum(place + within, high)
                window, place, low, high = window[ok], place[ok], low[ok], high[ok]
            for back in range(within):
                start = place - back
                stop = np.minimum(start + within, high)
                ok = start >= low
                for j in range(codes.shape[1]):
                    ok &= self.from_place(ranked[window, j], start) < stop
                out.append((window[ok], start[ok]))
        found = np.unique(np.stack([np.concatenate([w for w, _ in out]), np.concatenate([s for _, s in out])]), axis=1)
        return found[0], found[1]


def _matched(block: Block, items: pa.Table, width: int, within: int | None) -> pa.Table:
    """``row, iid, start, length`` of every match in one block."""
    words = items["words"].combine_chunks()
    lengths = np.diff(words.offsets.to_numpy())
    codes = pc.fill_null(pc.index_in(words.flatten(), value_set=block.terms), -1).to_numpy().astype(np.int64)
    first = np.cumsum(lengths) - lengths
    out = []
    for w in np.unique(np.minimum(lengths, width)):
        own = np.flatnonzero(np.minimum(lengths, width) == w)
        count = lengths[own] - w + 1
        item = np.repeat(own, count)
        at = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        grid = codes[at[:, None] + np.arange(w)]
        full = (grid >= 0).all(axis=1)
        grid, item = grid[full], item[full]
        window, start = block.phrases(grid) if within is None else block.near(grid, within)
        row = block.document(start)
        long = np.full(len(start), w) if within is None else np.minimum(within, block.starts[row] + block.n_words[row] - start)
        out.append((row, item[window], start - block.starts[row], long))
    row, item, start, long = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(4))
    return pa.table({"row": pa.array(row, pa.int32()), "iid": items["iid"].combine_chunks().take(pa.array(item)), "start": pa.array(start, pa.int64()), "length": pa.array(long, pa.int64())})


def matches(index: DataFrame, items: DataFrame, width: int = WINDOW, within: int | None = None) -> DataFrame:
    """``block, row, items, spans``: for each document with a match its items (``iid``) and the stretches of words hit, as far as they don't touch.

    Exact phrases of ``width`` words, or with ``within`` the stretches of so many words that hold all words of a window in any order.
    Items go to the blocks that hold a window's rarest term; there the lists are taken together from the rarest term on. A block's lists
    and at most ``CHUNK_WORDS`` words of items (one item at least) meet in a task.
    """
    size = items.agg(F.sum(F.size("words"))).first()[0] or 0
    chunks = -(-size // CHUNK_WORDS) or 1
    cell = lambda chunk: (F.col("block") * chunks + chunk).alias("cell")
    held = lists_of(index, items)
    pairs = _meetings(held, items, width).select("block", "iid", cell(F.pmod(F.xxhash64("iid"), F.lit(chunks))))
    pairs = stored(pairs, "meetings")
    lists = held.select("block", "term", "n", "gaps", "docs", cell(F.lit(0)) if chunks == 1 else F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.col("block") * chunks + c)).alias("cell"))
    lists = lists.join(pairs.select("cell").distinct(), "cell", "left_semi")
    sent = pairs.join(items.select("iid", "words"), "iid").select("cell", "iid", "words")

    def run(lists: pa.Table, items: pa.Table) -> pa.Table:
        if not lists.num_rows or not items.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("block", pa.int64()), ("row", pa.int32()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))))})
        block = lists["block"][0].as_py()
        found = _matched(Block(lists), items, width, within)
        grouped = found.group_by("row").aggregate([("iid", "distinct")])
        row, start = found["row"].to_numpy(), found["start"].to_numpy()
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], (start + found["length"].to_numpy())[order]
        # running ends, kept apart by document through an offset
        apart = (end.max(initial=0) + 1) * row.astype(np.int64)
        reach = np.maximum.accumulate(end + apart) if len(end) else end
        new = np.concatenate([[True], (start + apart)[1:] > reach[:-1]]) if len(end) else np.zeros(0, bool)
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(row)) - 1 if len(opens) else opens
        spans = pa.StructArray.from_arrays([pa.array(start[opens], pa.int64()), pa.array((reach - apart)[closes], pa.int64())], ["low", "high"])
        rows, count = np.unique(row[opens], return_counts=True)
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        by_row = dict(zip(grouped["row"].to_pylist(), grouped["iid_distinct"].to_pylist(), strict=True))
        return pa.table({
            "block": pa.array(np.full(len(rows), block), pa.int64()), "row": pa.array(rows, pa.int32()),
            "items": pa.array([by_row[r] for r in rows.tolist()], pa.list_(pa.int64())), "spans": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans),
        })

    met = lists.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, "block long, row int, items array<long>, spans array<struct<low: long, high: long>>")
    return met if chunks == 1 else met.groupBy("block", "row").agg(F.flatten(F.collect_list("items")).alias("items"), _joined(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))


def _joined(spans: Column) -> Column:
    """Stretches in order, those that touch put together."""
    def put(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        more = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], s["high"]).alias("high"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["high"] >= s["low"]), more).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.slice(spans, 1, 0), put)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document; other columns are not read.

    A null text has no words, an empty one neither; both come back clean. Rows with one doc_id are judged one by one. Benchmark rows
    with one item_id are one item, a null item_id is written as nothing; items without words are left out. A text of any length is one
    unit of a block. Empty tables on either side give no rows, or clean ones.
    """
    index, items = build_index(docs), items_of(benchmark)
    found = stored(matches(index, items, width), "matches")
    names = items.select("iid", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"))
    listed = found.select("block", "row", F.explode("items").alias("iid")).join(names, "iid").groupBy("block", "row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    hits = found.select("block", "row", hit.alias("n_hit")).join(listed, ["block", "row"])
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("names", F.array().cast("array<string>"))
    return documents_of(index).join(hits, ["block", "row"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(names, ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )

