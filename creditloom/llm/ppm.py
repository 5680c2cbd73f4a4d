"""Operator 10, language-model scores by prediction by partial matching: a byte-context trie counted over the training texts, escapes with symbol exclusion."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import Words, partitions_of, per_row, slices, small_batches, stored, trim, words_of

ORDER = 5
FOLDS, HELD_OUT = 7, 2
END = 0x0A
#: Bytes that a text of words, single spaces and the end can hold: tab and the other white space never occur.
ALPHABET = 252
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
#: Windows that are gathered before equal ones are added up.
GATHERED = 1 << 18
LOG10E = float(np.log10(np.e))

PACKED = "kind string, shard int, block long, keys binary, sizes binary, counts binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_ids: pa.Array) -> np.ndarray:
    """Texts that the model does not learn from. A null id counts as the empty text, which is learnt from."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in doc_ids.to_pylist()], dtype=bool)


def _even(texts: pa.Array, limit: int) -> Iterator[slice]:
    """Consecutive row ranges of about the same bytes of text, as few as ``limit`` bytes each allow; no range is over it by more than its last text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    total = int(ends[-1]) if len(ends) else 0
    n = max(1, -(-total // limit))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, total * np.arange(1, n) // n, side="left") + 1, [len(texts)]]))
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield slice(start, stop)


def blocks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in blocks of consecutive rows, one compressed row for each: ``block, blob``. Stored, so a block stays what it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for part in _even(batch.column(1), BLOCK_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([rows.column(0), pc.ascii_lower(pc.fill_null(rows.column(1), ""))], names=["doc_id", "text"]))
                blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
                number = (batch.column(2)[0].as_py() << 32) + n
                n += 1
                del rows, sink
                trim()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])

    return stored(docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("_p")).mapInArrow(run, "block long, blob binary"), "blocks")


def opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()


def packed(values: np.ndarray) -> bytes:
    """Numbers in zstd, first bytes of all before second ones: small numbers and small steps take a byte or less each."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpacked(blob: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def packed_codes(code: np.ndarray) -> bytes:
    """Ascending codes, by their steps."""
    return packed(np.diff(code.astype("<u8"), prepend=np.uint64(0)))


def unpacked_codes(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u8"), dtype=np.uint64)


def windows(words: Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of each text, its words joined by single spaces and closed by the end, that byte below the ``order`` bytes before it (ends before the text),
    and the number of bytes of each text."""
    offsets = np.concatenate([[0], words.ends]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.vocabulary.take(pa.array(words.codes))), " ")
    padded = pc.binary_join_element_wise("\n" * order, joined, "\n", "")
    size = pc.binary_length(padded).to_numpy().astype(np.int64)
    data = np.frombuffer(padded.buffers()[2] or b"", dtype=np.uint8)[: int(size.sum())]
    code = np.zeros(len(data), dtype=np.uint64)
    for k in range(order, -1, -1):
        code <<= np.uint64(8)
        code[k:] |= data[: len(data) - k]
    real = np.ones(len(data), dtype=bool)
    starts = np.cumsum(size) - size
    for k in range(order):
        real[starts + k] = False
    return code[real], size - order


def _requests(table: pa.Table, block: int, shards: int) -> Iterator[tuple]:
    """What a block holds and how often its training texts have it: words, byte windows, and pairs of bytes."""
    texts, train = table.column("text").combine_chunks(), ~held_out(table.column("doc_id"))
    vocabulary, counts = [], []

    def sliced() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in slices(texts, SLICE_BYTES):
            words = words_of(texts[part])
            learnt = train[part].astype(np.int64)
            vocabulary.append(words.vocabulary)
            counts.append(np.bincount(words.codes, weights=learnt[words.rows], minlength=len(words.vocabulary)).astype(np.int64))
            code, n = windows(words)
            number, distinct = pd.factorize(code)
            yield distinct, np.bincount(number, weights=np.repeat(learnt, n), minlength=len(distinct))

    code, times = _summed(sliced())
    trim()
    every = pa.concat_arrays(vocabulary).dictionary_encode()
    distinct = every.dictionary
    count = np.bincount(every.indices.to_numpy(), weights=np.concatenate(counts), minlength=len(distinct)).astype("<i8")
    del every, vocabulary, counts
    shard = (pd.util.hash_array(np.array(distinct.to_pylist(), dtype=object), categorize=False) % np.uint64(shards)).astype(np.int64) if len(distinct) else np.zeros(0, dtype=np.int64)
    for s, at in _by_shard(shard):
        own = distinct.take(pa.array(at))
        text = zstandard.ZstdCompressor(level=1).compress(b"".join(own.cast(pa.binary()).to_pylist()))
        yield "word", s, block, text, packed(pc.binary_length(own).to_numpy().astype("<u4")), packed(count[at])
    for s, at in _by_shard(_branch(code, shards)):
        yield "window", s, block, packed_codes(code[at]), b"", packed(times[at].astype("<i8"))
    pairs = np.bincount((code & np.uint64(0xFFFF)).astype(np.int64), weights=times, minlength=1 << 16).astype("<i8")
    some = np.flatnonzero(pairs)
    yield "pair", -1, block, some.astype("<u4").tobytes(), b"", pairs[some].tobytes()
    yield "end", -1, block, b"", b"", np.array([train.sum()], dtype="<i8").tobytes()


def _summed(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order, and the sums of their counts. Equal ones are added up whenever the new ones outnumber those held, so that memory follows the distinct ones."""
    codes, counts, held, new = [np.zeros(0, dtype=np.uint64)], [np.zeros(0)], 0, 0
    for code, count in parts:
        codes.append(code)
        counts.append(count)
        new += len(code)
        if new > max(GATHERED, held):
            merged = _merged(codes, counts)
            codes, counts, held, new = [merged[0]], [merged[1]], len(merged[0]), 0
    return _merged(codes, counts)


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    code, count = code[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.diff(code, prepend=code[:1] + np.uint64(1)))
    return code[first], np.add.reduceat(count, first) if len(first) else count


def _branch(code: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each window: whole branches of the trie, by the two bytes before the last."""
    return (((code >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) >> np.uint64(4)).astype(np.int64) % shards


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(shard[at[0]]), at


def requests(held: DataFrame, shards: int) -> DataFrame:
    """A row for each kind and shard of a block, keys in one binary and counts in another."""
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(_requests(opened(blob.as_py()), block, shards))
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                del rows
                trim()
                yield out

    with small_batches(held.sparkSession, rows=1):
        return stored(held.mapInArrow(run, PACKED), "requests")


def strings(keys: bytes, sizes: bytes) -> pa.Array:
    lengths = unpacked(sizes, "<u4").astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i4")
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.ZstdDecompressor().decompress(keys))])


class LowOrders:
    """Counts of bytes and of pairs of bytes, at most 2^16 of them, with what their escapes need."""

    def __init__(self, pairs: np.ndarray):
        self.pair = pairs.reshape(256, 256).astype(float)  # byte before, byte
        self.single = self.pair.sum(axis=0)
        seen = self.pair > 0
        self.kinds, self.total = seen.sum(axis=1), self.pair.sum(axis=1)
        self.left = self.single.sum() - (seen * self.single[None, :]).sum(axis=1)
        self.left_kinds = (self.single > 0).sum() - self.kinds
        self.unseen = ALPHABET - (self.single > 0).sum()


def costs(code: np.ndarray, count: np.ndarray, low: LowOrders, order: int = ORDER) -> np.ndarray:
    """log10 of the chance of each window's last byte after the bytes before it.

    ``code`` is sorted and has every window whose last two context bytes are those of one of its members. Escapes follow method C: a context with t
    counts of q different bytes gives a byte its count over t + q and the escape q over t + q. After an escape the bytes of the longer context are
    left out of the shorter one. Below single bytes all bytes not seen are equally likely.
    """
    out, done = np.zeros(len(code)), np.zeros(len(code), dtype=bool)
    above = None
    for k in range(order, 1, -1):
        entry, first, of_entry = np.unique(code & np.uint64((1 << (8 * (k + 1))) - 1), return_index=True, return_inverse=True)
        n = np.bincount(of_entry, weights=count, minlength=len(entry))
        context, of_context = np.unique(entry >> np.uint64(8), return_inverse=True)
        total = np.bincount(of_context, weights=n, minlength=len(context))
        kinds = np.bincount(of_context, weights=n > 0, minlength=len(context))
        here = of_context[of_entry]
        if above is None:
            t, q = total[here], kinds[here]
        else:
            a_entry_first, a_n, a_of_context, a_here, a_kinds = above
            shared = np.bincount(a_of_context, weights=np.where(a_n > 0, n[of_entry[a_entry_first]], 0.0), minlength=len(a_kinds))
            t, q = total[here] - shared[a_here], kinds[here] - a_kinds[a_here]
        out, done = _step(out, done, n[of_entry], t, q)
        above = first, n, of_context, here, kinds
    before, last = ((code >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64), (code & np.uint64(0xFF)).astype(np.int64)
    a_entry_first, a_n, a_of_context, a_here, a_kinds = above
    shared = np.bincount(a_of_context, weights=np.where(a_n > 0, low.pair[before, last][a_entry_first], 0.0), minlength=len(a_kinds))
    out, done = _step(out, done, low.pair[before, last], low.total[before] - shared[a_here], low.kinds[before] - a_kinds[a_here])
    out, done = _step(out, done, low.single[last], low.left[before], low.left_kinds[before])
    return np.where(done, out, out - np.log(max(1, low.unseen))) * LOG10E


def _step(out: np.ndarray, done: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mass = np.maximum(total + kinds, 1.0)
    hit = ~done & (n > 0)
    escape = ~done & ~hit & (total + kinds > 0) & (kinds > 0)
    out = np.where(hit, out + np.log(np.where(hit, n, 1.0) / mass), out)
    out = np.where(escape, out + np.log(np.where(escape, kinds, 1.0) / mass), out)
    return out, done | hit


def _answer(table: pa.Table, low: LowOrders) -> Iterator[tuple]:
    """Of one kind and shard: to each block the counts of its words in the whole corpus, or the costs of its windows. Windows are taken from one block at a time."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    block, keys, sizes, counts = (table.column(c).to_pylist() for c in ("block", "keys", "sizes", "counts"))
    if kind == "word":
        own = [strings(k, n) for k, n in zip(keys, sizes, strict=True)]
        ends = np.cumsum([len(x) for x in own])
        coded = pa.concat_arrays(own).dictionary_encode()
        at = coded.indices.to_numpy()
        total = np.bincount(at, weights=np.concatenate([unpacked(c, "<i8") for c in counts]), minlength=len(coded.dictionary)).astype("<i8")
        yield "all", -1, -1, b"", b"", np.array([int(total.sum()), int((total > 0).sum())], dtype="<i8").tobytes()
        for k, end in enumerate(ends.tolist()):
            yield kind, shard, block[k], keys[k], sizes[k], packed(total[at[end - len(own[k]) : end]])
        return
    code, count = _summed((unpacked_codes(k), unpacked(c, "<i8")) for k, c in zip(keys, counts, strict=True))
    cost = costs(code, count, low).astype("<f8")
    del count, counts
    for b, k in zip(block, keys, strict=True):
        yield kind, shard, b, k, b"", packed(cost[np.searchsorted(code, unpacked_codes(k))])


def _score(blob: bytes, answers: pa.Table, n_all: int, n_kinds: int, n_ends: int) -> pa.Table:
    docs = opened(blob)
    texts = docs.column("text").combine_chunks()
    words_in, windows_in = (answers.filter(pc.equal(answers.column("kind"), kind)) for kind in ("word", "window"))
    known = [strings(k, s) for k, s in zip(words_in.column("keys").to_pylist(), words_in.column("sizes").to_pylist(), strict=True)]
    known = pa.concat_arrays(known) if known else pa.array([], pa.string())
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *(unpacked(c, "<i8") for c in words_in.column("counts").to_pylist())])
    every = pd.Index(np.concatenate([unpacked_codes(k) for k in windows_in.column("keys").to_pylist()]))
    cost = np.concatenate([unpacked(c, "<f8") for c in windows_in.column("counts").to_pylist()])
    del windows_in, words_in
    n_tokens, score = [], []
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    vocabulary = []
    for part in slices(texts, SLICE_BYTES):
        words = words_of(texts[part])
        seen.append((words.codes.astype(np.int32), words.counts))
        vocabulary.append(words.vocabulary)
        n_tokens.append(words.counts + 1)
        code, n = windows(words)
        score.append(per_row(cost[every.get_indexer(code)], n))
    del every, cost
    # one table of the known words for all slices
    count = counts[pc.index_in(pa.concat_arrays(vocabulary), value_set=known).to_numpy()]
    n_known, base, done = [], [], 0
    log_mass = np.log10(n_all + n_kinds + 1.0)
    for (codes, n), own in zip(seen, vocabulary, strict=True):
        c = count[done : done + len(own)]
        done += len(own)
        n_known.append(per_row((c > 0).astype(np.int64)[codes], n) + int(n_ends > 0))
        base.append(per_row(np.log10(c + 1.0)[codes], n) + np.log10(n_ends + 1.0) - (n + 1) * log_mass)
    size = len(texts)
    columns = [docs.column("doc_id").combine_chunks(), pa.array(held_out(docs.column("doc_id"))), *(pa.array(np.concatenate(x)) for x in (n_tokens, n_known)), pa.array(np.full(size, n_all)), *(pa.array(np.concatenate(x)) for x in (base, score))]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def language_model_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row, logarithms to base 10.

    Words are runs of characters other than white space in lower case (A to Z only), the end of the text is a token. The model learns
    from all texts whose crc32(doc_id) modulo 7 is not 2. ``base_score`` is the add-one word model; ``score`` the chance that prediction by partial matching of
    order 5 gives the bytes of the words, single spaces between them and the end.

    Texts are kept in blocks. Each block asks once for what it holds: distinct words go to shards by their hash, distinct windows of six bytes
    by the two bytes before the last, so that a shard has whole branches of the trie. Shards add up the counts of all blocks and send
    back counts and costs to the blocks that asked. Neither the vocabulary nor the trie is ever in one place; only counts of byte pairs (2^16 at most) are broadcast.

    A null or empty text is the end alone. Repeated rows are scored each, and learnt from each. Without training texts all counts are 0. An empty table gives an empty result. Only
    the two named columns are read.
    """
    spark = docs.sparkSession
    shards = max(64, 4 * partitions_of(spark))
    held = blocks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    asked = requests(held, shards)
    low, ends = _low_orders(asked)
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])
    tables = spark.sparkContext.broadcast(LowOrders(low))

    def answer(table: pa.Table) -> pa.Table:
        rows = list(_answer(table, tables.value))
        out = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        del rows
        trim()
        return out

    answers = stored(asked.where("shard >= 0").groupBy("kind", "shard").applyInArrow(answer, PACKED), "answers")
    totals = answers.where("kind = 'all'").select(_long("counts", 0).alias("n"), _long("counts", 1).alias("v")).agg(F.sum("n"), F.sum("v")).first()
    n_all, n_kinds = (totals[0] or 0) + ends, (totals[1] or 0) + int(ends > 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.concat_tables([_score(blob, right, n_all, n_kinds, ends) for blob in left.column("blob").to_pylist()])
        trim()
        return out

    return held.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(score, RESULT)


def _long(column: str, k: int):
    """The k-th little-endian long of a binary column."""
    part = F.reverse(F.hex(F.substring(F.col(column), 8 * k + 1, 8)))
    # reversing digits also swaps those of a byte, which the pattern puts right
    return F.conv(F.regexp_replace(part, "(.)(.)", "$2$1"), 16, 10).cast("long")


def _low_orders(asked: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of byte pairs and of training texts, added up in tasks: at most 2^16 + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << 16) + 1, dtype=np.int64)
        for batch in batches:
            for kind, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                at = np.frombuffer(keys, dtype="<u4") if kind == "pair" else [1 << 16]
                total[at] += np.frombuffer(counts, dtype="<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    sums = asked.where("shard < 0").select("kind", "keys", "counts").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << 16) + 1, dtype=np.int64)
    for at, n in sums.collect():
        out[at] = n
    return out[: 1 << 16], int(out[1 << 16])
