"""Operator 4, packing by power-of-two decomposition: documents become pieces of binary length, pieces of one length share a bucket."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import gather, per_row, slices, small_batches, stored, trim

END = 0
#: The vocabulary's one special token. Its string in a text is that token, and cuts the text for all others.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Texts where a space touches other white space are tokenised whole; in all others every space starts a token.
UNEVEN = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}] | [\s\x{1C}-\x{1F}\x{85}\p{Z}]"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, rank long"


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary; ranks and JSON file hold the same tokens, so ids are those of either library."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of each token."""
    held = encoder(path)
    return np.array([len(held.decode_single_token_bytes(i)) for i in range(held.n_vocab)], dtype=np.int64)


def encode_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, flat, and their number for each text; the special token's string is its one id."""
    texts = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring(texts, SPECIAL)).as_py():
        return encode_plain(texts, path)
    between = pc.split_pattern(texts, SPECIAL)
    n = np.diff(between.offsets.to_numpy()).astype(np.int64)
    ids, counts = encode_plain(between.flatten(), path)
    last = np.zeros(len(counts), dtype=bool)
    last[np.cumsum(n) - 1] = True
    with_special = counts + ~last
    out = np.full(int(with_special.sum()), SPECIAL_ID, dtype=ids.dtype)
    plain = np.ones(len(out), dtype=bool)
    plain[(np.cumsum(with_special) - 1)[~last]] = False
    out[plain] = ids
    return out, per_row(with_special, n)


def encode_plain(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts in which no string is special.

    Words repeat, so each distinct one is tokenised once for a batch: the pattern never lets a token go over a space, hence the
    ids of a text are those of its parts between spaces, one after the other. The distinct parts are tokenised as one string and
    cut where their bytes end.
    """
    uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), dtype=np.int64)
    even = np.flatnonzero(~uneven)
    parts = pc.split_pattern(texts.take(pa.array(even)), " ")
    n_parts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    first = np.zeros(int(n_parts.sum()), dtype=bool)
    first[(np.cumsum(n_parts) - n_parts)[n_parts > 0]] = True
    values = parts.values
    # the first part of a text has no space before it
    coded = pc.if_else(pa.array(first), values, pc.binary_join_element_wise(" ", values, "")).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    ids, starts, lengths = encode_parts(distinct, path)
    flat = ids[gather(codes, starts, lengths)] if len(codes) else ids[:0]
    ends = np.cumsum(np.concatenate([[0], lengths[codes]])) if len(codes) else np.zeros(1, np.int64)
    counts[even] = np.diff(ends[np.concatenate([[0], np.cumsum(n_parts)])])
    if not uneven.any():
        return flat, counts
    odd = np.flatnonzero(uneven)
    own = {int(i): np.array(encoder(path).encode_ordinary(texts[int(i)].as_py()), dtype=np.uint32) for i in odd}
    for i, ids in own.items():
        counts[i] = len(ids)
    out = np.empty(int(counts.sum()), dtype=np.uint32)
    at = np.cumsum(counts) - counts
    taken = np.ones(len(out), dtype=bool)
    for i, ids in own.items():
        out[at[i] : at[i] + len(ids)] = ids
        taken[at[i] : at[i] + len(ids)] = False
    out[taken] = flat
    return out, counts


def encode_parts(parts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each part. Parts with a space in front can follow each other in one string; the others go one by one."""
    size = pc.binary_length(parts).to_numpy().astype(np.int64)
    spaced = pc.starts_with(parts, " ").to_numpy(zero_copy_only=False) if len(parts) else np.zeros(0, bool)
    # white space at the end of one part would run into the space of the next
    spaced &= ~pc.match_substring_regex(parts, r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]$|^ [\s\x{1C}-\x{1F}\x{85}\p{Z}]|^ $").to_numpy(zero_copy_only=False) if len(parts) else False
    lengths = np.zeros(len(parts), dtype=np.int64)
    joined = np.flatnonzero(spaced)
    held = encoder(path)
    text = b"".join(pc.binary_join(pa.ListArray.from_arrays([0, len(joined)], parts.take(pa.array(joined)).cast(pa.binary())), b"").to_pylist())
    pieces = [np.array(held.encode_ordinary(text.decode()), dtype=np.uint32)]
    last = np.zeros(len(text) + 1, dtype=bool)
    last[np.cumsum(size[joined])] = True
    cut = np.flatnonzero(last[np.cumsum(token_bytes(path)[pieces[0]])]) + 1
    assert len(cut) == len(joined), "a token goes over a space"
    lengths[joined] = np.diff(np.concatenate([[0], cut]))
    alone = np.flatnonzero(~spaced)
    for i, text in zip(alone, parts.take(pa.array(alone)).to_pylist(), strict=True):
        pieces.append(np.array(held.encode_ordinary(text), dtype=np.uint32))
        lengths[i] = len(pieces[-1])
    order = np.concatenate([joined, alone])
    starts = np.zeros(len(parts), dtype=np.int64)
    starts[order] = np.cumsum(lengths[order]) - lengths[order]
    return np.concatenate(pieces), starts, lengths


def binary_lengths(n_tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each document: as many of ``limit`` as fit, then the binary digits of the rest from the largest down."""
    powers = [1 << k for k in range(limit.bit_length() - 2, -1, -1)]
    columns = [n_tokens // limit, *(((n_tokens % limit) & p) > 0 for p in powers)]
    times = np.stack(columns, axis=1).astype(np.int64)
    lengths = np.repeat(np.tile([limit, *powers], len(n_tokens)), times.ravel())
    return lengths, times.sum(axis=1)


def pack(docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, bucket, batch``.

    A document's ids, closed by one id 0, are cut into pieces of ``limit`` and of the smaller powers of two; every piece is a
    sequence by itself, so no sequence crosses documents and none needs padding. Pieces of equal length share a ``bucket`` (the
    length's logarithm); ``batch`` numbers groups of about ``limit * 64`` tokens of one bucket within a task. Nothing is shuffled: cuts follow
    from a document's own number of tokens, and ids of sequences combine the writing task and the rank in it. The pieces are
    written to the shared folder first, so the ids stay as they are whatever is recomputed later.

    The string of the special token in a text is its one id. A null or empty text is the single id 0; a text of any length is tokenised whole. Rows with the same or a null doc_id are packed each for itself. An empty table gives
    no piece. Further columns are not carried.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = 0
        for batch in (whole.slice(part.start, part.stop - part.start) for whole in batches for part in slices(whole.column(1))):
            docs_ids, texts, task = batch.column(0), batch.column(1), batch.column(2)
            ids, counts = encode_batch(texts, vocabulary)
            with_end = counts + 1
            flat = np.full(int(with_end.sum()), END, dtype="<u4")
            taken = np.ones(len(flat), dtype=bool)
            taken[np.cumsum(with_end) - 1] = False
            flat[taken] = ids
            lengths, n = binary_lengths(with_end, limit)
            ends = np.cumsum(lengths)
            rows = np.repeat(np.arange(len(n)), n)
            start = (ends - lengths) - np.repeat(np.cumsum(with_end) - with_end, n)
            held = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i4")), pa.py_buffer(flat)])
            index = pa.array(rows)
            out = pa.RecordBatch.from_arrays(
                [docs_ids.take(index), pa.array(start), pa.array(lengths), held, pa.array(with_end[rows]), task.take(index), pa.array(rank + np.arange(len(rows)))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "task", "rank"],
            )
            rank += len(rows)
            del docs_ids, texts, task, ids, counts, with_end, flat, taken, lengths, n, ends, rows, start, held, index
            yield out
            del out
            trim()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().cast("long").alias("task"))
    with small_batches(docs.sparkSession, rows=2000):
        written = stored(source.mapInArrow(pieces, PIECES), "pieces", "zstd")
    return written.select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        F.expr("shiftleft(task, 40) + rank").alias("sequence_id"),
        F.log2(F.col("length").cast("double")).cast("int").alias("bucket"),
        F.expr(f"shiftleft(task, 40) + rank div ({64 * limit} div length)").alias("batch"),
    )


def digests(pieces: DataFrame) -> DataFrame:
    """Columns that a check compares: a piece's place and the CRC-32 of its ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket", "batch"
    )


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
