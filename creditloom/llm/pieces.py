"""Operator 1, SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import gather, per_row, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of text that are encoded at once, and bytes of distinct stretches that are solved at once.
SLICE, CHUNK = 4 << 20, 1 << 19


@dataclass
class DoubleArray:
    """Trie of byte strings: from state s, byte b leads to ``base[s] + b + 1`` if ``check`` there is s. ``value`` is -1 or the string's number."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in keys.items():
            node = 0
            for b in key:
                node = children[node].setdefault(b, len(children))
                if node == len(children):
                    children.append({})
            ends[node] = number
        size = 4 * len(children) + 1024
        base, check, value = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        check[0] = 0
        place, queue, first_free, wide_from = {0: 0}, [0], 1, 1
        for node in queue:
            at = place[node]
            value[at] = ends.get(node, -1)
            labels = sorted(children[node])
            if not labels:
                continue
            while check[first_free] >= 0:
                first_free += 1
            if len(labels) == 1 and labels[0] < first_free < size - 512:
                base[at] = start = first_free - labels[0] - 1
                check[first_free] = at
                place[children[node][labels[0]]] = first_free
                queue.append(children[node][labels[0]])
                continue
            offsets = np.array(labels) + 1
            look = max(first_free, wide_from)
            while True:
                # every free slot of a window is tried for the lowest label at once
                slots = look + np.flatnonzero(check[look : look + 2048] < 0)
                slots = slots[slots + int(offsets[-1] - offsets[0]) < size]
                starts = slots - offsets[0]
                fits = starts[(starts >= 0) & (check[starts[:, None] + offsets[None, :]] < 0).all(axis=1)] if len(starts) else starts
                if len(fits):
                    break
                look += 2048
                wide_from = max(wide_from, look - 8192)
                if look >= size - 512:
                    base, check, value = (np.concatenate([x, np.full(size, fill, dtype=np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                    size *= 2
            base[at] = start = int(fits[0])
            for b in labels:
                check[start + b + 1] = at
                place[children[node][b]] = start + b + 1
                queue.append(children[node][b])
        pad = np.full(258, -1, dtype=np.int32)
        return DoubleArray(np.concatenate([base, np.zeros(258, dtype=np.int32)]), np.concatenate([check, pad]), np.concatenate([value, pad]))


@dataclass
class Pieces:
    trie: DoubleArray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    surface: np.ndarray  # bytes that each piece stands for, flat
    starts: np.ndarray
    lengths: np.ndarray
    is_byte: np.ndarray


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Pieces and scores of a SentencePiece model file. Its log scores are taken as they stand, whatever the model was trained as."""
    held = sentencepiece.SentencePieceProcessor(model_file=path)
    n = held.get_piece_size()
    byte_ids, keys, surface, plain = np.zeros(256, dtype=np.int64), {}, [], []
    is_byte = np.zeros(n, dtype=bool)
    for i in range(n):
        piece = held.id_to_piece(i)
        if held.is_byte(i):
            is_byte[i], byte_ids[int(piece[3:5], 16)] = True, i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif held.is_control(i) or held.is_unknown(i) or held.is_unused(i):
            surface.append(b"")
        else:
            keys[piece.encode()] = i
            surface.append(piece.replace(MARK, " ").encode())
            plain.append(i)
    scores = np.array([held.get_score(i) for i in range(n)], dtype=np.float32)
    lengths = np.array([len(s) for s in surface], dtype=np.int64)
    return Pieces(
        DoubleArray.build(keys), scores, byte_ids, float(scores[plain].min()) - UNKNOWN_PENALTY,
        np.frombuffer(b"".join(surface), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths, is_byte,
    )


def matches(trie: DoubleArray, data: np.ndarray, begin: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces that start at ``begin`` and end by ``limit``: begin's row, end, piece. All starts walk the trie in step."""
    row, state, at = np.arange(len(begin)), np.zeros(len(begin), dtype=np.int32), begin.copy()
    found = []
    while len(row):
        inside = at < limit[row]
        row, state, at = row[inside], state[inside], at[inside]
        to = trie.base[state] + data[at] + 1
        there = trie.check[to] == state
        row, state, at = row[there], to[there], at[there] + 1
        piece = trie.value[state]
        some = piece >= 0
        found.append((row[some], at[some], piece[some]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))


def viterbi(held: Pieces, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best pieces of the strings ``data[ends[i-1]:ends[i]]``: ids flat, number of ids and score of each string.

    Scores add up in single precision from left to right and a later piece must be better to win, as in the library.
    """
    begins = np.concatenate([[0], ends[:-1]])
    string = np.repeat(np.arange(len(ends)), ends - begins)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    row, end, piece = matches(held.trie, data, first, ends[string[first]])
    start = first[row]
    # a character that is no piece itself is unknown
    width = np.diff(np.append(first, len(data)))
    single = np.zeros(len(first), dtype=bool)
    single[row[end - start == width[row]]] = True
    alone = np.flatnonzero(~single)
    start = np.concatenate([start, first[alone]])
    end = np.concatenate([end, first[alone] + width[alone]])
    score = np.concatenate([held.scores[piece], np.full(len(alone), held.unknown, dtype=np.float32)])
    piece = np.concatenate([piece, np.full(len(alone), -1, dtype=piece.dtype)])
    # one slot before each byte and one after each string
    from_slot, to_slot = start + string[start], end + string[start]
    local = start - begins[string[start]]
    order = np.argsort(local, kind="stable")
    from_slot, to_slot, score, piece, local = (x[order] for x in (from_slot, to_slot, score, piece, local))
    best = np.full(len(data) + len(ends), -np.inf, dtype=np.float32)
    best[begins + np.arange(len(ends))] = 0.0
    back = np.full(len(best), -1, dtype=np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(local)) + 1, [len(local)]]) if len(local) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        total = best[from_slot[a:b]] + score[a:b]
        better = total > best[to_slot[a:b]]
        to = to_slot[a:b][better]
        best[to] = total[better]
        back[to] = a + np.flatnonzero(better)
    last = ends + np.arange(len(ends))
    who, at, taken = np.arange(len(ends)), last.copy(), []
    stop = begins + np.arange(len(ends))
    while True:
        going = at != stop[who]
        who, at = who[going], at[going]
        if not len(who):
            break
        move = back[at]
        taken.append((who, move))
        at = from_slot[move]
    if not taken:
        return np.zeros(0, dtype=np.int64), np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends))
    who = np.concatenate([w for w, _ in taken])[::-1]
    move = np.concatenate([m for _, m in taken])[::-1]
    order = np.argsort(who, kind="stable")
    who, move = who[order], move[order]
    ids = piece[move].astype(np.int64)
    width = np.where(ids >= 0, 1, to_slot[move] - from_slot[move])
    out = np.repeat(ids, width)
    unknown = np.flatnonzero(out < 0)
    if len(unknown):
        offset = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        at_byte = np.repeat(from_slot[move] - who, width) + offset
        out[unknown] = held.byte_ids[data[at_byte[unknown]]]
    return out, np.bincount(who, weights=width, minlength=len(ends)).astype(np.int64), best[last].astype(np.float64)


def encode(texts: pa.Array, held: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, flat, their number and the score of each text. Every distinct stretch from one marker to the next is solved once for a slice.

    No piece goes on from another character to a marker, so the best path of a text is that of its stretches.
    """
    marked = pc.replace_substring(pc.fill_null(texts, ""), " ", MARK)
    empty = pc.equal(pc.binary_length(marked), 0).to_numpy(zero_copy_only=False)
    marked = pc.if_else(pa.array(empty), "", pc.binary_join_element_wise(MARK, marked, ""))
    odd = pc.match_substring_regex(marked, f"{MARK}({MARK}|$)").to_numpy(zero_copy_only=False)
    # text before the first marker is empty
    parts = pc.split_pattern(pc.if_else(pa.array(odd), "", marked), MARK)
    counts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    rest = np.ones(len(parts.values), dtype=bool)
    rest[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = False
    values = pc.binary_join_element_wise(MARK, parts.values.filter(pa.array(rest)), "")
    counts = np.maximum(counts - 1, 0)
    if odd.any():
        rows = np.flatnonzero(odd)
        lists = [re.findall(f"{MARK}+[^{MARK}]*", marked[int(i)].as_py()) for i in rows]
        of_row = np.concatenate([np.repeat(np.arange(len(counts)), counts), np.repeat(rows, [len(x) for x in lists])])
        values = pa.concat_arrays([values, pa.array([x for own in lists for x in own], pa.string())])
        order = np.argsort(of_row, kind="stable")
        values = values.take(pa.array(order))
        counts = np.bincount(of_row, minlength=len(counts)).astype(np.int64)
    coded = values.dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    ends = np.cumsum(pc.binary_length(distinct).to_numpy().astype(np.int64)) if len(distinct) else np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b"".join(distinct.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    solved, done = [], 0
    while done < len(distinct):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        solved.append(viterbi(held, data[base : ends[upto - 1]], ends[done:upto] - base))
        done = upto
    if not solved:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    ids, lengths, scores = (np.concatenate([s[k] for s in solved]) for k in range(3))
    flat = ids[gather(codes, np.cumsum(lengths) - lengths, lengths)]
    return flat, per_row(lengths[codes], counts), per_row(scores[codes], counts)


def decode(ids: np.ndarray, counts: np.ndarray, held: Pieces) -> pa.Array:
    """Texts of runs of ids: markers become spaces, the one put before the text goes, byte pieces join to characters (U+FFFD if they are none)."""
    data = held.surface[gather(ids, held.starts, held.lengths)] if len(ids) else np.zeros(0, dtype=np.uint8)
    size = per_row(held.lengths[ids], counts) if len(ids) else np.zeros(len(counts), dtype=np.int64)
    ends = np.cumsum(size)
    lead = np.flatnonzero(size > 0)
    lead = lead[data[(ends - size)[lead]] == 0x20]
    keep = np.ones(len(data), dtype=bool)
    keep[(ends - size)[lead]] = False
    size[lead] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype("<i4")
    raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())


ENCODED = "doc_id long, ids array<int>, score double, n_pieces long, n_byte_pieces long, decoded string"


def tokenise(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, score, n_pieces, n_byte_pieces, decoded`` for every row: the best piece ids of the whole text and what they decode to.

    A null or empty text has no pieces and decodes to the empty text. Equal texts get equal ids; repeated rows stay. A text comes back from its ids as it was, except that a marker sign
    in the text becomes a space. An empty table gives an empty result. Only the two named columns are read. The trie is
    built once and broadcast; the vocabulary file bounds its size.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, counts, score = encode(rows.column(1), held)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                columns = [rows.column(0), lists, pa.array(score), pa.array(counts), pa.array(per_row(held.is_byte[ids].astype(np.int64), counts)), decode(ids, counts, held)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "score", "n_pieces", "n_byte_pieces", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ENCODED)
