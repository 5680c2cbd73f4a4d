"""Hashed sparse features of texts and the fit of a linear score on them; shared by the quality and the toxicity model."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import words_of

BITS = 18


def slots(names: list[str], bits: int = BITS) -> np.ndarray:
    mask = (1 << bits) - 1
    return np.fromiter((zlib.crc32(x.encode()) & mask for x in names), dtype=np.int64, count=len(names))


def bare(vocabulary: pa.Array) -> pa.Array:
    """Words in lower case without the signs around them; a word of signs alone stays."""
    low = pc.utf8_lower(vocabulary)
    core = pc.replace_substring_regex(low, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return pc.if_else(pc.equal(pc.binary_length(core), 0), low, core)


def shapes(vocabulary: pa.Array) -> pa.Array:
    """Character classes of each word, runs drawn together: ``Xx``, ``X!!``, ``9.9``."""
    out = pc.replace_substring_regex(vocabulary, r"\p{Ll}+", "x")
    for pattern, sign in ((r"\p{Lu}+", "X"), (r"[\p{Lt}\p{Lm}\p{Lo}]+", "l"), (r"\p{N}+", "9")):
        out = pc.replace_substring_regex(out, pattern, sign)
    return out


def presence(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct bare words of each text and of their first four and five letters, and how many each text has.

    Beginnings stand for words that carry one stem under many endings.
    """
    words = words_of(texts)
    core = bare(words.vocabulary)
    keys = []
    for mark, length in (("w", None), ("4", 4), ("5", 5)):
        if not len(core):
            break
        longer = pc.greater(pc.utf8_length(core), length or 0).to_numpy(zero_copy_only=False)
        cut = core if length is None else pc.utf8_slice_codeunits(core, 0, length)
        held = slots([mark + x for x in cut.to_pylist()], bits)
        some = longer[words.codes]
        keys.append((words.rows[some] << bits) + held[words.codes[some]])
    key = np.sort(pd.unique(np.concatenate(keys))) if keys else np.zeros(0, dtype=np.int64)
    return key & ((1 << bits) - 1), np.bincount(key >> bits, minlength=len(texts)).astype(np.int64)


def bounded_sample(docs: DataFrame, key: list[str], n_rows: int) -> DataFrame:
    """About ``n_rows`` rows, chosen by a hash of ``key``: the same rows on every run; all rows of a smaller table."""
    share = n_rows / max(1, docs.count())
    return docs if share >= 1 else docs.where(F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(n_rows + n_rows // 4)


class Sparse:
    """Rows of (slot, value) in one flat pair of arrays."""

    def __init__(self, slot: np.ndarray, value: np.ndarray, counts: np.ndarray):
        self.slot, self.value, self.counts = slot, value, counts
        self.rows = np.repeat(np.arange(len(counts)), counts)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.slot] * self.value, minlength=len(self.counts))

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.slot, weights=errors[self.rows] * self.value, minlength=size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
