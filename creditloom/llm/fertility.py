"""Operator 2, quality rules by tokeniser fertility: public vocabularies measure each text, bands per language reject outliers."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import Words, gather, in_slices, per_row, small_batches, stored, words_of
from creditloom.llm.packing import encode_parts, encoder
from creditloom.session import held_side

LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "byte_tokens", "piece_tokens"]
DOUBLES = ["byte_fertility", "byte_fallback", "byte_entropy", "piece_fertility", "piece_fallback", "piece_entropy"]
MEASURES = "struct<" + ",".join([f"{c}:long" for c in LONGS] + [f"{c}:double" for c in DOUBLES]) + ">"

MIN_WORDS = 50
#: Figures that have a band, and how far it reaches on either side of the language's median, in robust deviations and at least.
BANDS = {"byte_fertility": (10.0, 0.18), "piece_fertility": (10.0, 0.18), "byte_entropy": (6.0, 0.3), "piece_entropy": (6.0, 0.3), "piece_fallback": (10.0, 0.05)}
SALTS = 32


@lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    held = sentencepiece.SentencePieceProcessor(model_file=path)
    return held, np.array([held.is_byte(i) for i in range(held.get_piece_size())])


def repeated_words(words: Words) -> np.ndarray:
    """Per text: words inside three-word windows that occur at least twice in the text."""
    codes, rows, v = words.codes, words.rows, max(1, len(words.vocabulary))
    if len(codes) < 3:
        return np.zeros(len(words.counts), dtype=np.int64)
    again = pd.Series(rows * v + codes).duplicated(keep=False).to_numpy()
    # a window can only come again if each of its words does
    at = np.flatnonzero((rows[2:] == rows[:-2]) & again[:-2] & again[1:-1] & again[2:])
    pair = pd.factorize(codes[at] * v + codes[at + 1])[0].astype(np.int64)
    window = pd.factorize(pair * v + codes[at + 2])[0].astype(np.int64)
    at = at[pd.Series(rows[at] * max(1, len(at)) + window).duplicated(keep=False).to_numpy()]
    inside = np.zeros(len(codes), dtype=np.int64)
    for k in range(3):
        inside[at + k] = 1
    return per_row(inside, words.counts)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    lines = pc.split_pattern(texts, "\n")
    n = np.diff(lines.offsets.to_numpy()).astype(np.int64)
    coded = lines.values.dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy().astype(np.int64)
    later = pd.Series(np.repeat(np.arange(len(n)), n) * max(1, len(coded.dictionary)) + codes).duplicated(keep="first").to_numpy()
    return per_row((later & worded[codes]).astype(np.int64) if len(codes) else codes, n)


def _figures(words: Words, chars: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens, characters per token, share of tokens that are ``odd``, entropy of tokens in bits against the most possible."""
    n = per_row(lengths[words.codes], words.counts) if len(words.codes) else np.zeros(len(words.counts), dtype=np.int64)
    tokens = ids[gather(words.codes, starts, lengths)].astype(np.int64) if len(words.codes) else ids[:0].astype(np.int64)
    some = np.maximum(n, 1)
    key = np.sort(np.repeat(np.arange(len(n)), n) * len(odd) + tokens)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.concatenate([first, [len(key)]]))
    spread = np.bincount(key[first] // len(odd), weights=times * np.log2(times), minlength=len(n)) if len(key) else np.zeros(len(n))
    entropy = (np.log2(some) - spread / some) / np.maximum(np.log2(np.minimum(some, len(odd))), 1.0)
    return n, chars / some, per_row(odd[tokens].astype(np.int64), n) / some, np.where(n > 0, entropy, 0.0)


def measure(texts: pa.Array, byte_vocabulary: str, piece_model: str) -> pa.StructArray:
    texts = pc.fill_null(texts, "")
    words = words_of(texts)
    vocabulary = words.vocabulary
    size = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = per_row(size[words.codes], words.counts) if len(size) else np.zeros(len(texts), dtype=np.int64)
    held, is_byte = pieces_of(piece_model)
    ids, starts, lengths = encode_parts(pc.binary_join_element_wise(" ", vocabulary, ""), byte_vocabulary)
    of_bytes = _figures(words, chars, ids, starts, lengths, _partial(byte_vocabulary))
    lists = held.encode(vocabulary.to_pylist(), num_threads=1) if len(vocabulary) else []
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    ids = np.array(list(chain.from_iterable(lists)), dtype=np.int64)
    of_pieces = _figures(words, chars, ids, np.cumsum(lengths) - lengths, lengths, is_byte)
    columns = [words.counts, chars, pc.count_substring_regex(texts, r"[#*$%&|<>]").cast(pa.int64()), repeated_lines(texts), repeated_words(words)]
    columns += [of_bytes[0], of_pieces[0], *of_bytes[1:], *of_pieces[1:]]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=LONGS + DOUBLES)


@lru_cache(maxsize=2)
def _partial(byte_vocabulary: str) -> np.ndarray:
    """Tokens of the byte-level vocabulary that are no whole characters."""
    held = encoder(byte_vocabulary)
    out = np.zeros(held.n_vocab, dtype=bool)
    for i in range(held.n_vocab):
        try:
            held.decode_single_token_bytes(i).decode()
        except UnicodeDecodeError:
            out[i] = True
    return out


def measured(text: str | Column, byte_vocabulary: str, piece_model: str) -> Column:
    """Struct of all figures of a text, whole words only; white space is not counted. Null and empty texts have zeros."""

    @F.arrow_udf(MEASURES)
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: measure(part, byte_vocabulary, piece_model))

    return run(text)


def judge(measures: DataFrame, group: str, bands: dict = BANDS, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``outside`` (names of the figures that leave their band) to measured rows.

    Base: fewer than ``min_words`` words, or over half of them in repeated windows. The bands of a figure lie around its median
    over all rows of the same ``group`` that pass the base, as wide as the quartiles on that side say. A null group is a group of
    its own. Quartiles are sketches merged over tasks; a group's bands are handed back by a broadcast while there are few groups, else by a salted join, so that a group with
    most of the rows is spread over tasks.
    """
    own = [c for c in measures.columns]
    rows = measures.withColumn("base_failed", F.expr(f"n_words < {int(min_words)} OR 100 * n_repeat_words > 50 * n_words"))
    rows = rows.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    limits = rows.where("NOT base_failed").groupBy("_group").agg(
        *(F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.lit(2000)).alias(c) for c in bands)
    )
    spread = []
    for c, (times, least) in bands.items():
        q = [F.col(c)[i] for i in range(3)]
        reach = [F.greatest((b - a) * (times / 0.6745), F.lit(least) * (q[1] if c.endswith("fertility") else F.lit(1.0))) for a, b in ((q[0], q[1]), (q[1], q[2]))]
        spread += [(q[1] - reach[0]).alias(f"_low_{c}"), (q[1] + reach[1]).alias(f"_high_{c}")]
    limits = limits.select("_group", *spread, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "byte_tokens"), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("_salt", salt).join(held_side(limits), ["_group", "_salt"], "left")
    outside = F.array_compact(F.array(*(F.when((F.col(c) < F.col(f"_low_{c}")) | (F.col(c) > F.col(f"_high_{c}")), F.lit(c)) for c in bands)))
    outside = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(outside)
    return joined.withColumn("outside", outside).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).select(*own, "base_failed", "outside", "kept")


def quality_rules(docs: DataFrame, byte_vocabulary: str, piece_model: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, lang``, all figures, ``base_failed, outside, kept``.

    Fertility is characters of words per token, under a byte-level and a piece vocabulary. ``*_fallback`` is the share of tokens
    that are bytes of a character, ``*_entropy`` that of tokens within the text against its maximum. Null or empty texts have zeros and
    fail the base. Repeated rows get equal results each. An empty table gives an empty result. Only the three named columns are
    read, so others may have any name.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), measured(F.col(text), byte_vocabulary, piece_model).alias("m"))
    return judge(stored(source.select("doc_id", "lang", "m.*"), "fertility"), "lang")


def keep_passing(docs: DataFrame, byte_vocabulary: str, piece_model: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` only. Measured rows are written once and read for bands and verdict."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(lang).alias("_lang"), measured(F.col(text), byte_vocabulary, piece_model).alias("_m"))
    with small_batches(docs.sparkSession):
        rows = stored(held.select("_doc", "_lang", "_m.*"), "measured", "zstd")
    return judge(rows, "_lang").where("kept").select("_doc.*")
