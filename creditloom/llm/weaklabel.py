"""Operator 8, quality classifier: EM weighs overlapping heuristic labellers, their posterior trains a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import in_slices, per_row, small_batches, words_of
from creditloom.llm.fertility import repeated_lines, repeated_words
from creditloom.llm.hashed import BITS, Sparse, bare, bounded_sample, shapes, sigmoid, slots

#: What the labellers look at: shares of words unless the name says otherwise.
SIGNALS = ["n_words", "symbols", "windows", "capitals", "shouts", "fresh", "ends", "bars", "lines", "letters"]
FIT_ROWS = 8000
KEPT_FROM = 0.25
#: Added to the words of a text when shares are taken, so that a few words say little for or against it.
SHRINK = 5

#: name, signal, SQL condition for a vote "good", SQL condition for a vote "bad"; otherwise the labeller abstains.
LABELLERS = [
    ("few_symbols", "symbols", "symbols < 0.05", "symbols > 0.25"),
    ("few_windows", "windows", "windows < 0.25", "windows > 0.5"),
    ("few_capitals", "capitals", "capitals < 0.25", "capitals > 0.6"),
    ("no_shouting", "shouts", "shouts < 0.05", "shouts > 0.3"),
    ("fresh_words", "fresh", "n_words >= 40 AND fresh > 0.35", "n_words >= 40 AND fresh < 0.12"),
    ("sentences", "ends", "ends BETWEEN 0.03 AND 0.34", "n_words >= 40 AND (ends < 0.005 OR ends > 0.6)"),
    ("no_table", "bars", "bars < 0.02", "bars > 0.15"),
    ("letters", "letters", "letters > 0.9", "letters < 0.7"),
]


def signals(texts: pa.Array) -> pa.StructArray:
    """Shares that labellers vote on; a text without words has n_words 0 and zeros."""
    words = words_of(texts)
    v, n = words.vocabulary, np.maximum(words.counts, 1)

    def share(mask: pa.Array) -> np.ndarray:
        flags = mask.to_numpy(zero_copy_only=False).astype(np.int64)
        return per_row(flags[words.codes], words.counts) / n if len(flags) else np.zeros(len(n))

    size = pc.utf8_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = size - pc.count_substring_regex(v, r"\P{L}").to_numpy(zero_copy_only=False)
    chars, own = (per_row(x[words.codes], words.counts) if len(size) else np.zeros(len(n), dtype=np.int64) for x in (size, letters))
    key = words.rows * max(1, len(v)) + words.codes
    fresh = np.bincount(np.unique(key) // max(1, len(v)), minlength=len(n)) if len(key) else np.zeros(len(n))
    columns = {
        "n_words": words.counts.astype(float),
        "symbols": share(pc.match_substring_regex(v, r"[#*$%&|<>~^=_\\{}@]")),
        "windows": repeated_words(words) / n,
        "capitals": share(pc.match_substring_regex(v, r"^\P{L}*\p{Lu}[\P{L}\p{Lu}]*\p{Lu}[\P{L}\p{Lu}]*$")),
        "shouts": share(pc.match_substring_regex(v, r"[!?]{2,}$")),
        "fresh": fresh / n,
        "ends": share(pc.match_substring_regex(v, r"[.!?:]$")),
        "bars": share(pc.match_substring_regex(v, r"^[|/\\-]+$")),
        "lines": repeated_lines(pc.fill_null(texts, "")) / n,
        "letters": own / np.maximum(chars, 1),
    }
    return pa.StructArray.from_arrays([pa.array(columns[c]) for c in SIGNALS], names=SIGNALS)


def signals_of(text: str | Column) -> Column:
    @F.arrow_udf("struct<" + ",".join(f"{c}:double" for c in SIGNALS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, signals)

    return run(text)


def votes(prefix: str = "") -> Column:
    """One sign for each labeller: + good, - bad, 0 no vote. At most 3 ** len(LABELLERS) different strings."""
    each = [F.when(F.expr("n_words = 0"), F.lit("0")).when(F.expr(good), F.lit("+")).when(F.expr(bad), F.lit("-")).otherwise(F.lit("0")) for _, _, good, bad in LABELLERS]
    return F.concat(*each)


@dataclass
class LabelModel:
    """Share of good documents and, for each labeller, the chance of each vote (-, 0, +) on a bad and on a good document."""

    prior: float
    chances: np.ndarray  # labeller, class (bad, good), vote

    def posterior(self, patterns: list[str]) -> np.ndarray:
        coded = _coded(patterns)
        logs = np.log(self.chances)
        each = [np.log(p) + sum(logs[j, y, coded[:, j]] for j in range(coded.shape[1])) for y, p in ((0, 1 - self.prior), (1, self.prior))]
        return sigmoid(each[1] - each[0])

    @property
    def accuracies(self) -> np.ndarray:
        """Of the votes each labeller gives, the share that is right."""
        right = (1 - self.prior) * self.chances[:, 0, 0] + self.prior * self.chances[:, 1, 2]
        given = right + (1 - self.prior) * self.chances[:, 0, 2] + self.prior * self.chances[:, 1, 0]
        return right / given


def _coded(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(s) for s in p] for p in patterns], dtype=np.int64).reshape(len(patterns), -1)


def expectation_maximisation(patterns: list[str], times: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> LabelModel:
    """Accuracies of labellers from the table of vote patterns alone. Starts from a vote in which one clear "bad" outweighs two "good"."""
    coded = _coded(patterns)
    good = sigmoid(2.0 * ((coded == 2).sum(axis=1) - 3.0 * (coded == 0).sum(axis=1)))
    model = None
    for _ in range(rounds):
        mass = np.stack([times * (1 - good), times * good])
        chances = np.stack([[[mass[y][coded[:, j] == v].sum() + 1.0 for v in range(3)] for y in range(2)] for j in range(coded.shape[1])])
        model = LabelModel(float((mass[1].sum() + 1) / (times.sum() + 2)), chances / chances.sum(axis=2, keepdims=True))
        now = model.posterior(patterns)
        if np.abs(now - good).max() < tolerance:
            break
        good = now
    return model


RARE = ["=windows", "=again", "=lines"]


def token_features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and their number per text: share of each bare word and of each shape, and of three kinds of repetition."""
    words = words_of(texts)
    n, v = np.maximum(words.counts, 1), words.vocabulary
    rows, size = words.rows, 1 << bits
    parts = []
    for names, mark in ((bare(v), "w"), (shapes(v), "s")):
        held = slots([mark + x for x in names.to_pylist()], bits)
        key, times = np.unique(rows * size + held[words.codes], return_counts=True) if len(held) else (np.zeros(0, dtype=np.int64),) * 2
        parts.append((key // size, key % size, times / (n + SHRINK)[key // size]))
    key = rows * max(1, len(v)) + words.codes
    fresh = np.bincount(np.unique(key) // max(1, len(v)), minlength=len(n)) if len(key) else np.zeros(len(n))
    repeats = [repeated_words(words) / (n + SHRINK), (words.counts - fresh) / (n + SHRINK), repeated_lines(pc.fill_null(texts, "")) / (n + SHRINK)]
    for name, values in zip(RARE, repeats, strict=True):
        some = np.flatnonzero((values > 0) & (words.counts > 0))
        parts.append((some, np.full(len(some), slots([name], bits)[0]), values[some]))
    row, slot, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(row, kind="stable")
    return slot[order], value[order], np.bincount(row, minlength=len(n)).astype(np.int64)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: pa.Array) -> pa.Array:
        slot, value, counts = token_features(texts, self.bits)
        logit = Sparse(slot, value, counts).times(self.weights) + self.bias
        return pa.array(np.where(counts > 0, sigmoid(logit), 0.0))


def fit_scorer(features: Sparse, target: np.ndarray, bits: int = BITS, rounds: int = 150, rate: float = 0.5, penalty: float = 1e-5) -> Scorer:
    """Logistic regression on soft targets by full-batch AdaGrad; both classes get equal weight."""
    size, good = 1 << bits, target.sum()
    weight = target * (0.5 / max(good, 1e-9)) + (1 - target) * (0.5 / max(len(target) - good, 1e-9))
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-10)
    for _ in range(rounds):
        error = weight * (sigmoid(features.times(w[:-1]) + w[-1]) - target)
        grad = np.append(features.back(error, size) + penalty * w[:-1], error.sum())
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
    return Scorer(w[:-1], float(w[-1]), bits)


def fit(docs: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> tuple[LabelModel, DataFrame, Scorer]:
    """Label model, its posterior for each vote pattern that occurs (``pattern, weak_label``), and the scorer.

    Labellers vote on all documents; EM sees the counts of all vote patterns, at most 3 ** 8 rows. The scorer is fitted on about
    ``fit_rows`` documents, chosen by a hash of their text, with the posterior as soft target.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        table = voted(docs.select(F.col(text).alias("text")), "text").groupBy("pattern").count().orderBy("pattern").toPandas()
    patterns, times = table["pattern"].tolist(), table["count"].to_numpy(dtype=float)
    if not patterns:
        return LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), spark.createDataFrame([], "pattern string, weak_label double"), Scorer(np.zeros(1 << BITS), 0.0)
    model = expectation_maximisation(patterns, times)
    posterior = spark.createDataFrame(list(zip(patterns, model.posterior(patterns).tolist(), strict=True)), "pattern string, weak_label double")

    def extract(batches):
        for batch in batches:
            slot, value, counts = token_features(batch.column(0))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (slot.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(1)], names=["slot", "value", "good"])

    chosen = bounded_sample(docs.select(F.col(text).alias("text")), ["text"], fit_rows)
    rows = voted(chosen, "text").join(F.broadcast(posterior), "pattern").select("text", F.col("weak_label").alias("good"))
    with small_batches(spark):
        held = rows.mapInArrow(extract, "slot array<int>, value array<float>, good double").toArrow().combine_chunks()
    slot, value = (pc.list_flatten(held.column(c)).to_numpy() for c in ("slot", "value"))
    counts = pc.list_value_length(held.column("slot")).to_numpy().astype(np.int64)
    return model, posterior, fit_scorer(Sparse(slot.astype(np.int64), value.astype(float), counts), held.column("good").to_numpy())


def voted(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the column ``pattern``."""
    own = docs.columns
    return docs.withColumn("_signals", signals_of(text)).select(*own, "_signals.*").select(*own, votes().alias("pattern"))


def scored(text: str | Column, scorer: Scorer) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, scorer.score)

    return run(text)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = KEPT_FROM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, weak_label, score, kept`` for every row.

    ``weak_label`` is the label model's posterior of "good" from the votes alone, ``score`` that of the linear scorer, ``kept``
    whether the score reaches ``threshold``. A null or empty text, or one of white space, gets score 0. Equal texts get
    equal scores; repeated rows stay. An empty table gives an empty result. Only the named columns are read. The table that is
    broadcast has a row for each vote pattern, at most 3 ** 8.
    """
    _, posterior, scorer = fit(docs, text, fit_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("score", scored("text", scorer))
    joined = voted(rows, "text").join(F.broadcast(posterior), "pattern", "left")
    return joined.select("doc_id", "weak_label", "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = KEPT_FROM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with the columns of ``docs`` only."""
    _, _, scorer = fit(docs, text, fit_rows)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), scored(F.col(text), scorer).alias("_score"))
    return held.where(F.col("_score") >= threshold).select("_doc.*")
