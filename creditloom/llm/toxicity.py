"""Operator 7, toxicity by cumulative-link regression: one weight vector on hashed words, ordered thresholds for severity grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import in_slices
from creditloom.llm.hashed import BITS, Sparse, bounded_sample, presence, sigmoid

GRADES = 4
FIT_ROWS = 12_000
TOXIC_FROM = 0.45


def grades_of(features: Sparse, toxic: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Severity 0 for a text labelled clean; 1, 2, 3 for a toxic one, by how many of its words mark toxic texts (thirds of the toxic ones).

    A word marks toxic texts if one in fifty of them has it and its smoothed log odds against clean ones reach 2.
    """
    size = 1 << bits
    bad = np.bincount(features.slot, weights=toxic[features.rows].astype(float), minlength=size)
    all_ = np.bincount(features.slot, minlength=size)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    marks = (bad >= np.maximum(3, n_bad / 50)) & (np.log((bad + 0.5) / (n_bad + 1)) - np.log((all_ - bad + 0.5) / (n_good + 1)) >= 2.0)
    load = np.bincount(features.rows, weights=marks[features.slot], minlength=len(toxic))
    out = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        limits = np.quantile(load[toxic], [1 / 3, 2 / 3])
        out[toxic] = 1 + (load[toxic] > limits[0]).astype(np.int64) + (load[toxic] > limits[1])
    return out


@dataclass
class CumulativeLink:
    """P(grade >= k) = sigmoid(weights of the text's words - thresholds[k - 1]); thresholds rise."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def at_least(self, features: Sparse) -> np.ndarray:
        return sigmoid(features.times(self.weights)[:, None] - self.thresholds[None, :])


def fit_cumulative(features: Sparse, grade: np.ndarray, grades: int = GRADES, bits: int = BITS, rounds: int = 400, rate: float = 0.3, penalty: float = 3e-3) -> CumulativeLink:
    """Maximum likelihood with an absolute-value penalty on weights, by full-batch proximal AdaGrad.

    The penalty leaves words of a few texts at zero, so long texts do not add up noise. Thresholds are a first value and the
    exponentials of steps, so they stay in order.
    """
    size, n = 1 << bits, max(1, len(grade))
    w, g2w = np.zeros(size), np.full(size, 1e-6)
    free, g2f = np.concatenate([[1.0], np.full(grades - 2, -0.5)]), np.full(grades - 1, 1e-8)
    # rare grades weigh as much as half the rows together
    weight = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum())) * n
    for _ in range(rounds):
        cut = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        eta = features.times(w)
        upper = np.concatenate([np.ones((len(grade), 1)), sigmoid(eta[:, None] - cut[None, :]), np.zeros((len(grade), 1))], axis=1)
        row = np.arange(len(grade))
        p_low, p_high = upper[row, grade], upper[row, grade + 1]
        inside = np.maximum(p_low - p_high, 1e-12)
        slope_low, slope_high = p_low * (1 - p_low), p_high * (1 - p_high)
        d_eta = -weight * (slope_low - slope_high) / inside / n
        d_cut = np.zeros(grades - 1)
        np.add.at(d_cut, grade[grade > 0] - 1, (weight * slope_low / inside / n)[grade > 0])
        np.add.at(d_cut, grade[grade < grades - 1], (-weight * slope_high / inside / n)[grade < grades - 1])
        tail = np.cumsum(d_cut[::-1])[::-1]
        d_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        grad = features.back(d_eta, size)
        g2w += grad * grad
        g2f += d_free * d_free
        step = rate / np.sqrt(g2w)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0.0)
        free -= rate * d_free / np.sqrt(g2f)
    return CumulativeLink(w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), bits)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> CumulativeLink:
    """Fits on about ``fit_rows`` labelled documents chosen by a hash of their id. A null label or text leaves a row out of the fit."""

    def extract(batches):
        for batch in batches:
            slot, counts = presence(batch.column(0))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32))), batch.column(1)], names=["slot", "toxic"])

    given = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = bounded_sample(given, ["_id"], fit_rows)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id").select("text", (F.col("toxic") > 0).alias("toxic"))
    held = rows.mapInArrow(extract, "slot array<int>, toxic boolean").toArrow().combine_chunks()
    if not held.num_rows:
        return CumulativeLink(np.zeros(1 << BITS), np.arange(1.0, GRADES))
    slot = pc.list_flatten(held.column("slot")).to_numpy().astype(np.int64)
    counts = pc.list_value_length(held.column("slot")).to_numpy().astype(np.int64)
    features = Sparse(slot, np.ones(len(slot)), counts)
    return fit_cumulative(features, grades_of(features, held.column("toxic").to_numpy().astype(bool)))


def severity_of(text: str | Column, model: CumulativeLink) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        def work(part: pa.Array) -> pa.Array:
            slot, counts = presence(part, model.bits)
            p = np.where((counts > 0)[:, None], model.at_least(Sparse(slot, np.ones(len(slot)), counts)), 0.0)
            return pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))

        return in_slices(texts, work)

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = TOXIC_FROM) -> DataFrame:
    """``doc_id, p_1, p_2, p_3, severity, grade, toxic`` for every row of ``docs``.

    ``p_k`` is the chance of grade k or more, ``severity`` their sum, the expected grade; ``grade`` the largest k with p_k of at least
    one half, ``toxic`` whether p_1 reaches ``threshold``. A null or empty text or one of white space has zeros and is not toxic. Equal
    texts get equal results; repeated rows stay, as do documents without a label. Empty ``docs`` give an empty result, empty ``labels`` a model
    of zero weights. Only the named columns are read.
    """
    model = fit(docs, labels, doc_id, text)
    p = [F.col("_p")[k] for k in range(GRADES - 1)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), severity_of(text, model).alias("_p"))
    return rows.select(
        "doc_id", *(x.alias(f"p_{k + 1}") for k, x in enumerate(p)), sum(p[1:], p[0]).alias("severity"),
        sum(((x >= 0.5).cast("int") for x in p[1:]), (p[0] >= 0.5).cast("int")).alias("grade"), (p[0] >= threshold).alias("toxic"),
    )
