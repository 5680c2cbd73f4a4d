"""Exact order statistics of many columns at once by rank intervals: no distinct value is shuffled, and the driver holds a bounded table.

    sketched limits of each column (one row for each task)
        -> exact counts, minima and maxima of the intervals between them (one row for each task and interval)
        -> the intervals that hold a wanted rank: cut again at evenly spaced doubles until few rows are left in them
        -> the values of those rows, counted

Doubles are compared as 64-bit numbers of the same order, so an interval can always be cut, and one that holds a single value is done
whatever number of rows has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits a column is cut at in the first pass, and cuts of one interval in every further pass.
LIMITS, CUTS = 512, 256
#: Distinct values the driver takes at most before it cuts intervals again.
GATHER = 200_000


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order; -0.0 becomes 0.0."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def from_bits(n: np.ndarray) -> np.ndarray:
    return np.where(n < 0, np.int64(-(2**63)) - n, n).astype(np.int64).view(np.float64)


@dataclass
class Intervals:
    """Of one column, in order: each interval's smallest and largest value and its rows; where it begins among all rows."""

    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    held: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # values and their counts of intervals that were gathered

    @property
    def before(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    @property
    def total(self) -> int:
        return int(self.n.sum())

    def at(self, rank: int) -> int:
        return int(np.searchsorted(np.cumsum(self.n), rank, side="right"))

    def value(self, rank: int) -> float | None:
        """Value of the row of this rank, or None if its interval has yet to be cut or gathered."""
        k = self.at(rank)
        if self.low[k] == self.high[k]:
            return float(self.low[k])
        if k in self.held:
            values, counts = self.held[k]
            return float(values[np.searchsorted(np.cumsum(counts), rank - int(self.before[k]), side="right")])
        return None


def _matrix(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for column in batch.columns:
        x = column.to_numpy(zero_copy_only=False).astype(float)
        yield x[~np.isnan(x)] + 0.0


def _counted(df: DataFrame, columns: Sequence[str], cuts: dict[str, np.ndarray]) -> dict[str, Intervals]:
    """Rows, minimum and maximum of each interval (cut i-1, cut i] of every column in ``cuts``. Tasks send one row for each interval they met."""
    names = [c for c in columns if c in cuts]
    shipped = df.sparkSession.sparkContext.broadcast([cuts[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = shipped.value
        n = [np.zeros(len(c) + 1, dtype=np.int64) for c in limits]
        low, high = [np.full(len(c) + 1, np.inf) for c in limits], [np.full(len(c) + 1, -np.inf) for c in limits]
        for batch in batches:
            for i, x in enumerate(_matrix(batch)):
                x.sort()
                ends = np.concatenate([[0], np.searchsorted(x, limits[i], side="right"), [len(x)]])
                some = np.flatnonzero(np.diff(ends))
                n[i][some] += np.diff(ends)[some]
                low[i][some] = np.minimum(low[i][some], x[ends[some]])
                high[i][some] = np.maximum(high[i][some], x[ends[some + 1] - 1])
        for i in range(len(limits)):
            some = np.flatnonzero(n[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[i][some]), pa.array(low[i][some]), pa.array(high[i][some])], names=["c", "k", "n", "low", "high"])

    met = df.select(*[F.col(c).cast("double") for c in names]).mapInArrow(run, "c int, k int, n long, low double, high double")
    rows = met.groupBy("c", "k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("c", "k").collect()
    out = {}
    for i, c in enumerate(names):
        own = [r for r in rows if r["c"] == i]
        out[c] = Intervals(np.array([r["low"] for r in own], dtype=float), np.array([r["high"] for r in own], dtype=float), np.array([r["n"] for r in own], dtype=np.int64))
    return out


def _gathered(df: DataFrame, wanted: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values and their counts of the rows that lie in the given intervals [low, high] of every column."""
    names = list(wanted)
    shipped = df.sparkSession.sparkContext.broadcast([wanted[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(_matrix(batch)):
                low, high = shipped.value[i]
                at = np.searchsorted(low, x, side="right") - 1
                value, n = np.unique(x[(at >= 0) & (x <= high[np.maximum(at, 0)])], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(value), pa.array(n.astype(np.int64))], names=["c", "v", "n"])

    met = df.select(*[F.col(c).cast("double") for c in names]).mapInArrow(run, "c int, v double, n long")
    rows = met.groupBy("c", "v").agg(F.sum("n").alias("n")).toArrow()
    c, v, n = (rows.column(k).to_numpy() for k in range(3))
    out = {}
    for i, name in enumerate(names):
        order = np.argsort(v[c == i])
        out[name] = v[c == i][order], n[c == i][order]
    return out


def interval_counts(df: DataFrame, columns: Sequence[str], limits: int = LIMITS) -> dict[str, Intervals]:
    """Counts of every column between sketched limits; the counts are exact."""
    numbers = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    probs = F.array(*[F.lit(i / limits) for i in range(1, limits)])
    row = numbers.agg(*[F.percentile_approx(c, probs, 4 * limits).alias(c) for c in columns]).first()
    return _counted(numbers, columns, {c: np.unique(np.array(row[c] or [], dtype=float)) for c in columns})


def refine(df: DataFrame, counts: dict[str, Intervals], ranks: Callable[[int], Sequence[int]], gather: int = GATHER, cuts: int = CUTS) -> dict[str, Intervals]:
    """``counts`` cut and gathered until every rank that ``ranks(rows)`` wants has its value."""
    out = dict(counts)
    while True:
        need: dict[str, np.ndarray] = {}
        for c, own in out.items():
            if own.total:
                open_ = sorted({own.at(r) for r in ranks(own.total) if own.value(r) is None})
                if open_:
                    need[c] = np.array(open_)
        if not need:
            return out
        if sum(int(out[c].n[k].sum()) for c, k in need.items()) <= gather:
            found = _gathered(df, {c: (out[c].low[k], out[c].high[k]) for c, k in need.items()})
            for c, ks in need.items():
                v, n = found[c]
                for k in ks:
                    own = slice(np.searchsorted(v, out[c].low[k]), np.searchsorted(v, out[c].high[k], side="right"))
                    out[c].held[int(k)] = v[own], n[own]
            return out
        finer = {}
        for c, ks in need.items():
            marks = []
            for k in ks:
                a, b = (int(v) for v in ordered_bits(np.array([out[c].low[k], out[c].high[k]])))
                marks += [a + (b - a) * i // cuts for i in range(cuts)]
            # the largest value below an interval ends what lies before it
            finer[c] = np.unique(np.concatenate([out[c].high[:-1], from_bits(np.array(marks, dtype=np.int64))]))
        out.update(_counted(df, list(finer), finer))


def fractions_of(probs: Sequence) -> list[Fraction]:
    return [Fraction(*p) if isinstance(p, tuple) else Fraction(p).limit_denominator(1_000_000) for p in probs]


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence, counts: dict[str, Intervals] | None = None, **bounds) -> dict[str, list[float]]:
    """Exact quantiles of every column with linear interpolation between neighbouring rows; no entry for a column without values.

    ``df`` is read three times (sketch, counts, values), more only where intervals hold too many rows to gather; keep it in memory or in
    a table. Ranks are worked out in whole numbers.
    """
    wanted = fractions_of(probs)
    counts = counts or interval_counts(df, columns)

    def ranks(n: int) -> list[int]:
        low = [(n - 1) * p.numerator // p.denominator for p in wanted]
        return [r for k in low for r in (k, min(k + 1, n - 1))]

    out = {}
    for c, own in refine(df, {c: counts[c] for c in columns}, ranks, **bounds).items():
        if not own.total:
            continue
        values = []
        for p in wanted:
            whole, rest = divmod((own.total - 1) * p.numerator, p.denominator)
            a = own.value(whole)
            values.append(a if rest == 0 else a + (own.value(whole + 1) - a) * (rest / float(p.denominator)))
        out[c] = values
    return out


def few_values(df: DataFrame, counts: dict[str, Intervals], limit: int) -> dict[str, list[float] | None]:
    """For every column its distinct values if there are at most ``limit`` of them, else None. Exact: columns whose intervals leave it open are looked at once more."""
    out: dict[str, list[float] | None] = {}
    unsure: dict[str, np.ndarray] = {}
    for c, own in counts.items():
        single = own.low == own.high
        if int(single.sum() + 2 * (~single).sum()) > limit:
            out[c] = None
        elif single.all():
            out[c] = own.low.tolist()
        else:
            unsure[c] = np.flatnonzero(~single)
    if unsure:
        shipped = df.sparkSession.sparkContext.broadcast([(counts[c].low[k], counts[c].high[k]) for c, k in unsure.items()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: list[np.ndarray] = [np.zeros(0)] * len(shipped.value)
            for batch in batches:
                for i, x in enumerate(_matrix(batch)):
                    low, high = shipped.value[i]
                    at = np.searchsorted(low, x, side="right") - 1
                    # a task that has seen more than the limit need not send more
                    seen[i] = np.unique(np.concatenate([seen[i], x[(at >= 0) & (x <= high[np.maximum(at, 0)])]]))[: limit + 1]
            for i, v in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v)], names=["c", "v"])

        names = list(unsure)
        rows = df.select(*[F.col(c).cast("double") for c in names]).mapInArrow(run, "c int, v double").groupBy("c").agg(F.slice(F.array_sort(F.collect_set("v")), 1, limit + 1).alias("v")).collect()
        for r in rows:
            own = counts[names[r["c"]]]
            values = sorted([*own.low[own.low == own.high].tolist(), *r["v"]])
            out[names[r["c"]]] = values if len(values) <= limit else None
    return out
