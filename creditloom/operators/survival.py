"""Survival tables and estimators on integer durations.

Everything that follows a risk set starts from one combined ``groupBy(duration)`` over the loans. Sums over longer durations are taken within
ranges of durations and shifted by the totals of the ranges behind, so durations may be as many as they like.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.tails import chi2_tail, normal_two_sided, pearson_two_sided
from creditloom.operators.fitted import Fitted
from creditloom.operators.labels import usable_columns
from creditloom.operators.metrics import score_bands
from creditloom.operators.ordered import exact_quantiles
from creditloom.session import written

MAX_AGE = 480
#: Durations in one part of the log-rank sums and of residuals.
RANGE = 512
#: Ranges of durations in a Cox fit; the driver holds one row of sums for each.
COX_RANGES = 64


def survival_table(
    rows: DataFrame,
    covariates: Sequence[str],
    keys: Sequence[str] = ("loan_seq_num",),
    age: str = "loan_age",
    target: str = "default_12m",
    order: str = "report_date",
    event_source: str = "flag",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per loan: covariates of its oldest row, duration = max(age, 1), event, first date and year.

    ``event_source='flag'`` takes the event from the forward label, ``'default_date'`` from a known default date.
    """
    extra = [c for c in (*covariates, *keep) if c in rows.columns]
    if event_source == "flag":
        event = F.coalesce(F.max(target), F.lit(0))
    elif event_source == "default_date":
        event = F.max(F.col("default_date").isNotNull().cast("int"))
    else:
        raise ValueError("event_source is 'flag' or 'default_date'")
    last = F.max_by(F.struct(*[F.col(c) for c in extra]), F.struct(F.col(age), F.col(order))) if extra else None
    out = rows.groupBy(*keys).agg(
        F.max(age).alias(age), event.cast("int").alias("event"), F.min(order).alias("first_date"),
        *([last.alias("_last")] if extra else []),
    )
    duration = F.when(F.col(age) < 1, 1).otherwise(F.col(age)).cast("int")
    return out.filter(F.col(age).isNotNull()).select(
        *keys, age, *[F.col(f"_last.{c}").alias(c) for c in extra if c != age],
        duration.alias("duration"), "event", "first_date", F.year("first_date").alias("orig_year"),
    )


def tertiles(df: DataFrame, column: str, alias: str = "tertile") -> DataFrame:
    """Groups 1 to 3 cut at the 33rd and 67th percentile, right-closed, with labels that carry the cuts."""
    keyed = df.withColumn("_g", F.pmod(F.xxhash64(column), F.lit(1)))
    cuts = exact_quantiles(keyed, ["_g"], column, [(33, 100), (67, 100)], "_cuts").select("_g", "_cuts")
    c, lo, hi = F.col(column), F.col("_cuts")[0], F.col("_cuts")[1]
    group = F.when(c <= lo, 1).when(c <= hi, 2).when(c > hi, 3)
    text = (
        F.when(c <= lo, F.concat(F.lit("Low (<= "), lo.cast("string"), F.lit(")")))
        .when(c <= hi, F.lit("Mid")).when(c > hi, F.concat(F.lit("High (> "), hi.cast("string"), F.lit(")")))
    )
    return keyed.join(F.broadcast(cuts), "_g").withColumn(alias, group).withColumn(f"{alias}_label", text).drop("_g", "_cuts")


def event_table(df: DataFrame, by: Sequence[str], max_t: int | None = None) -> DataFrame:
    """Deaths, exits and number at risk per group and duration (durations above ``max_t`` count at ``max_t``)."""
    t = F.col("duration") if max_t is None else F.when(F.col("duration") > max_t, max_t).otherwise(F.col("duration"))
    counts = df.groupBy(*by, t.cast("int").alias("duration")).agg(
        F.sum(F.col("event").cast("long")).alias("deaths"), F.count(F.lit(1)).alias("exits")
    )
    group = [F.col(b) for b in by] or [F.lit(0)]
    later = Window.partitionBy(*group).orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("at_risk", F.sum("exits").over(later))


def kaplan_meier(df: DataFrame, by: Sequence[str], max_t: int | None = 120, z: float = 1.959963984540054) -> DataFrame:
    """Product-limit survival with log-log confidence limits at every observed duration."""
    t = event_table(df.dropna(subset=list(by)) if by else df, by, max_t)
    group = [F.col(b) for b in by] or [F.lit(0)]
    upto = Window.partitionBy(*group).orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("deaths").cast("double"), F.col("at_risk").cast("double")
    out = t.withColumn("survival", F.product(1.0 - d / n).over(upto)).withColumn(
        "_v", F.sum(F.try_divide(d, n * (n - d))).over(upto)
    )
    s = F.col("survival")
    half = F.lit(z) * F.sqrt("_v") / F.log(s)
    inside = (s > 0) & (s < 1)
    limit = lambda sign: F.when(inside, F.exp(-F.exp(F.log(-F.log(s)) + sign * half))).when(s >= 1, F.lit(1.0))
    return out.select(
        *by, "duration", "at_risk", "deaths", "survival", limit(-1).alias("ci_lower"), limit(1).alias("ci_upper")
    )


def log_rank(df: DataFrame, by: str, max_t: int | None = 120, missing: str = "Unknown") -> DataFrame:
    """k-sample log-rank test: groups, chi-square statistic, degrees of freedom, p-value (one row).

    The event table is cut into ranges of ``RANGE`` durations. A group's loans that leave after a range are carried into it as
    one row, so each range works out the groups' shares of its risk sets by itself; they are written. The covariance of the k groups is never formed: its system is solved by
    conjugate gradients, each step one pass over the shares that multiplies it with a vector. The driver holds vectors of k numbers.
    """
    spark = df.sparkSession
    g = F.coalesce(F.col(by).cast("string"), F.lit(missing))
    t = event_table(df.withColumn("_grp", g), ["_grp"], max_t).select("_grp", F.col("duration").cast("long").alias("duration"), "exits", "deaths")
    t = t.withColumn("_range", F.floor(F.col("duration") / RANGE))
    per = t.groupBy("_grp", "_range").agg(F.sum("exits").alias("exits"))
    bounds = per.groupBy("_grp").agg(F.min("_range").alias("_first"), F.max("_range").alias("_last"))
    known = bounds.collect()
    if not known:
        return spark.createDataFrame([(0, None, 0, None)], "n_groups int, statistic double, dof int, p_value double")
    names, lowest = sorted(r["_grp"] for r in known), min(r["_first"] for r in known)
    # every range that a group's loans pass through, whether or not one leaves there
    grid = bounds.select("_grp", F.explode(F.sequence(F.lit(lowest), F.col("_last"))).alias("_range"))
    later = Window.partitionBy("_grp").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(per, ["_grp", "_range"], "left").select(
        "_grp", F.lit(None).cast("long").alias("duration"), F.coalesce(F.sum("exits").over(later), F.lit(0)).alias("exits"), F.lit(0).alias("deaths"), "_range",
    )
    parts = t.union(carried).select("_grp", "duration", F.col("exits").cast("double"), F.col("deaths").cast("double"), "_range")
    place = {name: i for i, name in enumerate(names)}
    shares = written(parts.groupBy("_range").applyInArrow(lambda table: _risk_shares(table, place), "weight double, died double, shares array<double>, deaths array<double>"), "shares")
    k = len(names) - 1
    x = _added(shares, len(names), lambda w, d, s, own: (own - d[:, None] * s).sum(axis=0))[:k]
    diagonal = _added(shares, len(names), lambda w, d, s, own: (w[:, None] * (s - s**2)).sum(axis=0))[:k]

    def times(y: np.ndarray) -> np.ndarray:
        y = np.append(y, 0.0)
        return _added(shares, len(names), lambda w, d, s, own: s.T @ (-w * (s @ y)) + (w @ s) * y)[:k]

    stat = float(x @ _solved(times, x, diagonal)) if k > 0 else 0.0
    return spark.createDataFrame([(len(names), stat, k, chi2_tail(stat, k))], "n_groups int, statistic double, dof int, p_value double")


def _risk_shares(table: pa.Table, place: dict[str, int]) -> pa.Table:
    """For each duration of one range with a death: the weight of its covariance, its deaths, each group's share of those at risk and its deaths."""
    at = np.array([place[g] for g in table["_grp"].to_pylist()])
    d = table["duration"].to_numpy().astype(float)
    inside = ~np.isnan(d)
    times, row = np.unique(d[inside], return_inverse=True)
    exits, deaths = np.zeros((len(times), len(place))), np.zeros((len(times), len(place)))
    np.add.at(exits, (row, at[inside]), table["exits"].to_numpy()[inside])
    np.add.at(deaths, (row, at[inside]), table["deaths"].to_numpy()[inside])
    after = np.bincount(at[~inside], weights=table["exits"].to_numpy()[~inside], minlength=len(place))
    risk = exits[::-1].cumsum(axis=0)[::-1] + after
    n, died = risk.sum(axis=1), deaths.sum(axis=1)
    some = (died > 0) & (n > 0)
    n, died, risk, deaths = n[some], died[some], risk[some], deaths[some]
    weight = np.divide(died * (n - died), n - 1, out=np.zeros_like(died), where=n > 1)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, len(place), dtype=np.int32)), pa.array(v.ravel())) for v in (risk / n[:, None], deaths)]
    return pa.table({"weight": weight, "died": died, "shares": lists[0], "deaths": lists[1]})


def _added(shares: DataFrame, k: int, fn: Callable[..., np.ndarray]) -> np.ndarray:
    """Sum over all durations of a vector of k numbers that ``fn(weight, died, shares, deaths)`` makes of a batch; tasks send one vector each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            w, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            s, own = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k) for c in (2, 3))
            total += fn(w, d, s, own)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["i", "v"])

    out = np.zeros(k)
    for r in shares.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _solved(times: Callable[[np.ndarray], np.ndarray], x: np.ndarray, diagonal: np.ndarray, tol: float = 1e-11) -> np.ndarray:
    """y with ``times(y) = x`` by conjugate gradients, scaled by the diagonal; a part of x that the matrix can't reach is left out."""
    scale = np.divide(1.0, diagonal, out=np.zeros_like(diagonal), where=diagonal > 1e-12 * max(diagonal.max(initial=0.0), 1e-300))
    y, r = np.zeros(len(x)), np.where(scale > 0, x, 0.0)
    z = scale * r
    p, rz = z, float(r @ z)
    goal = tol**2 * rz
    for _ in range(2 * len(x) + 10):
        if rz <= goal or rz == 0:
            break
        v = np.where(scale > 0, times(p), 0.0)
        bend = float(p @ v)
        if bend <= 1e-14 * float((p**2) @ diagonal):
            break  # a direction in which the matrix is flat
        y, r = y + rz / bend * p, r - rz / bend * v
        z = scale * r
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return y


@dataclass
class CoxModel:
    """Fitted proportional-hazards model. ``coef`` is on the raw covariate scale."""

    features: list[str]
    means: np.ndarray
    scales: np.ndarray
    coef: np.ndarray
    std_error: np.ndarray
    log_likelihood: float
    n: int
    n_events: int
    baseline: DataFrame | Sequence[tuple[int, float]]  # (duration, hazard) of every duration with an event
    iterations: int

    def eta(self) -> Column:
        """Linear predictor, centred at the training means."""
        total = F.lit(0.0)
        for f, m, b in zip(self.features, self.means, self.coef):
            total = total + F.lit(float(b)) * (F.col(f).cast("double") - F.lit(float(m)))
        return total

    def cumulative_hazards(self, horizons: Sequence[int]) -> list[float]:
        """Baseline cumulative hazard at the last event time up to each horizon (0 before the first): one row from the table of hazards."""
        if not isinstance(self.baseline, DataFrame):
            return [sum(h for t, h in self.baseline if t <= horizon) for horizon in horizons]
        row = self.baseline.agg(*[F.coalesce(F.sum(F.when(F.col("duration") <= h, F.col("hazard"))), F.lit(0.0)) for h in horizons]).first()
        return [float(v) for v in row]


class CoxArtefact(Fitted):
    """A fitted model that can be saved; the hazards stay a table."""

    def __init__(self, model: CoxModel):
        numbers = {"means": model.means, "scales": model.scales, "coef": model.coef, "std_error": model.std_error}
        state = {"features": list(model.features), **{k: [float(x) for x in v] for k, v in numbers.items()}}
        state |= {"log_likelihood": float(model.log_likelihood), "n": int(model.n), "n_events": int(model.n_events), "iterations": int(model.iterations)}
        super().__init__(state, {"baseline": model.baseline})

    @property
    def model(self) -> CoxModel:
        s = self.state
        return CoxModel(s["features"], *(np.array(s[k]) for k in ("means", "scales", "coef", "std_error")), s["log_likelihood"], s["n"], s["n_events"], self.tables["baseline"], s["iterations"])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.state.get("output", "eta"), self.model.eta())


def _tie_sums(d: int, a: float) -> np.ndarray:
    """Sums over l = 0..d-1 of log u, 1/u, l/u, 1/u2, l/u2, l2/u2 with u = a - l, a million terms at a time."""
    total = np.zeros(6)
    for first in range(0, d, 1_000_000):
        steps = np.arange(first, min(d, first + 1_000_000), dtype=float)
        u = a - steps
        total += [np.log(u).sum(), (1 / u).sum(), (steps / u).sum(), (1 / u**2).sum(), (steps / u**2).sum(), (steps**2 / u**2).sum()]
    return total


def _risk_sums(df: DataFrame, z: Sequence[Column], eta: Column) -> DataFrame:
    """Per duration (and its range): counts, event sums of z, and risk / event sums of exp(eta) x (1, z, zz'). One aggregate."""
    p = len(z)
    cells = df.select(
        "_range", "duration", "event", F.exp(eta).alias("_w"), *[c.alias(f"_z{i}") for i, c in enumerate(z)]
    )
    died = F.col("event") == 1
    w, dw = F.col("_w"), F.when(died, F.col("_w")).otherwise(0.0)
    zs = [F.col(f"_z{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    terms = [F.count(F.lit(1)).cast("double"), F.sum(died.cast("double"))]
    terms += [F.sum(F.when(died, c).otherwise(0.0)) for c in zs]
    for weight in (w, dw):
        terms += [F.sum(weight)] + [F.sum(weight * c) for c in zs] + [F.sum(weight * zs[i] * zs[j]) for i, j in pairs]
    return cells.groupBy("_range", "duration").agg(F.array(*terms).alias("s"))


def _range_totals(sums: DataFrame, p: int) -> dict[int, np.ndarray]:
    """Risk sums of all later ranges, for each of at most ``COX_RANGES`` ranges."""
    block = 1 + p + p * (p + 1) // 2
    rows = sums.groupBy("_range").agg(*[F.sum(F.col("s")[2 + p + i]).alias(f"v{i}") for i in range(block)]).collect()
    out, total = {}, np.zeros(block)
    for r in sorted(rows, key=lambda r: -r["_range"]):
        out[r["_range"]] = total
        total = total + np.array(r[1:], dtype=float)
    return out


def fit_cox(
    df: DataFrame, features: Sequence[str], penalizer: float = 0.1, max_iter: int = 50, tol: float = 1e-9
) -> CoxModel:
    """Cox model with Efron ties and an L2 penalty, by Newton steps.

    Objective: mean partial log-likelihood - penalizer / 2 x |beta|^2 on covariates scaled to unit sample
    deviation. Each step is one aggregate to a row for each duration; durations are cut into at most ``COX_RANGES`` ranges, which get the sums of the later ranges
    and add up their part of likelihood, gradient and Hessian in a task each. The driver sees ranges, never durations; the matrix work is p x p.
    """
    present = [f for f in features if f in df.columns]
    held = written(df.select(F.col("duration").cast("long").alias("duration"), F.col("event").cast("int").alias("event"), *[F.col(f).cast("double").alias(f) for f in present]), "cox-rows")
    feats = usable_columns(held, present)
    data = held.select("duration", "event", *feats).dropna()
    probs = F.array(*[F.lit(i / COX_RANGES) for i in range(1, COX_RANGES)])
    stats = data.agg(
        F.count(F.lit(1)), F.sum("event"), *[F.avg(f) for f in feats], *[F.stddev_samp(f) for f in feats], F.percentile_approx("duration", probs, 4 * COX_RANGES),
    ).first()
    n, n_events, p = stats[0], stats[1] or 0, len(feats)
    if n_events == 0:
        raise ValueError("no event in the survival table")
    limits = sorted(set(stats[-1]))
    data = data.withColumn("_range", F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in limits]), lambda x: x < F.col("duration")))).persist()
    try:
        means, scales = np.array(stats[2 : 2 + p], float), np.array(stats[2 + p : 2 + 2 * p], float)
        scales[~(scales > 0)] = 1.0
        z = [(F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(feats, means, scales)]
        beta, kept, best = np.zeros(p), np.zeros(p), -np.inf
        for step in range(1, max_iter + 1):
            value, grad, hess, _ = _cox_step(data, z, beta)
            value -= 0.5 * penalizer * n * float(beta @ beta)
            if value < best - 1e-9 * abs(best):
                beta = (beta + kept) / 2  # overshoot: go back halfway
                continue
            kept, best = beta, value
            hess = hess - penalizer * n * np.eye(p)
            move = np.linalg.solve(-hess, grad - penalizer * n * beta)
            if float(move @ -hess @ move) / n < tol:
                break
            beta = beta + move
        se = np.sqrt(np.diag(np.linalg.inv(-hess))) / scales
        baseline = _cox_step(data, z, kept, hazards=True)[3]
        return CoxModel(list(feats), means, scales, kept / scales, se, best, n, n_events, baseline, step)
    finally:
        data.unpersist()


def _cox_step(data: DataFrame, z: Sequence[Column], beta: np.ndarray, hazards: bool = False):
    """Log-likelihood, gradient, Hessian (Efron) at ``beta``, or the Breslow hazards of every duration with an event."""
    p = len(beta)
    eta = F.lit(0.0)
    for c, b in zip(z, beta):
        eta = eta + c * F.lit(float(b))
    sums = _risk_sums(data, z, eta).persist()
    try:
        later = _range_totals(sums, p)

        def run(table: pa.Table) -> pa.Table:
            rows = pc.list_flatten(table["s"]).to_numpy().reshape(table.num_rows, -1)
            value, grad, hess, times, rates = _cox_terms(table["duration"].to_numpy(), rows, beta, later[table["_range"][0].as_py()])
            if hazards:
                return pa.table({"duration": pa.array(times, pa.int64()), "hazard": pa.array(rates, pa.float64())})
            return pa.table({"terms": [[value, *grad, *hess.ravel()]]})

        parts = sums.groupBy("_range").applyInArrow(run, "duration long, hazard double" if hazards else "terms array<double>")
        if hazards:
            return None, None, None, written(parts, "hazards")
        total = np.sum([r["terms"] for r in parts.collect()], axis=0)  # a row for each range
        return total[0], total[1 : 1 + p], total[1 + p :].reshape(p, p), None
    finally:
        sums.unpersist()


def _cox_terms(durations: np.ndarray, sums: np.ndarray, beta: np.ndarray, later: np.ndarray):
    """The part of one range of durations, with a row of sums for each; ``later`` has the risk sums of all longer durations."""
    p = len(beta)
    order = np.argsort(-durations)
    durations, sums = durations[order], sums[order]
    block = 1 + p + p * (p + 1) // 2
    head, risk, dead = sums[:, : 2 + p], sums[:, 2 + p : 2 + p + block], sums[:, 2 + p + block :]
    at = np.cumsum(np.concatenate([later[None, :], risk]), axis=0)[1:]
    d = np.rint(head[:, 1]).astype(np.int64)
    some = d > 0
    durations, head, at, dead, d = durations[some], head[some], at[some], dead[some], d[some]
    (r0, r1, r2), (d0, d1, d2) = ((v[:, 0], v[:, 1 : 1 + p], v[:, 1 + p :]) for v in (at, dead))
    ratio = d / d0
    u = r0 * ratio
    log_u, inv, l_inv, inv2, l_inv2, ll_inv2 = ties = np.stack([np.log(u), 1 / u, 0 * u, 1 / u**2, 0 * u, 0 * u])
    for k in np.flatnonzero(d > 1):
        ties[:, k] = _tie_sums(int(d[k]), u[k])
    times = lambda m, c: m * c[:, None]
    value = float((head[:, 2:] @ beta - log_u + d * np.log(ratio)).sum())
    grad = (head[:, 2:] - times(r1, ratio * inv) + times(d1, l_inv / d0)).sum(axis=0)
    i, j = np.triu_indices(p)
    mixed = r1[:, i] * d1[:, j] + d1[:, i] * r1[:, j]
    upper = times(d2, l_inv / d0) - times(r2, ratio * inv) + times(r1[:, i] * r1[:, j], ratio**2 * inv2)
    upper = (upper - times(mixed, d * l_inv2 / d0**2) + times(d1[:, i] * d1[:, j], ll_inv2 / d0**2)).sum(axis=0)
    hess = np.zeros((p, p))
    hess[i, j] = hess[j, i] = upper
    return value, grad, hess, durations, d / r0


def cox_summary(model: CoxModel, spark) -> DataFrame:
    """Coefficient, hazard ratio, 95 % limits, z and p per covariate."""
    z95 = 1.959963984540054
    rows = []
    for f, b, s in zip(model.features, model.coef, model.std_error):
        z = b / s if s > 0 else float("nan")
        rows.append((f, float(b), float(math.exp(b)), float(s), float(math.exp(b - z95 * s)), float(math.exp(b + z95 * s)), float(z), normal_two_sided(z)))
    return spark.createDataFrame(
        rows, "feature string, coef double, hazard_ratio double, se double, hr_lower double, hr_upper double, z double, p_value double"
    )


#: Distinct durations of a range of the outlive counts below; places of a dense array there.
DURATIONS, PLACES = 2048, 1 << 21


def earlier_weight(key: np.ndarray, weight: np.ndarray, ask: np.ndarray) -> float:
    """Sum over i of ``ask[i]`` x the ``weight`` of all j before i with a larger key.

    Counted block by block: at each size, items of a right block meet those of the block left of it, both in the order of their keys. Arrays are sparse: room for the items only,
    whatever the span of the keys.
    """
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.diff(key[order], prepend=key[order][:1]) > 0) if len(key) else rank
    place, total, size = np.arange(len(key)), 0.0, 1
    while size < len(key):
        pair, right = place // (2 * size), (place // size) % 2 == 1
        # larger keys first; at equal keys the right block first, so that it doesn't meet the left one's equal keys
        at = np.lexsort((~right, -rank, pair))
        seen = np.cumsum(np.where(right[at], 0.0, weight[at]))
        own, asks = pair[at], np.where(right[at], ask[at], 0.0)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        before = np.concatenate([[0.0], seen])[first]
        total += float((asks * (seen - before[np.cumsum(np.diff(own, prepend=own[:1]) > 0)])).sum())
        size *= 2
    return total


def _inside_part(table: pa.Table) -> tuple[float, float]:
    """Won and tied pairs among the loans of one range of risks. An event at duration d has key 2d, a censored loan 2d + 1: the one that outlives an event has the larger key."""
    risk, d, ev, ce = (table[c].to_numpy() for c in ("_r", "_d", "ev", "ce"))
    order = np.lexsort((d, risk))
    risk, d, ev, ce = risk[order], d[order].astype(np.int64), ev[order].astype(float), ce[order].astype(float)
    key = np.stack([2 * d, 2 * d + 1], axis=1).ravel()
    weight, ask = np.stack([ev, ce], axis=1).ravel(), np.stack([ev, np.zeros(len(ev))], axis=1).ravel()
    # within one risk durations ascend, so no earlier loan of the same risk outlives a later one
    won = earlier_weight(key, weight, ask)
    group = np.cumsum(np.diff(risk, prepend=risk[:1]) != 0)
    both = ev + ce
    running = np.cumsum(both)
    last = np.append(np.flatnonzero(np.diff(group)), len(group) - 1)[group]
    return won, float((ev * (running[last] - running + ce)).sum())


def _across_parts(rows: pa.Table) -> tuple[float, float]:
    """Won pairs between ranges of risks, and all comparable pairs, for the events of one range of durations. Rows without a duration hold what outlives the range."""
    part, d, ev, ce = (rows[c].to_numpy(zero_copy_only=False) for c in ("_part", "_d", "ev", "ce"))
    inside = ~np.isnan(d.astype(float))
    parts, column = np.unique(part, return_inverse=True)
    later = np.bincount(column[~inside], weights=ce[~inside], minlength=len(parts)).astype(float)
    times, row = np.unique(d[inside].astype(np.int64), return_inverse=True)
    won = pairs = 0.0
    step = max(1, PLACES // max(1, len(parts)))
    for high in range(len(times), 0, -step):
        low = max(0, high - step)
        own = (row >= low) & (row < high)
        e, c = np.zeros((high - low, len(parts))), np.zeros((high - low, len(parts)))
        np.add.at(e, (row[own] - low, column[inside][own]), ev[inside][own])
        np.add.at(c, (row[own] - low, column[inside][own]), ce[inside][own])
        both = e + c
        outlive = later + both[::-1].cumsum(axis=0)[::-1] - both + c
        won += float((e * (outlive.cumsum(axis=1) - outlive)).sum())
        pairs += float((e.sum(axis=1) * outlive.sum(axis=1)).sum())
        later = later + both.sum(axis=0)
    return won, pairs


def concordance_index(df: DataFrame, risk: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of comparable pairs in which the higher risk fails first (ties in risk count half).

    A pair is comparable when the shorter duration is an event; at equal durations an event precedes a
    censored loan. Exact and without a pair join: loans become counts per (risk, duration), which are dealt out by ranges of the
    risk. Pairs inside a range are counted in its task, in room for its own rows; pairs across ranges come from the counts per (range,
    duration), dealt out by ranges of durations with what outlives each. Durations may have any span.
    """
    group = list(by)
    spark = df.sparkSession
    base = df.select(*by, F.col(risk).cast("double").alias("_r"), F.col("duration").cast("long").alias("_d"), F.col("event").cast("int").alias("_e"))
    base = base.filter(F.col("_r").isNotNull() & F.col("_d").isNotNull())
    keys = [F.col(g) for g in group]
    cells = base.groupBy(*group, "_r", "_d").agg(F.sum("_e").cast("long").alias("ev"), F.sum(1 - F.col("_e")).cast("long").alias("ce"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cells = written(cells.repartitionByRange(parts, *keys, F.col("_r")).withColumn("_part", F.spark_partition_id()), "risks")
    dealt = written(cells.groupBy(*group, "_part", "_d").agg(F.sum("ev").alias("ev"), F.sum("ce").alias("ce")), "durations")
    times = dealt.select("_d").distinct()
    ranges = max(1, -(-times.count() // DURATIONS))
    times = written(times.repartitionByRange(ranges, "_d").withColumn("_range", F.spark_partition_id()), "ranges")
    hist = dealt.join(times, "_d")
    # what outlives a range, for every range of risks that a group has
    held = hist.groupBy(*group, "_range", "_part").agg(F.sum(F.col("ev") + F.col("ce")).alias("n"))
    grid = held.select(*group, "_part").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("_range"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*group, "_range", "_part")]
    named = held.withColumnsRenamed({c: f"_k_{c}" for c in (*group, "_range", "_part")})
    later = Window.partitionBy(*group, "_part").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(named, reduce(and_, same), "left").select(
        *group, "_range", "_part", F.lit(None).cast("long").alias("_d"), F.lit(0).cast("long").alias("ev"), F.coalesce(F.sum("n").over(later), F.lit(0)).alias("ce")
    )
    fields = [*group, "_range", "_part", "_d", "ev", "ce"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*group).schema.fields)

    def counted(fn: Callable[[pa.Table], tuple[float, float]]) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            one, two = fn(table)
            return pa.table({**{g: table[g].slice(0, 1) for g in group}, "a": [one], "b": [two]})

        return run

    schema = ", ".join([*([kinds] if kinds else []), "a double, b double"])
    inner = cells.groupBy(*group, "_part").applyInArrow(counted(_inside_part), schema).select(*group, F.col("a").alias("won"), F.col("b").alias("tied"), F.lit(0.0).alias("pairs"))
    across = hist.select(*fields).union(carried.select(*fields)).groupBy(*group, "_range").applyInArrow(counted(_across_parts), schema)
    total = inner.unionByName(across.select(*group, F.col("a").alias("won"), F.lit(0.0).alias("tied"), F.col("b").alias("pairs")))
    total = total.groupBy(*group).agg(F.sum("won").alias("won"), F.sum("tied").alias("tied"), F.sum("pairs").alias("pairs"))
    index = F.try_divide(F.col("won") + F.col("tied") / 2, F.col("pairs"))
    return total.select(*by, F.col("pairs").cast("long").alias("n_pairs"), index.alias("c_index"))


def horizon_pds(model: CoxModel, df: DataFrame, horizons: Sequence[int] = (12, 24, 36, 60), keep: Sequence[str] = ("loan_seq_num",)) -> DataFrame:
    """Probability of default by each horizon, one column each: a narrow projection over the loans."""
    hazard = F.exp(model.eta())
    rows = df.dropna(subset=model.features)
    base = model.cumulative_hazards(horizons)
    return rows.select(
        *keep, *[(1.0 - F.exp(-F.lit(b) * hazard)).alias(f"pd_{h}m") for h, b in zip(horizons, base)],
        F.col("event").alias("actual_default"),
    )


def schoenfeld_residuals(model: CoxModel, df: DataFrame) -> DataFrame:
    """Long table (duration, feature, residual): covariate of each event minus its risk-set mean.

    Sums per duration are added up from the longest down within ranges, and across ranges from their totals; the means join the event rows by duration.
    """
    data = df.dropna(subset=model.features).withColumn("_w", F.exp(model.eta()))
    names = ["w", *[f"s_{f}" for f in model.features]]
    sums = data.groupBy("duration").agg(
        F.sum("_w").alias("w"), *[F.sum(F.col("_w") * F.col(f)).alias(f"s_{f}") for f in model.features]
    ).withColumn("_range", F.floor(F.col("duration") / RANGE))
    sums = written(sums, "risk-sums")
    longer = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.groupBy("_range").agg(*[F.sum(c).alias(c) for c in names]).select("_range", *[F.coalesce(F.sum(c).over(longer), F.lit(0.0)).alias(f"o_{c}") for c in names])
    later = Window.partitionBy("_range").orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    risk = sums.join(offsets, "_range").select("duration", *[(F.sum(c).over(later) + F.col(f"o_{c}")).alias(c) for c in names])
    means = risk.select("duration", *[(F.col(f"s_{f}") / F.col("w")).alias(f"m_{f}") for f in model.features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f).cast("double") - F.col(f"m_{f}")).alias("residual")) for f in model.features])
    return data.filter(F.col("event") == 1).join(means, "duration").select("duration", F.inline(cells))


def linear_trend(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope, intercept and correlation of y on x per group (built-in regression aggregates)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"),
    )


def with_correlation_p(trend: DataFrame) -> DataFrame:
    """Add the two-sided p-value of ``r`` over ``n`` pairs (one value per report row)."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pearson_two_sided(a, b) for a, b in zip(r, n)])

    return trend.withColumn("p_value", p_value("r", "n"))


def horizon_calibration(df: DataFrame, pd_col: str = "pd_12m", target: str = "actual_default", k: int = 10) -> DataFrame:
    """Mean predicted and observed rate per equal-frequency band of a horizon PD."""
    b = score_bands(df, [], pd_col, target, k)
    return b.select("band", "n", (F.col("score_sum") / F.col("n")).alias("mean_pd"), (F.col("n_default") / F.col("n")).alias("observed"))
