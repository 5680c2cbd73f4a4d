"""Macro scenarios, stressed default probabilities and expected credit loss.

Scenario tables are tiny and fixed in size (scenarios x quarters), so a projection carries them as literals:
every loan is projected inside its own row with array functions. No join, no shuffle and no 60-fold row
explosion, unless a fitted tree model has to be asked, see :func:`model_path_pds`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from creditloom.functions.scalars import clip
from creditloom.operators.ordered import exact_quantiles
from creditloom.operators.reports import wide_percentiles
from creditloom.session import written


@dataclass(frozen=True)
class Scenario:
    name: str
    label: str
    weight: float
    ur: tuple[float, ...]  # change of the unemployment rate per quarter, points
    hpi: tuple[float, ...]  # change of the price index per quarter, percent


# Five-quarter scenarios.
PEAK_SCENARIOS = (
    Scenario("Base", "Base Scenario", 0.60, (0.0, 0.0, 0.0, 0.0, 0.0), (0.5, 0.5, 0.5, 0.5, 0.5)),
    Scenario("Adverse", "Adverse Scenario", 0.30, (0.8, 1.0, 0.8, 0.4, 0.0), (-2.5, -3.0, -2.5, -1.5, 0.5)),
    Scenario("Severe", "Severe Scenario  (GFC-level)", 0.10, (1.2, 1.5, 1.5, 1.2, 0.6), (-5.0, -6.0, -6.0, -5.0, -3.0)),
)

# Twenty-quarter scenarios with recovery.
PATH_SCENARIOS = (
    Scenario("Base", "Base Scenario", 0.60, (0.0,) * 20, (0.5,) * 20),
    Scenario(
        "Adverse", "Adverse Scenario", 0.30,
        (0.8, 1.0, 0.8, 0.4, 0.0, 0.0, -0.4, -0.5, -0.5, -0.4, -0.3, -0.2, -0.1, -0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (-2.5, -3.0, -2.5, -1.5, -0.5, 0.0, 0.3, 0.5, 0.5, 0.5, 0.4, 0.4, 0.3, 0.3, 0.3, 0.2, 0.2, 0.2, 0.2, 0.2),
    ),
    Scenario(
        "Severe", "Severe Scenario (GFC-level)", 0.10,
        (1.2, 1.5, 1.5, 1.2, 0.6, 0.0, 0.0, 0.0, -0.5, -0.6, -0.7, -0.6, -0.5, -0.4, -0.3, -0.3, -0.2, -0.2, -0.1, -0.2),
        (-5.0, -6.0, -6.0, -5.0, -3.0, -1.0, -0.5, 0.0, 0.2, 0.3, 0.4, 0.4, 0.4, 0.4, 0.3, 0.3, 0.3, 0.2, 0.2, 0.2),
    ),
)

# Assumptions.
LOSS_SHARE = 0.40
DISCOUNT_RATE = 0.05
HORIZONS = (4, 8, 12, 20)
RATE_FLOOR = 0.5
INDEX_FLOOR = 0.1

# A scorer turns feature overrides (name -> SQL text) into the SQL text of a PD. Text keeps the hundreds of
# literals of a projection to one call into the JVM.
Scorer = Callable[[Mapping[str, str]], str]


# ------------------------------------------------------------------------------------------------ macro paths
def macro_paths(
    level: DataFrame, scenarios: Sequence[Scenario], rate: str = "rate", start_index: float = 1.0, floor_state: bool = True
) -> DataFrame:
    """(scenario, quarter, ur, hpi_ratio) from a one-row table with the current rate; quarter 0 is today.

    ``floor_state=True`` floors the running values, so the next quarter builds on the floored one, and
    rounds the output. ``False`` lets the running values move freely and floors only the reported rate.
    """
    def steps(s: Scenario) -> str:
        return ", ".join(f"named_struct('u', {u!r}D, 'h', {h!r}D)" for u, h in zip(s.ur, s.hpi))

    rows = F.expr("array(" + ", ".join(f"named_struct('scenario', '{s.name}', 'steps', array({steps(s)}))" for s in scenarios) + ")")
    start = F.array(F.struct(F.col("_rate").alias("u"), F.lit(start_index).alias("h")))

    def move(path: Column, step: Column) -> Column:
        last = F.element_at(path, -1)
        u, h = last["u"] + step["u"], last["h"] * (1 + step["h"] / 100)
        if floor_state:
            u, h = clip(u, lo=RATE_FLOOR), clip(h, lo=INDEX_FLOOR)
        return F.concat(path, F.array(F.struct(u.alias("u"), h.alias("h"))))

    grown = level.select(F.col(rate).cast("double").alias("_rate"), F.inline(rows)).select(
        "scenario", F.posexplode(F.aggregate("steps", start, move)).alias("quarter", "p")
    )
    ur, index = F.col("p.u"), F.col("p.h")
    if floor_state:
        ur, index = F.round(ur, 4), F.round(index, 6)
    else:
        ur = F.when(F.col("quarter") > 0, clip(ur, lo=RATE_FLOOR)).otherwise(ur)
    return grown.select("scenario", "quarter", ur.alias("ur"), index.alias("hpi_ratio"))


def quarterly_change(paths: DataFrame) -> DataFrame:
    """Rate and index (percent from start) with their change on the quarter; 0 in the first one."""
    w = Window.partitionBy("scenario").orderBy("quarter")
    pct = (F.col("hpi_ratio") - 1) * 100
    out = paths.withColumn("hpi_pct", pct)
    for c, name in (("ur", "ur_change"), ("hpi_pct", "hpi_change_pp")):
        out = out.withColumn(name, F.col(c) - F.lag(c, 1).over(w))
    return out.fillna(0.0, ["ur_change", "hpi_change_pp"])


def peak_quarters(paths: DataFrame) -> DataFrame:
    """The first quarter of the highest rate per scenario."""
    row = F.max_by(F.struct("quarter", "ur", "hpi_ratio"), F.struct("ur", -F.col("quarter")))
    return paths.groupBy("scenario").agg(row.alias("r")).select("scenario", "r.quarter", "r.ur", "r.hpi_ratio")


def path_summary(paths: DataFrame) -> DataFrame:
    """Peak rate and its quarter, final rate, lowest index, number of quarters with a falling rate."""
    steps = quarterly_change(paths)
    agg = steps.groupBy("scenario").agg(
        F.max("ur").alias("peak_ur"), F.max_by("quarter", F.struct("ur", -F.col("quarter"))).alias("peak_quarter"),
        F.max_by("ur", "quarter").alias("final_ur"), F.min("hpi_ratio").alias("trough_hpi"),
        F.count(F.when(F.round("ur_change", 9) < 0, 1)).alias("recovery_quarters"),
    )
    return agg


# ------------------------------------------------------------------------------------------------ scorers
def logistic_scorer(intercept: float, weights: Mapping[str, float]) -> Scorer:
    """Closed-form logistic PD; features named in the overrides are replaced by them."""

    def score(overrides: Mapping[str, str]) -> str:
        terms = [f"{float(intercept)!r}D"]
        for name, w in weights.items():
            value = overrides.get(name, f"`{name}`")
            terms.append(f"{float(w)!r}D * ({value})")
        return f"1D / (1D + exp(-({' + '.join(terms)})))"

    return score


def number_sql(x: float) -> str:
    return f"{float(x)!r}D"


def macro_overrides(ur: str, hpi_ratio: str, quarter: str | None, hpi_convention: str = "inverse") -> dict[str, str]:
    """Feature values (SQL text) of a loan under one macro row. The price feature is origination / current
    index, the path is current / start, so ``inverse`` turns one into the other; ``reference`` passes the ratio
    unchanged. With ``quarter`` the loan ages three months per quarter."""
    if hpi_convention not in ("inverse", "reference"):
        raise ValueError("hpi_convention is 'inverse' or 'reference'")
    out = {"ur_3m_lag": ur, "hpi_change": f"1D / {hpi_ratio}" if hpi_convention == "inverse" else hpi_ratio}
    if quarter is not None:
        out["loan_age"] = f"loan_age + {quarter} * 3"
    return out


def override_columns(ur: str, hpi_ratio: str, quarter: str | None, hpi_convention: str = "inverse") -> dict[str, Column]:
    return {k: F.expr(v) for k, v in macro_overrides(ur, hpi_ratio, quarter, hpi_convention).items()}


def _by_scenario(paths: DataFrame) -> dict[str, list[Row]]:
    out: dict[str, list[Row]] = {}
    for r in sorted(paths.collect(), key=lambda r: (r["scenario"], r["quarter"])):  # scenarios x quarters rows
        out.setdefault(r["scenario"], []).append(r)
    return out


# ------------------------------------------------------------------------------------------------ PD paths
def attach_path_pds(
    loans: DataFrame, paths: DataFrame, scorer: Scorer, hpi_convention: str = "inverse", pd_period: str = "as_is"
) -> DataFrame:
    """Add ``pds_<scenario>``: PD in quarter 1, 2, .. as an array. Row-local."""
    out = {}
    for name, rows in _by_scenario(paths).items():
        pds = [
            _period_sql(scorer(macro_overrides(number_sql(r["ur"]), number_sql(r["hpi_ratio"]), str(r["quarter"]), hpi_convention)), pd_period)
            for r in rows if r["quarter"] > 0
        ]
        out[f"pds_{name.lower()}"] = F.expr(f"array({', '.join(pds)})")
    return loans.withColumns(out)


def _period_sql(pd: str, pd_period: str) -> str:
    """``annual_to_quarter`` turns a 12-month PD into a quarterly one, ``as_is`` keeps it. Scorers return
    probabilities, so there is nothing to limit."""
    if pd_period == "annual_to_quarter":
        return f"1D - pow(1D - {pd}, 0.25D)"
    if pd_period != "as_is":
        raise ValueError("pd_period is 'as_is' or 'annual_to_quarter'")
    return pd


def model_path_pds(
    loans: DataFrame, paths: DataFrame, predict: Callable[[DataFrame], DataFrame], keys: Sequence[str],
    keep: Sequence[str] = ("orig_upb",), hpi_convention: str = "inverse", pd_period: str = "as_is", pd_col: str = "pd",
) -> DataFrame:
    """The same arrays, beside ``keys`` and ``keep``, from a fitted model that must see rows.

    ``keys`` identify a row of ``loans``. Loans are hashed by key *before* they fan out to scenarios x
    quarters, so the explosion, the scoring and the regrouping stay in one stage: n rows are shuffled, not 60 n.
    ``predict`` adds ``pd_col`` to a frame with the feature columns.
    """
    grid = _by_scenario(paths)
    cells = F.expr("array(" + ", ".join(
        f"named_struct('_s', '{s}', '_q', {int(r['quarter'])}, '_u', {float(r['ur'])!r}D, '_h', {float(r['hpi_ratio'])!r}D)"
        for s, rows in grid.items() for r in rows if r["quarter"] > 0
    ) + ")")
    fan = loans.repartition(*keys).select("*", F.inline(cells))
    stressed = fan.withColumns(override_columns("_u", "_h", "_q", hpi_convention))
    scored = predict(stressed).select(*keys, *keep, "_s", "_q", F.expr(_period_sql(pd_col, pd_period)).alias("_pd"))
    # 60 small cells per row key, a fixed number
    packed = scored.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in keep], F.collect_list(F.struct("_s", "_q", "_pd")).alias("_cells")
    )

    def series(scenario: str) -> Column:
        mine = F.filter("_cells", lambda c: c["_s"] == F.lit(scenario))
        return F.transform(F.array_sort(F.transform(mine, lambda c: F.struct(c["_q"].alias("q"), c["_pd"].alias("p")))), lambda c: c["p"])

    arrays = {f"pds_{s.lower()}": series(s) for s in grid}
    return packed.select(*keys, *keep, *[v.alias(k) for k, v in arrays.items()])


def filled(loans: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """Missing values of the named columns replaced, so that no loan leaves a total."""
    return loans.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items() if c in loans.columns})


def stressed_rows(loans: DataFrame, paths: DataFrame, hpi_convention: str = "inverse") -> DataFrame:
    """Every loan in every quarter of every scenario, with its features changed: (loan columns, scenario, quarter)."""
    rows = [r for own in _by_scenario(paths).values() for r in own if r["quarter"] > 0]
    cells = F.array(*[F.struct(F.lit(r["scenario"]).alias("scenario"), F.lit(int(r["quarter"])).alias("quarter"), F.lit(float(r["ur"])).alias("_u"), F.lit(float(r["hpi_ratio"])).alias("_h")) for r in rows])
    return loans.select("*", F.inline(cells)).withColumns(override_columns("_u", "_h", "quarter", hpi_convention)).drop("_u", "_h")


def _macro_cells(rows: Sequence[Row], hpi_convention: str, ages: bool) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """Feature values that each macro row sets, and what it adds to the age."""
    if hpi_convention not in ("inverse", "reference"):
        raise ValueError("hpi_convention is 'inverse' or 'reference'")
    price = [1.0 / float(r["hpi_ratio"]) if hpi_convention == "inverse" else float(r["hpi_ratio"]) for r in rows]
    return {"ur_3m_lag": [float(r["ur"]) for r in rows], "hpi_change": price}, {"loan_age": [3.0 * r["quarter"] for r in rows]} if ages else {}


def ensemble_path_pds(
    loans: DataFrame, paths: DataFrame, fitted, keys: Sequence[str], keep: Sequence[str] = ("orig_upb",), hpi_convention: str = "inverse", pd_period: str = "as_is",
) -> DataFrame:
    """The arrays of :func:`model_path_pds` from an artefact with ``cell_pds``: all quarters of all scenarios are cells of one pass over the trees, so a row
    neither fans out nor moves. A missing feature counts as its median of train, also under a shock."""
    grid = {s: [r for r in rows if r["quarter"] > 0] for s, rows in _by_scenario(paths).items()}
    rows = [r for own in grid.values() for r in own]
    scored = fitted.cell_pds(loans, *_macro_cells(rows, hpi_convention, True), len(rows), "_pds")
    if pd_period not in ("as_is", "annual_to_quarter"):
        raise ValueError("pd_period is 'as_is' or 'annual_to_quarter'")
    pds = F.col("_pds") if pd_period == "as_is" else F.transform("_pds", lambda p: 1.0 - F.pow(1.0 - p, F.lit(0.25)))
    out, done = [], 0
    for name, own in grid.items():
        out.append(F.slice(pds, done + 1, len(own)).alias(f"pds_{name.lower()}"))
        done += len(own)
    return scored.select(*keys, *keep, *out)


def ensemble_scenario_pds(loans: DataFrame, peaks: DataFrame, fitted, keep: Sequence[str], hpi_convention: str = "inverse") -> DataFrame:
    """:func:`model_scenario_pds` from an artefact with ``cell_pds``: one pass for all scenarios."""
    rows = peaks.orderBy("scenario").collect()
    scored = fitted.cell_pds(loans, *_macro_cells(rows, hpi_convention, False), len(rows), "_pds")
    return scored.select(*keep, *[F.col("_pds")[i].alias(f"pd_{r['scenario'].lower()}") for i, r in enumerate(rows)])


def ensemble_sensitivity(loans: DataFrame, fitted, shocks: Mapping[str, float] | None = None) -> DataFrame:
    """:func:`model_sensitivity` from an artefact with ``cell_pds``: the base and every shock are cells of one pass, averaged before the shuffle."""
    shocks = SHOCKS if shocks is None else shocks
    add = {f: [0.0] + [d if f == g else 0.0 for g in shocks] for f, d in shocks.items()}
    scored = fitted.cell_pds(loans, {}, add, 1 + len(shocks), "_pds")
    one = scored.agg(F.avg(F.col("_pds")[0]).alias("_base"), *[F.avg(F.col("_pds")[i + 1]).alias(f"_s_{f}") for i, f in enumerate(shocks)])
    return _sensitivity_rows(one, shocks)


def survival_array(pds: Column) -> Column:
    """Probability of being alive at the end of quarter 0, 1, ..: a fold over the row's own array."""
    return F.aggregate(pds, F.array(F.lit(1.0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) * (1.0 - p))))


def long_paths(loans: DataFrame, scenarios: Sequence[Scenario], keys: Sequence[str]) -> DataFrame:
    """(keys, scenario, quarter, pd, alive_before, alive) from the array columns."""
    cells = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.col(f"pds_{s.name.lower()}").alias("pds"), survival_array(F.col(f"pds_{s.name.lower()}")).alias("alive"))
        for s in scenarios
    ])
    opened = loans.select(*keys, F.inline(cells))
    return opened.select(*keys, "scenario", "alive", F.posexplode("pds").alias("_i", "pd")).select(
        *keys, "scenario", (F.col("_i") + 1).alias("quarter"), "pd", F.get("alive", F.col("_i")).alias("alive_before"), F.get("alive", F.col("_i") + 1).alias("alive")
    )


def survival_window(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The survival product over a long PD table as a window; exact also when a PD is 1."""
    w = Window.partitionBy(*keys, "scenario").orderBy("quarter")
    alive = F.product(1.0 - F.col("pd"))
    return long.withColumn("alive", alive.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "alive_before", F.coalesce(alive.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    )


#: Rows of a long table that one task sorts in memory.
SORTED = 1 << 20


def dealt_out(loans: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """``loans`` written, and dealt out by ``keys`` into parts so small that each loan may become ``cells`` rows of a sort in memory.

    Rows that are made of a loan stay in its part, so windows and joins over the keys and more need no exchange of the long table.
    """
    held = written(loans, "dealt")
    parts = max(int(loans.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-held.count() * cells // SORTED))
    return held.repartition(parts, *keys)


# ------------------------------------------------------------------------------------------------ path ECL
def horizon_label(h: int) -> str:
    return f"{h // 4}Y" if h % 4 == 0 else f"Q{h}"


def path_ecl(
    loans: DataFrame, scenarios: Sequence[Scenario], keys: Sequence[str], horizons: Sequence[int] = HORIZONS,
    ead: Column | None = None, lgd: Column | None = None, annual_rate: float = DISCOUNT_RATE,
) -> DataFrame:
    """``ecl_<scenario>_<horizon>`` per loan: sum of PD x alive-before x LGD x EAD x discount up to the horizon.

    Needs the ``pds_<scenario>`` arrays. Horizons beyond the path end at its last quarter.
    """
    exposure = F.col("orig_upb").cast("double") if ead is None else ead
    severity = F.lit(LOSS_SHARE) if lgd is None else lgd
    out = [*keys, exposure.alias("orig_upb")]
    shares = _discounted_shares(horizons, annual_rate)
    for s in scenarios:
        for i, h in enumerate(horizons):
            out.append((F.col(f"_shares_{s.name.lower()}")[i] * severity * exposure).alias(f"ecl_{s.name.lower()}_{horizon_label(h)}"))
    return loans.withColumns({f"_shares_{s.name.lower()}": shares(F.col(f"pds_{s.name.lower()}")) for s in scenarios}).select(*out)


def _cells(lists: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of a batch as a matrix of at least ``width`` columns: values (0 where there is none), which cells have one, which cells exist. No array counts as an empty one."""
    sizes, cells = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
    there = np.arange(max(width, sizes.max(initial=0))) < sizes[:, None]
    values, known = np.zeros(there.shape), np.zeros(there.shape, dtype=bool)
    values[there], known[there] = cells.fill_null(0.0).to_numpy(zero_copy_only=False), cells.is_valid().to_numpy(zero_copy_only=False)
    return values, known, there


def _discounted_shares(horizons: Sequence[int], annual_rate: float):
    """From an array of PDs: the sum over q of p_q x d_q x product of (1 - p_k), k < q, up to each horizon. One running sum of a batch gives all horizons; quarters behind
    the path's end add nothing, and a missing PD leaves the horizons from it on empty. (Written out as an expression it is longer than what the JVM compiles.)"""
    n = max(horizons, default=0)
    discount = (1.0 + annual_rate) ** (-np.arange(1, n + 1) / 4)
    at = list(horizons)

    @F.arrow_udf("array<double>")
    def run(lists: pa.Array) -> pa.Array:
        values, known, there = (m[:, :n] for m in _cells(lists, n))
        alive = np.cumprod(1.0 - values, axis=1)
        start = np.zeros((len(values), 1))
        total = np.cumsum(np.hstack([start, values * np.hstack([start + 1.0, alive[:, :-1]])[:, :n] * discount]), axis=1)[:, at]
        missing = np.logical_or.accumulate(np.hstack([start > 0, there & ~known]), axis=1)[:, at]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, max(1, len(at)), dtype=np.int32)), pa.array(total.ravel(), mask=missing.ravel()))

    return run


def ecl_long(ecl: DataFrame, scenarios: Sequence[Scenario], horizons: Sequence[int] = HORIZONS, keep: Sequence[str] = ()) -> DataFrame:
    """Wide per-loan losses to (keep.., scenario, label, weight, quarters, horizon, ecl)."""
    cells = F.array(*[
        F.struct(
            F.lit(s.name).alias("scenario"), F.lit(s.label).alias("label"), F.lit(s.weight).alias("weight"), F.lit(h).alias("quarters"),
            F.lit(horizon_label(h)).alias("horizon"), F.col(f"ecl_{s.name.lower()}_{horizon_label(h)}").alias("ecl"),
        )
        for s in scenarios for h in horizons
    ])
    return ecl.select(*keep, F.inline(cells))


def _portfolio(ecl: DataFrame, scenarios: Sequence[Scenario], horizons: Sequence[int]) -> DataFrame:
    """One row: the sum of every loss column, in millions. A single pass over the wide table."""
    names = [f"ecl_{s.name.lower()}_{horizon_label(h)}" for s in scenarios for h in horizons]
    return ecl.agg(*[(F.sum(n) / 1e6).alias(n) for n in names])


def ecl_summary(ecl: DataFrame, scenarios: Sequence[Scenario], horizons: Sequence[int] = HORIZONS, digits: int = 3) -> DataFrame:
    """Portfolio loss in millions per scenario and horizon, and the probability-weighted row."""
    one = _portfolio(ecl, scenarios, horizons)
    labels = [horizon_label(h) for h in horizons]

    def total(s: Scenario, h: str) -> Column:
        return F.round(F.col(f"ecl_{s.name.lower()}_{h}"), digits)

    rows = [
        F.struct(F.lit(s.label).alias("scenario"), F.lit(s.weight).alias("weight"), *[total(s, h).alias(f"total_ecl_{h}_m") for h in labels])
        for s in scenarios
    ]
    mixed = []
    for h in labels:
        acc = F.lit(0.0)
        for s in scenarios:
            acc = acc + F.lit(s.weight) * total(s, h)
        mixed.append(F.round(acc, digits).alias(f"total_ecl_{h}_m"))
    rows.append(F.struct(F.lit("PROBABILITY-WEIGHTED").alias("scenario"), F.lit(1.0).alias("weight"), *mixed))
    return one.select(F.inline(F.array(*rows)))


def mean_paths(long: DataFrame, base: str = "Base") -> DataFrame:
    """Mean PD and mean survival per scenario and quarter, and the PD relative to the base scenario."""
    return _relative_paths(long.groupBy("scenario", "quarter").agg(F.avg("pd").alias("mean_pd"), F.avg("alive").alias("mean_alive")), base)


def mean_array_paths(loans: DataFrame, scenarios: Sequence[Scenario], base: str = "Base") -> DataFrame:
    """:func:`mean_paths` of the array columns: sums and counts of a batch are one small row for each scenario and quarter, no loan fans out."""
    names = [(s.name, f"pds_{s.name.lower()}") for s in scenarios]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in names:
                pd, known, there = _cells(batch.column(column).drop_null())
                lives, alive = np.logical_and.accumulate(known, axis=1), np.cumprod(1.0 - pd, axis=1)
                columns = known.sum(axis=0), pd.sum(axis=0, where=known), lives.sum(axis=0), alive.sum(axis=0, where=lives)
                quarters = pa.array(np.arange(1, there.shape[1] + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(quarters), pa.string()), quarters, *map(pa.array, columns)], ["scenario", "quarter", "n", "pd", "n_alive", "alive"])

    found = loans.select(*[c for _, c in names]).mapInArrow(sums, "scenario string, quarter int, n long, pd double, n_alive long, alive double")
    total = {c: F.sum(c) for c in ("n", "pd", "n_alive", "alive")}
    means = F.try_divide(total["pd"], total["n"]).alias("mean_pd"), F.try_divide(total["alive"], total["n_alive"]).alias("mean_alive")
    return _relative_paths(found.groupBy("scenario", "quarter").agg(*means), base)


def _relative_paths(m: DataFrame, base: str) -> DataFrame:
    w = Window.partitionBy("quarter")
    ref = F.max(F.when(F.col("scenario") == base, F.col("mean_pd"))).over(w)
    return m.withColumn("relative_pd", F.try_divide(F.col("mean_pd"), ref))


def horizon_growth(ecl: DataFrame, scenarios: Sequence[Scenario], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Cumulative portfolio loss per horizon and its multiple of the shortest horizon's."""
    one = _portfolio(ecl, scenarios, horizons)
    first = horizon_label(horizons[0])
    cells = [
        F.struct(
            F.lit(s.name).alias("scenario"), F.lit(h).alias("quarters"), F.col(f"ecl_{s.name.lower()}_{horizon_label(h)}").alias("ecl_m"),
            (F.col(f"ecl_{s.name.lower()}_{horizon_label(h)}") / F.greatest(F.col(f"ecl_{s.name.lower()}_{first}"), F.lit(1e-9))).alias("multiple"),
        )
        for s in scenarios for h in horizons
    ]
    return one.select(F.inline(F.array(*cells)))


def recovery_saving(ecl: DataFrame, scenarios: Sequence[Scenario], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Longest-horizon loss against the first year's loss carried on in a straight line, and the difference."""
    one = _portfolio(ecl, scenarios, horizons)
    first, last = horizons[0], horizons[-1]
    cells = []
    for s in scenarios:
        v1, vl = F.col(f"ecl_{s.name.lower()}_{horizon_label(first)}"), F.col(f"ecl_{s.name.lower()}_{horizon_label(last)}")
        straight = v1 * F.lit(last / first)
        cells.append(F.struct(F.lit(s.name).alias("scenario"), vl.alias("with_recovery_m"), straight.alias("without_m"), (straight - vl).alias("saving_m")))
    return one.select(F.inline(F.array(*cells)))


def loss_percentiles(ecl: DataFrame, scenarios: Sequence[Scenario], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Mean, median, 95th and 99th percentile of per-loan loss, in thousands, per scenario and horizon."""
    columns = {f"ecl_{s.name.lower()}_{horizon_label(h)}": [s.name, horizon_label(h)] for s in scenarios for h in horizons}
    return wide_percentiles(ecl.select(*[(F.col(c) / 1000).alias(c) for c in columns]), columns, ["scenario", "horizon"], [(1, 2), (95, 100), (99, 100)], ["p50", "p95", "p99"])


def uplift_rows(ecl: DataFrame, keys: Sequence[str], horizon: int = 4, base: str = "Base", floor: float = 1e-9, others: Sequence[str] = ("Adverse", "Severe")) -> DataFrame:
    """Per loan: loss under each other scenario divided by the base loss."""
    h = horizon_label(horizon)
    b = F.col(f"ecl_{base.lower()}_{h}")
    return ecl.select(*keys, b.alias("ecl_base"), *[
        (F.col(f"ecl_{o.lower()}_{h}") / F.when(b < floor, floor).otherwise(b)).alias(f"uplift_{o.lower()}") for o in others
    ])


def uplift_summary(uplift: DataFrame, others: Sequence[str] = ("Adverse", "Severe")) -> DataFrame:
    return wide_percentiles(uplift, {f"uplift_{o.lower()}": [o] for o in others}, ["scenario"], [(1, 2), (95, 100)], ["p50", "p95"])


def top_rows(df: DataFrame, order: str, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The n largest by ``order`` (ties by key): top-k per task, then a merge."""
    return df.orderBy(F.desc(order), *keys).limit(n)


# ------------------------------------------------------------------------------------------------ peak quarter
def scenario_pds(loans: DataFrame, peaks: DataFrame, scorer: Scorer, keep: Sequence[str], hpi_convention: str = "inverse") -> DataFrame:
    """``pd_<scenario>`` under each scenario's peak quarter: a narrow projection."""
    rows = peaks.collect()  # one row per scenario
    cols = {
        f"pd_{r['scenario'].lower()}": F.expr(scorer(macro_overrides(number_sql(r["ur"]), number_sql(r["hpi_ratio"]), None, hpi_convention)))
        for r in rows
    }
    return loans.select(*keep, *[c.alias(n) for n, c in cols.items()])


def model_scenario_pds(
    loans: DataFrame, peaks: DataFrame, predict: Callable[[DataFrame], DataFrame], keep: Sequence[str],
    hpi_convention: str = "inverse", pd_col: str = "pd",
) -> DataFrame:
    """The same from a fitted model: one narrow scoring pass per scenario, chained, without fan-out or shuffle."""
    out = loans
    names = []
    saved = {c: f"_keep_{c}" for c in ("ur_3m_lag", "hpi_change") if c in loans.columns}
    out = out.withColumns({v: F.col(k) for k, v in saved.items()})
    for r in peaks.orderBy("scenario").collect():
        name = f"pd_{r['scenario'].lower()}"
        base = out.columns
        over = override_columns(number_sql(r["ur"]), number_sql(r["hpi_ratio"]), None, hpi_convention)
        out = predict(out.withColumns(over)).select(*base, F.col(pd_col).alias(name))
        names.append(name)
    restored = [F.col(saved.get(c, c)).alias(c) for c in keep]
    return out.select(*restored, *names)


def weighted_ecl(pds: DataFrame, scenarios: Sequence[Scenario], ead: str = "orig_upb", lgd: float = LOSS_SHARE) -> DataFrame:
    """Peak-quarter loss per scenario in millions, and the probability-weighted total as the last row."""
    one = pds.agg(*[
        f for s in scenarios for f in (
            F.avg(f"pd_{s.name.lower()}").alias(f"m_{s.name}"), (F.sum(F.col(f"pd_{s.name.lower()}") * lgd * F.col(ead)) / 1e6).alias(f"e_{s.name}"),
        )
    ])
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(s.label).alias("scenario"), F.lit(s.weight).alias("weight"), (F.col(f"m_{s.name}") * 100).alias("mean_pd_pct"),
            F.col(f"e_{s.name}").alias("total_ecl_m"), (F.col(f"e_{s.name}") * s.weight).alias("weighted_ecl_m"),
        )
        for s in scenarios
    ]
    acc = F.lit(0.0)
    for s in scenarios:
        acc = acc + F.col(f"e_{s.name}") * s.weight
    rows.append(F.struct(
        F.lit("PROBABILITY-WEIGHTED TOTAL").alias("scenario"), F.lit(1.0).alias("weight"), none.alias("mean_pd_pct"), none.alias("total_ecl_m"), acc.alias("weighted_ecl_m"),
    ))
    return one.select(F.inline(F.array(*rows)))


# Unit shocks of the sensitivity table.
SHOCKS = {"ur_3m_lag": 1.0, "hpi_change": 0.10}


def sensitivity(loans: DataFrame, scorer: Scorer, shocks: Mapping[str, float] = SHOCKS) -> DataFrame:
    """Mean PD before and after a unit shock of each feature, in percent. All shocks in one pass."""
    one = loans.agg(
        F.avg(F.expr(scorer({}))).alias("_base"), *[F.avg(F.expr(scorer({f: f"{f} + {number_sql(d)}"}))).alias(f"_s_{f}") for f, d in shocks.items()]
    )
    return _sensitivity_rows(one, shocks)


def model_sensitivity(loans: DataFrame, predict: Callable[[DataFrame], DataFrame], shocks: Mapping[str, float] = SHOCKS, pd_col: str = "pd") -> DataFrame:
    """The same from a fitted model: rows meet the short shock list by a generator and are averaged map-side."""
    cells = F.array(F.struct(F.lit("_base").alias("_shock")), *[F.struct(F.lit(f"_s_{f}").alias("_shock")) for f in shocks])
    fan = loans.select("*", F.inline(cells))
    fan = fan.withColumns({f: F.when(F.col("_shock") == f"_s_{f}", F.col(f) + F.lit(float(d))).otherwise(F.col(f)) for f, d in shocks.items()})
    names = ["_base", *[f"_s_{f}" for f in shocks]]
    one = predict(fan).groupBy().agg(*[F.avg(F.when(F.col("_shock") == n, F.col(pd_col))).alias(n) for n in names])
    return _sensitivity_rows(one, shocks)


def _sensitivity_rows(one: DataFrame, shocks: Mapping[str, float]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(float(d)).alias("shock"), (F.col("_base") * 100).alias("pd_base_pct"),
            (F.col(f"_s_{f}") * 100).alias("pd_shocked_pct"), ((F.col(f"_s_{f}") - F.col("_base")) * 100).alias("delta_pd_pp"),
        )
        for f, d in shocks.items()
    ]
    return one.select(F.inline(F.array(*rows)))


def loan_loss_quantile(losses: DataFrame, loss: str, by: Sequence[str] = (), level: tuple[int, int] = (99, 100)) -> DataFrame:
    """Quantile of per-loan expected loss and the mean of losses at or above it, for each group (or over all rows)."""
    group = list(by)
    keyed = losses if group else losses.withColumn("_g", F.pmod(F.xxhash64(loss), F.lit(1)))
    keys = group or ["_g"]
    q = exact_quantiles(keyed, keys, loss, [level], "_q").select(*keys, F.col("_q")[0].alias("quantile"))
    tail = keyed.join(q, keys)
    return tail.groupBy(*keys).agg(
        F.max("quantile").alias("quantile"), F.avg(F.when(F.col(loss) >= F.col("quantile"), F.col(loss))).alias("tail_mean")
    ).select(*group, "quantile", "tail_mean")


def path_against_peak(ecl: DataFrame, pds: DataFrame, scenarios: Sequence[Scenario], horizon: int = 4, lgd: float = LOSS_SHARE) -> DataFrame:
    """Portfolio loss of the full path beside the loss of the peak quarter alone, per scenario."""
    h = horizon_label(horizon)
    a = ecl.agg(*[(F.sum(f"ecl_{s.name.lower()}_{h}") / 1e6).alias(s.name) for s in scenarios])
    b = pds.agg(*[(F.sum(F.col(f"pd_{s.name.lower()}") * lgd * F.col("orig_upb")) / 1e6).alias(s.name) for s in scenarios])

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.col(s.name).alias(name)) for s in scenarios])))

    j = long(a, "path_ecl_m").join(long(b, "peak_ecl_m"), "scenario")
    return j.withColumn("ratio", F.col("path_ecl_m") / F.greatest(F.col("peak_ecl_m"), F.lit(1e-9)))
