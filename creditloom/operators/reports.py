"""Report tables: counts, rates, mixes, histograms, percentiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.scalars import case_below, code_label
from creditloom.operators.labels import DEFAULT_CODES, DISPOSITION_LABELS, WIDE_DEFAULT_CODES, is_default
from creditloom.operators.metrics import discrimination
from creditloom.operators.ordered import equal_frequency_bins, exact_quantiles
from creditloom.operators.ranks import column_quantiles
from creditloom.session import held_side, written

# Display labels.
CHANNEL_LABELS = {"R": "Retail", "B": "Broker", "C": "Correspondent", "T": "TPO Not Specified", "9": "Not Available"}
OCCUPANCY_LABELS = {"P": "Primary", "I": "Investor", "S": "Second Home"}
FEATURE_LABELS = {
    "delinquency_indicator": "Current Delinquency",
    "hpi_change": "HPI Change (Orig/Curr)",
    "occupancy_status": "Occupancy Type",
    "orig_interest_rate": "Note Rate (%)",
    "orig_cltv": "Combined LTV (%)",
    "num_borrowers": "Number of Borrowers",
    "credit_score": "FICO Score",
    "property_type": "Property Type",
    "loan_age": "Loan Age (Months)",
    "orig_dti": "Debt-to-Income (%)",
    "orig_upb": "Original UPB ($)",
    "ur_3m_lag": "Unemployment Rate (3m lag)",
}


def disposition_counts(panel: DataFrame, codes: Iterable[str] = DEFAULT_CODES) -> DataFrame:
    code = F.col("zero_balance_code")
    return (
        panel.filter(code.isNotNull()).groupBy("zero_balance_code").agg(F.count(F.lit(1)).alias("n"))
        .select("zero_balance_code", code_label(code, DISPOSITION_LABELS, "other").alias("label"), is_default(codes).cast("int").alias("is_default"), "n")
    )


def describe(df: DataFrame, by: Sequence[str], column: str, exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles, max per group. ``exact=False`` takes quartiles from a sketch in the same pass."""
    c = F.col(column).cast("double")
    base = df.filter(c.isNotNull() & ~F.isnan(c))
    measures = [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
    ]
    if not exact:
        q = F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)
        return base.groupBy(*by).agg(*measures, q.alias("q")).select(
            *by, "n", "mean", "std", "min", *[F.col("q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))], "max"
        )
    if not by:
        base, by_ = base.withColumn("_g", F.pmod(F.xxhash64(column), F.lit(1))), ["_g"]
    else:
        by_ = list(by)
    quart = exact_quantiles(base, by_, column, [(1, 4), (1, 2), (3, 4)], "q").select(*by_, "q")
    out = base.groupBy(*by_).agg(*measures).join(quart, by_)
    return out.select(*by, "n", "mean", "std", "min", *[F.col("q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))], "max")


def percentiles(df: DataFrame, by: Sequence[str], column: str, points: Sequence[tuple[int, int]], names: Sequence[str]) -> DataFrame:
    """n, mean and exact percentiles per group."""
    c = F.col(column)
    q = exact_quantiles(df, by, column, points, "q").select(*by, "q")
    agg = df.filter(c.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"))
    return agg.join(q, list(by)).select(*by, "n", "mean", *[F.col("q")[i].alias(nm) for i, nm in enumerate(names)])


def wide_percentiles(df: DataFrame, columns: Mapping[str, Sequence[str]], by: Sequence[str], points: Sequence[tuple[int, int]], names: Sequence[str]) -> DataFrame:
    """:func:`percentiles` of whole columns, a row for each that has values, with its labels in the columns ``by``.

    Rows are written once and stay wide; ranks are found by intervals, so no value is shuffled and no row fans out.
    """
    held = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "percentiles")
    row = held.agg(*[F.count(c) for c in columns], *[F.avg(c) for c in columns], *[F.count(F.when(F.isnan(c), 1)) for c in columns]).first()
    k = len(columns)
    plain = [c for i, c in enumerate(columns) if row[i] and not row[2 * k + i]]
    found = column_quantiles(held, plain, points) if plain else {}
    out = []
    for i, (c, labels) in enumerate(columns.items()):
        if row[i]:
            # not-a-number is the largest value there
            values = found[c] if c in found else exact_quantiles(held, [], c, points, "q").first()["q"]
            out.append((*labels, row[i], row[k + i], *values))
    fields = [*[f"{b} string" for b in by], "n long", "mean double", *[f"{nm} double" for nm in names]]
    return df.sparkSession.createDataFrame(out, ", ".join(fields))


def monthly_rates(panel: DataFrame, by: Sequence[str] = ("vintage",), codes: Iterable[str] = WIDE_DEFAULT_CODES) -> DataFrame:
    """Rows, defaults, 90-days-past-due rows and their rates in percent per group and month."""
    late = F.coalesce(F.col("delinquency_status").try_cast("int") >= 3, F.lit(False))
    agg = panel.filter(F.col("report_date").isNotNull()).groupBy(*by, F.col("report_date").alias("period")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(is_default(codes).cast("int")).alias("defaults"),
        F.sum(late.cast("int")).alias("dpd90"),
    )
    return agg.withColumn("default_rate", F.col("defaults") / F.col("total") * 100).withColumn("dpd90_rate", F.col("dpd90") / F.col("total") * 100)


def cumulative_default_by_age(
    panel: DataFrame, codes: Iterable[str] = WIDE_DEFAULT_CODES, max_age: int = 60, step: int = 6
) -> DataFrame:
    """Share of a vintage's loans in default by each age, in percent (long form).

    One row per loan first (smallest age with a default), then one average per age: no repeated distinct counts.
    """
    per_loan = panel.groupBy("vintage", "loan_seq_num").agg(F.min(F.when(is_default(codes), F.col("loan_age"))).alias("_age"))
    ages = list(range(step, max_age + 1, step))
    wide = per_loan.groupBy("vintage").agg(
        F.count(F.lit(1)).alias("n_loans"),
        *[(F.avg(F.coalesce(F.col("_age") <= a, F.lit(False)).cast("double")) * 100).alias(f"a{a}") for a in ages],
    )
    cells = F.array(*[F.struct(F.lit(a).alias("loan_age"), F.col(f"a{a}").alias("cum_default_pct")) for a in ages])
    return wide.select("vintage", "n_loans", F.inline(cells))


def mix(df: DataFrame, by: str, category: str, values: Sequence[str] | None = None) -> DataFrame:
    """Share of each category inside a group, in percent, one column per category."""
    counts = df.groupBy(by).pivot(category, list(values) if values else None).count().fillna(0)
    cols = [c for c in counts.columns if c != by]
    total = sum((F.col(f"`{c}`") for c in cols[1:]), F.col(f"`{cols[0]}`"))
    return counts.select(by, *[(F.col(f"`{c}`") / total * 100).alias(c) for c in cols])


def rate_by_band(df: DataFrame, column: str, target: str, k: int = 10) -> DataFrame:
    """Target rate in percent per equal-frequency band of a column."""
    banded = equal_frequency_bins(df.filter(F.col(column).isNotNull()), [], column, k, "band")
    return banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(target).cast("double")) * 100).alias("rate_pct")
    )


def rate_by_quarter(df: DataFrame, date: str, target: str) -> DataFrame:
    return df.groupBy(F.trunc(date, "quarter").alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(target).cast("double")) * 100).alias("rate_pct")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    n = F.count(F.lit(1))
    out = df.groupBy(target).agg(n.alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def histogram(df: DataFrame, by: Sequence[str], value: Column | str, lo: float, hi: float, bins: int) -> DataFrame:
    """Density histogram over [lo, hi]: bins are closed on the left, the last one on both sides. Empty bins are absent."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    slot = F.width_bucket(v, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    slot = F.when(v == hi, F.lit(bins)).otherwise(slot).cast("int")
    width = (hi - lo) / bins
    counts = (
        df.select(*by, v.alias("_v"), slot.alias("bin_no")).filter((F.col("_v") >= lo) & (F.col("_v") <= hi))
        .groupBy(*by, "bin_no").agg(F.count(F.lit(1)).alias("n"))
    )
    group = [F.col(b) for b in by] or [F.lit(0)]
    total = F.sum("n").over(Window.partitionBy(*group))
    return counts.select(
        *by, "bin_no", (F.lit(float(lo)) + (F.col("bin_no") - 1) * width).alias("lo"), (F.lit(float(lo)) + F.col("bin_no") * width).alias("hi"),
        "n", (F.col("n") / (total * F.lit(width))).alias("density"),
    )


def score_separation(df: DataFrame, by: Sequence[str], score: str, target: str, bins: int = 50) -> DataFrame:
    """Score histogram of goods and bads with the group's KS on every row."""
    h = histogram(df, [*by, target], score, 0.0, 1.0, bins)
    ks = discrimination(df, by, score, target).select(*by, "ks")
    return h.join(held_side(ks), list(by))


def horizon_summary(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Mean, median, 95th and 99th percentile of several probability columns, one row per column."""
    return wide_percentiles(df, {c: [label] for c, label in columns.items()}, ["horizon"], [(1, 2), (95, 100), (99, 100)], ["p50", "p95", "p99"])


def vintage_era(year: Column) -> Column:
    # Era limits and labels.
    return case_below(
        year,
        [(2004, "Pre-crisis (2000-2003)"), (2008, "Crisis (2004-2007)"), (2012, "Post-crisis (2008-2011)")],
        "Recovery (2012+)", missing="Unknown",
    )
