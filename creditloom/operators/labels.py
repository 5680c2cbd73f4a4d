"""Default and loss labels, complete-case filters, first-default lookup."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scalars import clip, safe_ratio

# Disposition codes.
DEFAULT_CODES = ("02", "03", "06", "09", "15")
WIDE_DEFAULT_CODES = ("02", "03", "06", "09", "15", "16", "96")
DISPOSITION_LABELS = {
    "01": "prepayment",
    "02": "3rd-party sale",
    "03": "short sale",
    "06": "repurchase",
    "09": "REO",
    "15": "note sale",
}


def is_default(codes: Iterable[str] = DEFAULT_CODES, column: str = "zero_balance_code") -> Column:
    return F.coalesce(F.col(column).isin(*codes), F.lit(False))


def first_default(panel: DataFrame, keys: Sequence[str] = ("loan_seq_num",), codes: Iterable[str] = DEFAULT_CODES) -> DataFrame:
    """Earliest default month per loan. The code filter reaches the scan and the minimum is combined before
    the shuffle, so only loans that default are shuffled."""
    return panel.filter(is_default(codes)).groupBy(*keys).agg(F.min("report_date").alias("default_date"))


def default_rows(
    panel: DataFrame,
    keys: Sequence[str] = ("loan_seq_num",),
    codes: Iterable[str] = DEFAULT_CODES,
    horizon_days: int = 365,
) -> DataFrame:
    """Rows before the loan's first default, with ``default_date``, ``days_to_default`` and ``default_12m``.

    Rows of loans that never default stay. A default row without a date gives no default date; the row
    itself is left out. Defaulted loans are few, so AQE normally broadcasts the lookup; if it is large the
    join is shuffled and a heavy loan key is split.
    """
    dated = panel.join(first_default(panel, keys, codes), list(keys), "left")
    days = F.datediff("default_date", "report_date")
    return (
        dated.filter(F.col("default_date").isNull() | (F.col("report_date") < F.col("default_date")))
        .filter(~is_default(codes))
        .withColumn("days_to_default", days)
        .withColumn("default_12m", F.coalesce(F.col("days_to_default").between(1, horizon_days), F.lit(False)).cast("int"))
    )


def last_known(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per key, the last non-missing value of every column in ``order``; columns may come from different rows.

    A combined aggregate, no sort of the rows. Rows of the same ``order`` value are settled by the larger value.
    """
    picks = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).alias(c) for c in columns
    ]
    return df.groupBy(*keys).agg(F.max(order).alias(order), *picks)


def loss_rows(
    panel: DataFrame,
    keys: Sequence[str] = ("loan_seq_num",),
    codes: Iterable[str] = DEFAULT_CODES,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """One row per defaulted loan with ``lgd_raw`` = loss / removal balance and ``lgd`` limited to [0, 1].

    The removal balance falls back to the current balance; a missing loss counts as 0; loans without a
    positive balance are left out.
    """
    columns = list(carry) if carry is not None else [c for c in panel.columns if c not in (*keys, "report_date")]
    rows = last_known(panel.filter(is_default(codes)), keys, "report_date", columns)
    upb = F.coalesce(F.col("zero_balance_removal_upb"), F.col("current_upb"))
    raw = safe_ratio(F.coalesce(F.col("actual_loss"), F.lit(0.0)), upb)
    return (
        rows.withColumn("lgd_raw", raw).withColumn("lgd", clip(F.col("lgd_raw"), 0.0, 1.0)).filter(F.col("lgd").isNotNull())
    )


def complete_cases(df: DataFrame, required: Sequence[str], within: str | None = None) -> DataFrame:
    """Drop rows missing a required column, ignoring columns that hold no value at all.

    With ``within`` (normally the vintage) that is decided per part: one aggregate of a few rows per part,
    joined back. The parts are vintages, so the broadcast side is bounded by the number of years.
    """
    if within is None:
        live = usable_columns(df, required)
        return df.dropna(subset=live) if live else df
    counts = df.groupBy(within).agg(*[F.count(c).alias(f"_has_{c}") for c in required])
    keep = None
    for c in required:
        ok = F.col(c).isNotNull() | (F.col(f"_has_{c}") == 0)
        keep = ok if keep is None else keep & ok
    counts = counts.withColumnRenamed(within, "_within")
    return df.join(counts, F.col(within).eqNullSafe(F.col("_within"))).filter(keep).drop("_within", *[f"_has_{c}" for c in required])


def usable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold at least one value (one aggregate, one row to the driver)."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return []
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in present]).first()
    return [c for c in present if row[c]]
