"""Panel joins, price-index lookups and the nearest-date lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scalars import safe_ratio
from creditloom.session import small_side


def join_panel(panel: DataFrame, loans: DataFrame, keys: Sequence[str] = ("vintage", "loan_seq_num")) -> DataFrame:
    """Inner join of monthly rows to their loan. No hint: the loan side grows with the data, and AQE splits
    a loan key that holds many rows because the loan side has each key once."""
    return panel.join(loans, list(keys), "inner")


def price_lookup(index: DataFrame) -> DataFrame:
    """One index value per (zip3, year, quarter); of repeated keys the smallest value is kept, so that the
    outcome does not depend on file order."""
    return index.groupBy("zip3", "year", "quarter").agg(F.min("hpi_index").alias("hpi_index"))


def attach_price_change(
    panel: DataFrame, index: DataFrame | None, orig_date: str = "orig_date", report_date: str = "report_date"
) -> DataFrame:
    """Index at origination, index at the report date and their ratio (origination / current).

    Without an index all four columns are NULL. ``hpi_change_since_orig`` repeats the ratio for the loss table.
    """
    names = ["hpi_orig", "hpi_curr", "hpi_change", "hpi_change_since_orig"]
    if index is None:
        return panel.withColumns({n: F.lit(None).cast("double") for n in names})
    # The lookup is a file of area x quarter values: counted once, broadcast while below the row bound.
    lookup = small_side(price_lookup(index))

    def at(date: str, name: str, df: DataFrame) -> DataFrame:
        side = lookup.select(
            F.col("zip3").alias("_z"), F.col("year").alias("_y"), F.col("quarter").alias("_q"), F.col("hpi_index").alias(name)
        )
        on = (F.col("zip3") == F.col("_z")) & (F.year(date) == F.col("_y")) & (F.quarter(date) == F.col("_q"))
        return df.join(side, on, "left").drop("_z", "_y", "_q")

    out = at(report_date, "hpi_curr", at(orig_date, "hpi_orig", panel))
    ratio = safe_ratio(F.col("hpi_orig"), F.col("hpi_curr"))
    return out.withColumn("hpi_change", ratio).withColumn("hpi_change_since_orig", ratio)


def nearest_by_day(series: DataFrame, date: str, value: str, tolerance_days: int) -> DataFrame:
    """Turn a dated series into a lookup with one row per calendar day: the nearest observation within the
    tolerance, the earlier one at equal distance. Each observation answers 2 x tolerance + 1 days."""
    reach = F.sequence(F.lit(-tolerance_days), F.lit(tolerance_days))
    near = series.filter(F.col(value).isNotNull()).select(
        F.col(date).alias("_obs"), F.col(value).alias("_val"), F.explode(reach).alias("_shift")
    )
    rank = F.struct(F.abs("_shift"), F.col("_obs"), F.col("_val"))
    return near.groupBy(F.date_add("_obs", F.col("_shift")).alias("_day")).agg(F.min_by("_val", rank).alias(value))


def attach_rate_lag(
    panel: DataFrame,
    series: DataFrame | None,
    report_date: str = "report_date",
    lag_months: int = 3,
    tolerance_days: int = 45,
    alias: str = "ur_3m_lag",
) -> DataFrame:
    """Nearest observation to ``report_date - lag`` within the tolerance, else NULL.

    The nearest-date search is done once per calendar day on the short series, so the panel needs a plain
    equi-join: no range join, no sort and no shuffle of the panel while the lookup is below the row bound.
    """
    if series is None:
        return panel.withColumn(alias, F.lit(None).cast("double"))
    lookup = small_side(nearest_by_day(series, "date", "unemployment_rate", tolerance_days))
    lookup = lookup.withColumnRenamed("unemployment_rate", alias)
    return panel.join(lookup, F.add_months(report_date, -lag_months) == F.col("_day"), "left").drop("_day")


def attach_balance(predictions: DataFrame, balances: DataFrame, key: str = "loan_seq_num", balance: str = "orig_upb") -> DataFrame:
    """Inner join of predictions to balances by loan."""
    return predictions.join(balances.select(key, balance), key, "inner")
