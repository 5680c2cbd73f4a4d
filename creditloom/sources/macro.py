"""Macro series: price index and unemployment rate files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.scalars import number, zfill
from creditloom.sources.tables import path_exists

# Accepted file names of the unemployment series.
RATE_FILES = ("unemployment_rate.csv", "unemployment.csv")


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text, names trimmed and in lower case."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.strip().lower() for c in raw.columns])


def read_price_index(spark: SparkSession, path: str) -> DataFrame | None:
    """(zip3, year, quarter, hpi_index, date), the date being the first day of the quarter's last month.

    ``None`` when the file is missing; features that need it are then NULL.
    """
    if not path_exists(spark, path):
        return None
    t = _text_csv(spark, path)
    year, quarter = F.trim("year").try_cast("int"), F.trim("quarter").try_cast("int")
    return t.select(
        zfill(F.trim("zip3"), 3).alias("zip3"), year.alias("year"), quarter.alias("quarter"), number(F.col("hpi_index")).alias("hpi_index"),
        F.make_date(year, quarter * 3, F.lit(1)).alias("date"),
    )


def rate_column(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if "rate" in c or "value" in c), None)


def read_unemployment(spark: SparkSession, folder: str, names: Sequence[str] = RATE_FILES) -> DataFrame | None:
    """(date, unemployment_rate) from the first file that exists, with a ``date`` column or ``year`` + ``period``.

    ``None`` when no file exists or the layout is unknown. Rows without a date or a number are left out.
    """
    path = next((f"{folder}/{n}" for n in names if path_exists(spark, f"{folder}/{n}")), None)
    if path is None:
        return None
    t = _text_csv(spark, path)
    rate = rate_column(t.columns)
    if rate is None:
        return None
    if "date" in t.columns:
        date = F.to_date(F.try_to_timestamp(F.trim("date")))
    elif {"year", "period"} <= set(t.columns):
        month = F.regexp_replace(F.trim("period"), "M", "").try_cast("int")
        # annual averages (M13) have no month
        date = F.when(month.between(1, 12), F.make_date(F.trim("year").try_cast("int"), month, F.lit(1)))
    else:
        return None
    return t.select(date.alias("date"), number(F.col(rate)).alias("unemployment_rate")).dropna()


def latest_level(series: DataFrame, date: str = "date", value: str = "unemployment_rate") -> DataFrame:
    """One row: the value of the last dated observation that has one."""
    known = series.filter(F.col(value).isNotNull())
    return known.agg(F.max_by(value, date).alias("rate"), F.max(date).alias("date"))
