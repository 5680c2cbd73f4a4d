"""Train / hold-out / out-of-time splits and repeatable samples, all by a hash of the row key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scalars import HASH_BUCKETS, hash_bucket

# Out-of-time cut-off and hold-out share.
OOT_CUTOFF = dt.date(2017, 6, 1)
OOS_FRACTION = 0.30


def share_below(bucket: Column, fraction: float, buckets: int = HASH_BUCKETS) -> Column:
    return bucket < F.lit(int(round(fraction * buckets)))


def temporal_split(
    df: DataFrame,
    date: str,
    keys: Sequence[str],
    cutoff: dt.date = OOT_CUTOFF,
    oos_fraction: float = OOS_FRACTION,
    seed: int = 42,
    bucket: Column | None = None,
    buckets: int = HASH_BUCKETS,
    alias: str = "split",
) -> DataFrame:
    """Label rows ``train``, ``oos`` or ``oot``; rows without a date belong to none and are left out.

    ``keys`` identify the row. Pass the loan id alone to keep all rows of a loan on one side.
    """
    b = hash_bucket(keys, seed) if bucket is None else bucket
    inside = F.when(share_below(b, 1.0 - oos_fraction, buckets), "train").otherwise("oos")
    label = F.when(F.col(date) >= F.lit(cutoff), "oot").otherwise(inside)
    return df.filter(F.col(date).isNotNull()).withColumn(alias, label)


def split_profile(df: DataFrame, date: str, cutoff: dt.date = OOT_CUTOFF) -> DataFrame:
    """Row count, in-sample count, share of missing dates and date range, in one pass."""
    d = F.col(date)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(d < F.lit(cutoff), 1)).alias("n_in_sample"),
        F.count(F.when(d >= F.lit(cutoff), 1)).alias("n_oot"),
        F.avg(d.isNull().cast("double")).alias("missing_share"),
        F.min(d).alias("first_date"),
        F.max(d).alias("last_date"),
    )


def require_in_sample(df: DataFrame, date: str, cutoff: dt.date = OOT_CUTOFF) -> DataFrame:
    """Return ``df``, or fail with the date range and missing share when nothing lies before the cut-off."""
    p = split_profile(df, date, cutoff).first()
    if p["n_in_sample"] == 0:
        raise ValueError(
            f"no row of {date} before {cutoff}: range {p['first_date']} to {p['last_date']}, "
            f"missing share {p['missing_share'] if p['n'] else 1.0:.1%}"
        )
    return df


def split_or_empty(df: DataFrame, date: str, keys: Sequence[str], minimum: int = 5, **kw) -> DataFrame:
    """As :func:`temporal_split`, but with fewer than ``minimum`` in-sample rows none of them is held out."""
    cutoff = kw.get("cutoff", OOT_CUTOFF)
    few = split_profile(df, date, cutoff).first()["n_in_sample"] < minimum
    return temporal_split(df, date, keys, **{**kw, **({"oos_fraction": 0.0} if few else {})})


def stratified_sample(
    df: DataFrame, target: str, keys: Sequence[str], fraction: float | Mapping, seed: int = 42,
    bucket: Column | None = None, buckets: int = HASH_BUCKETS,
) -> DataFrame:
    """Same share of every class (or a share per class). No shuffle."""
    b = hash_bucket(keys, seed) if bucket is None else bucket
    if isinstance(fraction, Mapping):
        keep = F.lit(False)
        for value, share in fraction.items():
            keep = keep | ((F.col(target) == F.lit(value)) & share_below(b, share, buckets))
        return df.filter(keep)
    return df.filter(share_below(b, fraction, buckets))


def fixed_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """``n`` rows without replacement: the lowest hashes. Planned as top-k per task, then a merge."""
    h = F.xxhash64(*keys, F.lit(seed)) if order is None else order
    return df.orderBy(h, *keys).limit(n)


def halves(
    df: DataFrame, keys: Sequence[str], seed: int = 7, bucket: Column | None = None, buckets: int = HASH_BUCKETS,
    alias: str = "half",
) -> DataFrame:
    """Label rows ``cal`` or ``eval`` by a second hash; rows have no position to cut at."""
    b = hash_bucket(keys, seed) if bucket is None else bucket
    return df.withColumn(alias, F.when(share_below(b, 0.5, buckets), "cal").otherwise("eval"))
