"""Global-order operators (running totals, ranks, exact quantiles) without a one-task sort.

Everything starts from a *tally*: rows reduced to one row per distinct key by a map-side combined
``groupBy``, so a value held by a third of all rows is one row after the first shuffle. Running totals
are then taken inside order buckets and shifted by the totals of the buckets before them:

    tally -> bucket limits (sketch, B per group) -> bucket totals (B rows per group) -> offsets
          -> window inside (group, bucket)

The limits come from a sketch, but they only decide which bucket a key falls into; the totals are exact.
The limits query also computes the group totals, so that all three reads of the tally ask for the same
columns and Spark reuses one exchange instead of scanning the input again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.scalars import right_closed_bin
from creditloom.operators.ranks import column_quantiles
from creditloom.session import held_side

# Limit tables are broadcast: MAX_GROUPS x MAX_BUCKETS doubles = 40 MB at the most. More groups raise an error, unless
# the caller says that there are many: then limits join by an ordinary shuffle on the group.
MAX_GROUPS = 5_000
MAX_BUCKETS = 1_024


def order_buckets(df: DataFrame) -> int:
    """Buckets per group: as many as shuffle partitions, between 32 and the maximum, so a cluster gets enough tasks."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32, min(MAX_BUCKETS, wanted))


def pinned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filter that is always true but mentions ``columns``.

    A tally is read several times by one query. Column pruning would give each read its own column list,
    hence its own shuffle and its own scan of the input; with the same columns Spark reuses the first shuffle.
    """
    return df.filter(F.size(F.array(*[F.col(c).cast("double") for c in columns])) > 0)


def tally(df: DataFrame, by: Sequence[str], key: str, sums: Mapping[str, Column]) -> DataFrame:
    """One row per (by, key) with the given sums; rows without a key are left out."""
    grouped = df.filter(F.col(key).isNotNull()).groupBy(*by, key)
    return pinned(grouped.agg(*[F.sum(expr).alias(name) for name, expr in sums.items()]), list(sums))


def running_totals(
    tallied: DataFrame, by: Sequence[str], key: str, sums: Sequence[str], buckets: int | None = None, many_groups: bool = False
) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller keys) and ``<s>_total`` for every column in ``sums``.

    ``tallied`` has one row per (by, key). ``by`` names few groups (models, splits, features); with ``many_groups`` there may be
    any number of them, and none should hold most keys. Keys per group are unlimited.
    """
    if by:
        base, group = tallied, list(by)
    else:
        # One group, made from the key itself so that the joins below stay equi-joins.
        base, group = tallied.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(1))), ["_g"]
    buckets = buckets or order_buckets(tallied)
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    base = pinned(base, sums)
    limits = base.groupBy(*group).agg(
        F.percentile_approx(key, probs, 4 * buckets).alias("_limits"),
        F.count(F.lit(1)).alias("_n_keys"),
        *[F.sum(s).alias(f"{s}_total") for s in sums],
    )
    n_groups = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    limits = pinned(limits, ["_n_keys", *[f"{s}_total" for s in sums]]).withColumn("_groups", F.lit(0) if many_groups else n_groups)
    checked = F.when(F.col("_groups") <= MAX_GROUPS, F.col("_limits")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_GROUPS} groups: pass many_groups=True"))
    )
    side = (lambda df: df) if many_groups else F.broadcast
    # Two levels of sorted limits, so that a key is compared with about 2 * sqrt(B) of them.
    step = max(2, math.isqrt(buckets))
    limits = limits.withColumn("_limits", checked).select(
        *group, "_n_keys", *[f"{s}_total" for s in sums],
        F.transform(F.sequence(F.lit(1), F.lit((buckets - 1) // step)), lambda i: F.get("_limits", i * step - 1)).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.lit((buckets - 1) // step)), lambda i: F.slice("_limits", i * step + 1, F.lit(step))).alias("_fine"),
    )
    block = F.size(F.filter("_coarse", lambda e: e < F.col(key)))
    bucket = block * step + F.size(F.filter(F.get("_fine", block), lambda e: e < F.col(key)))
    placed = (
        base.join(side(limits), group).withColumn("_bucket", F.coalesce(bucket, F.lit(0))).drop("_coarse", "_fine")
    )
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group, "_bucket")
        .agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
        .select(*group, "_bucket", *[F.sum(f"_sum_{s}").over(ahead).alias(f"_off_{s}") for s in sums])
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    # At most MAX_GROUPS x BUCKETS rows, so the shuffle below is the window's own and not a join's.
    out = placed.join(side(offsets), [*group, "_bucket"])
    for s in sums:
        before = F.coalesce(F.col(f"_off_{s}"), zero) + F.coalesce(F.sum(s).over(inside), zero)
        out = out.withColumn(f"{s}_before", before)
    drop = ["_bucket", *[f"_off_{s}" for s in sums]] + ([] if by else ["_g"])
    return out.drop(*drop)


def fractions_of(probs: Sequence[float | Fraction | tuple[int, int]]) -> list[Fraction]:
    out = []
    for p in probs:
        if isinstance(p, tuple):
            out.append(Fraction(*p))
        else:
            out.append(Fraction(p).limit_denominator(1_000_000))
    return out


def even_probs(k: int) -> list[Fraction]:
    """0, 1/k, .., 1 for k equal-frequency bins."""
    return [Fraction(i, k) for i in range(k + 1)]


def _rank(n: Column, p: Fraction) -> tuple[Column, Column]:
    """Whole part of p * (n - 1) and what is left over the denominator, in integers."""
    scaled = (n - 1) * F.lit(p.numerator)
    rest = F.pmod(scaled, F.lit(p.denominator))
    return ((scaled - rest) / F.lit(p.denominator)).cast("long"), rest


def quantiles_of_tally(
    tallied: DataFrame,
    by: Sequence[str],
    key: str,
    count: str,
    probs: Sequence,
    alias: str = "edges",
    many_groups: bool = False,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, ``array<double>`` in probability order.

    Ranks are computed in integers, so a probability such as 1/15 cannot miss a row by rounding. Only the
    (at most two per probability) rows that hold a wanted rank are gathered. Also returns ``n`` and ``n_keys``.
    """
    wanted = fractions_of(probs)
    run = running_totals(tallied, by, key, [count], many_groups=many_groups)
    before, held = F.col(f"{count}_before"), F.col(count)
    ranks = F.array(*[r for p in wanted for r in (_rank(F.col(f"{count}_total"), p)[0], _rank(F.col(f"{count}_total"), p)[0] + 1)])
    holders = run.filter(F.exists(ranks, lambda r: (r >= before) & (r < before + held)))
    picked = holders.groupBy(*by).agg(
        F.first(f"{count}_total").alias("n"),
        F.first("_n_keys").alias("n_keys"),
        F.collect_list(F.struct(before.alias("b"), held.alias("c"), F.col(key).cast("double").alias("v"))).alias("_held"),
    )

    def value_at(rank: Column) -> Column:
        return F.filter("_held", lambda h: (rank >= h["b"]) & (rank < h["b"] + h["c"]))[0]["v"]

    edges = []
    for p in wanted:
        rank, rest = _rank(F.col("n"), p)
        at = value_at(rank)
        step = rest / F.lit(float(p.denominator))
        edges.append(F.when(rest == 0, at).otherwise(at + (value_at(rank + 1) - at) * step))
    return picked.select(*by, "n", "n_keys", F.array(*edges).alias(alias))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence, alias: str = "edges", many_groups: bool = False) -> DataFrame:
    """Quantiles of a raw column (see :func:`quantiles_of_tally`)."""
    counted = tally(df, by, value, {"_n": F.lit(1)})
    return quantiles_of_tally(counted, by, value, "_n", probs, alias, many_groups)


def equal_frequency_bins(
    df: DataFrame, by: Sequence[str], value: str, k: int, alias: str = "bin_no"
) -> DataFrame:
    """Attach the right-closed equal-frequency bin of ``value`` inside each group; duplicate edges merge.

    ``by`` columns must not be NULL. Without ``by`` the whole frame is one group.
    """
    if by:
        edges = exact_quantiles(df, by, value, even_probs(k), "_edges").select(*by, F.array_distinct("_edges").alias("_edges"))
        joined = df.join(held_side(edges), list(by), "left")
    else:
        narrow = df.select(value).persist()
        try:
            found = column_quantiles(narrow, [value], even_probs(k))
        finally:
            narrow.unpersist()
        edges = sorted(set(found.get(value, [])))
        return df.withColumn(alias, right_closed_bin(F.col(value).cast("double"), F.array(*[F.lit(e) for e in edges])) if edges else F.lit(None).cast("int"))
    return joined.withColumn(alias, right_closed_bin(F.col(value), F.col("_edges"))).drop("_edges")


def ecdf(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution function at every distinct value."""
    run = running_totals(tally(df, by, value, {"n": F.lit(1)}), by, value, ["n"])
    return run.select(*by, value, "n", ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("ecdf"))


def rank_share(df: DataFrame, by: Sequence[str], value: str, alias: str = "rank_share") -> DataFrame:
    """Attach to each row its rank divided by n, in [0, 1); equal values share the lowest rank.

    Keys go back to the rows by an equi-join on (by, value); AQE splits a hot value on the row side,
    because the other side holds each value once.
    """
    run = running_totals(tally(df, by, value, {"n": F.lit(1)}), by, value, ["n"])
    ranks = run.select(*by, value, (F.col("n_before") / F.col("n_total")).alias(alias))
    return df.join(ranks, [*by, value], "left")


def concentration(df: DataFrame, by: Sequence[str], order: str, amount: str, shares: Sequence) -> DataFrame:
    """Share of the total ``amount`` held by the top share of rows when rows are ordered by ``order``, largest first.

    Inside a run of equal ``order`` values the amount is spread evenly, so the answer does not depend on
    row order. One output row per group and requested share.
    """
    points = fractions_of(shares)
    t = tally(
        df.withColumn("_neg", -F.col(order).cast("double")),
        by, "_neg", {"n": F.lit(1), "amt": F.coalesce(F.col(amount), F.lit(0.0))},
    )
    run = running_totals(t, by, "_neg", ["n", "amt"])
    wants = F.array(*[
        F.struct(
            F.lit(float(p)).alias("share"),
            _rank(F.col("n_total") + 1, p)[0].alias("rows"),  # floor(n * share)
        )
        for p in points
    ])
    hits = run.select(
        *by, "n", "n_before", "amt", "amt_before", "amt_total",
        F.explode(F.filter(wants, lambda w: (w["rows"] > F.col("n_before")) & (w["rows"] <= F.col("n_before") + F.col("n")))).alias("w"),
    )
    part = (F.col("w.rows") - F.col("n_before")) / F.col("n")
    return hits.select(
        *by,
        F.col("w.share").alias("row_share"),
        F.col("w.rows").alias("n_rows"),
        F.try_divide(F.col("amt_before") + F.col("amt") * part, F.col("amt_total")).alias("amount_share"),
    )
