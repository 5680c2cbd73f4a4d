"""Population stability index between a reference sample and other samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scalars import case_below
from creditloom.operators.evidence import FLOOR, fit_bins
from creditloom.session import written


def psi_flag(psi: Column) -> Column:
    # Published stability bands.
    return case_below(psi, [(0.10, "Stable"), (0.25, "Investigate")], "Major shift", missing="N/A")


def stability_bins(
    df: DataFrame, features: Sequence[str], sample: str, reference: str, n_bins: int = 10
) -> DataFrame:
    """Shares per feature and bin of every sample next to the reference's share.

    ``sample`` names the column that tells samples apart; ``reference`` is the value of the reference.
    Bins come from the reference only. Numeric rows outside the reference range fall out of the share's
    base. For categories the base is every row of the sample, so unseen categories lower the seen shares.
    All samples are counted in one table of bins, which is written; ``df`` is worked out once.
    """
    narrow = df.select(sample, *features).persist()
    try:
        plan = fit_bins(narrow.filter(F.col(sample) == reference), features, n_bins)
        long = narrow.select(sample, F.inline(plan.cells())).filter(F.col("bin_no").isNotNull() | F.col("label").isNotNull())
        bins = written(long.groupBy("feature", "bin_no", "label", sample).agg(F.count(F.lit(1)).alias("n")), "bins")
    finally:
        narrow.unpersist()
    totals = bins.groupBy("feature", sample).agg(F.sum("n").alias("_all"))
    shares = bins.join(totals, ["feature", sample]).withColumn("share", F.col("n") / F.col("_all")).drop("_all")
    ref = shares.filter(F.col(sample) == reference).select("feature", "bin_no", "label", F.col("share").alias("p"))
    # Every other sample must meet every reference bin, also the bins it has no row in.
    samples = totals.filter(F.col(sample) != reference).select("feature", sample)
    grid = ref.join(samples, "feature")
    mine = shares.filter(F.col(sample) != reference).select(
        F.col("feature").alias("_f"), F.col("bin_no").alias("_b"), F.col("label").alias("_l"), F.col(sample).alias("_s"),
        F.col("share").alias("_share"),
    )
    same = (
        (F.col("feature") == F.col("_f")) & F.col("bin_no").eqNullSafe(F.col("_b"))
        & F.col("label").eqNullSafe(F.col("_l")) & (F.col(sample) == F.col("_s"))
    )
    floor = F.lit(FLOOR)
    return (
        grid.join(mine, same, "left")
        .withColumn("p", F.when(F.col("p") < floor, floor).otherwise(F.col("p")))
        .withColumn("q", F.when(F.coalesce(F.col("_share"), floor) < floor, floor).otherwise(F.coalesce(F.col("_share"), floor)))
        .select("feature", "bin_no", "label", sample, "p", "q")
    )


def population_stability(
    df: DataFrame, features: Sequence[str], sample: str, reference: str, n_bins: int = 10
) -> DataFrame:
    """(feature, sample, psi, flag)."""
    part = (F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))
    return (
        stability_bins(df, features, sample, reference, n_bins)
        .groupBy("feature", sample)
        .agg(F.round(F.sum(part), 6).alias("psi"))
        .withColumn("flag", psi_flag(F.col("psi")))
    )


def stability_summary(
    df: DataFrame, features: Sequence[str], sample: str, reference: str, labels: dict[str, str], n_bins: int = 10
) -> DataFrame:
    """One row per feature, columns ``psi_<label>`` and ``flag_<label>`` per sample, joined as full outer."""
    long = population_stability(df, features, sample, reference, n_bins)
    out = None
    for value, label in labels.items():
        one = long.filter(F.col(sample) == value).select(
            "feature", F.col("psi").alias(f"psi_{label}"), F.col("flag").alias(f"flag_{label}")
        )
        out = one if out is None else out.join(one, "feature", "full")
    return out
