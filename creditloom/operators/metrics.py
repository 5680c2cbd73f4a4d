"""Discrimination, calibration and error metrics, computed from one row per distinct score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.scalars import right_closed_bin
from creditloom.functions.tails import chi2_tail_column
from creditloom.operators.ordered import even_probs, quantiles_of_tally, running_totals, tally


def score_tally(df: DataFrame, by: Sequence[str], score: str, target: str) -> DataFrame:
    """One row per (by, score): n, pos, neg."""
    y = F.col(target)
    return tally(
        df.withColumn(score, F.col(score).cast("double")), by, score,
        {"n": F.lit(1), "pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")},
    )


def _rank_columns(tallied: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return running_totals(tallied, by, score, ["n", "pos", "neg"])


def discrimination(df: DataFrame, by: Sequence[str], score: str, target: str) -> DataFrame:
    """n, n_defaults, auroc, ks, gini per group. AUROC counts ties half. NULL where one class is absent."""
    return discrimination_of_tally(score_tally(df, by, score, target), by, score)


def discrimination_of_tally(tallied: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """:func:`discrimination` from the rows of :func:`score_tally`."""
    r = _rank_columns(tallied, by, score)
    d = [F.col(c).cast("double") for c in ("pos", "neg_before", "neg", "pos_before")]
    wins = F.sum(d[0] * (d[1] + d[2] / 2.0))
    gap = F.max(F.abs(
        F.try_divide(d[3] + d[0], F.col("pos_total").cast("double")) - F.try_divide(d[1] + d[2], F.col("neg_total").cast("double"))
    ))
    both = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    out = r.groupBy(*by).agg(
        F.max("n_total").alias("n"),
        F.max("pos_total").alias("n_defaults"),
        F.when(both, wins / pairs).alias("auroc"),
        F.when(both, gap).alias("ks"),
    )
    return out.withColumn("gini", 2 * F.col("auroc") - 1)


def compare_models(scores: Mapping[str, DataFrame], target: str = "default_12m", score: str = "score", split: str = "split") -> DataFrame:
    """Discrimination of several models (name -> scored rows) side by side: one row for each model and split, the best of a split first."""
    both = reduce(DataFrame.unionByName, [df.select(split, target, F.col(score).alias("score")).withColumn("model", F.lit(name)) for name, df in scores.items()])
    return discrimination(both, ["model", split], "score", target).orderBy(split, F.desc("auroc"), "model")


def roc_points(df: DataFrame, by: Sequence[str], score: str, target: str, steps: int = 100) -> DataFrame:
    """Points of the ROC curve, highest score first, thinned to the last point of each of ``steps`` FPR cells. The curve starts at (0, 0), in cell -1."""
    r = _rank_columns(score_tally(df, by, score, target), by, score)
    fpr = F.try_divide(F.col("neg_total") - F.col("neg_before"), F.col("neg_total"))
    tpr = F.try_divide(F.col("pos_total") - F.col("pos_before"), F.col("pos_total"))
    pts = r.select(*by, F.col(score).alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    cell = F.ceil(F.col("fpr") * steps).cast("int")
    best = F.max_by(F.struct("threshold", "fpr", "tpr"), F.struct("tpr", "fpr", "threshold"))
    thinned = (
        pts.filter(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
        .groupBy(*by, cell.alias("cell")).agg(best.alias("p")).select(*by, "cell", "p.threshold", "p.fpr", "p.tpr")
    )
    # the cell with the last point of every curve, (1, 1), is there once for each group
    first = thinned.filter(F.col("cell") == steps).select(*by, F.lit(-1).alias("cell"), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return first.unionByName(thinned)


def score_bands(df: DataFrame, by: Sequence[str], score: str, target: str, k: int = 10) -> DataFrame:
    """Equal-frequency score bands from the score tally: n, pos, sum of scores, min and max per band."""
    t = score_tally(df, by, score, target)
    group = list(by)
    if not by:
        t, group = t.withColumn("_g", F.pmod(F.xxhash64(score), F.lit(1))), ["_g"]
    edges = quantiles_of_tally(t, group, score, "n", even_probs(k)).select(*group, F.array_distinct("edges").alias("_e"))
    s = F.col(score)
    return (
        t.join(F.broadcast(edges), group)
        .withColumn("band", right_closed_bin(s, F.col("_e")) - 1)
        .groupBy(*group, "band")
        .agg(
            F.min(s).alias("score_min"), F.max(s).alias("score_max"),
            F.sum("n").alias("n"), F.sum("pos").alias("n_default"), F.sum(s * F.col("n")).alias("score_sum"),
        )
        .drop("_g")
    )


def scorecard(df: DataFrame, by: Sequence[str], score: str, target: str, k: int = 10) -> DataFrame:
    """Bands with default rate and cumulative capture, riskiest band first. At most ``k`` rows per group."""
    bands = score_bands(df, by, score, target, k)
    group = [F.col(b) for b in by] or [F.lit(0)]
    order = Window.partitionBy(*group).orderBy(F.desc("score_min")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n_default").over(Window.partitionBy(*group))
    return bands.select(
        *by, "band", "score_min", "score_max", "n", "n_default",
        (F.col("n_default") / F.col("n")).alias("default_rate"),
        (F.sum("n_default").over(order) / F.when(total < 1, 1).otherwise(total)).alias("cum_capture"),
    )


def hosmer_lemeshow(df: DataFrame, by: Sequence[str], score: str, target: str, groups: int = 10) -> DataFrame:
    """hl_stat, hl_pval, hl_dof (= groups - 2, also when ties leave fewer bins) and the bin count."""
    bands = score_bands(df, by, score, target, groups)

    def floor(c: Column) -> Column:
        return F.when(c < 1e-9, 1e-9).otherwise(c)

    exp_bad, n, bad = F.col("score_sum"), F.col("n"), F.col("n_default")
    exp_good, good = n - exp_bad, n - bad
    stat = F.sum(F.pow(bad - exp_bad, 2) / floor(exp_bad) + F.pow(good - exp_good, 2) / floor(exp_good))
    out = bands.groupBy(*by).agg(stat.alias("hl_stat"), F.count(F.lit(1)).alias("n_bins"))
    return out.withColumn("hl_pval", chi2_tail_column(F.col("hl_stat"), groups - 2)).withColumn("hl_dof", F.lit(groups - 2))


def evaluate(df: DataFrame, by: Sequence[str], score: str, target: str, groups: int = 10) -> DataFrame:
    """Metric row per group: discrimination plus calibration test, all NULL when a group has no positive."""
    d = discrimination(df, by, score, target)
    if not by:
        raise ValueError("evaluate needs at least one grouping column, for example the split")
    h = hosmer_lemeshow(df, by, score, target, groups)
    out = d.join(h, list(by), "left")
    return out.select(
        *by, "n", "n_defaults", "auroc", "ks", "gini",
        *[F.when(F.col("n_defaults") > 0, F.col(c)).alias(c) for c in ("hl_stat", "hl_pval", "hl_dof", "n_bins")],
    )


def reliability(df: DataFrame, by: Sequence[str], prob: str, target: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [0, 1], right-closed: n, mean prediction, observed rate, gap. Empty bins are absent."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    p = F.col(prob)
    return (
        df.withColumn("bin_no", right_closed_bin(p, edges)).filter(F.col("bin_no").isNotNull())
        .groupBy(*by, "bin_no")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(target).cast("double")).alias("observed"))
        .withColumn("gap", F.abs(F.col("observed") - F.col("mean_pred")))
    )


def calibration_error(df: DataFrame, by: Sequence[str], prob: str, target: str, bins: int = 10) -> DataFrame:
    """Expected (row-weighted) and maximum calibration error over one and the same binning."""
    r = reliability(df, by, prob, target, bins)
    return r.groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce")
    )


def probability_error(df: DataFrame, by: Sequence[str], prob: str, target: str) -> DataFrame:
    """Brier score and mean bias."""
    p, y = F.col(prob), F.col(target).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(target)).cast("long").alias("n_events"),
        F.avg(F.pow(p - y, 2)).alias("brier"),
        (F.avg(p) - F.avg(y)).alias("bias"),
    )


def regression_error(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """n, rmse, mae, r2, bias from one grouped pass. R2 needs two rows and a spread in the actual values."""
    y, f = F.col(actual), F.col(predicted)
    agg = df.filter(y.isNotNull() & f.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.pow(f - y, 2)).alias("_mse"),
        F.avg(F.abs(f - y)).alias("mae"),
        F.avg(f - y).alias("bias"),
        F.var_pop(y).alias("_var"),
    )
    return agg.select(
        *by, "n", F.sqrt("_mse").alias("rmse"), "mae",
        F.when((F.col("n") > 1) & (F.col("_var") > 0), 1 - F.col("_mse") / F.col("_var")).alias("r2"),
        "bias",
    )


def stack_columns(df: DataFrame, keep: Sequence[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide to long: one row per (row, column), with ``columns`` mapping column name to label."""
    cells = F.array(*[F.struct(F.lit(lbl).alias(name), F.col(c).cast("double").alias(value)) for c, lbl in columns.items()])
    return df.select(*keep, F.inline(cells))


def long_run_default_rate(
    df: DataFrame, split: str, target: str, methods: dict[str, str], tolerance_pp: float = 0.1
) -> DataFrame:
    """Observed rate against mean PD per split and method, in percent, with a within-tolerance flag."""
    long = stack_columns(df, [split, target], methods, "method", "pd")
    agg = long.groupBy(split, "method").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.col(target).cast("double")) * 100).alias("observed_dr_pct"),
        (F.avg("pd") * 100).alias("mean_pd_pct"),
    )
    bias = F.col("mean_pd_pct") - F.col("observed_dr_pct")
    return agg.withColumn("bias_pp", bias).withColumn("within_tolerance", (F.abs(bias) < tolerance_pp).cast("int"))
