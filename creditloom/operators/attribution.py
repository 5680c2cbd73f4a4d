"""Exact attributions for boosted trees, and the report tables over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.scalars import clip, code_label, percentage_points, right_closed_bin, sigmoid
from creditloom.operators.ordered import even_probs, exact_quantiles
from creditloom.operators.ranks import column_quantiles
from creditloom.operators.reports import FEATURE_LABELS
from creditloom.operators.trees import Trees, read_trees

#: Rows that meet all leaves at once, and places of the arrays in between.
ROWS, CELLS = 256, 1 << 21


# ----------------------------------------------------------------------------------------------------------
# Leaves as tables of answers. Models are bounded by their training parameters (trees x 2^depth nodes), not by data.
# ----------------------------------------------------------------------------------------------------------
@dataclass
class LeafPath:
    """One leaf: its value and, per feature met on the way, the admitted interval and the share of training
    rows that follow the path when the feature is unknown."""

    value: float
    features: list[int]
    lower: list[float]  # exclusive
    upper: list[float]  # inclusive
    share: list[float]


def leaf_paths(trees: Trees) -> list[LeafPath]:
    leaves: list[LeafPath] = []
    for root in trees.roots:
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(int(root), {})]
        while todo:
            i, met = todo.pop()
            f = int(trees.feature[i])
            if f < 0:
                keys = sorted(met)
                leaves.append(LeafPath(float(trees.value[i]), keys, [met[k][0] for k in keys], [met[k][1] for k in keys], [met[k][2] for k in keys]))
                continue
            lo, hi, share = met.get(f, (-np.inf, np.inf, 1.0))
            cut = float(trees.threshold[i])
            for child, bounds in ((int(trees.below[i]), (lo, min(hi, cut))), (int(trees.above[i]), (max(lo, cut), hi))):
                todo.append((child, {**met, f: (*bounds, share * trees.count[child] / trees.count[i])}))
    return leaves


def export_leaves(model, spark) -> list[LeafPath]:
    """Leaves of a fitted Spark model on the margin scale (log-odds for the classifier)."""
    return leaf_paths(read_trees(model, spark))


def _size_weights(m: int) -> np.ndarray:
    """|S|! (m - |S| - 1)! / m! for every coalition size."""
    return np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])


@dataclass
class LeafTables:
    """All leaves that meet ``m`` features: what each of the 2^m answers to their conditions adds to each of the m features, worked out once for the model."""

    features: np.ndarray  # leaves x m
    met: list[np.ndarray]  # for each feature: its places x leaves, the bit of the leaf's condition where the place meets it
    answers: np.ndarray  # (leaves x 2^m) x m

    def add(self, phi: np.ndarray, at: np.ndarray) -> None:
        """Add the shares of every row to ``phi`` (rows x features): a condition code picks each leaf's answer. ``at``: places of the rows' features."""
        n_leaves, m = self.features.shape
        step = max(1, CELLS // (max(1, len(at)) * m))
        for k in range(0, n_leaves, step):
            part = slice(k, k + step)
            code = sum(self.met[f][:, part].take(at[:, f], axis=0) for f in np.unique(self.features[part]).tolist())
            amount = self.answers.take(code + (np.arange(n_leaves)[part] << m), axis=0)  # rows x leaves x m
            owner = np.zeros((amount.shape[1] * m, phi.shape[1]))
            owner[np.arange(len(owner)), self.features[part].ravel()] = 1.0
            phi += amount.reshape(len(at), -1) @ owner


def feature_places(cuts: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """For every value the number of its feature's cuts below it; one more than there are cuts where the value meets no condition (not a number)."""
    at = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    return np.where(x > -np.inf, at, [len(c) + 1 for c in cuts])


def _met(leaves: Sequence[LeafPath], cuts: Sequence[np.ndarray]) -> list[np.ndarray]:
    kind = np.min_scalar_type((1 << len(leaves[0].features)) - 1)
    out = [np.zeros((len(c) + 2, len(leaves)), dtype=kind) for c in cuts]
    for i, leaf in enumerate(leaves):
        for j, f in enumerate(leaf.features):
            first, last = (np.searchsorted(cuts[f], v, side=side) for v, side in ((leaf.lower[j], "right"), (leaf.upper[j], "left")))
            out[f][first : last + 1, i] = 1 << j
    return out


def leaf_tables(leaves: Sequence[LeafPath], cuts: Sequence[np.ndarray]) -> tuple[list[LeafTables], float]:
    """Tables by number of features, and the base value: the mean of all leaves. ``cuts``: the sorted thresholds of each feature."""
    base = sum(leaf.value * float(np.prod(leaf.share)) for leaf in leaves)
    out = []
    for m in sorted({len(leaf.features) for leaf in leaves} - {0}):
        own = [leaf for leaf in leaves if len(leaf.features) == m]
        share, value = np.array([leaf.share for leaf in own]), np.array([leaf.value for leaf in own])
        one = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
        answers = np.zeros((len(own), 1 << m, m))
        weights = _size_weights(m)
        for i in range(m):
            # coefficients by coalition size of prod_{j != i} (share_j + one_j * t)
            poly = np.zeros((len(own), 1 << m, m))
            poly[:, :, 0] = 1.0
            for j in range(m):
                if j != i:
                    moved = np.zeros_like(poly)
                    moved[:, :, 1:] = poly[:, :, :-1] * one[None, :, j : j + 1]
                    poly = poly * share[:, None, j : j + 1] + moved
            answers[:, :, i] = value[:, None] * (one[None, :, i] - share[:, None, i]) * (poly @ weights)
        out.append(LeafTables(np.array([leaf.features for leaf in own]), _met(own, cuts), answers.reshape(-1, m)))
    return out, base


def tree_attributions(model, df: DataFrame, features: Sequence[str], vector: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Shapley values of every row, ``shap_<feature>``, with base value, margin and probability. ``model``: :class:`Trees` or a fitted Spark model.

    Path-dependent values with the training row counts of the nodes. Rows stay in their partitions: the tables of answers are broadcast (leaves x 2^depth x depth numbers),
    the feature vector goes through Arrow in batches, and no row is sampled away. The margin is summed from the leaves themselves, so base + sum of values can be checked against it.
    """
    spark = df.sparkSession
    trees = model if isinstance(model, Trees) else read_trees(model, spark)
    cuts = trees.cuts()
    tables, base = leaf_tables(leaf_paths(trees), cuts)
    shipped = spark.sparkContext.broadcast((trees, cuts, tables))
    p = len(features)
    wanted = df.select(*keep, vector_to_array(vector).alias("_x"))
    schema = df.select(*keep).schema
    for f in ("margin", *[f"shap_{f}" for f in features], "base_value"):
        schema = schema.add(f, "double")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cuts, tables = shipped.value
        for batch in batches:
            n = batch.num_rows
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, p)
            at, phi = feature_places(cuts, x), np.zeros((n, p))
            for k in range(0, n, ROWS):
                for table in tables:
                    table.add(phi[k : k + ROWS], at[k : k + ROWS])
            made = [trees.margins(x), *phi.T, np.full(n, base)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in made)], names=names)

    return wanted.mapInArrow(run, schema).withColumn("predicted_pd", sigmoid(F.col("margin")))


# ----------------------------------------------------------------------------------------------------------
# Report tables
# ----------------------------------------------------------------------------------------------------------
def long_attributions(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), values: bool = False) -> DataFrame:
    """(keep.., feature, phi[, feature_value]) from the wide ``shap_<feature>`` columns."""
    cells = []
    for f in features:
        parts = [F.lit(f).alias("feature"), F.col(f"shap_{f}").alias("phi")]
        if values:
            parts.append(F.col(f).cast("double").alias("feature_value"))
        cells.append(F.struct(*parts))
    return df.select(*keep, F.inline(F.array(*cells)))


def global_importance(df: DataFrame, features: Sequence[str], base_rate: float = 0.008) -> DataFrame:
    """Mean absolute value per feature, its size in probability points, and rank."""
    agg = long_attributions(df, features).groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs"), "feature")
    return agg.withColumn("mean_abs_pp", percentage_points(F.col("mean_abs"), base_rate)).withColumn("rank", F.row_number().over(order))


def waterfall(df: DataFrame, features: Sequence[str], keys: Sequence[str], top: int = 10) -> DataFrame:
    """For every row: its ``top`` features by absolute value, the rest as one line, and the running margin.

    The features of a row are an array of that row, so nothing is shuffled.
    """
    cells = F.array(*[F.struct(F.abs(f"shap_{f}").alias("a"), F.lit(f).alias("feature"), F.col(f"shap_{f}").alias("phi")) for f in features])
    ordered = F.array_sort(cells, lambda x, y: F.when(x["a"] > y["a"], -1).when(x["a"] < y["a"], 1).when(x["feature"] < y["feature"], -1).otherwise(1))
    shown = F.transform(F.slice("_o", 1, top), lambda c: F.struct(c["feature"].alias("feature"), c["phi"].alias("phi")))
    if len(features) > top:
        rest = F.aggregate(F.slice("_o", top + 1, len(features)), F.lit(0.0), lambda acc, c: acc + c["phi"])
        shown = F.concat(shown, F.array(F.struct(F.lit("(all other features)").alias("feature"), rest.alias("phi"))))
    lines = df.select(*keys, "base_value", ordered.alias("_o")).select(*keys, "base_value", shown.alias("_s"))
    upto = F.aggregate(F.slice("_s", 1, F.col("position") + 1), F.col("base_value"), lambda acc, c: acc + c["phi"])
    return lines.select(*keys, "base_value", "_s", F.posexplode("_s").alias("position", "c")).select(
        *keys, (F.col("position") + 1).alias("position"), F.col("c.feature").alias("feature"), F.col("c.phi").alias("phi"),
        (upto - F.col("c.phi")).alias("start"), upto.alias("end"),
    )


def extreme_rows(df: DataFrame, score: str, columns: Sequence[str]) -> DataFrame:
    """The row of the highest and of the lowest score, in one aggregate; ties go to the smallest value of the first column. Rows without a score are neither."""
    cells = F.struct(*[F.col(c) for c in columns])
    s, first = F.col(score), F.col(columns[0])
    one = df.filter(s.isNotNull()).agg(F.min_by(cells, F.struct(-s, first)).alias("hi"), F.min_by(cells, F.struct(s, first)).alias("lo"))
    both = F.array(F.struct(F.lit("highest").alias("which"), F.col("hi").alias("r")), F.struct(F.lit("lowest").alias("which"), F.col("lo").alias("r")))
    return one.select(F.inline(both)).filter(F.col("r").isNotNull()).select("which", "r.*")


def _decile_edges(df: DataFrame, score: str, k: int) -> DataFrame:
    keyed = df.withColumn("_g", F.pmod(F.xxhash64(score), F.lit(1)))
    edges = exact_quantiles(keyed, ["_g"], score, even_probs(k), "_e").select("_g", F.array_distinct("_e").alias("_e"))
    return keyed.join(F.broadcast(edges), "_g").withColumn("decile", right_closed_bin(F.col(score), F.col("_e"))).drop("_g", "_e")


def decile_attributions(df: DataFrame, features: Sequence[str], score: str = "predicted_pd", k: int = 10) -> DataFrame:
    """Mean absolute value per decile of the score and feature."""
    banded = _decile_edges(df, score, k)
    return long_attributions(banded, features, ["decile"]).groupBy("decile", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def leading_feature_profile(df: DataFrame, features: Sequence[str], score: str = "predicted_pd", k: int = 10, top: int = 5) -> DataFrame:
    """Decile profile of the ``top`` globally leading features, with the running height of a stacked chart."""
    lead = global_importance(df, features).filter(F.col("rank") <= top).select("feature", "rank")
    per = decile_attributions(df, features, score, k).join(F.broadcast(lead), "feature")
    stack = Window.partitionBy("decile").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("stacked", F.sum("mean_abs").over(stack))


def segment_report(
    df: DataFrame, features: Sequence[str], score: str = "predicted_pd", target: str = "default_12m", k: int = 10, top: int = 3
) -> DataFrame:
    """Per score decile: loans, mean predicted and observed rate in percent, and its leading drivers as text."""
    banded = _decile_edges(df, score, k)
    means = banded.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n_loans"), (F.avg(score) * 100).alias("mean_pd_pct"),
        (F.avg(F.col(target).cast("double")) * 100).alias("observed_dr_pct"),
        *[F.avg(F.abs(f"shap_{f}")).alias(f"_a_{f}") for f in features],
    )
    cells = F.array(*[F.struct((-F.round(f"_a_{f}", 9)).alias("o"), F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f"_a_{f}").alias("v")) for i, f in enumerate(features)])
    best = F.slice(F.array_sort(cells), 1, top)
    text = F.array_join(F.transform(best, lambda c: F.concat(
        code_label(c["feature"], FEATURE_LABELS, c["feature"]), F.lit("("), F.format_string("%.3f", c["v"]), F.lit(")")
    )), ", ")
    return means.select("decile", "n_loans", "mean_pd_pct", "observed_dr_pct", text.alias("top_drivers"))


def percentile_scale(df: DataFrame, columns: Sequence[str], lo: int = 2, hi: int = 98) -> DataFrame:
    """Add ``<c>_scaled``: position between the 2nd and 98th percentile, limited to [0, 1]."""
    narrow = df.select(*columns).persist()
    try:
        cuts = {c: (v[0], v[1]) for c, v in column_quantiles(narrow, columns, [(lo, 100), (hi, 100)]).items()}
    finally:
        narrow.unpersist()
    scaled = {}
    for c in columns:
        low, high = cuts.get(c, (0.0, 0.0))
        scaled[f"{c}_scaled"] = clip((F.col(c) - F.lit(low)) / F.lit(max(high - low, 1e-9)), 0.0, 1.0)
    return df.withColumns(scaled)


def dependence_table(df: DataFrame, feature: str, interaction: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per row: feature value, its attribution and the scaled value of the interacting feature."""
    s = percentile_scale(df, [interaction])
    return s.select(*keep, F.col(feature).alias("feature_value"), F.col(f"shap_{feature}").alias("phi"), F.col(f"{interaction}_scaled").alias("interaction"))


def dependence_bins(df: DataFrame, feature: str, interaction: str, k: int = 20) -> DataFrame:
    """The dependence table in equal-frequency bins of the feature."""
    t = dependence_table(df, feature, interaction)
    keyed = t.withColumn("_g", F.pmod(F.xxhash64("feature_value"), F.lit(1)))
    edges = exact_quantiles(keyed, ["_g"], "feature_value", even_probs(k), "_e").select("_g", F.array_distinct("_e").alias("_e"))
    binned = keyed.join(F.broadcast(edges), "_g").withColumn("bin_no", right_closed_bin(F.col("feature_value"), F.col("_e")))
    return binned.groupBy("bin_no").agg(
        F.count(F.lit(1)).alias("n"), F.avg("feature_value").alias("mean_value"), F.avg("phi").alias("mean_phi"), F.avg("interaction").alias("mean_interaction")
    )


def beeswarm_density(df: DataFrame, features: Sequence[str], top: int = 10, bins: int = 40) -> DataFrame:
    """Density of the attributions per leading feature, with the mean scaled feature value of each cell.

    Replaces a scatter of all rows by at most ``top`` x ``bins`` cells.
    """
    scaled = percentile_scale(df, features)
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"shap_{f}").alias("phi"), F.col(f"{f}_scaled").alias("scaled")) for f in features
    ])
    long = scaled.select(F.inline(cells))
    span = long.groupBy("feature").agg(F.min("phi").alias("_lo"), F.max("phi").alias("_hi"))
    lead = global_importance(df, features).filter(F.col("rank") <= top).select("feature", "rank")
    placed = long.join(F.broadcast(lead), "feature").join(F.broadcast(span), "feature")
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    slot = F.least(F.floor((F.col("phi") - F.col("_lo")) / width * bins).cast("int"), F.lit(bins - 1))
    return placed.groupBy("feature", "rank", slot.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("phi").alias("mean_phi"), F.avg("scaled").alias("mean_scaled_value")
    )
