"""Default and loss models. Fitting is left to ``pyspark.ml``; this module sets up its inputs and reads its output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import comb, factorial
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.scalars import clip, hash_bucket, logit, sigmoid
from creditloom.operators import metrics
from creditloom.operators.encoding import Preparation, balanced_weight, class_counts, fit_preparation, positive_weight, standardised
from creditloom.operators.evidence import WoeModel, fit_woe
from creditloom.operators.fitted import Fitted
from creditloom.operators.splits import share_below, stratified_sample
from creditloom.operators.trees import Trees, read_trees
from creditloom.session import cut_off, shared_dir, written

# Feature lists of the default and the loss model.
PD_FEATURES = [
    "delinquency_indicator", "hpi_change", "occupancy_status", "orig_interest_rate", "orig_cltv", "num_borrowers",
    "credit_score", "property_type", "loan_age", "orig_dti", "orig_upb", "ur_3m_lag",
]
PD_CATEGORIES = ["occupancy_status", "property_type"]
LGD_FEATURES = [
    "hpi_change_since_orig", "mi_pct", "orig_cltv", "orig_dti", "orig_upb", "orig_interest_rate", "loan_age",
    "current_interest_rate", "ur_3m_lag", "occupancy_status", "first_time_homebuyer", "num_units", "property_type",
    "channel", "loan_purpose", "num_borrowers", "property_state",
]
LGD_CATEGORIES = ["occupancy_status", "first_time_homebuyer", "num_units", "property_type", "channel", "loan_purpose", "num_borrowers", "property_state"]
# Training parameters.
BOOSTED_PD = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.5, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 50}
BOOSTED_LGD = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
FOREST_LGD = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"}


def coefficient_table(spark, features: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """(feature, coefficient, abs_coef), largest magnitude first. As many rows as features."""
    rows = sorted(((f, float(c), abs(float(c))) for f, c in zip(features, coefficients)), key=lambda r: -r[2])
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coef double")


def importance_table(spark, features: Sequence[str], importances: Sequence[float]) -> DataFrame:
    total = sum(importances) or 1.0
    rows = sorted(((f, float(v), float(v) / total) for f, v in zip(features, importances)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, gain double, share double")


# ------------------------------------------------------------------------------------------------ logistic PD
def fit_logistic(df: DataFrame, vector: str, target: str, c: float = 1.0, weight: Column | None = None, max_iter: int = 200):
    """L2 logistic regression in the parameterisation "sum of losses + |beta|^2 / (2 C)".

    Spark divides the losses by the weight total, hence regParam = 1 / (C x weight total). The intercept is free.
    """
    w = F.lit(1.0) if weight is None else weight
    data = df.select(F.col(vector).alias("features"), F.col(target).cast("double").alias("label"), w.alias("weight"))
    total = data.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=1e-9,
    )
    return lr.fit(data)


class LogisticPd(Fitted):
    """WoE table, moments and coefficients. Scores are one expression over the encoded columns."""

    def __init__(self, woe: WoeModel, moments: dict[str, tuple[float, float]], columns: Sequence[str], coefficients: Sequence[float] = (), intercept: float = 0.0):
        state = {"moments": {c: [float(x) for x in m] for c, m in moments.items()}, "columns": list(columns), "coefficients": [float(c) for c in coefficients], "intercept": float(intercept)}
        super().__init__(state, models={"woe": woe})

    @property
    def woe(self) -> WoeModel:
        return self.models["woe"]

    @property
    def columns(self) -> list[str]:
        return self.state["columns"]

    @property
    def moments(self) -> dict[str, list[float]]:
        return self.state["moments"]

    @property
    def weights(self) -> list[float]:
        return self.state["coefficients"]

    def encoded(self, df: DataFrame) -> DataFrame:
        return standardised(self.woe.transform(df), self.moments)

    def transform(self, df: DataFrame, score: str | None = None) -> DataFrame:
        score = score or self.state.get("output", "score")
        margin = F.lit(self.state["intercept"])
        for c, w in zip(self.columns, self.weights, strict=True):
            margin = margin + F.lit(w) * F.col(c)
        return self.encoded(df).select(*df.columns, sigmoid(margin).alias(score))

    def coefficients(self, spark) -> DataFrame:
        return coefficient_table(spark, self.columns, self.weights)


def fit_logistic_pd(train: DataFrame, features: Sequence[str], target: str = "default_12m", n_bins: int = 15, c: float = 1.0) -> LogisticPd:
    """WoE encoding, scaling to population deviation 1, balanced classes, L2 logistic regression.

    ``train`` is kept while the fit lasts: the tally, the moments and the solver read the same rows.
    """
    train = train.select(target, *[f for f in features if f in train.columns]).persist()
    try:
        woe = fit_woe(train, features, target, n_bins)
        columns = [f"{f}_woe" for f in woe.names]
        row = woe.transform(train).agg(
            *[F.avg(x) for x in columns], *[F.stddev_pop(x) for x in columns], *[F.count(F.when(F.col(target) == k, 1)) for k in (0, 1)]
        ).first()
        k = len(columns)
        moments = {x: (row[i] or 0.0, row[k + i] or 1.0) for i, x in enumerate(columns)}
        fitted = LogisticPd(woe, moments, columns)
        weight = balanced_weight({0: row[2 * k], 1: row[2 * k + 1]}, target)
        vectors = VectorAssembler(inputCols=columns, outputCol="_features").transform(fitted.encoded(train)).select("_features", target)
        model = fit_logistic(vectors, "_features", target, c, weight)
    finally:
        train.unpersist()
    return LogisticPd(woe, moments, columns, model.coefficients, model.intercept)


# ------------------------------------------------------------------------------------------------ boosted PD
class BoostedPd(Fitted):
    """Preparation and trees. Margins are log-odds, worked out on Arrow batches from the node table."""

    def __init__(self, preparation: Preparation, trees: Trees, aurocs: Sequence[float] = ()):
        spark = SparkSession.active()
        super().__init__({"aurocs": [float(x) for x in aurocs], "n_features": trees.n_features}, {"nodes": trees.table(spark)}, {"preparation": preparation})
        self.trees = trees

    def _loaded(self) -> None:
        self.trees = Trees.from_table(self.tables["nodes"], self.state["n_features"])

    @property
    def preparation(self) -> Preparation:
        return self.models["preparation"]

    @property
    def features(self) -> list[str]:
        return self.preparation.features

    @property
    def aurocs(self) -> list[float]:
        """On validation rows, after each round that was fitted."""
        return self.state["aurocs"]

    def vectors(self, df: DataFrame) -> DataFrame:
        return self.preparation.transform(df)

    def _beside(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """``df`` with ``columns`` that are worked out from the prepared features; its own columns stay as they are."""
        held = df.withColumns({f"_raw_{c}": F.col(c) for c in df.columns})
        return self.preparation.numbers(held).select(*[F.col(f"_raw_{c}").alias(c) for c in df.columns], *[v.alias(k) for k, v in columns.items()])

    def margin(self) -> Column:
        return margin_column(self.trees, [F.col(f) for f in self.features])

    def transform(self, df: DataFrame, score: str | None = None) -> DataFrame:
        return self._beside(df, {score or self.state.get("output", "score"): sigmoid(self.margin())})

    def cell_pds(self, df: DataFrame, replace: Mapping[str, Sequence[float]], add: Mapping[str, Sequence[float]], n_cells: int, alias: str = "pds") -> DataFrame:
        """``df`` with an array of probabilities, one for each cell; a cell replaces some features and adds to others. Row-local: every row passes the trees once."""
        at = {f: i for i, f in enumerate(self.features)}
        swap, more = ({at[f]: np.asarray(v, dtype=float) for f, v in m.items() if f in at} for m in (replace, add))
        shipped = SparkSession.active().sparkContext.broadcast(self.trees)

        @F.arrow_udf("array<double>")
        def run(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(at))
            step = 1 << 14
            parts = [shipped.value.cell_margins(rows[k : k + step], swap, more, n_cells) for k in range(0, len(rows), step)]
            p = 1.0 / (1.0 + np.exp(-np.concatenate(parts))) if parts else np.zeros((0, n_cells))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, n_cells, dtype=np.int32)), pa.array(p.ravel()))

        return self._beside(df, {alias: run(F.array(*[F.col(f) for f in self.features]))})

    def importance(self, spark) -> DataFrame:
        return importance_table(spark, self.features, self.trees.importance().tolist())


def margin_column(trees: Trees, features: Sequence[Column]) -> Column:
    shipped = SparkSession.active().sparkContext.broadcast(trees)
    width = len(features)

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(shipped.value.margins(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)))

    return run(F.array(*features))


def staged_auroc(data: DataFrame, trees: Trees, vector: str = "features", label: str = "label", first: int = 0) -> list[float]:
    """AUROC of ``data`` after each round from ``first`` on. Margins of all rounds are one array of a row; they are tallied together, so one pass gives every round.

    A round in which one class is missing counts a half.
    """
    shipped = data.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), trees.n_features)
        m = shipped.value.staged(rows)[:, first:]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(m).ravel()))

    long = data.select(F.col(label).cast("int").alias("y"), F.posexplode(run(vector_to_array(vector))).alias("round", "margin"))
    tallied = written(metrics.score_tally(long, ["round"], "margin", "y"), "stages")  # read several times, and the trees would be walked each time
    found = {r["round"]: r["auroc"] for r in metrics.discrimination_of_tally(tallied, ["round"], "margin").select("round", "auroc").collect()}
    return [0.5 if found.get(i) is None else float(found[i]) for i in range(trees.n_trees - first)]


def fit_boosted_pd(
    train: DataFrame, features: Sequence[str] = PD_FEATURES, categories: Sequence[str] = PD_CATEGORIES, target: str = "default_12m",
    keys: Sequence[str] = ("loan_seq_num", "report_date"), others: Sequence[DataFrame] = (), sample: float = 1.0, validation: float = 0.2, patience: int = 20,
    block: int = 32, **params,
) -> BoostedPd:
    """Boosted trees with positives weighted by negatives / positives, as many rounds as give the best AUROC on validation rows.

    The rounds are fitted ``block``, 2 ``block``, 4 ``block`` .. at a time up to ``maxIter``; with one seed a longer fit begins with the trees of a shorter one, so only the rounds
    it adds are measured. The fit stops once ``patience`` rounds have passed since the best one, and the trees up to the best stay. (Spark's own
    early stop gives up at the first round that gains little loss, which small steps always do, and can't go on from given margins.)
    Validation rows are cut from train by a hash of the row key, so hold-out rows stay untouched. ``sample`` thins train by the same share in both classes; by default all rows are used.
    """
    spark = train.sparkSession
    rows = train if sample >= 1.0 else stratified_sample(train, target, keys, sample)
    # Node ids are not kept: finding a row's node again in a tree of depth 6 costs less than another array a row and level.
    settings = {**BOOSTED_PD, "seed": 42, "checkpointInterval": 10, **params}
    shared_dir(spark)  # the checkpoint interval acts only with a checkpoint folder
    rows = rows.filter(F.col(target).isNotNull()).select(*dict.fromkeys([*keys, target, *[f for f in features if f in rows.columns]]))
    rows = rows.repartition(spark.sparkContext.defaultParallelism, *keys).persist()
    try:
        prep = fit_preparation(rows, features, categories, others)
        data = cut_off(prep.transform(rows).select(
            "features", F.col(target).cast("double").alias("label"), positive_weight(class_counts(rows, target), target).alias("weight"),
            share_below(hash_bucket(keys, 11), validation).alias("is_validation"),
        ))
    finally:
        rows.unpersist()
    learn, held_out = data.filter(~F.col("is_validation")), data.filter("is_validation")
    measured = validation > 0 and not held_out.isEmpty()
    most = settings.pop("maxIter")
    rounds, aurocs = min(block, most) if measured else most, []
    while True:
        trees = read_trees(GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, **settings).fit(learn if measured else data), spark)
        if not measured:
            return BoostedPd(prep, trees)
        aurocs += staged_auroc(held_out, trees, first=len(aurocs))
        best = best_rounds(aurocs, patience)
        if rounds >= most or len(aurocs) - best >= patience:
            return BoostedPd(prep, trees.first(best), aurocs)
        rounds = min(2 * rounds, most)


def best_rounds(aurocs: Sequence[float], patience: int) -> int:
    """Rounds up to the largest value, looking no further than ``patience`` rounds without a larger one."""
    best = 0
    for i, value in enumerate(aurocs):
        if value > aurocs[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


# ------------------------------------------------------------------------------------------------ LGD models
def spline_knots(df: DataFrame, columns: Sequence[str], n_knots: int = 5) -> dict[str, list[float]]:
    """Evenly spaced knots between minimum and maximum of each column (one aggregate)."""
    row = df.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
    k = len(columns)
    return {c: [row[i] + (row[k + i] - row[i]) * j / (n_knots - 1) for j in range(n_knots)] for i, c in enumerate(columns)}


def spline_position(x: Column, knots: Sequence[float]) -> Column:
    """Position of x in knot intervals, 0 to number of intervals, limited at the ends (constant extrapolation)."""
    lo, hi, parts = knots[0], knots[-1], len(knots) - 1
    if not hi > lo:
        return F.when(x.isNotNull(), F.lit(0.0))
    return clip((x - F.lit(lo)) * F.lit(parts / (hi - lo)), 0.0, float(parts))


def spline_basis(u: Column, parts: int, degree: int = 3) -> list[Column]:
    """B-spline basis at position ``u``, without its last function.

    With even knots all functions are one cardinal spline at different offsets, a short sum of truncated powers:
    sum over k of (-1)^k C(degree + 1, k) (u - offset - k)+^degree / degree!.
    """
    out = []
    for j in range(parts + degree - 1):
        total = F.lit(0.0)
        for k in range(degree + 2):
            v = u - F.lit(float(j - degree + k))
            total = total + F.when(v > 0, F.pow(v, F.lit(float(degree)))).otherwise(0.0) * F.lit((-1.0) ** k * comb(degree + 1, k) / factorial(degree))
        out.append(F.when(u.isNotNull(), total))
    return out


class LossModels(Fitted):
    """The four loss regressors over one preparation. Predictions are limited to [0, 1]."""

    names: ClassVar[dict[str, str]] = {"frm_pred": "FRM", "spline_pred": "Spline", "random_forest_pred": "Random Forest", "boosted_pred": "Boosted Trees"}

    def __init__(self, preparation: Preparation, fractional, spline, knots: dict[str, list[float]], forest, boosted):
        super().__init__({"knots": knots}, models={"preparation": preparation, "fractional": fractional, "spline": spline, "forest": forest, "boosted": boosted})

    @property
    def preparation(self) -> Preparation:
        return self.models["preparation"]

    @property
    def knots(self) -> dict[str, list[float]]:
        return self.state["knots"]

    def _transform(self, df: DataFrame) -> DataFrame:
        """Add one column per model; feature columns come out encoded and imputed."""
        x = _with_basis(self.preparation.transform(df), self.knots)
        x = self.models["fractional"].transform(x).withColumn("frm_pred", clip(sigmoid(F.col("_frm")), 0.0, 1.0))
        x = self.models["spline"].transform(x).withColumn("spline_pred", clip(F.col("_spline"), 0.0, 1.0))
        x = self.models["forest"].transform(x).withColumn("random_forest_pred", clip(F.col("_forest"), 0.0, 1.0))
        x = self.models["boosted"].transform(x).withColumn("boosted_pred", clip(F.col("_boosted"), 0.0, 1.0))
        return x.drop("features", "_basis", "_frm", "_spline", "_forest", "_boosted")

    def coefficients(self, spark) -> DataFrame:
        return coefficient_table(spark, self.preparation.features, self.models["fractional"].coefficients)

    def importance(self, spark) -> DataFrame:
        return importance_table(spark, self.preparation.features, self.models["forest"].featureImportances.toArray().tolist())

    def evaluate(self, predictions: DataFrame, split: str = "split", actual: str = "lgd") -> DataFrame:
        long = metrics.stack_columns(predictions, [split, actual], self.names, "model", "predicted")
        return metrics.regression_error(long, ["model", split], actual, "predicted")


def _with_basis(df: DataFrame, knots: dict[str, list[float]]) -> DataFrame:
    """Add the basis vector ``_basis``; positions are columns of their own, so that no term repeats their expression."""
    placed = df.withColumns({f"_u_{c}": spline_position(F.col(c), ks) for c, ks in knots.items()})
    cols = {f"_b_{c}_{j}": b for c, ks in knots.items() for j, b in enumerate(spline_basis(F.col(f"_u_{c}"), len(ks) - 1))}
    out = VectorAssembler(inputCols=list(cols), outputCol="_basis").transform(placed.withColumns(cols))
    return out.drop(*cols, *[f"_u_{c}" for c in knots])


def fit_fractional(df: DataFrame, vector: str = "features", target: str = "lgd"):
    """Least squares on the logit of the loss ratio; predictions pass back through the logistic curve."""
    data = df.withColumn("_y", logit(F.col(target)))
    return LinearRegression(featuresCol=vector, labelCol="_y", predictionCol="_frm", solver="normal", regParam=0.0).fit(data)


def fit_loss_models(
    train: DataFrame, features: Sequence[str] = LGD_FEATURES, categories: Sequence[str] = LGD_CATEGORIES, target: str = "lgd",
    others: Sequence[DataFrame] = (), forest_params: dict | None = None, boosted_params: dict | None = None,
) -> LossModels:
    """Preparation and the four models. ``train`` is kept while it is prepared: labels, medians and knots read the same rows."""
    spark = train.sparkSession
    shared_dir(spark)
    train = train.select(target, *[f for f in features if f in train.columns]).persist()
    try:
        prep = fit_preparation(train, features, categories, others, missing_as_label=False)
        data = prep.transform(train).withColumn(target, F.col(target).cast("double"))
        knots = spline_knots(data, prep.features)
        data = cut_off(_with_basis(data, knots).select("features", "_basis", target), packed=True)
    finally:
        train.unpersist()
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="_forest", seed=42, **{**FOREST_LGD, **(forest_params or {})})
    boosted = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="_boosted", seed=42, **{**BOOSTED_LGD, **(boosted_params or {})})
    # The basis functions of one column add up to almost a constant, so the solver gets a trace of ridge.
    spline = LinearRegression(featuresCol="_basis", labelCol=target, predictionCol="_spline", solver="normal", regParam=1e-9, standardization=False)
    # The rounds of the boosting are many short jobs; the other fits run in the cores that these leave idle.
    with ThreadPoolExecutor(1) as beside:
        rounds = beside.submit(inheritable_thread_target(spark)(boosted.fit), data)
        line, curve, trees = fit_fractional(data, "features", target), spline.fit(data), forest.fit(data)
        return LossModels(prep, line, curve, knots, trees, rounds.result())
