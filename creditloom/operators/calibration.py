"""Score calibration: Platt scaling, isotonic regression, temperature with bias."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scalars import clip, logit, sigmoid
from creditloom.operators import metrics
from creditloom.operators.fitted import Fitted
from creditloom.operators.metrics import score_tally
from creditloom.operators.models import fit_logistic

EPS = 1e-7


def _counted(df: DataFrame, score: str, target: str) -> DataFrame:
    """One row per distinct score with counts: every fit below needs no more than that."""
    return score_tally(df, [], score, target)


@dataclass
class Platt:
    a: float
    b: float

    def apply(self, score: Column) -> Column:
        return sigmoid(F.lit(self.a) * score + F.lit(self.b))


def fit_platt(df: DataFrame, score: str, target: str, c: float = 1e6) -> Platt:
    """Logistic regression of the target on the raw score, nearly without penalty, on weighted distinct scores."""
    t = _counted(df, score, target)
    both = t.select(score, F.inline(F.array(
        F.struct(F.lit(1).alias("y"), F.col("pos").cast("double").alias("w")), F.struct(F.lit(0).alias("y"), F.col("neg").cast("double").alias("w"))
    ))).filter(F.col("w") > 0)
    rows = VectorAssembler(inputCols=[score], outputCol="_x").transform(both).persist()
    try:
        m = fit_logistic(rows, "_x", "y", c, F.col("w"), max_iter=1000)
    finally:
        rows.unpersist()
    return Platt(float(m.coefficients[0]), float(m.intercept))


@dataclass
class Isotonic:
    """Monotone step-and-line map. The boundary table has as many points as the fit has distinct levels x 2."""

    model: object

    def transform(self, df: DataFrame, score: str, alias: str) -> DataFrame:
        model = self.model.setFeaturesCol("_iso_x").setPredictionCol(alias)
        return model.transform(df.withColumn("_iso_x", F.col(score).cast("double"))).drop("_iso_x")


def fit_isotonic(df: DataFrame, score: str, target: str) -> Isotonic:
    """Isotonic regression over distinct scores, weighted by their counts; constant outside the fitted range."""
    t = _counted(df, score, target)
    data = t.select(F.col(score).alias("_iso_x"), (F.col("pos") / F.col("n")).alias("label"), F.col("n").cast("double").alias("weight"))
    iso = IsotonicRegression(featuresCol="_iso_x", labelCol="label", weightCol="weight", isotonic=True)
    return Isotonic(iso.fit(data))


@dataclass
class Temperature:
    t: float
    b: float
    nll: float

    def apply(self, score: Column) -> Column:
        return sigmoid(logit(score, EPS) / F.lit(self.t) + F.lit(self.b))


# Temperature grid.
GRID = (0.1, 5.0, 500)


def fit_temperature(df: DataFrame, score: str, target: str, grid: tuple[float, float, int] = GRID) -> Temperature:
    """sigma(logit(p) / T + b): T from a grid by lowest negative log-likelihood, b so that mean log-odds meet the base rate.

    The first pass takes means. In the second every partition of the distinct scores returns one vector of
    partial losses, one entry per T; the vectors are added in Spark.
    """
    t = _counted(df, score, target).withColumn("_l", logit(F.col(score), EPS))
    one = t.agg(F.sum(F.col("_l") * F.col("n")) / F.sum("n"), F.sum("pos") / F.sum("n"), F.sum("n")).first()
    mean_logit, rate, n = float(one[0]), min(max(float(one[1]), EPS), 1 - EPS), int(one[2])
    temps = np.linspace(*grid)
    goal = float(np.log(rate / (1 - rate)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(temps))
        for pdf in batches:
            for part in np.array_split(pdf[["_l", "pos", "neg"]].to_numpy(float), max(1, len(pdf) // 4096)):
                z = (part[:, :1] - mean_logit) / temps + goal
                p = np.clip(1 / (1 + np.exp(-z)), EPS, 1 - EPS)
                total -= (part[:, 1:2] * np.log(p) + part[:, 2:3] * np.log(1 - p)).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(len(temps)), "loss": total})

    sums = t.select("_l", "pos", "neg").mapInPandas(partial, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss"))
    best = sums.agg(F.min_by(F.struct("i", "loss"), F.struct("loss", "i")).alias("r")).first()["r"]
    t_best = float(temps[best["i"]])
    return Temperature(t_best, goal - mean_logit / t_best, best["loss"] / n)


class Calibrators(Fitted):
    """The three maps of one score; saved whole, the isotonic one as Spark's own model."""

    def __init__(self, platt: Platt, isotonic: Isotonic, temperature: Temperature):
        super().__init__({"platt": asdict(platt), "temperature": asdict(temperature)}, models={"isotonic": isotonic.model})

    @property
    def platt(self) -> Platt:
        return Platt(**self.state["platt"])

    @property
    def isotonic(self) -> Isotonic:
        return Isotonic(self.models["isotonic"])

    @property
    def temperature(self) -> Temperature:
        return Temperature(**self.state["temperature"])

    def transform(self, df: DataFrame, score: str, prefix: str = "") -> DataFrame:
        out = df.withColumn(f"{prefix}platt", self.platt.apply(F.col(score))).withColumn(f"{prefix}temperature", self.temperature.apply(F.col(score)))
        return self.isotonic.transform(out, score, f"{prefix}isotonic").withColumn(f"{prefix}isotonic", clip(F.col(f"{prefix}isotonic"), 0.0, 1.0))


def fit_calibrators(df: DataFrame, score: str, target: str) -> Calibrators:
    return Calibrators(fit_platt(df, score, target), fit_isotonic(df, score, target), fit_temperature(df, score, target))


def calibration_metrics(df: DataFrame, columns: dict[str, str], target: str, bins: int = 10) -> DataFrame:
    """One row per label: n, events, AUROC, Brier, calibration errors, bias, Hosmer-Lemeshow."""
    long = metrics.stack_columns(df, [target], columns, "label", "p")
    d = metrics.discrimination(long, ["label"], "p", target).select("label", "auroc")
    e = metrics.probability_error(long, ["label"], "p", target)
    c = metrics.calibration_error(long, ["label"], "p", target, bins)
    h = metrics.hosmer_lemeshow(long, ["label"], "p", target).select("label", "hl_stat", "hl_pval")
    return e.join(d, "label").join(c, "label").join(h, "label").select(
        "label", "n", "n_events", "auroc", "brier", "ece", "mce", "bias", "hl_stat", "hl_pval"
    )


def calibrate_models(
    df: DataFrame, models: dict[str, str], target: str, half: str = "half", keep: Sequence[str] = (), fitted: dict[str, Calibrators] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """For every score column in ``models`` (column -> name): fit on the ``cal`` half (or take ``fitted`` by name), score and measure the ``eval`` half.

    Returns (metrics of all models and methods, calibrated eval rows).
    """
    cal, out = df.filter(F.col(half) == "cal"), df.filter(F.col(half) == "eval")
    columns: dict[str, str] = {}
    for score, name in models.items():
        own = (fitted or {}).get(name) or fit_calibrators(cal.filter(F.col(score).isNotNull()), score, target)
        prefix = f"{name.lower()}_"
        out = own.transform(out, score, prefix)
        columns[score] = f"{name} Raw"
        columns.update({f"{prefix}{m}": f"{name} {m.capitalize()}" for m in ("platt", "isotonic", "temperature")})
    return calibration_metrics(out, columns, target), out.select(*keep, target, *columns)
