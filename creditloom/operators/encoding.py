"""Feature preparation: label codes, median imputation, scaling, class weights, feature vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.evidence import LITERAL
from creditloom.operators.fitted import Fitted
from creditloom.operators.labels import usable_columns
from creditloom.operators.ranks import column_quantiles
from creditloom.session import written

MISSING = "missing"


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians (mean of the two middle values) of several columns at once."""
    if not columns:
        return {}
    narrow = df.select(*columns).persist()
    try:
        return {c: v[0] for c, v in column_quantiles(narrow, columns, [(1, 2)]).items()}
    finally:
        narrow.unpersist()


def scale_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column scales by 1."""
    row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    k = len(columns)
    return {c: (row[i] or 0.0, row[k + i] if row[k + i] else 1.0) for i, c in enumerate(columns)}


def standardised(df: DataFrame, moments: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in moments.items()})


def class_counts(df: DataFrame, target: str) -> dict[int, int]:
    """Rows of each class; rows without a target belong to none."""
    return {int(r[target]): r["n"] for r in df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}


def balanced_weight(counts: Mapping[int, int], target: str) -> Column:
    """n / (2 x class size)."""
    n = sum(counts.values())
    return F.when(F.col(target) == 1, n / (2.0 * max(counts.get(1, 0), 1))).otherwise(n / (2.0 * max(counts.get(0, 0), 1)))


def positive_weight(counts: Mapping[int, int], target: str) -> Column:
    """Positives weigh negatives / positives, negatives 1."""
    return F.when(F.col(target) == 1, counts.get(0, 0) / max(counts.get(1, 0), 1)).otherwise(1.0)


def dictionary(labels: DataFrame) -> DataFrame:
    """``feature, label, code``: the distinct labels of each feature numbered from 0 in their order.

    Labels are dealt out by range and numbered within each part; a part's first number comes from the counts of the parts before it, one row for each
    part and feature. No task or driver holds a whole dictionary.
    """
    spark = labels.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = written(labels.select("feature", "label").distinct().repartitionByRange(parts, "feature", "label").withColumn("_part", F.spark_partition_id()), "labels")
    earlier = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("feature", "_part").agg(F.count(F.lit(1)).alias("n")).select("feature", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("feature", "_part").orderBy("label")
    return dealt.join(starts, ["feature", "_part"]).select("feature", "label", (F.col("_start") + F.row_number().over(inside) - 1).alias("code"))


class LabelEncoder(Fitted):
    """Codes 0, 1, .. in the labels' order. Unseen and missing labels get code 0 (missing counts as a label
    of its own when ``fit`` saw it). Features of few labels are looked up in a literal map, others by a join with their table."""

    def __init__(self, columns: Sequence[str], few: Mapping[str, Mapping[str, int]], codes: DataFrame | None):
        super().__init__({"columns": list(columns), "few": {c: dict(m) for c, m in few.items()}}, {} if codes is None else {"codes": codes})

    @property
    def columns(self) -> list[str]:
        return self.state["columns"]

    def _transform(self, df: DataFrame) -> DataFrame:
        out, few = df, self.state["few"]
        text = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in self.columns}
        for c in self.columns:
            if c not in few:
                held = self.tables["codes"].filter(F.col("feature") == c).select(F.col("label").alias("_label"), F.col("code").cast("double").alias("_code"))
                out = out.join(held, text[c] == F.col("_label"), "left").withColumn(c, F.coalesce("_code", F.lit(0.0))).drop("_label", "_code")
        pairs = {c: [F.lit(x) for label, code in few[c].items() for x in (label, float(code))] for c in self.columns if c in few}
        # an empty map has no types
        return out.withColumns({c: F.coalesce(F.element_at(F.create_map(*kv), text[c]), F.lit(0.0)) if kv else F.lit(0.0) for c, kv in pairs.items()}) if pairs else out


def fit_labels(frames: Sequence[DataFrame], columns: Sequence[str], missing_as_label: bool = True) -> LabelEncoder:
    """Fit on one frame (train) or on the union of several. A feature of up to ``LITERAL`` labels is held by the driver, longer dictionaries stay tables."""
    cols = [c for c in columns if c in frames[0].columns]
    if not cols:
        return LabelEncoder([], {}, None)
    union = None
    for df in frames:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if missing_as_label else F.col(c).cast("string")).alias("label")) for c in cols])
        part = df.select(F.inline(cells)).filter(F.col("label").isNotNull())
        union = part if union is None else union.unionByName(part)
    codes = written(dictionary(union), "codes")
    sizes = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [c for c in cols if sizes.get(c, 0) <= LITERAL]
    held: dict[str, dict[str, int]] = {c: {} for c in few}
    for r in codes.filter(F.col("feature").isin(few)).orderBy("feature", "code").collect():
        held[r["feature"]][r["label"]] = r["code"]
    return LabelEncoder(cols, held, codes)


class Preparation(Fitted):
    """Encoder, imputation values and the active feature list, fitted on train."""

    def __init__(self, encoder: LabelEncoder, fills: Mapping[str, float], features: Sequence[str]):
        super().__init__({"fills": dict(fills), "features": list(features)}, models={"encoder": encoder})

    @property
    def encoder(self) -> LabelEncoder:
        return self.models["encoder"]

    @property
    def fills(self) -> dict[str, float]:
        return self.state["fills"]

    @property
    def features(self) -> list[str]:
        return self.state["features"]

    def numbers(self, df: DataFrame) -> DataFrame:
        """Features as numbers: codes for labels, the median of train for what is missing."""
        return self.encoder.transform(df).withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(self.fills[f])) for f in self.features})

    def transform(self, df: DataFrame, vector: str = "features") -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol=vector).transform(self.numbers(df))


def fit_preparation(
    train: DataFrame, features: Sequence[str], categories: Sequence[str], others: Sequence[DataFrame] = (), missing_as_label: bool = True
) -> Preparation:
    """Label codes (fitted on train, or on the union with ``others``), features alive in train, medians."""
    present = [f for f in features if f in train.columns]
    encoder = fit_labels([train, *others], [c for c in categories if c in present], missing_as_label)
    coded = encoder.transform(train)
    alive = usable_columns(coded, present)
    return Preparation(encoder, medians(coded, alive), alive)
