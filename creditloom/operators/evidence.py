"""Weight of evidence and information value for many features in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.scalars import case_below, right_closed_bin
from creditloom.operators.fitted import Fitted
from creditloom.operators.ordered import even_probs, pinned
from creditloom.operators.ranks import column_quantiles, few_values, interval_counts
from creditloom.session import written

FLOOR = 1e-9
CATEGORY_LIMIT = 10
#: Labels of a feature that are written into a plan as literals.
LITERAL = 256


def split_by_type(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, text) names, in the given order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [f for f in features if isinstance(kinds[f], (T.StringType, T.BooleanType))]
    return [f for f in features if f not in text], text


def feature_tally(df: DataFrame, features: Sequence[str], keep: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Distinct values of every feature with sums: (keep.., feature, value, label, sums..).

    Numeric features fill ``value``, text features fill ``label``. Features become rows by an in-place
    ``inline`` and are combined before the shuffle, so the input is read once for all features and what
    is shuffled is distinct values, not rows.
    """
    numeric, text = split_by_type(df, features)
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def usable(name: str) -> Column:
        v = F.col(name).cast("double")
        return F.when(~F.isnan(v), v)

    cells = [F.struct(F.lit(f).alias("feature"), usable(f).alias("value"), none_s.alias("label")) for f in numeric]
    cells += [F.struct(F.lit(f).alias("feature"), none_d.alias("value"), F.col(f).cast("string").alias("label")) for f in text]
    measured = df.select(*keep, *[e.alias(f"_m_{n}") for n, e in sums.items()], F.array(*cells).alias("_cells"))
    long = measured.select(*keep, *[f"_m_{n}" for n in sums], F.inline("_cells"))
    grouped = long.filter(F.col("value").isNotNull() | F.col("label").isNotNull()).groupBy(*keep, "feature", "value", "label")
    return pinned(grouped.agg(*[F.sum(f"_m_{n}").alias(n) for n in sums]), list(sums))


def number_label(value: Column) -> Column:
    """Label of a number used as a category: whole numbers without decimals."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


@dataclass
class Bins:
    """How features are binned: edges of numeric ones; all others are categories, labelled by their text."""

    edges: dict[str, list[float]]
    numeric: list[str]
    text: list[str]

    def cells(self) -> Column:
        """Array of (feature, kind, bin_no, label), one for each feature."""
        none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
        out = []
        for f in self.numeric:
            v = F.col(f).cast("double")
            v = F.when(~F.isnan(v), v)
            kind, bin_no, label = ("num", literal_bin(v, self.edges[f]), none_s) if f in self.edges else ("cat", none_i, number_label(v))
            out.append(F.struct(F.lit(f).alias("feature"), F.lit(kind).alias("kind"), bin_no.alias("bin_no"), label.alias("label")))
        out += [F.struct(F.lit(f).alias("feature"), F.lit("cat").alias("kind"), none_i.alias("bin_no"), F.col(f).cast("string").alias("label")) for f in self.text]
        return F.array(*out)

    def bounds(self) -> Column:
        """Edges of the row's ``feature``, null for a category."""
        pairs = [x for f, e in self.edges.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in e]))]
        return F.element_at(F.create_map(*pairs), F.col("feature")) if pairs else F.lit(None).cast("array<double>")


def literal_bin(c: Column, edges: Sequence[float]) -> Column:
    """:func:`right_closed_bin` for known edges, as one compiled chain of comparisons."""
    out = F.when((c < edges[0]) | (c > edges[-1]), F.lit(None).cast("int"))
    for i, e in enumerate(edges[1:] or edges, 1):
        out = out.when(c <= e, F.lit(i))
    return out


def fit_bins(df: DataFrame, features: Sequence[str], n_bins: int) -> Bins:
    """Equal-frequency edges of the numeric features with more than ``CATEGORY_LIMIT`` values, duplicate edges removed. Reads ``df`` three times or four."""
    numeric, text = split_by_type(df, features)
    if not numeric:
        return Bins({}, [], text)
    counts = interval_counts(df, numeric)
    few = few_values(df, counts, CATEGORY_LIMIT)
    many = [f for f in numeric if few.get(f) is None and counts[f].total]
    edges = column_quantiles(df, many, even_probs(n_bins), counts) if many else {}
    return Bins({f: sorted(set(e)) for f, e in edges.items()}, numeric, text)


def woe_table(df: DataFrame, features: Sequence[str], target: str = "default_12m", n_bins: int = 15) -> DataFrame:
    """One row per feature and bin.

    Columns: feature, kind ('num' or 'cat'), bin_no, lo, hi, label, n_total, n_good, n_bad, default_rate,
    woe, iv_component, iv_total. Text features and features with at most 10 distinct values are
    categories; the others get equal-frequency bins, right-closed. Shares are floored at 1e-9, totals at 1.
    Rows missing the feature are left out.

    The needed columns are kept while bins are fitted and counted, so ``df`` is worked out once; the counts, a row for each bin, are
    written and everything else is derived from them.
    """
    y = F.col(target)
    narrow = df.filter(y.isNotNull()).select(target, *features).persist()
    try:
        bins = fit_bins(narrow, features, n_bins)
        long = narrow.select(F.col(target).alias("_y"), F.inline(bins.cells())).filter(F.col("bin_no").isNotNull() | F.col("label").isNotNull())
        counted = long.groupBy("feature", "kind", "bin_no", "label").agg(
            F.count(F.lit(1)).alias("n_total"), F.count(F.when(F.col("_y") == 0, 1)).alias("n_good"), F.count(F.when(F.col("_y") == 1, 1)).alias("n_bad")
        )
        counted = written(counted, "bins")
    finally:
        narrow.unpersist()
    one = F.lit(1)
    totals = counted.groupBy("feature").agg(F.sum("n_good").alias("_g"), F.sum("n_bad").alias("_b"))
    placed = counted.join(totals, "feature")
    p, q = (F.col(n) / F.when(F.col(t) > 1, F.col(t)).otherwise(one) for n, t in (("n_good", "_g"), ("n_bad", "_b")))
    placed = placed.withColumn("_p", F.when(p < FLOOR, FLOOR).otherwise(p)).withColumn("_q", F.when(q < FLOOR, FLOOR).otherwise(q))
    woe = F.log(F.col("_p") / F.col("_q"))
    placed = placed.withColumn("woe", woe).withColumn("iv_component", (F.col("_p") - F.col("_q")) * woe).withColumn("_e", bins.bounds())
    iv = placed.groupBy("feature").agg(F.sum("iv_component").alias("iv_total"))
    return placed.join(iv, "feature").select(
        "feature", "kind", "bin_no",
        F.try_element_at("_e", F.col("bin_no")).alias("lo"),
        F.try_element_at("_e", F.col("bin_no") + 1).alias("hi"),
        "label", "n_total", "n_good", "n_bad",
        (F.col("n_bad") / F.col("n_total")).alias("default_rate"),
        "woe", "iv_component", "iv_total",
    )


def iv_strength(iv: Column) -> Column:
    # Published strength bands of the information value.
    return case_below(iv, [(0.02, "Negligible"), (0.10, "Weak"), (0.30, "Medium"), (0.50, "Strong")], "Very strong")


def information_value(df: DataFrame, features: Sequence[str], target: str = "default_12m", n_bins: int = 15) -> DataFrame:
    """(feature, iv, strength), largest first."""
    return iv_from_woe(woe_table(df, features, target, n_bins))


def iv_from_woe(table: DataFrame) -> DataFrame:
    iv = F.round(F.sum("iv_component"), 6)
    return (
        table.groupBy("feature").agg(iv.alias("iv"))
        .withColumn("strength", iv_strength(F.col("iv")))
        .orderBy(F.desc("iv"), "feature")
    )


class WoeModel(Fitted):
    """Fitted encoding. Edges and values of numeric features and of text features with up to ``LITERAL`` labels are literals; other text features are joined
    with the table."""

    def __init__(self, numeric: dict, categories: dict, texts: dict, names: Sequence[str], table: DataFrame):
        super().__init__({"numeric": numeric, "categories": categories, "texts": texts, "names": list(names)}, {"woe": table})

    @property
    def names(self) -> list[str]:
        return self.state["names"]

    @property
    def table(self) -> DataFrame:
        return self.tables["woe"]

    def transform(self, df: DataFrame, suffix: str = "_woe") -> DataFrame:
        """Add one WoE column per feature. Missing, out-of-range and unseen values score 0."""
        out = df
        cols: dict[str, Column] = {}
        for name, (edges, by_bin) in self.state["numeric"].items():
            bin_no = right_closed_bin(F.col(name).cast("double"), F.array(*[F.lit(e) for e in edges]))
            cols[name + suffix] = F.coalesce(F.try_element_at(F.array(*[F.lit(w) for w in by_bin]), bin_no), F.lit(0.0))
        for held, kind in (("categories", "double"), ("texts", "string")):
            for name, pairs in self.state[held].items():
                literals = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
                cols[name + suffix] = F.coalesce(F.element_at(literals, F.col(name).cast(kind)), F.lit(0.0))
        if cols:
            out = out.withColumns(cols)
        for name in self.names:
            if name + suffix not in cols:
                side = self.table.filter(F.col("feature") == name).select(F.col("label").alias("_label"), F.col("woe").alias(name + suffix))
                out = out.join(side, F.col(name).cast("string") == F.col("_label"), "left").drop("_label").fillna(0.0, [name + suffix])
        return out


def fit_woe(train: DataFrame, features: Sequence[str], target: str = "default_12m", n_bins: int = 15) -> WoeModel:
    """Learn the encoding on train rows. WoE is rounded to 6 places, as in the reported table."""
    table = written(woe_table(train, features, target, n_bins).withColumn("woe", F.round("woe", 6)), "woe")
    _, text = split_by_type(train, features)
    sizes = {r["feature"]: r["n"] for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [f for f, n in sizes.items() if n <= LITERAL]
    # At most n_bins (or 10) rows per numeric feature, LITERAL rows per text feature.
    by_feature: dict[str, list] = {}
    for r in table.filter(F.col("feature").isin(few)).orderBy("feature", "bin_no", "label").collect():
        by_feature.setdefault(r["feature"], []).append(r)
    numeric, categories, texts = {}, {}, {}
    for name, mine in by_feature.items():
        if name in text:
            texts[name] = [[r["label"], float(r["woe"])] for r in mine]
        elif mine[0]["kind"] == "num":
            lows, highs = {r["bin_no"]: r["lo"] for r in mine}, {r["bin_no"]: r["hi"] for r in mine}
            edges = [lows[min(lows)]] + [highs[b] for b in sorted(highs)]
            woes = {r["bin_no"]: float(r["woe"]) for r in mine}
            numeric[name] = [edges, [woes.get(b, 0.0) for b in range(1, len(edges))]]
        else:
            categories[name] = [[float(r["label"]), float(r["woe"])] for r in mine]
    return WoeModel(numeric, categories, texts, [f for f in features if f in sizes], table)


def category_screen(df: DataFrame, features: Sequence[str], limit: int = CATEGORY_LIMIT) -> DataFrame:
    """(feature, n_distinct, is_category): text, or at most ``limit`` distinct values. Exact, from the tally."""
    t = feature_tally(df, features, [], {"n": F.lit(1)})
    text = F.max(F.col("label").isNotNull())
    return t.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"), (text | (F.count(F.lit(1)) <= limit)).cast("int").alias("is_category")
    )
