"""Rank intervals, tree tables and saved artefacts against plain computations."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from creditloom.operators import encoding, evidence, models, ranks, trees
from creditloom.session import fresh_path


# ------------------------------------------------------------------------------------------------ ranks
@given(st.lists(st.floats(allow_nan=False), min_size=1))
def test_bits_keep_the_order(values):
    x = np.array(values) + 0.0
    bits = ranks.ordered_bits(x)
    assert (ranks.from_bits(bits) == x).all()
    assert (np.argsort(x, kind="stable") == np.argsort(bits, kind="stable")).all()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(0)
    n = 5000
    pdf = pd.DataFrame({
        "a": rng.normal(size=n) * 10.0 ** rng.integers(-8, 8, n), "hot": np.where(rng.random(n) < 0.6, 7.0, rng.integers(0, 3000, n)),
        "few": rng.integers(0, 9, n).astype(float), "whole": rng.integers(-20, 10_000_000, n), "constant": 3.0, "empty": np.nan,
    })
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("double")).repartition(5)


@pytest.mark.parametrize("bounds", [{}, {"gather": 10, "cuts": 3}])
def test_quantiles_equal_numpy(numbers, bounds):
    pdf, df = numbers
    columns = list(pdf.columns)
    probs = [0, (1, 15), (1, 3), 0.5, (99, 100), 1]
    counts = ranks.interval_counts(df, columns, 16)
    assert {c: v.total for c, v in counts.items()} == {c: int(pdf[c].notna().sum()) for c in columns}
    got = ranks.column_quantiles(df, columns, probs, counts, **bounds)
    assert set(got) == set(columns) - {"empty"}
    for c, values in got.items():
        want = np.nanquantile(pdf[c].astype(float), [0, 1 / 15, 1 / 3, 0.5, 0.99, 1])
        assert np.allclose(values, want, rtol=1e-9, atol=1e-12), c


def test_few_values_are_exact(numbers, spark):
    pdf, df = numbers
    for limits in (2, 16):
        got = ranks.few_values(df, ranks.interval_counts(df, list(pdf.columns), limits), 10)
        assert got["few"] == sorted(pdf.few.unique().tolist()) and got["constant"] == [3.0] and got["empty"] == []
        assert got["a"] is None and got["hot"] is None and got["whole"] is None
    eleven = spark.createDataFrame([(float(i % 11),) for i in range(500)], "v double")
    assert ranks.few_values(eleven, ranks.interval_counts(eleven, ["v"], 3), 10)["v"] is None
    assert len(ranks.few_values(eleven, ranks.interval_counts(eleven, ["v"], 3), 11)["v"]) == 11


def test_bins_read_their_input_once(spark, numbers):
    """No exchange of the bin table's plan carries a value: everything is derived from the written counts."""
    pdf, df = numbers
    t = evidence.woe_table(df.withColumn("y", (F.col("a") > 0).cast("int")), ["a", "hot", "few"], "y", 5)
    assert "Generate" not in t._jdf.queryExecution().toString() and t.filter("feature = 'few'").count() == 9
    hot = t.filter("feature = 'hot'").orderBy("bin_no").collect()
    rows = pdf[pdf.a.notna()]
    assert sum(r["n_total"] for r in hot) == len(rows) and [r["lo"] for r in hot] == sorted(set(np.quantile(rows.hot, np.linspace(0, 1, 6))))[:-1]


# ------------------------------------------------------------------------------------------------ trees
@pytest.fixture(scope="module")
def boosted(spark):
    rng = np.random.default_rng(1)
    n = 1200
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame({"loan_seq_num": range(n), "report_date": pd.Timestamp("2001-01-01"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "default_12m": y, "kind": np.where(x[:, 0] > 1, "x", None)})
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_node_tables_give_the_models_margins(spark, boosted):
    pdf, df = boosted
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("label", F.col("default_12m").cast("double"))
    short, long = (GBTClassifier(maxIter=k, maxDepth=3, seed=4, stepSize=0.1, subsamplingRate=0.5, featureSubsetStrategy="0.8").fit(data) for k in (3, 6))
    held = trees.read_trees(long, spark)
    rows = long.transform(data).orderBy("loan_seq_num").select("rawPrediction").collect()
    x = pdf[["a", "b", "c"]].to_numpy()
    assert np.allclose(held.margins(x), [2 * r[0][1] for r in rows], atol=1e-12)
    # a longer fit with the same seed goes on from the shorter one
    assert np.array_equal(trees.read_trees(short, spark).margins(x), held.first(3).margins(x)) and np.allclose(held.staged(x)[:, 2], held.first(3).margins(x), atol=1e-12)
    assert np.allclose(held.importance(), long.featureImportances.toArray(), atol=1e-9)
    forest = RandomForestRegressor(numTrees=4, maxDepth=4, seed=2).fit(data)
    rows = forest.transform(data).orderBy("loan_seq_num").select("prediction").collect()
    assert np.allclose(trees.read_trees(forest, spark).margins(x), [r[0] for r in rows], atol=1e-12)
    again = trees.Trees.from_table(held.table(spark), 3)
    assert np.array_equal(again.margins(x), held.margins(x))


def test_nodes_come_as_columns(spark, boosted, monkeypatch):
    """A row object for each node of a long fit would fill the driver."""
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(boosted[1]).withColumn("label", F.col("default_12m").cast("double"))
    model = GBTClassifier(maxIter=2, maxDepth=2, seed=4).fit(data)

    def refuse(*rest, **more):
        raise AssertionError("rows of nodes at the driver")

    monkeypatch.setattr(type(data), "collect", refuse)
    held = trees.read_trees(model, spark)
    again = trees.Trees.from_table(held.table(spark), 3)
    names = ("tree", "feature", "threshold", "below", "above", "value", "count", "gain")
    assert held.n_trees == 2 and all(np.array_equal(getattr(held, n), getattr(again, n)) and getattr(held, n).dtype == getattr(again, n).dtype for n in names)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 140))
def test_cells_equal_changed_rows(seed, n_cells):
    rng = np.random.default_rng(seed)
    rows: list[list] = []
    for tree in range(3):  # random full trees of depth 3 on a coarse grid, so that ties with thresholds occur
        start = len(rows)
        for i in range(15):
            leaf = i >= 7
            rows.append([tree, -1 if leaf else int(rng.integers(0, 3)), float(rng.integers(-3, 4)), -1 if leaf else start + 2 * i + 1, -1 if leaf else start + 2 * i + 2, float(rng.normal()), 1.0, 0.0])
    columns = list(zip(*rows, strict=True))
    held = trees.Trees(*(np.array(c) for c in columns), 3)
    x = rng.integers(-4, 5, (20, 3)).astype(float)
    replace, add = {0: rng.integers(-4, 5, n_cells).astype(float)}, {1: rng.integers(0, 4, n_cells).astype(float)}
    got = held.cell_margins(x, replace, add, n_cells)
    for c in range(n_cells):
        changed = x.copy()
        changed[:, 0], changed[:, 1] = replace[0][c], changed[:, 1] + add[1][c]
        assert np.allclose(got[:, c], held.margins(changed), atol=1e-12)


# ------------------------------------------------------------------------------------------------ artefacts
def test_artefacts_come_back_whole(spark, boosted):
    _, df = boosted
    tree = models.fit_boosted_pd(df, ["a", "b", "kind"], ["kind"], block=4, maxIter=8, maxDepth=3, minInstancesPerNode=5, patience=3)
    line = models.fit_logistic_pd(df, ["a", "b", "kind"])
    path = fresh_path(spark, "both")
    PipelineModel([tree.into("t"), line.into("l")]).write().save(path)
    direct = line.transform(tree.transform(df, "t"), "l").orderBy("loan_seq_num").select("t", "l").collect()
    loaded = PipelineModel.load(path).transform(df).orderBy("loan_seq_num").select("t", "l").collect()
    assert direct == loaded
    back = models.BoostedPd.load(tree.save(fresh_path(spark, "one")))
    assert back.features == tree.features and back.aurocs == tree.aurocs and back.preparation.fills == tree.preparation.fills
    assert back.importance(spark).collect() == tree.importance(spark).collect()


def test_dictionary_numbers_labels_in_order_without_one_task(spark):
    rng = np.random.default_rng(3)
    words = sorted({f"{v:x}" for v in rng.integers(0, 1 << 40, 5000)})
    labels = spark.createDataFrame([("f", w) for w in words] * 2 + [("g", "z"), ("g", "a")], "feature string, label string").repartition(6)
    codes = {(r["feature"], r["label"]): r["code"] for r in encoding.dictionary(labels).collect()}
    assert codes == {**{("f", w): i for i, w in enumerate(words)}, ("g", "a"): 0, ("g", "z"): 1}
    rows = spark.createDataFrame([(w,) for w in words] + [(None,), ("unseen",)], "f string")
    encoder = encoding.fit_labels([rows.filter("f <> 'unseen'")], ["f"], missing_as_label=False)
    assert not encoder.state["few"]
    coded = encoder.transform(rows.withColumn("w", F.col("f"))).collect()
    place = {w: float(i) for i, w in enumerate(words)}
    assert len(coded) == len(words) + 2 and all(r["f"] == place.get(r["w"], 0.0) for r in coded)


def test_rows_without_a_target_belong_to_no_class(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (1,)], "y int")
    assert encoding.class_counts(df, "y") == {0: 1, 1: 2}


# ------------------------------------------------------------------------------------------------ layout by loan
def test_a_panel_laid_out_by_loan_needs_no_exchange(spark, tmp_path):
    from creditloom.operators import joins, labels, survival
    from creditloom.sources import tables

    rng = np.random.default_rng(5)
    panel = pd.DataFrame([(i, pd.Timestamp(2000 + m // 12, 1 + m % 12, 1).date(), m, "03" if m == 7 and i % 3 == 0 else None, 100.0 - m, None, 90.0, int(rng.integers(0, 2))) for i in range(60) for m in range(10)],
                         columns=["loan_seq_num", "report_date", "loan_age", "zero_balance_code", "current_upb", "actual_loss", "zero_balance_removal_upb", "default_12m"])
    schema = "loan_seq_num long, report_date date, loan_age int, zero_balance_code string, current_upb double, actual_loss double, zero_balance_removal_upb double, default_12m int"
    df = spark.createDataFrame(panel.astype(object).where(panel.notna(), None), schema).repartition(7)
    held = tables.write_by_key(df, f"{tmp_path}/panel", ["loan_seq_num"], buckets=4)
    loans = tables.write_by_key(df.select("loan_seq_num").distinct().withColumn("x", F.lit(1)), f"{tmp_path}/loans", ["loan_seq_num"], buckets=4)
    plain = lambda d: d.drop("default_12m")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (lambda d, o: joins.join_panel(d, o, ["loan_seq_num"]), lambda d, o: labels.first_default(d), lambda d, o: labels.default_rows(plain(d)), lambda d, o: survival.survival_table(d, [])):
            out = made(held, loans)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
            assert sorted(map(str, out.collect())) == sorted(map(str, made(df, loans).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
