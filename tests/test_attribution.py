import itertools
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler

from creditloom.catalog import fits
from creditloom.operators import attribution
from creditloom.operators.trees import Trees

FEATS = ["a", "b", "c"]


def expectation(leaves, x, known):
    total = 0.0
    for lf in leaves:
        p = lf.value
        for f, lo, hi, share in zip(lf.features, lf.lower, lf.upper, lf.share):
            p *= float(lo < x[f] <= hi) if f in known else share
        total += p
    return total


def test_values_equal_brute_force_and_add_up(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=FEATS)
    pdf["label"] = ((pdf.a + pdf.a * pdf.b + 0.3 * rng.normal(size=400)) > 0).astype(float)
    df = VectorAssembler(inputCols=FEATS, outputCol="features").transform(spark.createDataFrame(pdf)).repartition(3)
    model = GBTClassifier(maxIter=3, maxDepth=3, seed=1).fit(df)
    out = attribution.tree_attributions(model, df, FEATS, keep=FEATS).toPandas()
    sums = out[[f"shap_{f}" for f in FEATS]].sum(axis=1) + out.base_value
    assert np.abs(sums - out.margin).max() < 1e-9
    leaves = attribution.export_leaves(model, spark)
    for _, row in out.head(8).iterrows():
        x = row[FEATS].to_numpy(float)
        for i in range(3):
            others = [j for j in range(3) if j != i]
            phi = 0.0
            for k in range(3):
                for s in itertools.combinations(others, k):
                    phi += factorial(k) * factorial(2 - k) / 6 * (expectation(leaves, x, {*s, i}) - expectation(leaves, x, set(s)))
            assert abs(phi - row[f"shap_{FEATS[i]}"]) < 1e-9


def test_waterfall_ends_at_the_margin(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1, -0.4, 0.2)], "k int, base_value double, shap_a double, shap_b double, shap_c double")
    rows = attribution.waterfall(df, FEATS, ["k"], top=1).orderBy("position").collect()
    assert [r["feature"] for r in rows] == ["b", "(all other features)"]
    assert abs(rows[-1]["end"] - 0.4) < 1e-12 and abs(rows[0]["start"] - 0.5) < 1e-12


def test_places_of_features_answer_the_conditions_of_leaves():
    """Values at, between and beyond the cuts, and values that are no number."""
    ints, floats = (lambda *v: np.array(v, dtype=np.int64)), (lambda *v: np.array(v, dtype=float))
    # a <= 1 ? (a <= 0 ? 1 : 2) : (c <= 5 ? 3 : 4)
    trees = Trees(ints(*[0] * 7), ints(0, 0, 2, -1, -1, -1, -1), floats(1, 0, 5, 0, 0, 0, 0), ints(1, 3, 5, -1, -1, -1, -1), ints(2, 4, 6, -1, -1, -1, -1), floats(0, 0, 0, 1, 2, 3, 4), floats(10, 6, 4, 5, 1, 3, 1), np.zeros(7), 3)
    leaves = attribution.leaf_paths(trees)
    tables, base = attribution.leaf_tables(leaves, trees.cuts())
    x = np.array([[a, 9.0, c] for a in (-1, 0, 0.5, 1, 2, np.inf, np.nan) for c in (4, 5, 6, np.nan)], dtype=float)
    phi = np.zeros(x.shape)
    for t in tables:
        t.add(phi, attribution.feature_places(trees.cuts(), x))
    for row, found in zip(x, phi):
        full, none = expectation(leaves, row, {0, 2}), expectation(leaves, row, set())
        a, c = expectation(leaves, row, {0}), expectation(leaves, row, {2})
        assert np.allclose(found, [(a - none + full - c) / 2, 0, (c - none + full - a) / 2], atol=1e-12)
    assert abs(base - expectation(leaves, x[0], set())) < 1e-12


def test_reports_read_written_attributions(spark, monkeypatch):
    """A report that ranks rows reads them several times; the attributions are worked out once."""
    out = spark.range(60).selectExpr("id as loan_seq_num", "cast(id as double) / 60 as predicted_pd", "cast(id % 2 as int) as default_12m", "cast(id as double) as credit_score", "cast(id % 7 as double) as orig_upb", "id - 3.0d as shap_credit_score", "1.0d as shap_orig_upb")
    attributed = out.mapInArrow(lambda batches: batches, out.schema)
    monkeypatch.setattr(fits, "attributed", lambda spark, sf: (attributed, ["credit_score", "orig_upb"]))
    for q in (fits.attribution_segments, fits.attribution_by_decile, fits.attribution_dependence, fits.attribution_density):
        df = q(spark, "")
        assert df.count() > 0 and "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
