"""Steps whose work must not grow faster than the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import reports, scenarios, survival, trees
from creditloom.session import setting


def stump(feature, cut, low, high, tree=0, at=0):
    return [(tree, feature, cut, at + 1, at + 2, 0.0), (tree, -1, 0.0, -1, -1, low), (tree, -1, 0.0, -1, -1, high)]


def ensemble():
    rows = stump(0, 5.0, 1.0, 2.0) + stump(1, 0.5, 10.0, 20.0, 1, 3) + stump(0, 7.0, 100.0, 200.0, 2, 6)
    t, f, c, b, a, v = (np.array(x) for x in zip(*rows))
    return trees.Trees(t, f, c, b, a, v, np.ones(len(t)), np.ones(len(t)), 2)


def test_rows_that_no_split_tells_apart_pass_the_trees_once(monkeypatch):
    held = ensemble()
    x = np.random.default_rng(1).uniform(0, 10, (5000, 2))
    x[0, 0], x[1, 0], x[2] = 5.0, 7.0, np.nan
    want = np.where(x[:, 0] <= 5, 1, 2) + np.where(x[:, 1] <= 0.5, 10, 20) + np.where(x[:, 0] <= 7, 100, 200)
    seen = []
    plain = trees.Trees.leaves
    monkeypatch.setattr(trees.Trees, "leaves", lambda self, rows: seen.append(len(rows)) or plain(self, rows))
    assert np.array_equal(held.margins(x), want) and sum(seen) <= 6
    assert len(held.margins(x[:0])) == 0
    words = trees.Trees._words
    monkeypatch.setattr(trees.Trees, "_words", lambda self, rows, *a: seen.append(len(rows)) or words(self, rows, *a))
    seen.clear()
    cells = held.cell_margins(x, {0: np.array([4.0, 6.0, 8.0])}, {}, 3)
    assert seen == [2]
    assert np.array_equal(cells, np.array([101.0, 102.0, 202.0]) + np.where(x[:, 1] <= 0.5, 10, 20)[:, None])


def test_wide_percentiles_match_numpy_and_shuffle_no_value(spark):
    x = np.random.default_rng(2).normal(size=999)
    df = spark.createDataFrame([(float(v), float(i % 3) if i % 2 else None, None, float("nan") if i < 990 else 1.0) for i, v in enumerate(x)], "a double, b double, c double, d double")
    got = {r["k"]: r for r in reports.wide_percentiles(df, {c: [c] for c in "abcd"}, ["k"], [(1, 2), (99, 100)], ["p50", "p99"]).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["n"] == 999
    assert np.allclose([got["a"]["p50"], got["a"]["p99"]], np.percentile(x, [50, 99])) and got["a"]["mean"] == pytest.approx(x.mean())
    assert got["b"]["n"] == 499 and got["b"]["p50"] == 1.0 and np.isnan(got["d"]["p50"])


def test_long_paths_of_loans_dealt_out_are_not_shuffled(spark):
    loans = spark.range(50).select(F.col("id").alias("k"), F.array(F.lit(0.1), F.lit(0.5)).alias("pds_base"))
    dealt = scenarios.dealt_out(loans, ["k"], 2)
    w = scenarios.survival_window(scenarios.long_paths(dealt, scenarios.PATH_SCENARIOS[:1], ["k"]).select("k", "scenario", "quarter", "pd"), ["k"])
    assert w._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r["quarter"], round(r["alive"], 9), r["alive_before"]) for r in w.collect()} == {(1, 0.9, 1.0), (2, 0.45, 0.9)}


def test_cox_sums_of_a_range_match_the_sums_one_by_one():
    rng, p = np.random.default_rng(3), 2
    m, block = 40, 6
    z, died, n = rng.normal(size=(m, p)), np.arange(m) % 3, 5 + np.arange(m) % 4
    beta, later = np.array([0.3, -0.2]), np.array([2.0, 0.1, 0.2, 0.5, 0.1, 0.4])
    w = np.exp(z @ beta)
    flat = np.concatenate([np.ones((m, 1)), z, np.stack([z[:, 0] ** 2, z[:, 0] * z[:, 1], z[:, 1] ** 2], axis=1)], axis=1) * w[:, None]
    sums = np.concatenate([n[:, None], died[:, None], z * died[:, None], flat * n[:, None], flat * died[:, None]], axis=1)
    durations = rng.permutation(m) + 1
    value, grad, hess, times, rates = survival._cox_terms(durations, sums, beta, later)
    square = lambda f: np.array([[f[3], f[4]], [f[4], f[5]]])
    at, v, g, h, hazards = later.copy(), 0.0, np.zeros(p), np.zeros((p, p)), {}
    for k in np.argsort(-durations):
        risk, dead = sums[k, 2 + p : 2 + p + block], sums[k, 2 + p + block :]
        at = at + risk
        v += float(sums[k, 2 : 2 + p] @ beta)
        g += sums[k, 2 : 2 + p]
        for l in range(died[k]):
            f = at - l / died[k] * dead
            mean = f[1:3] / f[0]
            v -= np.log(f[0])
            g -= mean
            h -= square(f) / f[0] - np.outer(mean, mean)
        if died[k]:
            hazards[durations[k]] = died[k] / at[0]
    assert value == pytest.approx(v) and np.allclose(grad, g) and np.allclose(hess, h)
    assert dict(zip(times.tolist(), rates)) == pytest.approx(hazards)


def test_a_setting_ends_with_its_block(spark, tmp_path):
    from creditloom.catalog import files

    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    with pytest.raises(ValueError), setting(spark, key, "7"):
        assert spark.conf.get(key) == "7"
        raise ValueError
    path = files._write_text(spark.range(6).select(F.col("id").alias("a"), (F.col("id") % 3).alias("vintage")), ["a", "b"], str(tmp_path / "out"))
    assert spark.conf.get(key, None) == before
    assert {(r["value"], r["n"]) for r in spark.read.text(path).groupBy("value").agg(F.count("*").alias("n")).collect()} == {(f"{i}|", 1) for i in range(6)}
