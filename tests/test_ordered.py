import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import evidence, metrics, ordered, stability


def frame(spark, n=3000, parts=5, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=n), 3)
    v[: n // 3] = 0.125  # a third of all rows share one value
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "v": v, "y": rng.integers(0, 2, n), "w": rng.random(n)})
    return pdf, spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_quantiles_equal_numpy(spark, parts):
    pdf, df = frame(spark, parts=parts)
    got = {r["g"]: r["edges"] for r in ordered.exact_quantiles(df, ["g"], "v", ordered.even_probs(15)).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["v"], np.linspace(0, 1, 16)), atol=1e-12)


def test_quantiles_of_one_row_and_of_one_value(spark):
    one = spark.createDataFrame([("a", 2.0)], "g string, v double")
    assert ordered.exact_quantiles(one, ["g"], "v", [(1, 2)]).first()["edges"] == [2.0]
    same = spark.createDataFrame([("a", 2.0)] * 9, "g string, v double")
    assert ordered.exact_quantiles(same, ["g"], "v", ordered.even_probs(4)).first()["edges"] == [2.0] * 5


@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_running_totals(spark, buckets):
    pdf, df = frame(spark)
    t = ordered.tally(df, ["g"], "v", {"n": F.lit(1), "pos": F.col("y")})
    got = ordered.running_totals(t, ["g"], "v", ["n", "pos"], buckets).toPandas().sort_values(["g", "v"])
    want = pdf.groupby(["g", "v"]).agg(n=("y", "size"), pos=("y", "sum")).reset_index().sort_values(["g", "v"])
    for c in ("n", "pos"):
        before = want.groupby("g")[c].cumsum() - want[c]
        assert (got[f"{c}_before"].to_numpy() == before.to_numpy()).all()
        assert (got[f"{c}_total"].to_numpy() == want.groupby("g")[c].transform("sum").to_numpy()).all()


def test_auroc_and_ks_by_pairs(spark):
    pdf, df = frame(spark, n=300)
    got = {r["g"]: r for r in metrics.discrimination(df, ["g"], "v", "y").collect()}
    flipped = {r["g"]: r for r in metrics.discrimination(df.withColumn("v", -F.col("v")), ["g"], "v", "y").collect()}
    for g, part in pdf.groupby("g"):
        p, q = part.loc[part.y == 1, "v"].to_numpy()[:, None], part.loc[part.y == 0, "v"].to_numpy()[None, :]
        assert abs(got[g]["auroc"] - ((p > q) + 0.5 * (p == q)).mean()) < 1e-12
        assert abs(got[g]["auroc"] + flipped[g]["auroc"] - 1) < 1e-12
        cuts = np.unique(part["v"])
        ks = max(abs((p <= c).mean() - (q <= c).mean()) for c in cuts)
        assert abs(got[g]["ks"] - ks) < 1e-12


def test_single_class_gives_null(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0)], "g string, s double, y int")
    r = metrics.evaluate(df, ["g"], "s", "y").first()
    assert r["auroc"] is None and r["ks"] is None and r["hl_stat"] is None and r["n"] == 2


def test_psi_of_equal_samples_is_zero_and_iv_is_not_negative(spark):
    pdf, df = frame(spark)
    both = df.withColumn("s", F.lit("r")).unionByName(df.withColumn("s", F.lit("t")))
    psi = stability.population_stability(both, ["v", "g"], "s", "r").collect()
    assert len(psi) == 2 and all(abs(r["psi"]) < 1e-12 and r["flag"] == "Stable" for r in psi)
    assert all(r["iv"] >= 0 for r in evidence.information_value(df, ["v", "g"], "y").collect())


def test_woe_bin_without_bads_uses_the_floor(spark):
    df = spark.createDataFrame([("x", 0)] * 5 + [("z", 0), ("z", 1)], "f string, y int")
    rows = {r["label"]: r for r in evidence.woe_table(df, ["f"], "y").collect()}
    assert abs(rows["x"]["woe"] - np.log((5 / 6) / 1e-9)) < 1e-9


def test_concentration_without_distinct_order(spark):
    df = spark.createDataFrame([(1.0, 10.0)] * 10, "o double, a double")
    got = ordered.concentration(df, [], "o", "a", [(1, 5), (1, 2), (1, 1)]).orderBy("row_share").collect()
    assert [round(r["amount_share"], 12) for r in got] == [0.2, 0.5, 1.0]


def test_any_number_of_groups(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(5001), 3), "v": rng.normal(size=15003)})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["edges"][0] for r in ordered.exact_quantiles(df, ["g"], "v", [(1, 2)], many_groups=True).collect()}
    want = pdf.groupby("g").v.median()
    assert len(got) == 5001 and all(abs(got[g] - m) < 1e-12 for g, m in want.items())
    with pytest.raises(Exception, match="many_groups"):
        ordered.exact_quantiles(df, ["g"], "v", [(1, 2)]).collect()
