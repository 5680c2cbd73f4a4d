"""Queries on fits and report tables whose result has a closed form, so that SQL gives the numbers themselves."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query
from creditloom.catalog.fits import LINEAR, LINEAR_SQL, linear_attributions, oos_scores
from creditloom.catalog.panel import CUT, day
from creditloom.catalog.report import quant
from creditloom.catalog.survive import COVARIATES, survival_rows
from creditloom.functions.scalars import rounded, sigmoid
from creditloom.operators import attribution, calibration, labels, models, reports, splits, survival, trees
from creditloom.session import written


def late_flag(df):
    """One yes-or-no feature, as a vector."""
    return VectorAssembler(inputCols=["late"], outputCol="features").transform(df.withColumn("late", F.col("delinquency_indicator").cast("double")))


@query("logistic_binary_odds", views="fx_pd", sql="""
WITH t AS (SELECT delinquency_indicator AS x, sum(default_12m)::DOUBLE AS p, sum(1 - default_12m)::DOUBLE AS n FROM fx_pd GROUP BY 1)
SELECT round(ln((SELECT p / n FROM t WHERE x = 0)), 4) + 0 AS intercept, round(ln((SELECT p / n FROM t WHERE x = 1) / (SELECT p / n FROM t WHERE x = 0)), 4) + 0 AS coefficient""")
def logistic_binary_odds(spark, sf):
    """Without a penalty the weight of a yes-or-no feature is its log odds ratio."""
    rows = late_flag(base.pd_rows(spark, sf).select("delinquency_indicator", "default_12m")).persist()
    m = models.fit_logistic(rows, "features", "default_12m", c=1e12)
    rows.unpersist()
    return spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, coefficient double").select(
        rounded(F.col("intercept"), 4).alias("intercept"), rounded(F.col("coefficient"), 4).alias("coefficient")
    )


STUMP = """
WITH c AS (SELECT sum(1 - default_12m)::DOUBLE / sum(default_12m) AS w, count(*)::DOUBLE AS n FROM fx_pd),
t AS (SELECT delinquency_indicator AS x, count(*) AS k, 2 * sum(default_12m * w)::DOUBLE / sum(default_12m * w + 1 - default_12m) - 1 AS v FROM fx_pd, c GROUP BY 1),
b AS (SELECT sum(k * 2 * v) / sum(k) AS base FROM t)"""


def stump(spark, sf):
    """One round of depth 1 on one yes-or-no feature: two leaves that hold the weighted class means."""
    rows = late_flag(base.pd_rows(spark, sf).select("loan_seq_num", "report_date", "delinquency_indicator", F.col("default_12m").cast("double").alias("label")))
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    weighted = rows.withColumn("w", F.when(F.col("label") == 1, counts[0] / counts[1]).otherwise(1.0))
    model = GBTClassifier(maxIter=1, maxDepth=1, weightCol="w", seed=1).fit(weighted)
    return rows, trees.read_trees(model, spark)


@query("boosted_stump_scores", views="fx_pd", sql=STUMP + """
SELECT x AS late, k AS n, round(1 / (1 + exp(-2 * v)), 6) AS score FROM t""")
def boosted_stump_scores(spark, sf):
    rows, tree = stump(spark, sf)
    scored = rows.select("late", sigmoid(models.margin_column(tree, [F.col("late")])).alias("score"))
    return scored.groupBy(F.col("late").cast("int").alias("late"), rounded(F.col("score")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("attribution_stump_rows", views="fx_pd", sql=STUMP + """
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, round(base, 6) + 0 AS base_value, round(2 * v - base, 6) + 0 AS shap_late, round(2 * v, 6) + 0 AS margin
FROM fx_pd JOIN t ON t.x = delinquency_indicator, b""")
def attribution_stump_rows(spark, sf):
    rows, tree = stump(spark, sf)
    out = attribution.tree_attributions(tree, rows, ["late"], keep=["loan_seq_num", "report_date"])
    return out.select("loan_seq_num", day("report_date").alias("report_date"), *[rounded(F.col(c)).alias(c) for c in ("base_value", "shap_late", "margin")])


@query("loss_stump_predictions", views="fx_lgd", sql="""
WITH t AS (SELECT CASE WHEN delinquency_status > 2 THEN 1 ELSE 0 END AS late, count(*) AS n, avg(lgd) AS v FROM fx_lgd GROUP BY 1) SELECT late, n, round(v, 6) AS predicted FROM t""")
def loss_stump_predictions(spark, sf):
    rows = late_flag(base.lgd_rows(spark, sf).select("lgd", (F.col("delinquency_status") > 2).cast("int").alias("delinquency_indicator")))
    tree = trees.read_trees(GBTRegressor(maxIter=1, maxDepth=1, labelCol="lgd", seed=1).fit(rows), spark)
    scored = rows.select("late", models.margin_column(tree, [F.col("late")]).alias("p"))
    return scored.groupBy(F.col("late").cast("int").alias("late"), rounded(F.col("p")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------ calibration
TWO = """
WITH s AS (SELECT CASE WHEN score > 0.2 THEN 0.6 ELSE 0.2 END AS x, default_12m AS y, (loan_seq_num * 31 + 7) % 100 < 50 AS cal FROM fx_scores WHERE split = 'oos'),
r AS (SELECT x, avg(y) AS p FROM s WHERE cal GROUP BY 1)"""


def two_levels(spark, sf):
    return oos_scores(spark, sf).withColumn("score", F.when(F.col("score") > 0.2, 0.6).otherwise(0.2))


@query("platt_two_levels", views="fx_scores", sql=TWO + """,
l AS (SELECT max(CASE WHEN x < 0.5 THEN ln(p / (1 - p)) END) AS a0, max(CASE WHEN x > 0.5 THEN ln(p / (1 - p)) END) AS a1 FROM r)
SELECT round((a1 - a0) / 0.4, 2) + 0 AS a, round(a0 - 0.2 * (a1 - a0) / 0.4, 2) + 0 AS b FROM l""")
def platt_two_levels(spark, sf):
    """Through two levels of the score the curve passes exactly."""
    p = calibration.fit_platt(two_levels(spark, sf).filter("half = 'cal'"), "score", "default_12m", c=1e9)
    return spark.createDataFrame([(p.a, p.b)], "a double, b double").select(*[rounded(F.col(c), 2).alias(c) for c in ("a", "b")])


@query("calibrated_two_levels", views="fx_scores", sql=TWO + """,
e AS (SELECT s.y, r.p FROM s JOIN r ON r.x = s.x WHERE NOT cal),
m AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_events, round(avg((p - y) * (p - y)), 4) AS brier, round(avg(p) - avg(y), 4) + 0 AS bias FROM e)
SELECT 'LR Platt' AS label, * FROM m UNION ALL SELECT 'LR Isotonic', * FROM m""")
def calibrated_two_levels(spark, sf):
    measured, _ = calibration.calibrate_models(two_levels(spark, sf), {"score": "LR"}, "default_12m")
    kept = measured.filter(F.col("label").isin("LR Platt", "LR Isotonic"))
    return kept.select("label", "n", "n_events", rounded(F.col("brier"), 4).alias("brier"), rounded(F.col("bias"), 4).alias("bias"))


# ------------------------------------------------------------------------------------------------ survival
@query("horizon_null_probability", views="fx_survival", sql="""
WITH t AS (SELECT duration AS t, sum(event)::DOUBLE AS d, count(*) AS c FROM fx_survival GROUP BY 1),
h AS (SELECT t, d / sum(c) OVER (ORDER BY t DESC) AS h FROM t)
SELECT loan_seq_num, event AS actual_default, """ + ", ".join(f"round(1 - exp(-(SELECT coalesce(sum(h), 0) FROM h WHERE t <= {m})), 6) AS pd_{m}m" for m in (12, 24, 36, 60)) + """ FROM fx_survival""")
def horizon_null_probability(spark, sf):
    """A covariate that is the same for all has no effect; the baseline is the sum of deaths over those at risk."""
    rows = survival_rows(spark, sf).withColumn("same", F.lit(1.0))
    h = survival.horizon_pds(survival.fit_cox(rows, ["same"]), rows)
    return h.select("loan_seq_num", "actual_default", *[rounded(F.col(f"pd_{m}m")).alias(f"pd_{m}m") for m in (12, 24, 36, 60)])


@query("cox_score_equations", sql="SELECT feature, TRUE AS solved FROM (VALUES ('credit_score'), ('orig_upb'), ('delinquency_indicator')) AS t(feature)")
def cox_score_equations(spark, sf):
    """Without ties the residuals of a covariate add up to the penalty's pull on its coefficient."""
    rows = survival_rows(spark, sf).withColumn("duration", F.col("duration") * 10_000_000 + F.col("loan_seq_num"))
    rows = written(rows.select("duration", "event", *COVARIATES), "cox-book")
    m = survival.fit_cox(rows, COVARIATES, tol=1e-14)
    sums = survival.schoenfeld_residuals(m, rows).groupBy("feature").agg(F.sum("residual").alias("s"))
    pull = [(f, float(0.1 * m.n * b * s * s), float(s)) for f, b, s in zip(m.features, m.coef, m.scales)]
    side = spark.createDataFrame(pull, "feature string, pull double, scale double")
    return sums.join(side, "feature").select("feature", (F.abs(F.col("s") - F.col("pull")) < 1e-5 * m.n * F.col("scale")).alias("solved"))


SCORED = """
WITH s AS (SELECT event, 1 - exp(-0.5::DOUBLE * exp(-credit_score / 300.0::DOUBLE)) AS a, 1 - exp(-2.0::DOUBLE * exp(-credit_score / 300.0::DOUBLE)) AS b FROM fx_survival),
l AS (SELECT '12m' AS k, a AS v FROM s UNION ALL SELECT '60m', b FROM s)"""


def closed_horizons(spark, sf):
    risk = F.exp(-F.col("credit_score") / F.lit(300.0))
    return survival_rows(spark, sf).select(F.col("event").alias("actual_default"), (1 - F.exp(-0.5 * risk)).alias("pd_12m"), (1 - F.exp(-2.0 * risk)).alias("pd_60m"))


@query("horizon_closed_summary", views="fx_survival", sql=SCORED + "," + quant("l", "k", "v", [(1, 2), (95, 100), (99, 100)]) + """
SELECT k AS horizon, count(*) AS n, round(avg(v), 6) AS mean, round(any_value(q1), 6) AS p50, round(any_value(q2), 6) AS p95, round(any_value(q3), 6) AS p99 FROM l JOIN qs ON g = k GROUP BY 1""")
def horizon_closed_summary(spark, sf):
    h = reports.horizon_summary(closed_horizons(spark, sf), {"pd_12m": "12m", "pd_60m": "60m"})
    return h.select("horizon", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("horizon_closed_calibration", views="fx_survival", sql="""
WITH s AS (SELECT event, round(1 - exp(-0.5::DOUBLE * exp(-credit_score / 300.0::DOUBLE)), 9) AS v, 1 AS one FROM fx_survival),
""" + quant("s", "one", "v", [(i, 10) for i in range(11)]) + """,
e AS (SELECT list_sort(list_distinct([q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11])) AS e FROM qs),
b AS (SELECT event, v, greatest(len(list_filter(e, lambda x: x < v)), 1) - 1 AS band FROM s, e)
SELECT CAST(band AS INTEGER) AS band, count(*) AS n, round(avg(v), 6) AS mean_pd, round(avg(event), 6) AS observed FROM b GROUP BY 1""")
def horizon_closed_calibration(spark, sf):
    c = survival.horizon_calibration(closed_horizons(spark, sf).withColumn("pd_12m", F.round("pd_12m", 9)))
    return c.select(F.col("band").cast("int").alias("band"), "n", rounded(F.col("mean_pd")).alias("mean_pd"), rounded(F.col("observed")).alias("observed"))


# ------------------------------------------------------------------------------------------------ report tables over closed-form attributions
DECILES = LINEAR_SQL + """,
r0 AS (SELECT loan_seq_num, report_date, default_12m, round(1 / (1 + exp(-(-2.0::DOUBLE + p1 + p2 + p3))), 9) AS v, p1, p2, p3, 1 AS one FROM s),
""" + quant("r0", "one", "v", [(i, 10) for i in range(11)]) + """,
e AS (SELECT list_sort(list_distinct([q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11])) AS e FROM qs),
d AS (SELECT r0.*, CAST(greatest(len(list_filter(e, lambda x: x < v)), 1) AS INTEGER) AS decile FROM r0, e)"""


def linear_scored(spark, sf):
    rows = linear_attributions(spark, sf)
    total = sum((F.col(f"shap_{f}") for f in LINEAR), F.col("base_value"))
    return rows.withColumn("predicted_pd", F.round(sigmoid(total), 9))


@query("linear_attribution_segments", views="fx_pd", sql=DECILES + """
SELECT decile, count(*) AS n_loans, round(avg(v) * 100, 6) AS mean_pd_pct, round(avg(default_12m) * 100, 6) AS observed_dr_pct,
  list_aggregate(list_transform(list_reverse_sort([(round(avg(abs(p1)), 9), 'FICO Score'), (round(avg(abs(p2)), 9), 'Original UPB ($)'), (round(avg(abs(p3)), 9), 'Loan Age (Months)')])[1:2], lambda t: t[2]), 'string_agg', ', ') AS drivers
FROM d GROUP BY 1""")
def linear_attribution_segments(spark, sf):
    t = attribution.segment_report(linear_scored(spark, sf), list(LINEAR), top=2)
    return t.select("decile", "n_loans", rounded(F.col("mean_pd_pct")).alias("mean_pd_pct"), rounded(F.col("observed_dr_pct")).alias("observed_dr_pct"), F.regexp_replace("top_drivers", r"\([0-9.]+\)", "").alias("drivers"))


@query("linear_attribution_by_decile", views="fx_pd", sql=DECILES + """,
g AS (SELECT decile, feature, avg(abs(phi)) AS m FROM (SELECT decile, unnest([('credit_score', p1), ('orig_upb', p2), ('loan_age', p3)]) AS t, t[1] AS feature, t[2] AS phi FROM d) GROUP BY 1, 2),
o AS (SELECT feature, CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS INTEGER) AS rank FROM l GROUP BY 1)
SELECT decile, g.feature, rank, round(m, 6) AS mean_abs, round(sum(m) OVER (PARTITION BY decile ORDER BY rank), 6) AS stacked FROM g JOIN o ON o.feature = g.feature WHERE rank <= 2""")
def linear_attribution_by_decile(spark, sf):
    t = attribution.leading_feature_profile(linear_scored(spark, sf), list(LINEAR), top=2)
    return t.select("decile", "feature", "rank", rounded(F.col("mean_abs")).alias("mean_abs"), rounded(F.col("stacked")).alias("stacked"))


@query("linear_attribution_dependence", views="fx_pd", sql=LINEAR_SQL + """,
x AS (SELECT credit_score::DOUBLE AS v, -0.004::DOUBLE * (credit_score - a) AS phi, orig_upb, 1 AS one FROM fx_pd, m),
""" + quant("x", "one", "v", [(i, 5) for i in range(6)]) + """,
u AS (SELECT one, orig_upb AS w FROM x),
""" + quant("u", "one", "w", [(2, 100), (98, 100)]).replace("qr AS", "ur AS").replace("qs AS", "us AS").replace("FROM qr", "FROM ur") + """,
b AS (SELECT greatest(len(list_filter(list_sort(list_distinct([qs.q1, qs.q2, qs.q3, qs.q4, qs.q5, qs.q6])), lambda e: e < v)), 1) AS bin_no, v, phi,
  least(greatest((orig_upb - us.q1) / greatest(us.q2 - us.q1, 1e-9), 0), 1) AS i FROM x, qs, us)
SELECT CAST(bin_no AS INTEGER) AS bin_no, count(*) AS n, round(avg(v), 6) AS mean_value, round(avg(phi), 6) + 0 AS mean_phi, round(avg(i), 6) AS mean_interaction FROM b GROUP BY 1""")
def linear_attribution_dependence(spark, sf):
    t = attribution.dependence_bins(linear_attributions(spark, sf), "credit_score", "orig_upb", k=5)
    return t.select(F.col("bin_no").cast("int").alias("bin_no"), "n", *[rounded(F.col(c)).alias(c) for c in ("mean_value", "mean_phi", "mean_interaction")])


@query("linear_attribution_density", views="fx_pd", sql=LINEAR_SQL + """,
span AS (SELECT feature, min(phi) AS lo, max(phi) AS hi, CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS INTEGER) AS rank FROM l GROUP BY 1)
SELECT l.feature, rank, CAST(least(floor((phi - lo) / (hi - lo) * 8), 7) AS INTEGER) AS cell, count(*) AS n FROM l JOIN span ON span.feature = l.feature WHERE rank <= 2 GROUP BY 1, 2, 3""")
def linear_attribution_density(spark, sf):
    return attribution.beeswarm_density(linear_attributions(spark, sf), list(LINEAR), top=2, bins=8).select("feature", "rank", "cell", "n")


@query("hash_split_bands", views="fx_pd", sql=f"""
WITH t AS (SELECT count(CASE WHEN report_date >= DATE '{CUT}' THEN 1 END) AS late, count(CASE WHEN report_date < DATE '{CUT}' THEN 1 END) AS early FROM fx_pd)
SELECT 'oot' AS part, late AS n, TRUE AS in_band FROM t UNION ALL SELECT 'in sample', early, TRUE FROM t""")
def hash_split_bands(spark, sf):
    """The time cut is exact; the hashed share of train lies within four deviations of 70 %."""
    rows = splits.temporal_split(labels.default_rows(base.panel(spark, sf)), "report_date", ["loan_seq_num", "report_date"], CUT)
    n = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    early = n.get("train", 0) + n.get("oos", 0)
    near = abs(n.get("train", 0) - 0.7 * early) <= 4 * (0.21 * early) ** 0.5
    return spark.createDataFrame([("oot", n.get("oot", 0), True), ("in sample", early, near)], "part string, n long, in_band boolean")
