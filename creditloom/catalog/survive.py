"""Queries: survival tables and estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query, saved
from creditloom.catalog.panel import day
from creditloom.functions.scalars import rounded
from creditloom.operators import metrics, reports, survival

COVARIATES = ["credit_score", "orig_upb", "delinquency_indicator"]


def survival_rows(spark, sf):
    return survival.survival_table(base.pd_rows(spark, sf), COVARIATES, keep=("channel",))


def cox(spark, sf):
    return saved(spark, sf, "cox", survival.CoxArtefact, lambda: survival.CoxArtefact(survival.fit_cox(survival_rows(spark, sf), COVARIATES))).model


@query("survival_table", views="fx_survival", sql="""
SELECT loan_seq_num, CAST(duration AS INTEGER) AS duration, event, credit_score, delinquency_indicator, orig_upb, channel, strftime(first_date, '%Y-%m-%d') AS first_date FROM fx_survival""")
def survival_table(spark, sf):
    return survival_rows(spark, sf).select(
        "loan_seq_num", "duration", "event", "credit_score", "delinquency_indicator", "orig_upb", "channel", day("first_date").alias("first_date")
    )


@query("survival_by_default_date", views="fx_pd", sql="""
SELECT loan_seq_num, CAST(greatest(max(loan_age), 1) AS INTEGER) AS duration, max(CASE WHEN default_date IS NOT NULL THEN 1 ELSE 0 END) AS event FROM fx_pd GROUP BY 1""")
def survival_by_default_date(spark, sf):
    return survival.survival_table(base.pd_rows(spark, sf), [], event_source="default_date").select("loan_seq_num", "duration", "event")


KM_SQL = """
WITH t AS (SELECT channel, CAST(least(duration, 120) AS INTEGER) AS duration, CAST(sum(event) AS BIGINT) AS d, count(*) AS c FROM fx_survival GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY channel ORDER BY duration DESC) AS BIGINT) AS n FROM t),
k AS (SELECT *, product(1 - d / n) OVER w AS s, sum(CASE WHEN n > d THEN d / (n * (n - d)::DOUBLE) END) OVER w AS v FROM r WINDOW w AS (PARTITION BY channel ORDER BY duration))
"""


@query("kaplan_meier", views="fx_survival", sql=KM_SQL + """
SELECT channel, duration, n AS at_risk, d AS deaths, round(s, 6) AS survival,
  CASE WHEN s > 0 AND s < 1 THEN round(exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(v) / ln(s))), 6) WHEN s >= 1 THEN 1 END AS ci_lower,
  CASE WHEN s > 0 AND s < 1 THEN round(exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(v) / ln(s))), 6) WHEN s >= 1 THEN 1 END AS ci_upper FROM k""")
def kaplan_meier(spark, sf):
    k = survival.kaplan_meier(survival_rows(spark, sf), ["channel"])
    return k.withColumns({c: rounded(F.col(c)) for c in ("survival", "ci_lower", "ci_upper")})


@query("log_rank_two_groups", views="fx_survival", sql="""
WITH t AS (SELECT least(duration, 120) AS t, delinquency_indicator AS g, sum(event) AS d, count(*) AS c FROM fx_survival GROUP BY 1, 2),
times AS (SELECT DISTINCT t FROM t),
r AS (SELECT x.t, sum(CASE WHEN t.t >= x.t THEN c END) AS n, sum(CASE WHEN t.t >= x.t AND g = 0 THEN c ELSE 0 END) AS n0,
   sum(CASE WHEN t.t = x.t THEN d ELSE 0 END) AS d, sum(CASE WHEN t.t = x.t AND g = 0 THEN d ELSE 0 END) AS d0 FROM times x CROSS JOIN t GROUP BY 1),
s AS (SELECT sum(d0 - d * n0 / n) AS oe, sum(CASE WHEN n > 1 THEN d * (n0 / n) * (1 - n0 / n) * (n - d) / (n - 1) END) AS v FROM r WHERE d > 0)
SELECT 2 AS n_groups, 1 AS dof, round(oe * oe / v, 6) AS statistic FROM s""")
def log_rank_two_groups(spark, sf):
    r = survival.log_rank(survival_rows(spark, sf), "delinquency_indicator")
    return r.select("n_groups", "dof", rounded(F.col("statistic")).alias("statistic"))


@query("log_rank_by_channel", views="fx_survival", sql="""
WITH t AS (SELECT least(duration, 120) AS t, channel AS g, sum(event) AS d, count(*) AS c FROM fx_survival GROUP BY 1, 2),
times AS (SELECT DISTINCT t FROM t),
r AS (SELECT x.t, sum(CASE WHEN t.t >= x.t THEN c END)::DOUBLE AS n, sum(CASE WHEN t.t = x.t THEN d ELSE 0 END)::DOUBLE AS d,
   sum(CASE WHEN t.t >= x.t AND g = 'F' THEN c ELSE 0 END) / sum(CASE WHEN t.t >= x.t THEN c END)::DOUBLE AS p1, sum(CASE WHEN t.t = x.t AND g = 'F' THEN d ELSE 0 END) AS d1,
   sum(CASE WHEN t.t >= x.t AND g = 'O' THEN c ELSE 0 END) / sum(CASE WHEN t.t >= x.t THEN c END)::DOUBLE AS p2, sum(CASE WHEN t.t = x.t AND g = 'O' THEN d ELSE 0 END) AS d2
   FROM times x CROSS JOIN t GROUP BY 1),
w AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS w FROM r WHERE d > 0),
s AS (SELECT sum(d1 - d * p1) AS x1, sum(d2 - d * p2) AS x2, sum(w * p1 * (1 - p1)) AS v11, sum(w * p2 * (1 - p2)) AS v22, -sum(w * p1 * p2) AS v12 FROM w),
q AS (SELECT (x1 * x1 * v22 - 2 * x1 * x2 * v12 + x2 * x2 * v11) / (v11 * v22 - v12 * v12) AS stat FROM s)
SELECT 3 AS n_groups, 2 AS dof, round(stat, 6) AS statistic, round(exp(-stat / 2), 6) AS p_value FROM q""")
def log_rank_by_channel(spark, sf):
    r = survival.log_rank(survival_rows(spark, sf), "channel")
    return r.select("n_groups", "dof", rounded(F.col("statistic")).alias("statistic"), rounded(F.col("p_value")).alias("p_value"))


@query("concordance_index", views="fx_survival", sql="""
WITH c AS (SELECT credit_score / 550 + orig_upb / 1e7 AS r, duration AS d, sum(event) AS ev, sum(1 - event) AS ce FROM fx_survival GROUP BY 1, 2),
p AS (SELECT sum(a.ev * CASE WHEN b.d > a.d THEN b.ev + b.ce ELSE b.ce END * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END)::DOUBLE AS won,
   sum(a.ev * CASE WHEN b.d > a.d THEN b.ev + b.ce ELSE b.ce END) AS pairs FROM c a JOIN c b ON b.d >= a.d WHERE a.ev > 0)
SELECT CAST(pairs AS BIGINT) AS n_pairs, round(won / pairs, 6) AS c_index FROM p""")
def concordance_index(spark, sf):
    s = survival_rows(spark, sf).withColumn("risk", F.col("credit_score") / 550 + F.col("orig_upb") / 1e7)
    return survival.concordance_index(s, "risk").withColumn("c_index", rounded(F.col("c_index")))


@query("cox_coefficients")
def cox_coefficients(spark, sf):
    return survival.cox_summary(cox(spark, sf), spark)


@query("horizon_default_probability")
def horizon_default_probability(spark, sf):
    return survival.horizon_pds(cox(spark, sf), survival_rows(spark, sf))


@query("horizon_probability_summary")
def horizon_probability_summary(spark, sf):
    s = survival_rows(spark, sf)
    h = survival.horizon_pds(cox(spark, sf), s)
    return reports.horizon_summary(h, {f"pd_{m}m": f"{m}m" for m in (12, 24, 36, 60)})


@query("horizon_calibration")
def horizon_calibration(spark, sf):
    s = survival_rows(spark, sf)
    return survival.horizon_calibration(survival.horizon_pds(cox(spark, sf), s))


@query("schoenfeld_trend")
def schoenfeld_trend(spark, sf):
    s = survival_rows(spark, sf)
    r = survival.schoenfeld_residuals(cox(spark, sf), s)
    return survival.with_correlation_p(survival.linear_trend(r, ["feature"], "residual", "duration"))


@query("null_model_residual_trend", views="fx_survival", sql="""
WITH t AS (SELECT duration, count(*) AS c, sum(credit_score) AS x FROM fx_survival GROUP BY 1),
m AS (SELECT duration, sum(x) OVER (ORDER BY duration DESC) / sum(c) OVER (ORDER BY duration DESC) AS mu FROM t)
SELECT count(*) AS n, round(regr_slope(credit_score - mu, s.duration), 6) + 0 AS slope, round(corr(s.duration, credit_score - mu), 6) + 0 AS r
FROM fx_survival s JOIN m ON m.duration = s.duration WHERE event = 1""")
def null_model_residual_trend(spark, sf):
    """Residuals of a model with a zero coefficient: the risk-set means are plain means."""
    import numpy as np

    zero = survival.CoxModel(["credit_score"], np.zeros(1), np.ones(1), np.zeros(1), np.ones(1), 0.0, 0, 0, [], 0)
    r = survival.schoenfeld_residuals(zero, survival_rows(spark, sf))
    return survival.linear_trend(r, [], "residual", "duration").select("n", rounded(F.col("slope")).alias("slope"), rounded(F.col("r")).alias("r"))
