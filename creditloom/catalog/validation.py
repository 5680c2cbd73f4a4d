"""Queries: discrimination and calibration metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query
from creditloom.catalog.binning import BAND_SQL
from creditloom.catalog.sqltools import bin_expr, edges_cte
from creditloom.functions.scalars import rounded
from creditloom.operators import metrics, reports

RANK_SQL = """
WITH t AS (SELECT split, score, count(*) AS n, CAST(sum(default_12m) AS BIGINT) AS pos FROM fx_scores GROUP BY 1, 2),
r AS (SELECT *, n - pos AS neg, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(n - pos) OVER w, 0) AS nb,
   sum(pos) OVER (PARTITION BY split) AS pt, sum(n - pos) OVER (PARTITION BY split) AS nt
   FROM t WINDOW w AS (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT split, CAST(sum(n) AS BIGINT) AS n, CAST(max(pt) AS BIGINT) AS n_defaults,
   sum(pos::DOUBLE * (nb::DOUBLE + neg::DOUBLE / 2)) / (max(pt)::DOUBLE * max(nt)::DOUBLE) AS auroc,
   max(abs((pb + pos) / pt - (nb + neg) / nt)) AS ks FROM r GROUP BY 1)
"""


@query("discrimination", views="fx_scores", sql=RANK_SQL + """
SELECT split, n, n_defaults, round(auroc, 6) AS auroc, round(ks, 6) AS ks, round(2 * auroc - 1, 6) + 0 AS gini FROM d""")
def discrimination(spark, sf):
    d = metrics.discrimination(base.scores(spark, sf), ["split"], "score", "default_12m")
    return d.withColumns({c: rounded(F.col(c)) for c in ("auroc", "ks", "gini")})


@query("roc_points", views="fx_scores", sql=RANK_SQL + """,
p AS (SELECT split, score AS threshold, (nt - nb) / nt AS fpr, (pt - pb) / pt AS tpr FROM r),
c AS (SELECT *, CAST(ceil(fpr * 100) AS INTEGER) AS cell, row_number() OVER (PARTITION BY split, CAST(ceil(fpr * 100) AS INTEGER) ORDER BY tpr DESC, fpr DESC, threshold DESC) AS rn FROM p)
SELECT split, cell, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM c WHERE rn = 1 UNION ALL SELECT DISTINCT split, -1, NULL, 0, 0 FROM p""")
def roc_points(spark, sf):
    r = metrics.roc_points(base.scores(spark, sf), ["split"], "score", "default_12m")
    return r.withColumns({c: rounded(F.col(c)) for c in ("fpr", "tpr")})


@query("split_metric_rows", views="fx_scores", sql=RANK_SQL + "," + BAND_SQL.strip()[5:] + """,
hl AS (SELECT split, count(*) AS n_bins, sum(pow(n_default - score_sum, 2) / greatest(score_sum, 1e-9)
   + pow((n - n_default) - (n - score_sum), 2) / greatest(n - score_sum, 1e-9)) AS x FROM bands GROUP BY 1)
SELECT d.split, n, n_defaults, round(auroc, 6) AS auroc, round(ks, 6) AS ks, round(2 * auroc - 1, 6) + 0 AS gini, round(x, 6) AS hl_stat,
  round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS hl_pval, 8 AS hl_dof, n_bins FROM d JOIN hl ON hl.split = d.split""")
def split_metric_rows(spark, sf):
    e = metrics.evaluate(base.scores(spark, sf), ["split"], "score", "default_12m")
    return e.withColumns({c: rounded(F.col(c)) for c in ("auroc", "ks", "gini", "hl_stat", "hl_pval")})


@query("model_comparison", views="fx_scores", sql="""
WITH two AS (SELECT 'Logistic Regression' AS model, split, score, default_12m FROM fx_scores
  UNION ALL SELECT 'Balance', split, orig_upb, default_12m FROM fx_scores),
t AS (SELECT model, split, score, sum(default_12m) AS pos, sum(1 - default_12m) AS neg FROM two GROUP BY 1, 2, 3),
r AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb, sum(pos) OVER g AS pt, sum(neg) OVER g AS nt
  FROM t WINDOW w AS (PARTITION BY model, split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY model, split))
SELECT model, split, round(sum(pos::DOUBLE * (nb::DOUBLE + neg::DOUBLE / 2)) / (max(pt)::DOUBLE * max(nt)::DOUBLE), 6) AS auroc,
  round(max(abs((pb + pos) / pt - (nb + neg) / nt)), 6) AS ks FROM r WHERE split IN ('oos', 'oot') GROUP BY 1, 2""")
def model_comparison(spark, sf):
    """The scored table beside a ranking by balance."""
    s = base.scores(spark, sf).filter(F.col("split").isin("oos", "oot"))
    d = metrics.compare_models({"Logistic Regression": s, "Balance": s.withColumn("score", F.col("orig_upb").cast("double"))})
    return d.select("model", "split", rounded(F.col("auroc")).alias("auroc"), rounded(F.col("ks")).alias("ks"))


@query("loss_error_metrics", views="fx_lgd", sql="""
WITH p AS (SELECT split, lgd AS y, 0.35 + 0.2 * (credit_score - 300) / 550 AS f1, 0.5::DOUBLE AS f2 FROM fx_lgd),
l AS (SELECT split, 'score_line' AS model, y, f1 AS f FROM p UNION ALL SELECT split, 'constant', y, f2 FROM p)
SELECT model, split, count(*) AS n, round(sqrt(avg((f - y) * (f - y))), 6) AS rmse, round(avg(abs(f - y)), 6) AS mae,
  round(1 - avg((f - y) * (f - y)) / var_pop(y), 6) + 0 AS r2, round(avg(f - y), 6) + 0 AS bias FROM l GROUP BY 1, 2""")
def loss_error_metrics(spark, sf):
    g = base.lgd_rows(spark, sf)
    wide = g.select("split", "lgd", (0.35 + 0.2 * (F.col("credit_score") - 300) / 550).alias("f1"), F.lit(0.5).alias("f2"))
    long = metrics.stack_columns(wide, ["split", "lgd"], {"f1": "score_line", "f2": "constant"}, "model", "predicted")
    e = metrics.regression_error(long, ["model", "split"], "lgd", "predicted")
    return e.withColumns({c: rounded(F.col(c)) for c in ("rmse", "mae", "r2", "bias")})


@query("brier_and_bias", views="fx_scores", sql="""
SELECT split, count(*) AS n, CAST(sum(default_12m) AS BIGINT) AS n_events, round(avg(pow(score - default_12m, 2)), 6) AS brier,
  round(avg(score) - avg(default_12m), 6) + 0 AS bias FROM fx_scores GROUP BY 1""")
def brier_and_bias(spark, sf):
    e = metrics.probability_error(base.scores(spark, sf), ["split"], "score", "default_12m")
    return e.withColumns({c: rounded(F.col(c)) for c in ("brier", "bias")})


REL_SQL = """
WITH b AS (SELECT split, CAST(""" + bin_expr("score", "[x / 10.0::DOUBLE for x in range(0, 11)]") + """ AS INTEGER) AS bin_no, score, default_12m FROM fx_scores),
rel AS (SELECT split, bin_no, count(*) AS n, avg(score) AS mp, avg(default_12m) AS ob FROM b WHERE bin_no IS NOT NULL GROUP BY 1, 2)
"""


@query("reliability_table", views="fx_scores", sql=REL_SQL + """
SELECT split, bin_no, n, round(mp, 6) AS mean_pred, round(ob, 6) AS observed, round(abs(ob - mp), 6) AS gap FROM rel""")
def reliability_table(spark, sf):
    r = metrics.reliability(base.scores(spark, sf), ["split"], "score", "default_12m")
    return r.withColumns({c: rounded(F.col(c)) for c in ("mean_pred", "observed", "gap")})


@query("calibration_error", views="fx_scores", sql=REL_SQL + """
SELECT split, round(sum(n * abs(ob - mp)) / sum(n), 6) AS ece, round(max(abs(ob - mp)), 6) AS mce FROM rel GROUP BY 1""")
def calibration_error(spark, sf):
    c = metrics.calibration_error(base.scores(spark, sf), ["split"], "score", "default_12m")
    return c.withColumns({k: rounded(F.col(k)) for k in ("ece", "mce")})


@query("long_run_default_rate", views="fx_scores", sql="""
WITH l AS (SELECT split, default_12m AS y, 'Raw' AS method, score AS p FROM fx_scores UNION ALL SELECT split, default_12m, 'Scaled', 0.9 * score + 0.1 FROM fx_scores)
SELECT split, method, count(*) AS n, round(avg(y) * 100, 6) AS observed_dr_pct, round(avg(p) * 100, 6) AS mean_pd_pct,
  round(avg(p) * 100 - avg(y) * 100, 6) + 0 AS bias_pp, CASE WHEN abs(avg(p) * 100 - avg(y) * 100) < 0.1 THEN 1 ELSE 0 END AS within_tolerance FROM l GROUP BY 1, 2""")
def long_run_default_rate(spark, sf):
    s = base.scores(spark, sf).withColumn("scaled", 0.9 * F.col("score") + 0.1)
    t = metrics.long_run_default_rate(s, "split", "default_12m", {"score": "Raw", "scaled": "Scaled"})
    return t.withColumns({c: rounded(F.col(c)) for c in ("observed_dr_pct", "mean_pd_pct", "bias_pp")})


@query("bias_tolerance_table", views="fx_scores", sql="""
WITH l AS (SELECT default_12m AS y, 'raw' AS method, score AS p FROM fx_scores WHERE split <> 'train'
   UNION ALL SELECT default_12m, 'half', score / 2 FROM fx_scores WHERE split <> 'train' UNION ALL SELECT default_12m, 'odds', score / (1 + score) FROM fx_scores WHERE split <> 'train')
SELECT 'all' AS split, method, count(*) AS n, round(avg(y) * 100, 6) AS observed_dr_pct, round(avg(p) * 100, 6) AS mean_pd_pct,
  round(avg(p) * 100 - avg(y) * 100, 6) + 0 AS bias_pp, CASE WHEN abs(avg(p) * 100 - avg(y) * 100) < 0.1 THEN 1 ELSE 0 END AS within_tolerance FROM l GROUP BY 1, 2""")
def bias_tolerance_table(spark, sf):
    s = base.scores(spark, sf).filter(F.col("split") != "train").withColumns({
        "half": F.col("score") / 2, "odds": F.col("score") / (1 + F.col("score")), "split": F.lit("all"),
    })
    t = metrics.long_run_default_rate(s, "split", "default_12m", {"score": "raw", "half": "half", "odds": "odds"})
    return t.withColumns({c: rounded(F.col(c)) for c in ("observed_dr_pct", "mean_pd_pct", "bias_pp")})


@query("score_separation", views="fx_scores", sql="""
WITH h AS (SELECT split, default_12m, least(CAST(floor(score / 0.02::DOUBLE) AS INTEGER) + 1, 50) AS bin_no, count(*) AS n FROM fx_scores GROUP BY 1, 2, 3),
""" + RANK_SQL.strip()[5:] + """
SELECT h.split, default_12m, bin_no, h.n, round(h.n / (sum(h.n) OVER (PARTITION BY h.split, default_12m) * 0.02::DOUBLE), 6) AS density, round(ks, 6) AS ks
FROM h JOIN d ON d.split = h.split""")
def score_separation(spark, sf):
    s = reports.score_separation(base.scores(spark, sf), ["split"], "score", "default_12m")
    return s.select("split", "default_12m", "bin_no", "n", rounded(F.col("density")).alias("density"), rounded(F.col("ks")).alias("ks"))
