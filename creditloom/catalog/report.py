"""Queries: descriptive report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query
from creditloom.catalog.panel import day
from creditloom.catalog.sqltools import bin_expr, edges_cte
from creditloom.functions.scalars import code_label, discount_factor, logit, percentage_points, rounded, sigmoid
from creditloom.operators import reports, survival


def quant(source: str, group: str, value: str, points: list[tuple[int, int]]) -> str:
    """CTE ``qs(g, q1, q2, ..)``: interpolated quantiles by integer rank."""
    cols = []
    for i, (a, b) in enumerate(points, 1):
        lo, rest = f"({a} * (n - 1)) // {b}", f"({a} * (n - 1)) % {b}"
        v0, v1 = f"max(CASE WHEN rn = {lo} THEN v END)", f"max(CASE WHEN rn = {lo} + 1 THEN v END)"
        cols.append(f"{v0} + CASE WHEN max({rest}) = 0 THEN 0 ELSE ({v1} - {v0}) * (max({rest}) / {b}.0::DOUBLE) END AS q{i}")
    return f"""
qr AS (SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS rn, count(*) OVER (PARTITION BY {group}) AS n
  FROM {source} WHERE {value} IS NOT NULL),
qs AS (SELECT g, {', '.join(cols)} FROM qr GROUP BY g)"""


@query("describe_loss", views="fx_lgd", sql="WITH " + quant("fx_lgd", "split", "lgd", [(1, 4), (1, 2), (3, 4)]) + """
SELECT split, count(*) AS n, round(avg(lgd), 6) AS mean, round(stddev_samp(lgd), 6) AS std, round(min(lgd), 6) AS min,
  round(any_value(q1), 6) AS p25, round(any_value(q2), 6) AS p50, round(any_value(q3), 6) AS p75, round(max(lgd), 6) AS max
FROM fx_lgd JOIN qs ON g = split GROUP BY 1""")
def describe_loss(spark, sf):
    d = reports.describe(base.lgd_rows(spark, sf).select("split", "lgd"), ["split"], "lgd")
    return d.withColumns({c: rounded(F.col(c)) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query("describe_originations", views="fx_loans", sql="WITH " + quant("fx_loans", "vintage", "orig_upb", [(1, 4), (1, 2), (3, 4)]) + """
SELECT vintage, count(*) AS n, round(avg(orig_upb) / 1000, 6) AS mean_k, round(min(orig_upb) / 1000, 6) AS min_k, round(any_value(q1) / 1000, 9) AS p25_k,
  round(any_value(q2) / 1000, 9) AS p50_k, round(any_value(q3) / 1000, 9) AS p75_k, round(max(orig_upb) / 1000, 6) AS max_k FROM fx_loans JOIN qs ON g = vintage GROUP BY 1""")
def describe_originations(spark, sf):
    d = reports.describe(base.loans(spark, sf), ["vintage"], "orig_upb")
    return d.select(
        "vintage", "n", *[rounded(F.col(c) / 1000).alias(f"{c}_k") for c in ("mean", "min", "max")],
        *[rounded(F.col(c) / 1000, 9).alias(f"{c}_k") for c in ("p25", "p50", "p75")],
    )


@query("monthly_default_rates", views="fx_panel", sql="""
SELECT vintage, strftime(report_date, '%Y-%m-%d') AS period, count(*) AS total,
  CAST(sum(CASE WHEN zero_balance_code IN ('02','03','06','09','15','16','96') THEN 1 ELSE 0 END) AS BIGINT) AS defaults,
  CAST(sum(CASE WHEN delinquency_status >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS dpd90,
  round(sum(CASE WHEN zero_balance_code IN ('02','03','06','09','15','16','96') THEN 1 ELSE 0 END) / count(*) * 100, 6) AS default_rate,
  round(sum(CASE WHEN delinquency_status >= 3 THEN 1 ELSE 0 END) / count(*) * 100, 6) AS dpd90_rate FROM fx_panel GROUP BY 1, 2""")
def monthly_default_rates(spark, sf):
    p = base.panel(spark, sf).withColumn("delinquency_status", F.col("delinquency_status").cast("string"))
    m = reports.monthly_rates(p)
    return m.withColumn("period", day("period")).withColumns({c: rounded(F.col(c)) for c in ("default_rate", "dpd90_rate")})


@query("cumulative_default_by_age", views="fx_panel", sql="""
WITH l AS (SELECT vintage, loan_seq_num, min(CASE WHEN zero_balance_code IN ('02','03','06','09','15','16','96') THEN loan_age END) AS a FROM fx_panel GROUP BY 1, 2)
SELECT vintage, CAST(k AS INTEGER) AS loan_age, count(*) AS n_loans, round(avg(CASE WHEN a <= k THEN 1 ELSE 0 END) * 100, 6) AS cum_default_pct
FROM l, (SELECT unnest(range(6, 61, 6)) AS k) GROUP BY 1, 2""")
def cumulative_default_by_age(spark, sf):
    c = reports.cumulative_default_by_age(base.panel(spark, sf))
    return c.withColumn("cum_default_pct", rounded(F.col("cum_default_pct")))


@query("occupancy_mix", views="fx_loans", sql="""
SELECT vintage, round(count(*) FILTER (WHERE channel = 'F') / count(*) * 100, 6) AS F, round(count(*) FILTER (WHERE channel = 'O') / count(*) * 100, 6) AS O,
  round(count(*) FILTER (WHERE channel = 'P') / count(*) * 100, 6) AS P FROM fx_loans GROUP BY 1""")
def occupancy_mix(spark, sf):
    m = reports.mix(base.loans(spark, sf), "vintage", "channel", ["F", "O", "P"])
    return m.select("vintage", *[rounded(F.col(c)).alias(c) for c in ("F", "O", "P")])


@query("default_rate_by_score_band", views="fx_pd", sql="""
WITH one AS (SELECT 1 AS g, credit_score, default_12m FROM fx_pd), """ + edges_cte("one", "g", "credit_score", 10) + f"""
SELECT CAST({bin_expr("credit_score")} AS INTEGER) AS band, count(*) AS n, round(avg(default_12m) * 100, 6) AS rate_pct FROM one, edges GROUP BY 1""")
def default_rate_by_score_band(spark, sf):
    r = reports.rate_by_band(base.pd_rows(spark, sf), "credit_score", "default_12m")
    return r.withColumn("rate_pct", rounded(F.col("rate_pct")))


@query("default_rate_by_quarter", views="fx_pd", sql="""
SELECT strftime(date_trunc('quarter', report_date), '%Y-%m-%d') AS quarter, count(*) AS n, round(avg(default_12m) * 100, 6) AS rate_pct FROM fx_pd GROUP BY 1""")
def default_rate_by_quarter(spark, sf):
    r = reports.rate_by_quarter(base.pd_rows(spark, sf), "report_date", "default_12m")
    return r.withColumn("quarter", day("quarter")).withColumn("rate_pct", rounded(F.col("rate_pct")))


@query("class_balance", views="fx_pd", sql="""
SELECT default_12m, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_pd GROUP BY 1""")
def class_balance(spark, sf):
    return reports.class_balance(base.pd_rows(spark, sf), "default_12m").withColumn("share", rounded(F.col("share")))


@query("balance_histogram", views="fx_loans", sql="""
WITH b AS (SELECT vintage, CASE WHEN orig_upb = 800000 THEN 40 ELSE CAST(floor(orig_upb / 20000) AS INTEGER) + 1 END AS bin_no FROM fx_loans WHERE orig_upb BETWEEN 0 AND 800000)
SELECT vintage, bin_no, (bin_no - 1) * 20000.0::DOUBLE AS lo, bin_no * 20000.0::DOUBLE AS hi, count(*) AS n,
  round(count(*) / (sum(count(*)) OVER (PARTITION BY vintage) * 20000) * 1000, 6) AS density_per_k FROM b GROUP BY 1, 2""")
def balance_histogram(spark, sf):
    h = reports.histogram(base.loans(spark, sf), ["vintage"], "orig_upb", 0, 800000, 40)
    return h.select("vintage", "bin_no", "lo", "hi", "n", rounded(F.col("density") * 1000).alias("density_per_k"))


@query("loss_by_channel", views="fx_lgd", sql="WITH " + quant("fx_lgd", "channel", "lgd", [(1, 2), (95, 100)]) + """
SELECT CASE channel WHEN 'O' THEN 'Other' WHEN 'F' THEN 'Final' ELSE channel END AS channel, count(*) AS n, round(avg(lgd), 6) AS mean,
  round(any_value(q1), 6) AS p50, round(any_value(q2), 6) AS p95 FROM fx_lgd JOIN qs ON g = channel GROUP BY 1""")
def loss_by_channel(spark, sf):
    p = reports.percentiles(base.lgd_rows(spark, sf).select("channel", "lgd"), ["channel"], "lgd", [(1, 2), (95, 100)], ["p50", "p95"])
    label = code_label(F.col("channel"), {"O": "Other", "F": "Final"}, F.col("channel"))
    return p.select(label.alias("channel"), "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "p50", "p95")])


@query("loss_histogram_by_channel", views="fx_lgd", sql="""
WITH b AS (SELECT channel, CASE WHEN lgd = 1 THEN 20 ELSE CAST(floor(20 * lgd::DOUBLE) AS INTEGER) + 1 END AS bin_no FROM fx_lgd)
SELECT channel, bin_no, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY channel) * 0.05::DOUBLE), 6) AS density FROM b GROUP BY 1, 2""")
def loss_histogram_by_channel(spark, sf):
    h = reports.histogram(base.lgd_rows(spark, sf), ["channel"], "lgd", 0, 1, 20)
    return h.select("channel", "bin_no", "n", rounded(F.col("density")).alias("density"))


@query("latest_rate_level", views="fx_ur", sql="""
SELECT arg_max(unemployment_rate, date) AS rate, strftime(max(date), '%Y-%m-%d') AS date FROM fx_ur""")
def latest_rate_level(spark, sf):
    from creditloom.sources import macro

    return macro.latest_level(base.unemployment(spark, sf)).withColumn("date", day("date"))


@query("vintage_era_counts", views="fx_pd", sql="""
WITH f AS (SELECT loan_seq_num, year(min(report_date)) AS y FROM fx_pd GROUP BY 1)
SELECT CASE WHEN y < 2004 THEN 'Pre-crisis (2000-2003)' WHEN y < 2008 THEN 'Crisis (2004-2007)' WHEN y < 2012 THEN 'Post-crisis (2008-2011)' ELSE 'Recovery (2012+)' END AS era,
  count(*) AS n, CAST(min(y) AS INTEGER) AS first_year FROM f GROUP BY 1""")
def vintage_era_counts(spark, sf):
    s = survival.survival_table(base.pd_rows(spark, sf), [])
    return s.groupBy(reports.vintage_era(F.col("orig_year")).alias("era")).agg(F.count(F.lit(1)).alias("n"), F.min("orig_year").alias("first_year"))


@query("scalar_transforms", views="fx_scores fx_loans", sql="""
SELECT s.loan_seq_num, s.score, round(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))), 6) + 0 AS logit,
  round(1 / (1 + exp(-score)), 6) AS sigmoid, round(1 / pow(1.05, (loan_seq_num % 20) / 4), 6) AS discount, round(score * 0.008 * 0.992 * 100, 6) AS pp
FROM fx_scores s""")
def scalar_transforms(spark, sf):
    s, x = base.scores(spark, sf), F.col("score")
    return s.select(
        "loan_seq_num", "score", rounded(logit(x)).alias("logit"), rounded(sigmoid(x)).alias("sigmoid"),
        rounded(discount_factor(F.col("loan_seq_num") % 20)).alias("discount"), rounded(percentage_points(x)).alias("pp"),
    )


@query("linear_trend_by_channel", views="fx_lgd", sql="""
SELECT channel, count(*) AS n, round(regr_slope(lgd, loan_age), 6) + 0 AS slope, round(regr_intercept(lgd, loan_age), 6) + 0 AS intercept,
  round(corr(loan_age, lgd), 6) + 0 AS r FROM fx_lgd GROUP BY 1""")
def linear_trend_by_channel(spark, sf):
    t = survival.linear_trend(base.lgd_rows(spark, sf), ["channel"], "lgd", "loan_age")
    return t.withColumns({c: rounded(F.col(c)) for c in ("slope", "intercept", "r")})
