"""Queries: joins, labels, cleaning predicates, splits and samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query
from creditloom.functions.scalars import rounded
from creditloom.operators import joins, labels, reports, splits


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("panel_join", views="fx_panel", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, vintage, loan_age, zero_balance_code, channel,
       current_upb, orig_upb, credit_score FROM fx_panel""")
def panel_join(spark, sf):
    return base.panel(spark, sf).select(
        "loan_seq_num", day("report_date").alias("report_date"), "vintage", "loan_age", "zero_balance_code", "channel",
        "current_upb", "orig_upb", "credit_score",
    )


@query("price_change_lookup", views="fx_panel fx_hpi", sql="""
SELECT p.loan_seq_num, strftime(p.report_date, '%Y-%m-%d') AS report_date, o.hpi_index AS hpi_orig, c.hpi_index AS hpi_curr,
       round(CASE WHEN c.hpi_index > 0 THEN o.hpi_index / c.hpi_index END, 6) AS hpi_change
FROM fx_panel p
LEFT JOIN fx_hpi o ON o.zip3 = p.zip3 AND o.year = year(p.orig_date) AND o.quarter = quarter(p.orig_date)
LEFT JOIN fx_hpi c ON c.zip3 = p.zip3 AND c.year = year(p.report_date) AND c.quarter = quarter(p.report_date)""")
def price_change_lookup(spark, sf):
    return joins.attach_price_change(base.panel(spark, sf), base.price_index(spark, sf)).select(
        "loan_seq_num", day("report_date").alias("report_date"), "hpi_orig", "hpi_curr", rounded(F.col("hpi_change")).alias("hpi_change")
    )


ASOF_SQL = """
WITH lags AS (SELECT DISTINCT report_date, CAST(report_date - INTERVAL 3 MONTH AS DATE) AS lag_date FROM fx_panel),
near AS (SELECT report_date, unemployment_rate, row_number() OVER (PARTITION BY report_date
           ORDER BY abs(datediff('day', date, lag_date)), date) AS rn
         FROM lags JOIN fx_ur ON abs(datediff('day', date, lag_date)) <= 45)
"""


@query("nearest_rate_lag", views="fx_panel fx_ur", sql=ASOF_SQL + """
SELECT p.loan_seq_num, strftime(p.report_date, '%Y-%m-%d') AS report_date, n.unemployment_rate AS ur_3m_lag
FROM fx_panel p LEFT JOIN near n ON n.report_date = p.report_date AND n.rn = 1""")
def nearest_rate_lag(spark, sf):
    return joins.attach_rate_lag(base.panel(spark, sf), base.unemployment(spark, sf)).select(
        "loan_seq_num", day("report_date").alias("report_date"), "ur_3m_lag"
    )


@query("first_default_date", views="fx_first_default", sql="""
SELECT loan_seq_num, strftime(default_date, '%Y-%m-%d') AS default_date FROM fx_first_default""")
def first_default_date(spark, sf):
    return labels.first_default(base.panel(spark, sf)).select("loan_seq_num", day("default_date").alias("default_date"))


@query("default_label_rows", views="fx_pd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, strftime(default_date, '%Y-%m-%d') AS default_date,
       default_12m, credit_score, orig_upb, loan_age, occupancy_status FROM fx_pd""")
def default_label_rows(spark, sf):
    return labels.default_rows(base.panel(spark, sf)).select(
        "loan_seq_num", day("report_date").alias("report_date"), day("default_date").alias("default_date"),
        "default_12m", "credit_score", "orig_upb", "loan_age", "occupancy_status",
    )


@query("default_predicate_counts", views="fx_panel", sql="""
SELECT vintage, count(*) AS n, CAST(sum(CASE WHEN zero_balance_code IN ('02','03','06','09','15') THEN 1 ELSE 0 END) AS BIGINT) AS n_default,
       CAST(sum(CASE WHEN zero_balance_code IN ('02','03','06','09','15','16','96') THEN 1 ELSE 0 END) AS BIGINT) AS n_default_wide
FROM fx_panel GROUP BY 1""")
def default_predicate_counts(spark, sf):
    return base.panel(spark, sf).groupBy("vintage").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(labels.is_default().cast("int")).alias("n_default"),
        F.sum(labels.is_default(labels.WIDE_DEFAULT_CODES).cast("int")).alias("n_default_wide"),
    )


@query("loss_label_rows", views="fx_lgd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, round(lgd_raw, 6) AS lgd_raw, round(lgd, 6) AS lgd,
       current_upb, zero_balance_removal_upb FROM fx_lgd""")
def loss_label_rows(spark, sf):
    return labels.loss_rows(base.panel(spark, sf)).select(
        "loan_seq_num", day("report_date").alias("report_date"), rounded(F.col("lgd_raw")).alias("lgd_raw"),
        rounded(F.col("lgd")).alias("lgd"), "current_upb", "zero_balance_removal_upb",
    )


@query("resolution_last_known", views="fx_panel", sql="""
SELECT loan_seq_num, arg_max(actual_loss, report_date) FILTER (WHERE actual_loss IS NOT NULL) AS actual_loss,
       arg_max(zero_balance_removal_upb, report_date) FILTER (WHERE zero_balance_removal_upb IS NOT NULL) AS zero_balance_removal_upb,
       arg_max(zero_balance_code, report_date) FILTER (WHERE zero_balance_code IS NOT NULL) AS zero_balance_code
FROM fx_panel GROUP BY 1""")
def resolution_last_known(spark, sf):
    p = base.panel(spark, sf)
    return labels.last_known(p, ["loan_seq_num"], "report_date", ["actual_loss", "zero_balance_removal_upb", "zero_balance_code"]).drop("report_date")


@query("complete_case_rows", views="fx_panel", sql="""
WITH marked AS (SELECT *, CASE WHEN vintage % 2 = 0 THEN actual_loss END AS part_loss FROM fx_panel),
has AS (SELECT vintage, count(part_loss) AS a, count(zero_balance_removal_upb) AS b FROM marked GROUP BY 1)
SELECT m.loan_seq_num, strftime(m.report_date, '%Y-%m-%d') AS report_date, m.vintage FROM marked m JOIN has h ON h.vintage = m.vintage
WHERE (m.part_loss IS NOT NULL OR h.a = 0) AND (m.zero_balance_removal_upb IS NOT NULL OR h.b = 0)""")
def complete_case_rows(spark, sf):
    p = base.panel(spark, sf).withColumn("part_loss", F.when(F.col("vintage") % 2 == 0, F.col("actual_loss")))
    return labels.complete_cases(p, ["part_loss", "zero_balance_removal_upb"], within="vintage").select(
        "loan_seq_num", day("report_date").alias("report_date"), "vintage"
    )


@query("usable_feature_counts", views="fx_panel", sql="""
WITH n AS (SELECT count(actual_loss) AS a, count(zero_balance_removal_upb) AS b, count(credit_score) AS c, count(CASE WHEN credit_score < 0 THEN 1 END) AS d FROM fx_panel)
SELECT feature, n > 0 AS usable, n FROM (SELECT 'actual_loss' AS feature, a AS n FROM n UNION ALL SELECT 'zero_balance_removal_upb', b FROM n
  UNION ALL SELECT 'credit_score', c FROM n UNION ALL SELECT 'never', d FROM n)""")
def usable_feature_counts(spark, sf):
    p = base.panel(spark, sf).withColumn("never", F.when(F.col("credit_score") < 0, 1))
    names = ["actual_loss", "zero_balance_removal_upb", "credit_score", "never"]
    live = labels.usable_columns(p, names)
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(c in live).alias("usable"), F.count(c).alias("n")) for c in names]
    return p.agg(F.array(*cells).alias("r")).select(F.inline("r"))


CUT = dt.date(2000, 6, 1)


@query("laid_out_default_rows", views="fx_pd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, default_12m, strftime(default_date, '%Y-%m-%d') AS default_date FROM fx_pd""")
def laid_out_default_rows(spark, sf):
    """Default labels from the panel written in buckets of loans: join and first default read it as it lies."""
    from creditloom.session import fresh_path
    from creditloom.sources import tables

    panel = tables.write_by_key(base.panel(spark, sf), fresh_path(spark, "panel"), ["loan_seq_num"])
    return labels.default_rows(panel).select("loan_seq_num", day("report_date").alias("report_date"), "default_12m", day("default_date").alias("default_date"))


@query("laid_out_last_known", views="fx_lgd", sql="SELECT loan_seq_num, round(lgd_raw, 6) AS lgd_raw, round(lgd, 6) AS lgd FROM fx_lgd")
def laid_out_last_known(spark, sf):
    from creditloom.session import fresh_path
    from creditloom.sources import tables

    panel = tables.write_by_key(base.panel(spark, sf), fresh_path(spark, "panel"), ["loan_seq_num"])
    return labels.loss_rows(panel).select("loan_seq_num", rounded(F.col("lgd_raw")).alias("lgd_raw"), rounded(F.col("lgd")).alias("lgd"))


@query("temporal_split_counts", views="fx_pd", sql="""
SELECT CASE WHEN report_date >= DATE '2000-06-01' THEN 'oot' WHEN (loan_seq_num * 7919 + 13) % 100 < 70 THEN 'train' ELSE 'oos' END AS split,
       count(*) AS n, CAST(sum(default_12m) AS BIGINT) AS n_default, round(avg(default_12m), 6) AS default_rate
FROM fx_pd GROUP BY 1""")
def temporal_split_counts(spark, sf):
    rows = labels.default_rows(base.panel(spark, sf))
    bucket = (F.col("loan_seq_num") * 7919 + 13) % 100
    s = splits.temporal_split(rows, "report_date", ["loan_seq_num"], CUT, 0.30, bucket=bucket, buckets=100)
    return s.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("default_12m").alias("n_default"), rounded(F.avg("default_12m")).alias("default_rate")
    )


@query("split_guard_profile", views="fx_pd", sql="""
SELECT count(*) AS n, count(CASE WHEN report_date < DATE '2000-06-01' THEN 1 END) AS n_in_sample,
       count(CASE WHEN report_date >= DATE '2000-06-01' THEN 1 END) AS n_oot, 0.0::DOUBLE AS missing_share,
       strftime(min(report_date), '%Y-%m-%d') AS first_date, strftime(max(report_date), '%Y-%m-%d') AS last_date FROM fx_pd""")
def split_guard_profile(spark, sf):
    p = splits.split_profile(labels.default_rows(base.panel(spark, sf)), "report_date", CUT)
    return p.withColumn("first_date", day("first_date")).withColumn("last_date", day("last_date"))


@query("hash_split_shares")
def hash_split_shares(spark, sf):
    rows = splits.temporal_split(labels.default_rows(base.panel(spark, sf)), "report_date", ["loan_seq_num", "report_date"], CUT)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("default_12m")).alias("default_rate"))


@query("stratified_sample_rows", views="fx_pd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, default_12m FROM fx_pd
WHERE (loan_seq_num * 104729 + month(report_date)) % 100 < 20""")
def stratified_sample_rows(spark, sf):
    rows = labels.default_rows(base.panel(spark, sf))
    bucket = (F.col("loan_seq_num") * 104729 + F.month("report_date")) % 100
    s = splits.stratified_sample(rows, "default_12m", ["loan_seq_num"], 0.20, bucket=bucket, buckets=100)
    return s.select("loan_seq_num", day("report_date").alias("report_date"), "default_12m")


@query("fixed_size_sample", views="fx_lgd", sql="""
SELECT loan_seq_num, round(lgd, 6) AS lgd FROM fx_lgd ORDER BY (loan_seq_num * 7919) % 104729, loan_seq_num LIMIT 2000""")
def fixed_size_sample(spark, sf):
    rows = labels.loss_rows(base.panel(spark, sf), carry=["zero_balance_removal_upb", "current_upb", "actual_loss"])
    s = splits.fixed_sample(rows, ["loan_seq_num"], 2000, order=(F.col("loan_seq_num") * 7919) % 104729)
    return s.select("loan_seq_num", rounded(F.col("lgd")).alias("lgd"))


@query("calibration_halves", views="fx_scores", sql="""
SELECT split, CASE WHEN (loan_seq_num * 31 + 7) % 100 < 50 THEN 'cal' ELSE 'eval' END AS half, count(*) AS n,
       CAST(sum(default_12m) AS BIGINT) AS n_default FROM fx_scores WHERE split = 'oos' GROUP BY 1, 2""")
def calibration_halves(spark, sf):
    s = base.scores(spark, sf).filter(F.col("split") == "oos")
    h = splits.halves(s, ["loan_seq_num"], bucket=(F.col("loan_seq_num") * 31 + 7) % 100, buckets=100)
    return h.groupBy("split", "half").agg(F.count(F.lit(1)).alias("n"), F.sum("default_12m").alias("n_default"))


@query("disposition_counts", views="fx_panel", sql="""
SELECT zero_balance_code, CASE zero_balance_code WHEN '01' THEN 'prepayment' WHEN '03' THEN 'short sale' ELSE 'other' END AS label,
       CASE WHEN zero_balance_code IN ('02','03','06','09','15') THEN 1 ELSE 0 END AS is_default, count(*) AS n
FROM fx_panel WHERE zero_balance_code IS NOT NULL GROUP BY 1, 2, 3""")
def disposition_counts(spark, sf):
    return reports.disposition_counts(base.panel(spark, sf))


@query("overall_rates", views="fx_pd fx_lgd", sql="""
SELECT 'default_rate' AS measure, count(*) AS n, round(avg(default_12m), 6) AS value FROM fx_pd
UNION ALL SELECT 'mean_lgd', count(*), round(avg(lgd), 6) FROM fx_lgd""")
def overall_rates(spark, sf):
    p = base.panel(spark, sf)
    d = labels.default_rows(p).agg(F.lit("default_rate").alias("measure"), F.count(F.lit(1)).alias("n"), rounded(F.avg("default_12m")).alias("value"))
    g = labels.loss_rows(p).agg(F.lit("mean_lgd").alias("measure"), F.count(F.lit(1)).alias("n"), rounded(F.avg("lgd")).alias("value"))
    return d.unionByName(g)


@query("vintage_union", views="fx_loans", sql="""
SELECT vintage, count(*) AS n, round(sum(orig_upb) / 1e6, 6) AS upb_m FROM fx_loans GROUP BY 1""")
def vintage_union(spark, sf):
    """Per-vintage parts written by the sink and read back as one table."""
    from creditloom.session import fresh_path
    from creditloom.sources import tables

    path = fresh_path(spark, "vintages")
    tables.write_by_vintage(base.loans(spark, sf), path)
    return tables.read_columns(spark, path, ["vintage", "orig_upb"]).groupBy("vintage").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("orig_upb") / 1e6).alias("upb_m")
    )


@query("balance_join_ecl", views="fx_lgd fx_loans", sql="""
SELECT g.loan_seq_num, round(g.lgd * l.orig_upb / 1000, 6) AS ecl_k, round(0.4 * l.orig_upb / 1000, 6) AS ecl_pred_k
FROM fx_lgd g JOIN fx_loans l ON l.loan_seq_num = g.loan_seq_num""")
def balance_join_ecl(spark, sf):
    g = labels.loss_rows(base.panel(spark, sf), carry=["zero_balance_removal_upb", "current_upb", "actual_loss"])
    j = joins.attach_balance(g.select("loan_seq_num", "lgd"), base.loans(spark, sf))
    return j.select(
        "loan_seq_num", rounded(F.col("lgd") * F.col("orig_upb") / 1000).alias("ecl_k"),
        rounded(0.4 * F.col("orig_upb") / 1000).alias("ecl_pred_k"),
    )
