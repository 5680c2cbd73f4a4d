"""Queries: raw text scans, cleaning and sinks, over loan files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query
from creditloom.catalog.panel import day
from creditloom.functions.scalars import code_label, rounded
from creditloom.session import fresh_path, setting
from creditloom.sources import loans, macro, tables


def _write_text(df, columns, path):
    """The 32-column layout, one folder per vintage, empty text for what is missing."""
    full = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns], "vintage")
    write = (full.write.partitionBy("vintage").option("sep", "|").option("encoding", "ISO-8859-1").option("nullValue", "").option("emptyValue", "")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    # a task keeps a file open for each vintage, so its wide text rows need not be sorted by it
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "64"):
        write.csv(path)
    return path


def origination_files(spark, sf):
    o, c = base.table(spark, sf, "orders"), base.table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    raw = j.select(
        F.year("o_orderdate").alias("vintage"), F.col("o_orderkey").alias("loan_seq_num"),
        F.date_format(F.add_months(base.month_start(F.col("o_orderdate")), 1), "yyyyMM").alias("first_payment_date"),
        (F.lit(280) + (F.col("o_custkey") * 37) % 720).alias("credit_score"),
        (F.col("o_orderkey") % 130).alias("orig_dti"), (F.col("o_orderkey") % 240).alias("orig_cltv"),
        F.col("o_totalprice").alias("orig_upb"), (F.col("o_orderkey") % 12).alias("num_borrowers"),
        (F.col("c_nationkey") * 4099).alias("postal_code"), F.concat(F.lit(" "), F.col("o_orderstatus")).alias("channel"),
        F.when(F.col("o_orderkey") % 7 == 0, "Société Générale").alias("seller_name"),
    )
    return _write_text(raw, loans.ORIGINATION_COLUMNS, fresh_path(spark, "originations"))


@query("origination_scan", sql="""
WITH r AS (SELECT o_orderkey AS loan_seq_num, year(o_orderdate) AS vintage, date_trunc('month', o_orderdate) AS d, 280 + (o_custkey * 37) % 720 AS cs,
   o_orderkey % 130 AS dti, o_orderkey % 240 AS cltv, o_orderkey % 12 AS nb, o_totalprice, c_nationkey * 4099 AS zip, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(loan_seq_num AS VARCHAR) AS loan_seq_num, CAST(vintage AS INTEGER) AS vintage, strftime(d, '%Y-%m-%d') AS orig_date, CASE WHEN cs <> 999 THEN least(greatest(cs, 300), 850)::DOUBLE END AS credit_score,
  CASE WHEN dti NOT IN (9, 99) THEN least(dti, 100)::DOUBLE END AS orig_dti, CASE WHEN cltv NOT IN (9, 99) THEN least(cltv, 200)::DOUBLE END AS orig_cltv, o_totalprice AS orig_upb,
  CASE WHEN nb <> 9 THEN nb::DOUBLE END AS num_borrowers, CASE WHEN length(CAST(zip AS VARCHAR)) < 5 THEN lpad(CAST(zip AS VARCHAR), 5, '0') ELSE CAST(zip AS VARCHAR) END[1:3] AS zip3,
  ' ' || o_orderstatus AS channel, CASE WHEN loan_seq_num % 7 = 0 THEN 'Société Générale' END AS seller_name FROM r WHERE loan_seq_num NOT IN (9, 99, 999, 9999, 99999, 999999)
UNION ALL SELECT NULL, CAST(vintage AS INTEGER), strftime(d, '%Y-%m-%d'), CASE WHEN cs <> 999 THEN least(greatest(cs, 300), 850)::DOUBLE END, CASE WHEN dti NOT IN (9, 99) THEN least(dti, 100)::DOUBLE END,
  CASE WHEN cltv NOT IN (9, 99) THEN least(cltv, 200)::DOUBLE END, o_totalprice, CASE WHEN nb <> 9 THEN nb::DOUBLE END, CASE WHEN length(CAST(zip AS VARCHAR)) < 5 THEN lpad(CAST(zip AS VARCHAR), 5, '0') ELSE CAST(zip AS VARCHAR) END[1:3],
  ' ' || o_orderstatus, CASE WHEN loan_seq_num % 7 = 0 THEN 'Société Générale' END FROM r WHERE loan_seq_num IN (9, 99, 999, 9999, 99999, 999999)""")
def origination_scan(spark, sf):
    clean = loans.clean_originations(loans.read_originations(spark, origination_files(spark, sf)))
    return clean.select(
        "loan_seq_num", "vintage", day("orig_date").alias("orig_date"), "credit_score", "orig_dti", "orig_cltv", "orig_upb", "num_borrowers", "zip3", "channel", "seller_name"
    )


def servicing_files(spark, sf):
    p = base.perf(spark, sf)
    line = F.col("delinquency_status")
    odd = F.year("report_date") % 2 == 1
    raw = p.select(
        F.year("report_date").alias("vintage"), "loan_seq_num",
        F.when(odd, F.date_format("report_date", "yyyyMM")).otherwise(F.date_format("report_date", "MM/yyyy")).alias("monthly_reporting_period"),
        F.when(F.col("zero_balance_code").isNotNull(), F.date_format("report_date", "yyyy-MM")).alias("zero_balance_date"),
        F.when(line == 0, "X").when(line == 6, "R").otherwise(line.cast("string")).alias("delinquency_status"),
        (F.col("loan_seq_num") % 600 - 50).alias("loan_age"), F.regexp_replace("zero_balance_code", "^0", "").alias("zero_balance_code"),
        "current_upb", "actual_loss", "zero_balance_removal_upb",
    )
    return _write_text(raw, loans.SERVICING_COLUMNS, fresh_path(spark, "servicing"))


@query("servicing_scan", views="fx_perf", sql="""
SELECT CAST(loan_seq_num AS VARCHAR) AS loan_seq_num, CAST(year(report_date) AS INTEGER) AS vintage, strftime(report_date, '%Y-%m-%d') AS report_date,
  CASE WHEN zero_balance_code IS NOT NULL THEN strftime(report_date, '%Y-%m-%d') END AS zero_balance_date, CASE WHEN delinquency_status = 6 THEN NULL ELSE delinquency_status::DOUBLE END AS delinquency_status,
  CASE WHEN delinquency_status BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS delinquency_indicator, least(greatest(loan_seq_num % 600 - 50, 0), 480)::DOUBLE AS loan_age, zero_balance_code, current_upb,
  round(actual_loss, 4) AS actual_loss, zero_balance_removal_upb FROM fx_perf""")
def servicing_scan(spark, sf):
    clean = loans.clean_servicing(loans.read_servicing(spark, servicing_files(spark, sf)))
    return clean.select(
        "loan_seq_num", "vintage", day("report_date").alias("report_date"), day("zero_balance_date").alias("zero_balance_date"), "delinquency_status", "delinquency_indicator",
        "loan_age", "zero_balance_code", "current_upb", rounded(F.col("actual_loss"), 4).alias("actual_loss"), "zero_balance_removal_upb",
    )


@query("period_null_rates", views="fx_perf", sql="""
SELECT CAST(year(report_date) AS INTEGER) AS vintage, 'report_date' AS date_column, 0.0::DOUBLE AS null_rate, 0 AS warning FROM fx_perf GROUP BY 1
UNION ALL SELECT CAST(year(report_date) AS INTEGER), 'zero_balance_date', round(avg(CASE WHEN zero_balance_code IS NULL THEN 1 ELSE 0 END), 6), CASE WHEN avg(CASE WHEN zero_balance_code IS NULL THEN 1 ELSE 0 END) > 0.01 THEN 1 ELSE 0 END FROM fx_perf GROUP BY 1""")
def period_null_rates(spark, sf):
    raw = loans.read_servicing(spark, servicing_files(spark, sf))
    dated = loans.parse_periods(raw, {"monthly_reporting_period": "report_date", "zero_balance_date": "zero_balance_date"})
    return loans.period_null_rates(dated, ["report_date", "zero_balance_date"]).withColumn("null_rate", rounded(F.col("null_rate")))


@query("price_index_scan", views="fx_hpi", sql="""
SELECT lpad(CAST(zip3 AS VARCHAR), 3, '0') AS zip3, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter, hpi_index, strftime(make_date(year, quarter * 3, 1), '%Y-%m-%d') AS date FROM fx_hpi""")
def price_index_scan(spark, sf):
    path = fresh_path(spark, "price-index")
    tables.write_summary(base.price_index(spark, sf).toDF(" ZIP3", "Year", "QUARTER ", "hpi_index"), path)
    return macro.read_price_index(spark, path).withColumn("date", day("date"))


@query("unemployment_scan", views="fx_ur", sql="""
SELECT strftime(date, '%Y-%m-%d') AS date, unemployment_rate FROM fx_ur""")
def unemployment_scan(spark, sf):
    folder = fresh_path(spark, "macro")
    t = base.unemployment(spark, sf).select(
        F.year("date").alias("Year"), F.concat(F.lit("M"), F.date_format("date", "MM")).alias("Period"), F.col("unemployment_rate").alias("Value")
    )
    tables.write_summary(t, f"{folder}/unemployment.csv")
    return macro.read_unemployment(spark, folder).withColumn("date", day("date"))


@query("score_table_roundtrip", views="fx_scores", sql="SELECT split, count(*) AS n, CAST(sum(default_12m) AS BIGINT) AS n_default, round(avg(score), 6) AS mean_score FROM fx_scores GROUP BY 1")
def score_table_roundtrip(spark, sf):
    path = fresh_path(spark, "scores")
    tables.write_by_split(base.scores(spark, sf), path)
    wanted = [c for c in tables.table_columns(spark, path) if c in ("split", "default_12m", "score")]
    return tables.read_columns(spark, path, wanted).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("default_12m").alias("n_default"), rounded(F.avg("score")).alias("mean_score")
    )


@query("csv_or_empty_scan", views="fx_scores", sql="SELECT split, count(*) AS n, round(avg(score), 6) AS mean_score FROM fx_scores GROUP BY 1")
def csv_or_empty_scan(spark, sf):
    path = fresh_path(spark, "score-csv")
    s = base.scores(spark, sf).withColumn("report_date", F.lit("2000-01-01"))
    s.select("loan_seq_num", "report_date", "default_12m", "score", "split").write.option("header", True).csv(path)
    here, gone = tables.read_csv_or_empty(spark, path), tables.read_csv_or_empty(spark, path + "-missing")
    return here.unionByName(gone).groupBy("split").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("score")).alias("mean_score"))


@query("code_labels", views="fx_loans", sql="""
SELECT CASE channel WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' ELSE 'Other' END AS label, lower(trim(replace(occupancy_status, '-', ' '))) AS occupancy, count(*) AS n FROM fx_loans GROUP BY 1, 2""")
def code_labels(spark, sf):
    t = base.loans(spark, sf)
    return t.groupBy(
        code_label(F.col("channel"), {"F": "Final", "O": "Open"}, "Other").alias("label"), F.lower(F.trim(F.replace("occupancy_status", F.lit("-"), F.lit(" ")))).alias("occupancy")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("split_frame_union", views="fx_lgd", sql="""
SELECT split, count(*) AS n, count(a) AS n_a, count(b) AS n_b FROM (SELECT split, CASE WHEN split = 'train' THEN lgd END AS a, CASE WHEN split = 'oos' THEN lgd END AS b FROM fx_lgd) GROUP BY 1""")
def split_frame_union(spark, sf):
    g = base.lgd_rows(spark, sf)
    parts = {"train": g.filter(F.col("split") == "train").select("loan_seq_num", F.col("lgd").alias("a")), "oos": g.filter(F.col("split") == "oos").select("loan_seq_num", F.col("lgd").alias("b"))}
    return tables.with_split(parts).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))
