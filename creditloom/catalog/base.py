"""Registry, and the loan book that stands in for loan files: views over the given tables.

orders x customer give one loan per order, lineitem gives the monthly panel, order values give the macro
series and line items give a scored table. :data:`VIEWS` states the same views in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.joins import join_panel
from creditloom.operators.labels import default_rows, loss_rows
from creditloom.session import fresh_path

_SAVED: dict[tuple[str, str, str], str] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the SQL views its oracle text reads."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return wrap


def saved(spark: SparkSession, sf_dir: str, name: str, kind, fit: Callable):
    """An artefact that is fitted once for a session and its data, written to the shared folder, and loaded by every query that uses it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SAVED:
        _SAVED[key] = fit().save(fresh_path(spark, name))
    return kind.load(_SAVED[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_start(c) -> F.Column:
    return F.trunc(c.cast("date"), "month")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("loan_seq_num"),
        F.year("o_orderdate").alias("vintage"),
        month_start(F.col("o_orderdate")).alias("orig_date"),
        F.col("o_totalprice").alias("orig_upb"),
        F.col("o_orderpriority").alias("occupancy_status"),
        F.col("o_orderstatus").alias("channel"),
        F.col("c_nationkey").alias("zip3"),
        (F.lit(300) + (F.col("o_custkey") * 37) % 551).alias("credit_score"),
    )


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.max(F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0))
    upb, line = F.max("l_extendedprice"), F.max("l_linenumber")
    return li.groupBy(
        F.col("l_orderkey").alias("loan_seq_num"), month_start(F.col("l_shipdate")).alias("report_date")
    ).agg(
        F.when(flag == 2, "03").when(flag == 1, "01").alias("zero_balance_code"),
        upb.alias("current_upb"),
        (line - 1).alias("delinquency_status"),
        F.when(F.max("l_returnflag") == "R", upb * F.max("l_discount") * 10).alias("actual_loss"),
        F.when(line % 3 != 0, upb).alias("zero_balance_removal_upb"),
    )


def rounded_mean(per_unit: int):
    """Mean balance, rounded half up to 1 / ``per_unit``. Cents are summed as integers, so no mean falls on either side of a tie by chance."""
    cents, n = F.sum(F.round(F.col("orig_upb") * 100).cast("long")), F.count("orig_upb")
    return F.try_divide(F.floor(F.try_divide((2 * cents * per_unit + 100 * n).cast("decimal(38,0)"), (200 * n).cast("decimal(38,0)"))).cast("double"), F.lit(float(per_unit)))


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loans(spark, sf_dir).groupBy(
        "zip3", F.year("orig_date").alias("year"), F.quarter("orig_date").alias("quarter")
    ).agg(rounded_mean(100).alias("hpi_index"))


def unemployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        loans(spark, sf_dir).filter(F.month("orig_date") % 5 != 0)
        .groupBy(F.col("orig_date").alias("date"))
        .agg((rounded_mean(1) / 10000).alias("unemployment_rate"))
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    x = F.lit(-1.5) + 0.03 * (F.col("l_quantity") - 25) + 8 * (F.col("l_discount") - 0.05)
    return table(spark, sf_dir, "lineitem").select(
        k.alias("loan_seq_num"),
        (F.col("l_returnflag") == "R").cast("int").alias("default_12m"),
        F.when(k % 3 == 0, "train").when(k % 3 == 1, "oos").otherwise("oot").alias("split"),
        F.round(1 / (1 + F.exp(-x)), 4).alias("score"),
        F.col("l_extendedprice").alias("orig_upb"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel x loans, months since origination as loan age, no month before origination."""
    joined = join_panel(perf(spark, sf_dir), loans(spark, sf_dir), ["loan_seq_num"])
    months = (F.year("report_date") - F.year("orig_date")) * 12 + F.month("report_date") - F.month("orig_date")
    return joined.filter(F.col("report_date") >= F.col("orig_date")).withColumn("loan_age", months).withColumn(
        "delinquency_indicator", F.coalesce((F.col("delinquency_status") > 2).cast("int"), F.lit(0))
    )


def pd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled default table with the arithmetic split used by the oracles."""
    return default_rows(panel(spark, sf_dir)).withColumn("split", arithmetic_split())


def lgd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss_rows(panel(spark, sf_dir)).withColumn("split", arithmetic_split())


def arithmetic_split():
    k = F.col("loan_seq_num")
    return F.when((k * 7919 + 13) % 100 < 70, "train").otherwise("oos")


# The same views as SQL.
VIEWS: dict[str, tuple[str, str]] = {
    "fx_loans": ("", """
SELECT o_orderkey AS loan_seq_num, CAST(year(o_orderdate) AS INTEGER) AS vintage,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS orig_date,
       o_totalprice AS orig_upb, o_orderpriority AS occupancy_status, o_orderstatus AS channel,
       c_nationkey AS zip3, 300 + (o_custkey * 37) % 551 AS credit_score
FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "fx_perf": ("", """
SELECT l_orderkey AS loan_seq_num, CAST(date_trunc('month', l_shipdate) AS DATE) AS report_date,
       CASE max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END)
            WHEN 2 THEN '03' WHEN 1 THEN '01' END AS zero_balance_code,
       max(l_extendedprice) AS current_upb, max(l_linenumber) - 1 AS delinquency_status,
       CASE WHEN max(l_returnflag) = 'R' THEN max(l_extendedprice) * max(l_discount) * 10 END AS actual_loss,
       CASE WHEN max(l_linenumber) % 3 <> 0 THEN max(l_extendedprice) END AS zero_balance_removal_upb
FROM lineitem GROUP BY 1, 2"""),
    "fx_hpi": ("fx_loans", """
SELECT zip3, year(orig_date) AS year, quarter(orig_date) AS quarter, CAST((2 * sum(CAST(round(orig_upb * 100) AS BIGINT)) * 100 + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 100 AS hpi_index
FROM fx_loans GROUP BY 1, 2, 3"""),
    "fx_ur": ("fx_loans", """
SELECT orig_date AS date, CAST((2 * sum(CAST(round(orig_upb * 100) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 10000 AS unemployment_rate
FROM fx_loans WHERE month(orig_date) % 5 <> 0 GROUP BY 1"""),
    "fx_scores": ("", """
SELECT l_orderkey AS loan_seq_num, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS default_12m,
       CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'oos' ELSE 'oot' END AS split,
       round(1 / (1 + exp(-(-1.5 + 0.03 * (l_quantity - 25) + 8 * (l_discount - 0.05)))), 4) AS score,
       l_extendedprice AS orig_upb
FROM lineitem"""),
    "fx_panel": ("fx_loans fx_perf", """
SELECT p.*, l.* EXCLUDE (loan_seq_num),
       CAST(datediff('month', l.orig_date, p.report_date) AS INTEGER) AS loan_age,
       CASE WHEN p.delinquency_status > 2 THEN 1 ELSE 0 END AS delinquency_indicator
FROM fx_perf p JOIN fx_loans l ON p.loan_seq_num = l.loan_seq_num WHERE p.report_date >= l.orig_date"""),
    "fx_first_default": ("fx_panel", """
SELECT loan_seq_num, min(report_date) AS default_date FROM fx_panel
WHERE zero_balance_code IN ('02', '03', '06', '09', '15') GROUP BY 1"""),
    "fx_pd": ("fx_panel fx_first_default", """
SELECT p.*, d.default_date,
       CASE WHEN datediff('day', p.report_date, d.default_date) BETWEEN 1 AND 365 THEN 1 ELSE 0 END AS default_12m,
       CASE WHEN (p.loan_seq_num * 7919 + 13) % 100 < 70 THEN 'train' ELSE 'oos' END AS split
FROM fx_panel p LEFT JOIN fx_first_default d ON p.loan_seq_num = d.loan_seq_num
WHERE d.default_date IS NULL OR p.report_date < d.default_date"""),
    "fx_lgd": ("fx_panel", """
SELECT *, least(greatest(lgd_raw, 0), 1) AS lgd,
       CASE WHEN (loan_seq_num * 7919 + 13) % 100 < 70 THEN 'train' ELSE 'oos' END AS split
FROM (SELECT *, CASE WHEN coalesce(zero_balance_removal_upb, current_upb) > 0
        THEN coalesce(actual_loss, 0) / coalesce(zero_balance_removal_upb, current_upb) END AS lgd_raw
  FROM (SELECT loan_seq_num, max(report_date) AS report_date,
       arg_max(zero_balance_removal_upb, report_date) FILTER (WHERE zero_balance_removal_upb IS NOT NULL) AS zero_balance_removal_upb,
       arg_max(current_upb, report_date) AS current_upb,
       arg_max(actual_loss, report_date) FILTER (WHERE actual_loss IS NOT NULL) AS actual_loss,
       arg_max(delinquency_status, report_date) AS delinquency_status,
       arg_max(loan_age, report_date) AS loan_age,
       any_value(orig_upb) AS orig_upb, any_value(credit_score) AS credit_score, any_value(channel) AS channel,
       any_value(occupancy_status) AS occupancy_status, any_value(zip3) AS zip3, any_value(vintage) AS vintage
     FROM fx_panel WHERE zero_balance_code IN ('02', '03', '06', '09', '15') GROUP BY 1))
WHERE lgd_raw IS NOT NULL"""),
    "fx_survival": ("fx_pd", """
SELECT loan_seq_num, max(loan_age) AS loan_age, greatest(max(loan_age), 1) AS duration, max(default_12m) AS event,
       min(report_date) AS first_date, arg_max(credit_score, loan_age) AS credit_score, arg_max(orig_upb, loan_age) AS orig_upb,
       arg_max(delinquency_indicator, loan_age) AS delinquency_indicator, arg_max(channel, loan_age) AS channel
FROM fx_pd GROUP BY 1"""),
}


def with_views(names: str, body: str) -> str:
    """``body`` behind a WITH list of the named views and everything they read."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0].split():
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
