"""Queries: equal-frequency bins, weight of evidence, information value, stability, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query
from creditloom.catalog.sqltools import bin_expr, edges_cte
from creditloom.functions.scalars import clip, rounded
from creditloom.operators import evidence, metrics, ordered, reports, stability

FEATURES = ["credit_score", "orig_upb", "loan_age", "current_upb", "delinquency_status", "occupancy_status", "channel"]

LONG_SQL = """
WITH long AS (
  SELECT 'credit_score' AS feature, credit_score::DOUBLE AS v, NULL::VARCHAR AS s, default_12m AS y, split FROM fx_pd
  UNION ALL SELECT 'orig_upb', orig_upb, NULL, default_12m, split FROM fx_pd
  UNION ALL SELECT 'loan_age', loan_age::DOUBLE, NULL, default_12m, split FROM fx_pd
  UNION ALL SELECT 'current_upb', current_upb, NULL, default_12m, split FROM fx_pd
  UNION ALL SELECT 'delinquency_status', delinquency_status::DOUBLE, NULL, default_12m, split FROM fx_pd
  UNION ALL SELECT 'occupancy_status', NULL, occupancy_status, default_12m, split FROM fx_pd
  UNION ALL SELECT 'channel', NULL, channel, default_12m, split FROM fx_pd),
"""


def woe_sql(k: int, tail: str, where: str = "TRUE") -> str:
    return LONG_SQL + f"""
use_rows AS (SELECT * FROM long WHERE {where}),
{edges_cte("use_rows", "feature", "v", k)},
placed AS (SELECT r.feature, CASE WHEN v IS NOT NULL AND n_keys > 10 THEN 'num' ELSE 'cat' END AS kind,
    CASE WHEN v IS NOT NULL AND n_keys > 10 THEN {bin_expr("v")} END AS bin_no,
    CASE WHEN NOT (v IS NOT NULL AND n_keys > 10) THEN coalesce(s, CAST(CAST(v AS BIGINT) AS VARCHAR)) END AS label,
    CASE WHEN v IS NOT NULL AND n_keys > 10 THEN e END AS e, y
  FROM use_rows r LEFT JOIN edges ON g = r.feature WHERE v IS NOT NULL OR s IS NOT NULL),
bins AS (SELECT feature, kind, bin_no, label, any_value(e) AS e, count(*) AS n_total,
    CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_good, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad
  FROM placed GROUP BY 1, 2, 3, 4),
shares AS (SELECT *, greatest(n_good / greatest(sum(n_good) OVER (PARTITION BY feature), 1), 1e-9) AS p,
    greatest(n_bad / greatest(sum(n_bad) OVER (PARTITION BY feature), 1), 1e-9) AS q FROM bins)
""" + tail


@query("woe_table", views="fx_pd", sql=woe_sql(15, """
SELECT feature, kind, CAST(bin_no AS INTEGER) AS bin_no, label, round(e[bin_no], 6) AS lo, round(e[bin_no + 1], 6) AS hi, n_total, n_good, n_bad,
  round(n_bad / n_total, 6) AS default_rate, round(ln(p / q), 6) + 0 AS woe, round((p - q) * ln(p / q), 8) + 0 AS iv_component FROM shares"""))
def woe_table(spark, sf):
    t = evidence.woe_table(base.pd_rows(spark, sf), FEATURES)
    return t.select(
        "feature", "kind", "bin_no", "label", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), "n_total", "n_good", "n_bad",
        rounded(F.col("default_rate")).alias("default_rate"), rounded(F.col("woe")).alias("woe"), rounded(F.col("iv_component"), 8).alias("iv_component"),
    )


@query("information_value", views="fx_pd", sql=woe_sql(15, """
SELECT feature, round(sum((p - q) * ln(p / q)), 6) AS iv,
  CASE WHEN round(sum((p - q) * ln(p / q)), 6) < 0.02 THEN 'Negligible' WHEN round(sum((p - q) * ln(p / q)), 6) < 0.10 THEN 'Weak'
       WHEN round(sum((p - q) * ln(p / q)), 6) < 0.30 THEN 'Medium' WHEN round(sum((p - q) * ln(p / q)), 6) < 0.50 THEN 'Strong'
       ELSE 'Very strong' END AS strength FROM shares GROUP BY 1"""))
def information_value(spark, sf):
    return evidence.information_value(base.pd_rows(spark, sf), FEATURES)


@query("woe_encoded_rows", views="fx_pd", sql=woe_sql(15, """,
woes AS (SELECT feature, bin_no, label, round(ln(p / q), 6) AS woe FROM shares),
ed AS (SELECT g, e, n_keys FROM edges)
SELECT r.loan_seq_num, strftime(r.report_date, '%Y-%m-%d') AS report_date,
  coalesce(c.woe, 0)::DOUBLE + 0 AS credit_score_woe, coalesce(d.woe, 0)::DOUBLE + 0 AS delinquency_status_woe, coalesce(o.woe, 0)::DOUBLE + 0 AS occupancy_status_woe
FROM fx_pd r
LEFT JOIN ed ce ON ce.g = 'credit_score'
LEFT JOIN woes c ON c.feature = 'credit_score' AND c.bin_no = """ + bin_expr("r.credit_score", "ce.e") + """
LEFT JOIN woes d ON d.feature = 'delinquency_status' AND d.label = CAST(r.delinquency_status AS VARCHAR)
LEFT JOIN woes o ON o.feature = 'occupancy_status' AND o.label = r.occupancy_status""", where="split = 'train'"))
def woe_encoded_rows(spark, sf):
    rows = base.pd_rows(spark, sf)
    model = evidence.fit_woe(rows.filter(F.col("split") == "train"), ["credit_score", "delinquency_status", "occupancy_status"])
    return model.transform(rows).select(
        "loan_seq_num", F.date_format("report_date", "yyyy-MM-dd").alias("report_date"),
        *[rounded(F.col(f"{c}_woe")).alias(f"{c}_woe") for c in ("credit_score", "delinquency_status", "occupancy_status")],
    )


@query("document_information_value", sql="""
WITH rows_ AS (SELECT d.n_chars::DOUBLE AS v, l.quality AS y, 'n_chars' AS feature FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
text_rows AS (SELECT d.lang AS s, l.quality AS y, 'lang' AS feature FROM documents d JOIN labels l ON l.doc_id = d.doc_id
   UNION ALL SELECT d.source, l.quality, 'source' FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
""" + edges_cte("rows_", "feature", "v", 15) + f""",
bins AS (SELECT feature, CAST({bin_expr("v")} AS VARCHAR) AS b, y FROM rows_ JOIN edges ON g = feature UNION ALL SELECT feature, s, y FROM text_rows WHERE s IS NOT NULL),
agg AS (SELECT feature, b, sum(1 - y) AS ng, sum(y) AS nb FROM bins GROUP BY 1, 2),
sh AS (SELECT feature, greatest(ng / greatest(sum(ng) OVER (PARTITION BY feature), 1), 1e-9) AS p, greatest(nb / greatest(sum(nb) OVER (PARTITION BY feature), 1), 1e-9) AS q FROM agg)
SELECT feature, round(sum((p - q) * ln(p / q)), 6) AS iv FROM sh GROUP BY 1""")
def document_information_value(spark, sf):
    d, lab = base.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), base.table(spark, sf, "labels")
    return evidence.information_value(d.join(lab, "doc_id"), ["n_chars", "lang", "source"], "quality").drop("strength")


PSI_FEATURES = ["credit_score", "orig_upb", "loan_age", "delinquency_status", "occupancy_status"]

PSI_SQL = """
WITH base_rows AS (SELECT *, CASE WHEN report_date >= DATE '2000-06-01' THEN 'oot' ELSE split END AS part FROM fx_pd),
long AS (
  SELECT 'credit_score' AS feature, credit_score::DOUBLE AS v, NULL::VARCHAR AS s, part FROM base_rows
  UNION ALL SELECT 'orig_upb', orig_upb, NULL, part FROM base_rows
  UNION ALL SELECT 'loan_age', loan_age::DOUBLE, NULL, part FROM base_rows
  UNION ALL SELECT 'delinquency_status', delinquency_status::DOUBLE, NULL, part FROM base_rows
  UNION ALL SELECT 'occupancy_status', NULL, occupancy_status, part FROM base_rows),
ref AS (SELECT * FROM long WHERE part = 'train'),
""" + edges_cte("ref", "feature", "v", 10) + f""",
placed AS (SELECT l.feature, part, CASE WHEN v IS NOT NULL AND n_keys > 10 THEN CAST({bin_expr("v")} AS VARCHAR)
    ELSE coalesce(s, CAST(CAST(v AS BIGINT) AS VARCHAR)) END AS b FROM long l LEFT JOIN edges ON g = l.feature),
sh AS (SELECT feature, part, b, count(*) / sum(count(*)) OVER (PARTITION BY feature, part) AS share FROM placed WHERE b IS NOT NULL GROUP BY 1, 2, 3),
pairs AS (SELECT r.feature, x.part, greatest(r.share, 1e-9) AS p, greatest(coalesce(t.share, 1e-9), 1e-9) AS q
  FROM sh r JOIN (SELECT DISTINCT feature, part FROM sh WHERE part <> 'train') x ON x.feature = r.feature
  LEFT JOIN sh t ON t.feature = r.feature AND t.part = x.part AND t.b = r.b WHERE r.part = 'train'),
psi AS (SELECT feature, part, round(sum((p - q) * ln(p / q)), 6) AS psi FROM pairs GROUP BY 1, 2),
flags AS (SELECT *, CASE WHEN psi < 0.10 THEN 'Stable' WHEN psi < 0.25 THEN 'Investigate' ELSE 'Major shift' END AS flag FROM psi)
"""


def psi_rows(spark, sf):
    rows = base.pd_rows(spark, sf)
    part = F.when(F.col("report_date") >= F.lit("2000-06-01").cast("date"), "oot").otherwise(F.col("split"))
    return rows.withColumn("part", part)


@query("population_stability", views="fx_pd", sql=PSI_SQL + "SELECT feature, part, psi + 0 AS psi, flag FROM flags")
def population_stability(spark, sf):
    p = stability.population_stability(psi_rows(spark, sf), PSI_FEATURES, "part", "train")
    return p.withColumn("psi", rounded(F.col("psi")))


@query("stability_summary", views="fx_pd", sql=PSI_SQL + """
SELECT coalesce(a.feature, b.feature) AS feature, a.psi + 0 AS psi_OOS, a.flag AS flag_OOS, b.psi + 0 AS psi_OOT, b.flag AS flag_OOT
FROM (SELECT * FROM flags WHERE part = 'oos') a FULL JOIN (SELECT * FROM flags WHERE part = 'oot') b ON a.feature = b.feature""")
def stability_summary(spark, sf):
    s = stability.stability_summary(psi_rows(spark, sf), PSI_FEATURES, "part", "train", {"oos": "OOS", "oot": "OOT"})
    return s.withColumns({c: rounded(F.col(c)) for c in ("psi_OOS", "psi_OOT")})


@query("segment_stability", sql="""
WITH ref AS (SELECT 'c_acctbal' AS feature, c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING'),
""" + edges_cte("ref", "feature", "v", 10) + f""",
placed AS (SELECT c_mktsegment AS part, {bin_expr("c_acctbal")} AS b FROM customer, edges),
sh AS (SELECT part, b, count(*) / sum(count(*)) OVER (PARTITION BY part) AS share FROM placed WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT t.c_mktsegment, round(sum((r.share - coalesce(s.share, 1e-9)) * ln(r.share / coalesce(s.share, 1e-9))), 6) AS psi
FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING') t CROSS JOIN (SELECT * FROM sh WHERE part = 'BUILDING') r
LEFT JOIN sh s ON s.part = t.c_mktsegment AND s.b = r.b GROUP BY 1""")
def segment_stability(spark, sf):
    c = base.table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    return stability.population_stability(c, ["c_acctbal"], "c_mktsegment", "BUILDING").select("c_mktsegment", "psi")


BAND_SQL = """
WITH """ + edges_cte("fx_scores", "split", "score", 10) + f""",
banded AS (SELECT s.*, {bin_expr("score")} - 1 AS band FROM fx_scores s JOIN edges ON g = s.split),
bands AS (SELECT split, band, min(score) AS score_min, max(score) AS score_max, count(*) AS n, CAST(sum(default_12m) AS BIGINT) AS n_default, sum(score) AS score_sum
  FROM banded GROUP BY 1, 2)
"""


@query("scorecard", views="fx_scores", sql=BAND_SQL + """
SELECT split, CAST(band AS INTEGER) AS band, score_min, score_max, n, n_default, round(n_default / n, 6) AS default_rate,
  round(sum(n_default) OVER (PARTITION BY split ORDER BY score_min DESC) / greatest(sum(n_default) OVER (PARTITION BY split), 1), 6) AS cum_capture FROM bands""")
def scorecard(spark, sf):
    s = metrics.scorecard(base.scores(spark, sf), ["split"], "score", "default_12m")
    return s.withColumn("default_rate", rounded(F.col("default_rate"))).withColumn("cum_capture", rounded(F.col("cum_capture")))


@query("hosmer_lemeshow", views="fx_scores", sql=BAND_SQL + """,
st AS (SELECT split, count(*) AS n_bins, sum(pow(n_default - score_sum, 2) / greatest(score_sum, 1e-9)
   + pow((n - n_default) - (n - score_sum), 2) / greatest(n - score_sum, 1e-9)) AS x FROM bands GROUP BY 1)
SELECT split, n_bins, round(x, 6) AS hl_stat, round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS hl_pval, 8 AS hl_dof FROM st""")
def hosmer_lemeshow(spark, sf):
    h = metrics.hosmer_lemeshow(base.scores(spark, sf), ["split"], "score", "default_12m")
    return h.withColumn("hl_stat", rounded(F.col("hl_stat"))).withColumn("hl_pval", rounded(F.col("hl_pval")))


@query("equal_frequency_bands", views="fx_pd", sql="WITH " + edges_cte("fx_pd", "split", "credit_score", 10) + f"""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, CAST({bin_expr("credit_score")} AS INTEGER) AS bin_no
FROM fx_pd JOIN edges ON g = split""")
def equal_frequency_bands(spark, sf):
    b = ordered.equal_frequency_bins(base.pd_rows(spark, sf), ["split"], "credit_score", 10)
    return b.select("loan_seq_num", F.date_format("report_date", "yyyy-MM-dd").alias("report_date"), "bin_no")


@query("tertile_groups", views="fx_survival", sql="""
WITH rn AS (SELECT credit_score AS v, row_number() OVER (ORDER BY credit_score) - 1 AS rn, count(*) OVER () AS n FROM fx_survival),
cut AS (SELECT k, max(CASE WHEN rn = (k * (n - 1)) // 100 THEN v END)::DOUBLE
   + (max(CASE WHEN rn = (k * (n - 1)) // 100 + 1 THEN v END) - max(CASE WHEN rn = (k * (n - 1)) // 100 THEN v END)) * max((k * (n - 1)) % 100) / 100.0::DOUBLE AS e
   FROM rn, (SELECT unnest([33, 67]) AS k) GROUP BY k)
SELECT CAST(CASE WHEN credit_score <= (SELECT e FROM cut WHERE k = 33) THEN 1 WHEN credit_score <= (SELECT e FROM cut WHERE k = 67) THEN 2 ELSE 3 END AS INTEGER) AS tertile,
  count(*) AS n, min(credit_score) AS lo, max(credit_score) AS hi FROM fx_survival GROUP BY 1""")
def tertile_groups(spark, sf):
    from creditloom.operators import survival

    s = survival.survival_table(base.pd_rows(spark, sf), ["credit_score"])
    return survival.tertiles(s, "credit_score").groupBy("tertile").agg(
        F.count(F.lit(1)).alias("n"), F.min("credit_score").alias("lo"), F.max("credit_score").alias("hi")
    )


@query("clipped_percentile_scale", views="fx_pd", sql="""
WITH rn AS (SELECT orig_upb AS v, row_number() OVER (ORDER BY orig_upb) - 1 AS rn, count(*) OVER () AS n FROM fx_pd),
cut AS (SELECT k, max(CASE WHEN rn = (k * (n - 1)) // 100 THEN v END)
   + (max(CASE WHEN rn = (k * (n - 1)) // 100 + 1 THEN v END) - max(CASE WHEN rn = (k * (n - 1)) // 100 THEN v END)) * max((k * (n - 1)) % 100) / 100.0::DOUBLE AS e
   FROM rn, (SELECT unnest([2, 98]) AS k) GROUP BY k)
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date,
  round(least(greatest((orig_upb - (SELECT e FROM cut WHERE k = 2)) / ((SELECT e FROM cut WHERE k = 98) - (SELECT e FROM cut WHERE k = 2)), 0), 1), 6) + 0 AS scaled FROM fx_pd""")
def clipped_percentile_scale(spark, sf):
    from creditloom.operators import attribution

    s = attribution.percentile_scale(base.pd_rows(spark, sf), ["orig_upb"])
    return s.select("loan_seq_num", F.date_format("report_date", "yyyy-MM-dd").alias("report_date"), rounded(F.col("orig_upb_scaled")).alias("scaled"))


@query("empirical_distribution", views="fx_scores", sql="""
SELECT split, score, n, round(sum(n) OVER (PARTITION BY split ORDER BY score) / sum(n) OVER (PARTITION BY split), 6) AS ecdf
FROM (SELECT split, score, count(*) AS n FROM fx_scores GROUP BY 1, 2)""")
def empirical_distribution(spark, sf):
    return ordered.ecdf(base.scores(spark, sf), ["split"], "score").withColumn("ecdf", rounded(F.col("ecdf")))


@query("rank_normalised_values", views="fx_lgd", sql="""
SELECT loan_seq_num, round((rank() OVER (PARTITION BY channel ORDER BY lgd) - 1) / count(*) OVER (PARTITION BY channel), 6) AS rank_share FROM fx_lgd""")
def rank_normalised_values(spark, sf):
    g = base.lgd_rows(spark, sf).select("loan_seq_num", "channel", "lgd")
    return ordered.rank_share(g, ["channel"], "lgd").select("loan_seq_num", rounded(F.col("rank_share")).alias("rank_share"))


CONC_SQL = """
WITH t AS (SELECT {order} AS o, count(*) AS n, sum({amount}) AS amt FROM fx_lgd GROUP BY 1),
r AS (SELECT *, coalesce(sum(n) OVER w, 0) AS nb, coalesce(sum(amt) OVER w, 0) AS ab, sum(n) OVER () AS nt, sum(amt) OVER () AS total_amt
      FROM t WINDOW w AS (ORDER BY o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT unnest([{shares}]) AS k)
SELECT k / 100.0::DOUBLE AS row_share, CAST((k * nt) // 100 AS BIGINT) AS n_rows, round((ab + amt * ((k * nt) // 100 - nb) / n) / total_amt, 6) AS amount_share
FROM r, p WHERE (k * nt) // 100 > nb AND (k * nt) // 100 <= nb + n"""


@query("cumulative_loss_curve", views="fx_lgd", sql=CONC_SQL.format(order="lgd * orig_upb", amount="lgd * orig_upb", shares=", ".join(str(i) for i in range(5, 101, 5))))
def cumulative_loss_curve(spark, sf):
    g = base.lgd_rows(spark, sf).withColumn("ecl", F.col("lgd") * F.col("orig_upb"))
    c = ordered.concentration(g, [], "ecl", "ecl", [(i, 100) for i in range(5, 101, 5)])
    return c.withColumn("amount_share", rounded(F.col("amount_share")))


@query("top_share_of_loss", views="fx_lgd", sql=CONC_SQL.format(order="lgd", amount="lgd * orig_upb", shares="20"))
def top_share_of_loss(spark, sf):
    g = base.lgd_rows(spark, sf).withColumn("ecl", F.col("lgd") * F.col("orig_upb"))
    return ordered.concentration(g, [], "lgd", "ecl", [(20, 100)]).withColumn("amount_share", rounded(F.col("amount_share")))


@query("numeric_category_screen", views="fx_pd", sql=LONG_SQL + """
one AS (SELECT 1) SELECT feature, CAST(count(DISTINCT coalesce(s, CAST(v AS VARCHAR))) AS BIGINT) AS n_distinct,
 CASE WHEN bool_or(s IS NOT NULL) OR count(DISTINCT v) <= 10 THEN 1 ELSE 0 END AS is_category FROM long GROUP BY 1""")
def numeric_category_screen(spark, sf):
    return evidence.category_screen(base.pd_rows(spark, sf), FEATURES)
