"""Queries: macro paths, stressed PDs, expected credit loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query
from creditloom.catalog.panel import day
from creditloom.catalog.report import quant
from creditloom.functions.scalars import rounded
from creditloom.operators import encoding, joins, labels, ordered, reports, scenarios
from creditloom.operators.scenarios import PATH_SCENARIOS, PEAK_SCENARIOS
from creditloom.sources import macro

KEYS = ["loan_seq_num", "report_date"]
WEIGHTS = {"ur_3m_lag": 0.03, "hpi_change": 2.0, "loan_age": 0.002, "credit_score": -0.003}
SCORER = scenarios.logistic_scorer(-4.8, WEIGHTS)


def sql_pd(ur: str, hpi: str, age: str) -> str:
    return f"1 / (1 + exp(-(-4.8::DOUBLE + 0.03::DOUBLE * {ur} + 2.0::DOUBLE * {hpi} + 0.002::DOUBLE * {age} - 0.003::DOUBLE * credit_score)))"


def sql_paths(table, digits: bool) -> str:
    """CTEs ``steps`` and ``paths(scenario, weight, quarter, ur, hpi_ratio)`` starting from the latest rate of fx_ur."""
    rows = ", ".join(
        f"('{s.name}', {i}, {s.weight}::DOUBLE, [{', '.join(map(str, s.ur))}]::DOUBLE[], [{', '.join(map(str, s.hpi))}]::DOUBLE[])" for i, s in enumerate(table)
    )
    ur, hpi = "start + coalesce(sum(u) OVER w, 0)", "coalesce(product(1 + h / 100) OVER w, 1)"
    if digits:
        ur, hpi = f"round({ur}, 4)", f"round({hpi}, 6)"
    n = len(table[0].ur)
    return f"""
lv AS (SELECT arg_max(unemployment_rate, date) AS start FROM fx_ur),
sc(scenario, pos, weight, us, hs) AS (VALUES {rows}),
steps AS (SELECT scenario, pos, weight, q AS quarter, start, CASE WHEN q > 0 THEN us[q] ELSE 0 END AS u, CASE WHEN q > 0 THEN hs[q] ELSE 0 END AS h
  FROM sc, lv, (SELECT unnest(range(0, {n + 1})) AS q)),
paths AS (SELECT scenario, pos, weight, CAST(quarter AS INTEGER) AS quarter, {ur} AS ur, {hpi} AS hpi_ratio FROM steps
  WINDOW w AS (PARTITION BY scenario ORDER BY quarter))"""


def level(spark, sf):
    return macro.latest_level(base.unemployment(spark, sf))


def path_table(spark, sf):
    return scenarios.macro_paths(level(spark, sf), PATH_SCENARIOS)


def peak_table(spark, sf):
    return scenarios.macro_paths(level(spark, sf), PEAK_SCENARIOS, floor_state=False)


def risk_rows(spark, sf):
    return labels.default_rows(base.panel(spark, sf)).select(*KEYS, "loan_age", "credit_score", "orig_upb")


def projected(spark, sf):
    return scenarios.attach_path_pds(risk_rows(spark, sf), path_table(spark, sf), SCORER)


def losses(spark, sf):
    return scenarios.path_ecl(projected(spark, sf), PATH_SCENARIOS, KEYS)


PATHS = "WITH " + sql_paths(PATH_SCENARIOS, True)
PEAKS = "WITH " + sql_paths(PEAK_SCENARIOS, False)
LONG = PATHS + f""",
q AS (SELECT loan_seq_num, report_date, orig_upb, scenario, pos, weight, quarter, {sql_pd('ur', '(1 / hpi_ratio)', '(loan_age + quarter * 3)')} AS pd
  FROM fx_pd, paths WHERE quarter > 0),
lng AS (SELECT *, product(1 - pd) OVER w AS alive, coalesce(product(1 - pd) OVER (PARTITION BY loan_seq_num, report_date, scenario ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS alive_before
  FROM q WINDOW w AS (PARTITION BY loan_seq_num, report_date, scenario ORDER BY quarter))"""
ECL = LONG + """,
part AS (SELECT *, pd * alive_before * 0.4::DOUBLE * orig_upb / pow(1.05::DOUBLE, quarter / 4) AS loss FROM lng),
ecl AS (SELECT loan_seq_num, report_date, scenario, pos, any_value(weight) AS weight, any_value(orig_upb) AS orig_upb,
  sum(CASE WHEN quarter <= 4 THEN loss ELSE 0 END) AS y1, sum(CASE WHEN quarter <= 8 THEN loss ELSE 0 END) AS y2,
  sum(CASE WHEN quarter <= 12 THEN loss ELSE 0 END) AS y3, sum(loss) AS y5 FROM part GROUP BY 1, 2, 3, 4)"""


@query("macro_paths_full", views="fx_ur", sql=PATHS + " SELECT scenario, quarter, round(ur, 4) AS ur, round(hpi_ratio, 6) AS hpi_ratio FROM paths")
def macro_paths_full(spark, sf):
    return path_table(spark, sf).select("scenario", "quarter", rounded(F.col("ur"), 4).alias("ur"), rounded(F.col("hpi_ratio")).alias("hpi_ratio"))


@query("macro_paths_peak", views="fx_ur", sql=PEAKS + " SELECT scenario, quarter, round(ur, 6) AS ur, round(hpi_ratio, 6) AS hpi_ratio FROM paths")
def macro_paths_peak(spark, sf):
    return peak_table(spark, sf).withColumns({c: rounded(F.col(c)) for c in ("ur", "hpi_ratio")})


@query("macro_quarterly_change", views="fx_ur", sql=PATHS + """
SELECT scenario, quarter, round(coalesce(ur - lag(ur) OVER w, 0), 6) + 0 AS ur_change,
  round(coalesce((hpi_ratio - 1) * 100 - (lag(hpi_ratio) OVER w - 1) * 100, 0), 6) + 0 AS hpi_change_pp FROM paths WINDOW w AS (PARTITION BY scenario ORDER BY quarter)""")
def macro_quarterly_change(spark, sf):
    c = scenarios.quarterly_change(path_table(spark, sf))
    return c.select("scenario", "quarter", rounded(F.col("ur_change")).alias("ur_change"), rounded(F.col("hpi_change_pp")).alias("hpi_change_pp"))


@query("peak_quarters", views="fx_ur", sql=PEAKS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY round(ur, 9) DESC, quarter) AS rn FROM paths)
SELECT scenario, quarter, round(ur, 6) AS ur, round(hpi_ratio, 6) AS hpi_ratio FROM r WHERE rn = 1""")
def peak_quarters(spark, sf):
    p = peak_table(spark, sf).withColumn("ur", F.round("ur", 9))
    return scenarios.peak_quarters(p).withColumns({c: rounded(F.col(c)) for c in ("ur", "hpi_ratio")})


@query("path_summary", views="fx_ur", sql=PATHS + """,
d AS (SELECT *, ur - lag(ur) OVER (PARTITION BY scenario ORDER BY quarter) AS du FROM paths)
SELECT scenario, round(max(ur), 4) AS peak_ur, CAST(arg_max(quarter, ur * 1000 - quarter / 1000) AS INTEGER) AS peak_quarter, round(arg_max(ur, quarter), 4) AS final_ur,
  round(min(hpi_ratio), 6) AS trough_hpi, count(CASE WHEN round(du, 9) < 0 THEN 1 END) AS recovery_quarters FROM d GROUP BY 1""")
def path_summary(spark, sf):
    s = scenarios.path_summary(path_table(spark, sf))
    return s.withColumns({c: rounded(F.col(c)) for c in ("peak_ur", "final_ur", "trough_hpi")})


@query("stressed_feature_rows", views="fx_pd fx_ur", sql=PATHS + """
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, scenario, quarter, ur AS ur_3m_lag, round(1 / hpi_ratio, 6) AS hpi_change, CAST(loan_age + quarter * 3 AS INTEGER) AS loan_age
FROM fx_pd, paths WHERE quarter > 0""")
def stressed_feature_rows(spark, sf):
    out = scenarios.stressed_rows(risk_rows(spark, sf), path_table(spark, sf))
    return out.select("loan_seq_num", day("report_date").alias("report_date"), "scenario", "quarter", "ur_3m_lag", rounded(F.col("hpi_change")).alias("hpi_change"), "loan_age")


@query("survival_product", views="fx_pd fx_ur", sql=LONG + """
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, """ + ", ".join(
    f"round(max(CASE WHEN scenario = '{s.name}' AND quarter = {q} THEN alive END), 6) AS alive_{s.name.lower()}_{q}" for s in PATH_SCENARIOS for q in range(1, 21)
) + " FROM lng GROUP BY 1, 2")
def survival_product(spark, sf):
    arrays = {s: scenarios.survival_array(F.col(f"pds_{s.name.lower()}")) for s in PATH_SCENARIOS}
    return projected(spark, sf).select(
        "loan_seq_num", day("report_date").alias("report_date"),
        *[rounded(F.get(a, F.lit(q))).alias(f"alive_{s.name.lower()}_{q}") for s, a in arrays.items() for q in range(1, 21)],
    )


@query("survival_product_window", views="fx_pd fx_ur", sql=LONG + """
SELECT scenario, quarter, count(*) AS n, round(avg(alive), 6) AS mean_alive, round(avg(alive_before), 6) AS mean_alive_before FROM lng GROUP BY 1, 2""")
def survival_product_window(spark, sf):
    loans = scenarios.dealt_out(risk_rows(spark, sf), KEYS, 20 * len(PATH_SCENARIOS))
    pds = scenarios.attach_path_pds(loans, path_table(spark, sf), SCORER)
    lng = scenarios.long_paths(pds, PATH_SCENARIOS, KEYS).select(*KEYS, "scenario", "quarter", "pd")
    w = scenarios.survival_window(lng, KEYS)
    return w.groupBy("scenario", "quarter").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("alive")).alias("mean_alive"), rounded(F.avg("alive_before")).alias("mean_alive_before"))


@query("path_ecl_by_loan", views="fx_pd fx_ur", sql=ECL + """
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, any_value(orig_upb) AS orig_upb, """ + ", ".join(
    f"round(sum(CASE WHEN scenario = '{s.name}' THEN {c} END) / 1000, 6) AS ecl_{s.name.lower()}_{h}" for s in PATH_SCENARIOS for c, h in (("y1", "1Y"), ("y2", "2Y"), ("y3", "3Y"), ("y5", "5Y"))
) + " FROM ecl GROUP BY 1, 2")
def path_ecl_by_loan(spark, sf):
    e = losses(spark, sf)
    return e.select("loan_seq_num", day("report_date").alias("report_date"), "orig_upb", *[rounded(F.col(c) / 1000).alias(c) for c in e.columns if c.startswith("ecl_")])


@query("path_ecl_summary", views="fx_pd fx_ur", sql=ECL + """,
t AS (SELECT scenario, pos, any_value(weight) AS weight, round(sum(y1) / 1e6, 3) AS a, round(sum(y2) / 1e6, 3) AS b, round(sum(y3) / 1e6, 3) AS c, round(sum(y5) / 1e6, 3) AS d FROM ecl GROUP BY 1, 2)
SELECT CASE scenario WHEN 'Base' THEN 'Base Scenario' WHEN 'Adverse' THEN 'Adverse Scenario' ELSE 'Severe Scenario (GFC-level)' END AS scenario, weight, a AS total_ecl_1Y_m, b AS total_ecl_2Y_m, c AS total_ecl_3Y_m, d AS total_ecl_5Y_m FROM t
UNION ALL SELECT 'PROBABILITY-WEIGHTED', 1.0::DOUBLE, round(sum(weight * a), 3), round(sum(weight * b), 3), round(sum(weight * c), 3), round(sum(weight * d), 3) FROM t""")
def path_ecl_summary(spark, sf):
    return scenarios.ecl_summary(losses(spark, sf), PATH_SCENARIOS)


@query("mean_pd_paths", views="fx_pd fx_ur", sql=LONG + """,
m AS (SELECT scenario, quarter, avg(pd) AS p, avg(alive) AS a FROM lng GROUP BY 1, 2)
SELECT m.scenario, m.quarter, round(m.p, 6) AS mean_pd, round(m.a, 6) AS mean_alive, round(m.p / b.p, 6) AS relative_pd FROM m JOIN m b ON b.quarter = m.quarter AND b.scenario = 'Base'""")
def mean_pd_paths(spark, sf):
    m = scenarios.mean_paths(scenarios.long_paths(projected(spark, sf), PATH_SCENARIOS, KEYS))
    return m.withColumns({c: rounded(F.col(c)) for c in ("mean_pd", "mean_alive", "relative_pd")})


@query("horizon_growth", views="fx_pd fx_ur", sql=ECL + """,
t AS (SELECT scenario, sum(y1) / 1e6 AS a, sum(y2) / 1e6 AS b, sum(y3) / 1e6 AS c, sum(y5) / 1e6 AS d FROM ecl GROUP BY 1)
SELECT scenario, q AS quarters, round(v, 6) AS ecl_m, round(v / a, 6) AS multiple FROM (SELECT scenario, a, 4 AS q, a AS v FROM t UNION ALL SELECT scenario, a, 8, b FROM t
  UNION ALL SELECT scenario, a, 12, c FROM t UNION ALL SELECT scenario, a, 20, d FROM t)""")
def horizon_growth(spark, sf):
    return scenarios.horizon_growth(losses(spark, sf), PATH_SCENARIOS).withColumns({c: rounded(F.col(c)) for c in ("ecl_m", "multiple")})


@query("recovery_saving", views="fx_pd fx_ur", sql=ECL + """
SELECT scenario, round(sum(y5) / 1e6, 6) AS with_recovery_m, round(sum(y1) / 1e6 * 5, 6) AS without_m, round(sum(y1) / 1e6 * 5 - sum(y5) / 1e6, 6) + 0 AS saving_m FROM ecl GROUP BY 1""")
def recovery_saving(spark, sf):
    return scenarios.recovery_saving(losses(spark, sf), PATH_SCENARIOS).withColumns({c: rounded(F.col(c)) for c in ("with_recovery_m", "without_m", "saving_m")})


@query("loss_percentiles", views="fx_pd fx_ur", sql=ECL + """,
l AS (SELECT scenario || '|1Y' AS k, y1 / 1000 AS v FROM ecl UNION ALL SELECT scenario || '|2Y', y2 / 1000 FROM ecl UNION ALL SELECT scenario || '|3Y', y3 / 1000 FROM ecl UNION ALL SELECT scenario || '|5Y', y5 / 1000 FROM ecl),
""" + quant("l", "k", "v", [(1, 2), (95, 100), (99, 100)]) + """
SELECT split_part(k, '|', 1) AS scenario, split_part(k, '|', 2) AS horizon, count(*) AS n, round(avg(v), 6) AS mean, round(any_value(q1), 6) AS p50, round(any_value(q2), 6) AS p95,
  round(any_value(q3), 6) AS p99 FROM l JOIN qs ON g = k GROUP BY 1, 2""")
def loss_percentiles(spark, sf):
    p = scenarios.loss_percentiles(losses(spark, sf), PATH_SCENARIOS)
    return p.withColumns({c: rounded(F.col(c)) for c in ("mean", "p50", "p95", "p99")})


UPLIFT = ECL + """,
w AS (SELECT loan_seq_num, report_date, max(CASE WHEN scenario = 'Base' THEN y1 END) AS b, max(CASE WHEN scenario = 'Adverse' THEN y1 END) AS a, max(CASE WHEN scenario = 'Severe' THEN y1 END) AS s FROM ecl GROUP BY 1, 2)"""


@query("scenario_uplift", views="fx_pd fx_ur", sql=UPLIFT + """,
l AS (SELECT 'Adverse' AS k, a / b AS v FROM w UNION ALL SELECT 'Severe', s / b FROM w), """ + quant("l", "k", "v", [(1, 2), (95, 100)]) + """
SELECT k AS scenario, count(*) AS n, round(avg(v), 6) AS mean, round(any_value(q1), 6) AS p50, round(any_value(q2), 6) AS p95 FROM l JOIN qs ON g = k GROUP BY 1""")
def scenario_uplift(spark, sf):
    u = scenarios.uplift_summary(scenarios.uplift_rows(losses(spark, sf), KEYS))
    return u.withColumns({c: rounded(F.col(c)) for c in ("mean", "p50", "p95")})


@query("top_uplift_loans", views="fx_pd fx_ur", sql=UPLIFT + """
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, round(s / b, 6) AS uplift_severe FROM w ORDER BY round(s / b, 9) DESC, loan_seq_num, report_date LIMIT 10""")
def top_uplift_loans(spark, sf):
    u = scenarios.uplift_rows(losses(spark, sf), KEYS).withColumn("uplift_severe", F.round("uplift_severe", 9))
    return scenarios.top_rows(u, "uplift_severe", KEYS).select("loan_seq_num", day("report_date").alias("report_date"), rounded(F.col("uplift_severe")).alias("uplift_severe"))


PEAK_PD = PEAKS + f""",
pk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY round(ur, 9) DESC, quarter) AS rn FROM paths),
sp AS (SELECT loan_seq_num, report_date, orig_upb, scenario, pos, weight, {sql_pd('ur', '(1 / hpi_ratio)', 'loan_age')} AS pd FROM fx_pd, pk WHERE rn = 1)"""


def peak_pds(spark, sf):
    peaks = scenarios.peak_quarters(peak_table(spark, sf).withColumn("ur", F.round("ur", 9)))
    return scenarios.scenario_pds(risk_rows(spark, sf), peaks, SCORER, [*KEYS, "orig_upb"])


@query("peak_scenario_pds", views="fx_pd fx_ur", sql=PEAK_PD + """
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, orig_upb, round(max(CASE WHEN scenario = 'Base' THEN pd END), 6) AS pd_base,
  round(max(CASE WHEN scenario = 'Adverse' THEN pd END), 6) AS pd_adverse, round(max(CASE WHEN scenario = 'Severe' THEN pd END), 6) AS pd_severe FROM sp GROUP BY 1, 2, 3""")
def peak_scenario_pds(spark, sf):
    p = peak_pds(spark, sf)
    return p.select("loan_seq_num", day("report_date").alias("report_date"), "orig_upb", *[rounded(F.col(c)).alias(c) for c in ("pd_base", "pd_adverse", "pd_severe")])


@query("peak_weighted_ecl", views="fx_pd fx_ur", sql=PEAK_PD + """,
t AS (SELECT scenario, weight, avg(pd) * 100 AS m, sum(pd * 0.4::DOUBLE * orig_upb) / 1e6 AS e FROM sp GROUP BY 1, 2)
SELECT CASE scenario WHEN 'Base' THEN 'Base Scenario' WHEN 'Adverse' THEN 'Adverse Scenario' ELSE 'Severe Scenario  (GFC-level)' END AS scenario, weight, round(m, 6) AS mean_pd_pct,
  round(e, 6) AS total_ecl_m, round(e * weight, 6) AS weighted_ecl_m FROM t UNION ALL SELECT 'PROBABILITY-WEIGHTED TOTAL', 1.0::DOUBLE, NULL, NULL, round(sum(e * weight), 6) FROM t""")
def peak_weighted_ecl(spark, sf):
    w = scenarios.weighted_ecl(peak_pds(spark, sf), PEAK_SCENARIOS)
    return w.withColumns({c: rounded(F.col(c)) for c in ("mean_pd_pct", "total_ecl_m", "weighted_ecl_m")})


def featured_rows(spark, sf):
    """All rows of the book; those without a rate or an index keep them empty."""
    p = labels.default_rows(base.panel(spark, sf))
    p = joins.attach_rate_lag(joins.attach_price_change(p, base.price_index(spark, sf)), base.unemployment(spark, sf))
    return p.select(*KEYS, "default_12m", "loan_age", "credit_score", "orig_upb", "ur_3m_lag", "hpi_change")


@query("macro_sensitivity", views="fx_pd fx_ur fx_hpi", sql="""
WITH lags AS (SELECT DISTINCT report_date, CAST(report_date - INTERVAL 3 MONTH AS DATE) AS lag_date FROM fx_pd),
near AS (SELECT report_date, unemployment_rate AS ur, row_number() OVER (PARTITION BY report_date ORDER BY abs(datediff('day', date, lag_date)), date) AS rn
   FROM lags JOIN fx_ur ON abs(datediff('day', date, lag_date)) <= 45),
e AS (SELECT p.credit_score, p.loan_age, n.ur, CASE WHEN c.hpi_index > 0 THEN o.hpi_index / c.hpi_index END AS hpi FROM fx_pd p LEFT JOIN near n ON n.report_date = p.report_date AND n.rn = 1
  LEFT JOIN fx_hpi o ON o.zip3 = p.zip3 AND o.year = year(p.orig_date) AND o.quarter = quarter(p.orig_date)
  LEFT JOIN fx_hpi c ON c.zip3 = p.zip3 AND c.year = year(p.report_date) AND c.quarter = quarter(p.report_date)),
f AS (SELECT credit_score, loan_age, coalesce(ur, (SELECT median(ur) FROM e)) AS ur, coalesce(hpi, (SELECT median(hpi) FROM e)) AS hpi FROM e),
""" + f"m AS (SELECT avg({sql_pd('ur', 'hpi', 'loan_age')}) AS b, avg({sql_pd('(ur + 1.0)', 'hpi', 'loan_age')}) AS u, avg({sql_pd('ur', '(hpi + 0.1)', 'loan_age')}) AS h FROM f)" + """
SELECT 'ur_3m_lag' AS feature, 1.0::DOUBLE AS shock, round(b * 100, 6) AS pd_base_pct, round(u * 100, 6) AS pd_shocked_pct, round((u - b) * 100, 6) + 0 AS delta_pd_pp FROM m
UNION ALL SELECT 'hpi_change', 0.1::DOUBLE, round(b * 100, 6), round(h * 100, 6), round((h - b) * 100, 6) + 0 FROM m""")
def macro_sensitivity(spark, sf):
    rows = featured_rows(spark, sf)
    s = scenarios.sensitivity(scenarios.filled(rows, encoding.medians(rows, ["ur_3m_lag", "hpi_change"])), SCORER)
    return s.withColumns({c: rounded(F.col(c)) for c in ("pd_base_pct", "pd_shocked_pct", "delta_pd_pp")})


@query("loan_loss_quantile", views="fx_pd fx_ur", sql=PEAK_PD + """,
l AS (SELECT 'Severe' AS scenario, pd * 0.4::DOUBLE * orig_upb / 1000 AS loss FROM sp WHERE scenario = 'Severe'), """ + quant("l", "scenario", "loss", [(99, 100)]) + """
SELECT scenario, round(any_value(q1), 6) AS quantile, round(avg(CASE WHEN loss >= q1 THEN loss END), 6) AS tail_mean FROM l JOIN qs ON g = scenario GROUP BY 1""")
def loan_loss_quantile(spark, sf):
    l = peak_pds(spark, sf).select((F.col("pd_severe") * 0.4 * F.col("orig_upb") / 1000).alias("loss"))
    return scenarios.loan_loss_quantile(l, "loss").withColumn("scenario", F.lit("Severe")).withColumns({c: rounded(F.col(c)) for c in ("quantile", "tail_mean")})


@query("path_against_peak", views="fx_pd fx_ur", sql=ECL + """,
lv2 AS (SELECT start FROM lv),
pk AS (SELECT 'Base' AS scenario, start AS ur, 1.0::DOUBLE AS hpi_ratio FROM lv2 UNION ALL SELECT 'Adverse', start + 3.0, (1 - 0.025::DOUBLE) * (1 - 0.03::DOUBLE) * (1 - 0.025::DOUBLE) * (1 - 0.015::DOUBLE) FROM lv2
  UNION ALL SELECT 'Severe', start + 6.0, (1 - 0.05::DOUBLE) * (1 - 0.06::DOUBLE) * (1 - 0.06::DOUBLE) * (1 - 0.05::DOUBLE) * (1 - 0.03::DOUBLE) FROM lv2),
""" + f"sp AS (SELECT scenario, sum({sql_pd('ur', '(1 / hpi_ratio)', 'loan_age')} * 0.4::DOUBLE * orig_upb) / 1e6 AS e FROM fx_pd, pk GROUP BY 1)," + """
t AS (SELECT scenario, sum(y1) / 1e6 AS a FROM ecl GROUP BY 1)
SELECT t.scenario, round(a, 6) AS path_ecl_m, round(e, 6) AS peak_ecl_m, round(a / e, 6) AS ratio FROM t JOIN sp ON sp.scenario = t.scenario""")
def path_against_peak(spark, sf):
    r = scenarios.path_against_peak(losses(spark, sf), peak_pds(spark, sf), PATH_SCENARIOS)
    return r.withColumns({c: rounded(F.col(c)) for c in ("path_ecl_m", "peak_ecl_m", "ratio")})


@query("stressed_pd_distribution", views="fx_pd fx_ur", sql=PEAK_PD + """,
b AS (SELECT scenario, least(CAST(floor(40 * (pd * 100) / 20) AS INTEGER) + 1, 40) AS bin_no FROM sp WHERE pd * 100 BETWEEN 0 AND 20)
SELECT scenario, bin_no, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY scenario) * 0.5::DOUBLE), 6) AS density FROM b GROUP BY 1, 2""")
def stressed_pd_distribution(spark, sf):
    p = peak_pds(spark, sf)
    cells = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.col(f"pd_{s.name.lower()}").alias("pd")) for s in PEAK_SCENARIOS])
    h = reports.histogram(p.select(F.inline(cells)), ["scenario"], F.col("pd") * 100, 0, 20, 40)
    return h.select("scenario", "bin_no", "n", rounded(F.col("density")).alias("density"))


@query("stressed_pd_percentiles", views="fx_pd fx_ur", sql=PEAK_PD + "," + quant("sp", "scenario", "pd", [(1, 2), (95, 100), (99, 100)]) + """
SELECT scenario, count(*) AS n, round(avg(pd), 6) AS mean, round(any_value(q1), 6) AS p50, round(any_value(q2), 6) AS p95, round(any_value(q3), 6) AS p99 FROM sp JOIN qs ON g = scenario GROUP BY 1""")
def stressed_pd_percentiles(spark, sf):
    t = reports.wide_percentiles(peak_pds(spark, sf), {f"pd_{s.name.lower()}": [s.name] for s in PEAK_SCENARIOS}, ["scenario"], [(1, 2), (95, 100), (99, 100)], ["p50", "p95", "p99"])
    return t.withColumns({c: rounded(F.col(c)) for c in ("mean", "p50", "p95", "p99")})


@query("loss_exposure_histogram", views="fx_lgd", sql="""
WITH l AS (SELECT 'actual' AS kind, lgd * orig_upb / 1000 AS v FROM fx_lgd UNION ALL SELECT 'predicted', 0.4::DOUBLE * orig_upb / 1000 FROM fx_lgd),
b AS (SELECT kind, CASE WHEN v = 500 THEN 40 ELSE CAST(floor(v / 12.5::DOUBLE) AS INTEGER) + 1 END AS bin_no FROM l WHERE v BETWEEN 0 AND 500)
SELECT kind, bin_no, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY kind) * 12.5::DOUBLE), 6) AS density FROM b GROUP BY 1, 2""")
def loss_exposure_histogram(spark, sf):
    g = base.lgd_rows(spark, sf)
    cells = F.array(
        F.struct(F.lit("actual").alias("kind"), (F.col("lgd") * F.col("orig_upb") / 1000).alias("v")),
        F.struct(F.lit("predicted").alias("kind"), (0.4 * F.col("orig_upb") / 1000).alias("v")),
    )
    h = reports.histogram(g.select(F.inline(cells)), ["kind"], "v", 0, 500, 40)
    return h.select("kind", "bin_no", "n", rounded(F.col("density")).alias("density"))


@query("stressed_pd_ecdf", views="fx_pd fx_ur", sql=PEAK_PD + """,
d AS (SELECT scenario, round(pd, 12) AS pd, count(*) AS n FROM sp GROUP BY 1, 2)
SELECT scenario, pd, n, round(sum(n) OVER (PARTITION BY scenario ORDER BY pd) / sum(n) OVER (PARTITION BY scenario), 6) AS ecdf FROM d""")
def stressed_pd_ecdf(spark, sf):
    p = peak_pds(spark, sf)
    cells = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.round(f"pd_{s.name.lower()}", 12).alias("pd")) for s in PEAK_SCENARIOS])
    return ordered.ecdf(p.select(F.inline(cells)), ["scenario"], "pd").withColumn("ecdf", rounded(F.col("ecdf")))
