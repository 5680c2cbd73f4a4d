"""Queries: encoders, fitted models, calibration and attribution."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from creditloom.catalog import base
from creditloom.catalog.base import query, saved
from creditloom.catalog.panel import day
from creditloom.catalog.stress import KEYS, PATHS, featured_rows, path_table, peak_table
from creditloom.functions.scalars import rounded
from creditloom.operators import attribution, calibration, encoding, metrics, models, scenarios, splits
from creditloom.operators.scenarios import PATH_SCENARIOS, PEAK_SCENARIOS
from creditloom.session import fresh_path, written

PD_COLS = ["credit_score", "orig_upb", "loan_age", "current_upb", "delinquency_status", "occupancy_status"]
def modelling_rows(spark, sf):
    return base.pd_rows(spark, sf).select(*KEYS, "split", "default_12m", *PD_COLS)


def train_part(df):
    return df.filter(F.col("split") == "train")


def logistic(spark, sf):
    return saved(spark, sf, "logistic", models.LogisticPd, lambda: models.fit_logistic_pd(train_part(modelling_rows(spark, sf)), PD_COLS))


def scored_logistic(spark, sf):
    return logistic(spark, sf).transform(modelling_rows(spark, sf))


def boosted(spark, sf):
    rows = modelling_rows(spark, sf)
    return rows, saved(spark, sf, "boosted", models.BoostedPd, lambda: models.fit_boosted_pd(train_part(rows), PD_COLS, ["occupancy_status"]))


@query("median_values", views="fx_pd", sql="""
SELECT 'credit_score' AS feature, round(median(credit_score), 6) AS median FROM fx_pd UNION ALL SELECT 'orig_upb', round(median(orig_upb), 6) FROM fx_pd
UNION ALL SELECT 'zero_balance_removal_upb', round(median(zero_balance_removal_upb), 6) FROM fx_pd""")
def median_values(spark, sf):
    cols = ["credit_score", "orig_upb", "zero_balance_removal_upb"]
    m = encoding.medians(base.pd_rows(spark, sf), cols)
    return spark.createDataFrame([(c, m[c]) for c in cols], "feature string, median double").withColumn("median", rounded(F.col("median")))


@query("imputed_rows", views="fx_pd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, coalesce(zero_balance_removal_upb, (SELECT median(zero_balance_removal_upb) FROM fx_pd)) AS filled FROM fx_pd""")
def imputed_rows(spark, sf):
    rows = base.pd_rows(spark, sf)
    m = encoding.medians(rows, ["zero_balance_removal_upb"])["zero_balance_removal_upb"]
    return rows.select("loan_seq_num", day("report_date").alias("report_date"), F.coalesce("zero_balance_removal_upb", F.lit(m)).alias("filled"))


@query("standardised_rows", views="fx_pd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, round((credit_score - (SELECT avg(credit_score) FROM fx_pd)) / (SELECT stddev_pop(credit_score) FROM fx_pd), 6) + 0 AS credit_score FROM fx_pd""")
def standardised_rows(spark, sf):
    rows = base.pd_rows(spark, sf)
    z = encoding.standardised(rows, encoding.scale_moments(rows, ["credit_score"]))
    return z.select("loan_seq_num", day("report_date").alias("report_date"), rounded(F.col("credit_score")).alias("credit_score"))


@query("label_codes", views="fx_pd", sql="""
WITH c AS (SELECT occupancy_status AS v, (row_number() OVER (ORDER BY occupancy_status) - 1)::DOUBLE AS code FROM (SELECT DISTINCT occupancy_status FROM fx_pd WHERE split = 'train'))
SELECT coalesce(code, 0) AS code, count(*) AS n FROM fx_pd LEFT JOIN c ON v = occupancy_status GROUP BY 1""")
def label_codes(spark, sf):
    rows = modelling_rows(spark, sf)
    enc = encoding.fit_labels([train_part(rows)], ["occupancy_status"])
    return enc.transform(rows).groupBy(F.col("occupancy_status").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("label_codes_union", views="fx_pd", sql="""
WITH c AS (SELECT channel AS v, (row_number() OVER (ORDER BY channel) - 1)::DOUBLE AS code FROM (SELECT DISTINCT channel FROM fx_pd))
SELECT split, coalesce(code, 0) AS code, count(*) AS n FROM fx_pd LEFT JOIN c ON v = channel GROUP BY 1, 2""")
def label_codes_union(spark, sf):
    rows = base.pd_rows(spark, sf).select("split", "channel")
    enc = encoding.fit_labels([train_part(rows), rows.filter(F.col("split") == "oos")], ["channel"], missing_as_label=False)
    return enc.transform(rows).groupBy("split", F.col("channel").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("class_weights", views="fx_pd", sql="""
WITH c AS (SELECT count(*) AS n, sum(default_12m) AS p FROM fx_pd)
SELECT default_12m, round(CASE WHEN default_12m = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END, 6) AS balanced, round(CASE WHEN default_12m = 1 THEN (n - p) / p ELSE 1 END, 6) AS positive, count(*) AS rows FROM fx_pd, c GROUP BY 1, 2, 3""")
def class_weights(spark, sf):
    rows = base.pd_rows(spark, sf)
    counts = encoding.class_counts(rows, "default_12m")
    b, p = encoding.balanced_weight(counts, "default_12m"), encoding.positive_weight(counts, "default_12m")
    return rows.groupBy("default_12m", rounded(b).alias("balanced"), rounded(p).alias("positive")).agg(F.count(F.lit(1)).alias("rows"))


@query("logistic_coefficients")
def logistic_coefficients(spark, sf):
    return logistic(spark, sf).coefficients(spark)


@query("logistic_scores")
def logistic_scores(spark, sf):
    return scored_logistic(spark, sf).select(*KEYS, "default_12m", "score", "split")


@query("logistic_score_equations", sql="""
SELECT feature, TRUE AS solved FROM (VALUES ('intercept'), ('credit_score_woe'), ('orig_upb_woe'), ('loan_age_woe'), ('current_upb_woe'), ('delinquency_status_woe'), ('occupancy_status_woe')) AS t(feature)""")
def logistic_score_equations(spark, sf):
    """At the optimum the weighted residuals are at right angles to each feature, up to the penalty's pull."""
    train = train_part(modelling_rows(spark, sf))
    m = logistic(spark, sf)
    z = m.encoded(m.transform(train))
    w = encoding.balanced_weight(encoding.class_counts(train, "default_12m"), "default_12m")
    residual = w * (F.col("score") - F.col("default_12m"))
    sums = [F.sum(residual * (F.lit(1.0) if c is None else F.col(c))) for c in (None, *m.columns)]
    pull = [0.0, *m.weights]
    names = ["intercept", *m.columns]
    off = F.array(*[F.struct(F.lit(n).alias("feature"), (F.abs(s + b) <= 1e-4 * F.sum(w)).alias("solved")) for n, s, b in zip(names, sums, pull)])
    return z.agg(off.alias("r")).select(F.inline("r"))


@query("logistic_metrics")
def logistic_metrics(spark, sf):
    return metrics.evaluate(scored_logistic(spark, sf), ["split"], "score", "default_12m")


@query("boosted_scores")
def boosted_scores(spark, sf):
    rows, m = boosted(spark, sf)
    return m.transform(rows).select(*KEYS, "default_12m", "score", "split")


@query("boosted_metrics")
def boosted_metrics(spark, sf):
    rows, m = boosted(spark, sf)
    scored = written(m.transform(rows).select("split", "default_12m", "score"), "scored")  # ranks read the scores several times
    return metrics.discrimination(scored, ["split"], "score", "default_12m")


@query("boosted_importance")
def boosted_importance(spark, sf):
    return boosted(spark, sf)[1].importance(spark)


LGD_COLS = ["orig_upb", "credit_score", "loan_age", "current_upb", "channel", "occupancy_status"]


def loss_models(spark, sf):
    rows = base.lgd_rows(spark, sf)
    fit = lambda: models.fit_loss_models(train_part(rows), LGD_COLS, ["channel", "occupancy_status"], others=[rows.filter(F.col("split") == "oos")])
    return rows, saved(spark, sf, "loss", models.LossModels, fit)


@query("loss_predictions")
def loss_predictions(spark, sf):
    rows, m = loss_models(spark, sf)
    return m.transform(rows).select("loan_seq_num", "split", F.col("lgd").alias("actual_lgd"), *m.names)


@query("loss_model_metrics")
def loss_model_metrics(spark, sf):
    rows, m = loss_models(spark, sf)
    return m.evaluate(m.transform(rows))


@query("fractional_response_line", views="fx_lgd", sql="""
WITH y AS (SELECT credit_score::DOUBLE AS x, ln(least(greatest(lgd, 1e-6), 1 - 1e-6) / (1 - least(greatest(lgd, 1e-6), 1 - 1e-6))) AS y FROM fx_lgd)
SELECT 'credit_score' AS feature, round(regr_slope(y, x), 6) + 0 AS coefficient, round(regr_intercept(y, x), 6) AS intercept FROM y""")
def fractional_response_line(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["credit_score"], outputCol="features").transform(base.lgd_rows(spark, sf))
    m = models.fit_fractional(rows)
    return spark.createDataFrame([("credit_score", float(m.coefficients[0]), float(m.intercept))], "feature string, coefficient double, intercept double").withColumns(
        {c: rounded(F.col(c)) for c in ("coefficient", "intercept")}
    )


@query("spline_basis_rows", views="fx_pd", sql="""
WITH k AS (SELECT min(credit_score)::DOUBLE AS lo, (max(credit_score) - min(credit_score)) / 4 AS w FROM fx_pd),
p AS (SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, (credit_score - lo) / w AS u FROM fx_pd, k)
SELECT loan_seq_num, report_date, """ + ", ".join(
    "round((" + " + ".join(f"{c} * pow(greatest(u - {j - 3 + i}, 0), 3)" for i, c in enumerate((1, -4, 6, -4, 1))) + f") / 6, 6) + 0 AS b{j}" for j in range(6)
) + " FROM p")
def spline_basis_rows(spark, sf):
    rows = base.pd_rows(spark, sf)
    knots = models.spline_knots(rows, ["credit_score"])["credit_score"]
    placed = rows.withColumn("u", models.spline_position(F.col("credit_score"), knots))
    return placed.select(
        "loan_seq_num", day("report_date").alias("report_date"), *[rounded(b).alias(f"b{j}") for j, b in enumerate(models.spline_basis(F.col("u"), len(knots) - 1))]
    )


# ------------------------------------------------------------------------------------------------ calibration
def oos_scores(spark, sf):
    s = base.scores(spark, sf).filter(F.col("split") == "oos")
    return splits.halves(s, ["loan_seq_num"], bucket=(F.col("loan_seq_num") * 31 + 7) % 100, buckets=100)


@query("platt_coefficients")
def platt_coefficients(spark, sf):
    p = calibration.fit_platt(oos_scores(spark, sf).filter(F.col("half") == "cal"), "score", "default_12m")
    return spark.createDataFrame([(p.a, p.b)], "a double, b double")


@query("isotonic_fit", views="fx_scores", sql="""
WITH t AS (SELECT score AS x, count(*)::DOUBLE AS w, sum(default_12m)::DOUBLE AS s FROM fx_scores WHERE split = 'oos' AND (loan_seq_num * 31 + 7) % 100 < 50 GROUP BY 1),
c AS (SELECT x, w, s, sum(w) OVER o AS cw, sum(s) OVER o AS cs, row_number() OVER o AS i FROM t WINDOW o AS (ORDER BY x)),
m AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS v FROM c a JOIN c b ON b.i >= a.i),
inner_min AS (SELECT p.i, j, min(v) AS v FROM c p JOIN m ON j <= p.i AND k >= p.i GROUP BY 1, 2)
SELECT x AS score, round(max(v), 6) AS isotonic FROM inner_min JOIN c ON c.i = inner_min.i GROUP BY 1""")
def isotonic_fit(spark, sf):
    cal = oos_scores(spark, sf).filter(F.col("half") == "cal")
    fit = calibration.fit_isotonic(cal, "score", "default_12m")
    return fit.transform(cal.select("score").distinct(), "score", "isotonic").withColumn("isotonic", rounded(F.col("isotonic")))


@query("temperature_fit", views="fx_scores", sql="""
WITH t AS (SELECT score, ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7))) AS l, count(*) AS n, sum(default_12m) AS p FROM fx_scores
   WHERE split = 'oos' AND (loan_seq_num * 31 + 7) % 100 < 50 GROUP BY 1),
m AS (SELECT sum(l * n) / sum(n) AS ml, ln((sum(p) / sum(n)) / (1 - sum(p) / sum(n))) AS goal, sum(n) AS nn FROM t),
g AS (SELECT i, 0.1::DOUBLE + i * (4.9::DOUBLE / 499) AS tt FROM (SELECT unnest(range(0, 500)) AS i)),
z AS (SELECT tt, any_value(goal) AS goal, any_value(ml) AS ml, -sum(p * ln(least(greatest(1 / (1 + exp(-((l - ml) / tt + goal))), 1e-7), 1 - 1e-7))
   + (n - p) * ln(1 - least(greatest(1 / (1 + exp(-((l - ml) / tt + goal))), 1e-7), 1 - 1e-7))) / any_value(nn) AS nll FROM t, m, g GROUP BY 1)
SELECT round(arg_min(tt, nll), 6) AS t, round(arg_min(goal - ml / tt, nll), 6) AS b, round(min(nll), 6) AS nll FROM z""")
def temperature_fit(spark, sf):
    f = calibration.fit_temperature(oos_scores(spark, sf).filter(F.col("half") == "cal"), "score", "default_12m")
    return spark.createDataFrame([(f.t, f.b, f.nll)], "t double, b double, nll double").withColumns({c: rounded(F.col(c)) for c in ("t", "b", "nll")})


@query("calibrated_metrics")
def calibrated_metrics(spark, sf):
    return calibration.calibrate_models(oos_scores(spark, sf), {"score": "LR"}, "default_12m")[0]


@query("calibrated_scores")
def calibrated_scores(spark, sf):
    return calibration.calibrate_models(oos_scores(spark, sf), {"score": "LR"}, "default_12m", keep=["loan_seq_num"])[1]


# ------------------------------------------------------------------------------------------------ attribution
def attributed(spark, sf):
    """Attributions with the encoded feature values and the label beside them."""
    rows, m = boosted(spark, sf)
    feats = m.features
    out = attribution.tree_attributions(m.trees, m.vectors(rows), feats, keep=[*KEYS, "split", "default_12m", *feats])
    return out, feats


def shares(feats):
    return [f"shap_{f}" for f in feats]


def read_often(out, *columns):
    """The columns of all rows, written: a report that ranks rows reads them several times, and each time would work out the attributions again."""
    return written(out.select(*columns), "attributed")


@query("attribution_rows")
def attribution_rows(spark, sf):
    out, feats = attributed(spark, sf)
    return out.select(*KEYS, "default_12m", *[f"shap_{f}" for f in feats], "base_value", "margin", "predicted_pd")


@query("attribution_additivity", views="fx_pd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, TRUE AS additive, TRUE AS a_probability FROM fx_pd""")
def attribution_additivity(spark, sf):
    """Base value and attributions of a row add up to its margin, and the margin's curve is its predicted default rate."""
    out, feats = attributed(spark, sf)
    total = sum((F.col(f"shap_{f}") for f in feats), F.col("base_value"))
    return out.select(
        "loan_seq_num", day("report_date").alias("report_date"), (F.abs(total - F.col("margin")) < 1e-6).alias("additive"),
        F.col("predicted_pd").between(0, 1).alias("a_probability"),
    )


@query("attribution_importance")
def attribution_importance(spark, sf):
    return attribution.global_importance(*attributed(spark, sf))


@query("attribution_waterfall")
def attribution_waterfall(spark, sf):
    out, feats = attributed(spark, sf)
    return attribution.waterfall(out, feats, KEYS, top=4)


@query("extreme_risk_loans", views="fx_pd", sql="""
WITH r AS (SELECT loan_seq_num, 1 / (1 + exp(-credit_score / 550.0::DOUBLE)) AS s FROM fx_pd)
SELECT 'highest' AS which, arg_max(loan_seq_num, (s, -loan_seq_num)) AS loan_seq_num, round(max(s), 6) AS score FROM r UNION ALL SELECT 'lowest', arg_min(loan_seq_num, (s, loan_seq_num)), round(min(s), 6) FROM r""")
def extreme_risk_loans(spark, sf):
    r = base.pd_rows(spark, sf).withColumn("score", 1 / (1 + F.exp(-F.col("credit_score") / 550.0)))
    return attribution.extreme_rows(r, "score", ["loan_seq_num", "score"]).select("which", "loan_seq_num", rounded(F.col("score")).alias("score"))


@query("attribution_segments")
def attribution_segments(spark, sf):
    out, feats = attributed(spark, sf)
    return attribution.segment_report(read_often(out, "predicted_pd", "default_12m", *shares(feats)), feats)


@query("attribution_by_decile")
def attribution_by_decile(spark, sf):
    out, feats = attributed(spark, sf)
    return attribution.leading_feature_profile(read_often(out, "predicted_pd", *shares(feats)), feats)


@query("attribution_dependence")
def attribution_dependence(spark, sf):
    out, _ = attributed(spark, sf)
    return attribution.dependence_bins(read_often(out, "credit_score", "orig_upb", "shap_credit_score"), "credit_score", "orig_upb")


@query("attribution_density")
def attribution_density(spark, sf):
    out, feats = attributed(spark, sf)
    return attribution.beeswarm_density(read_often(out, *feats, *shares(feats)), feats)


# Closed-form attributions (weight x centred value) give the report tables an SQL statement.
LINEAR = {"credit_score": -0.004, "orig_upb": 2e-6, "loan_age": 0.01}
LINEAR_SQL = """
WITH m AS (SELECT avg(credit_score) AS a, avg(orig_upb) AS b, avg(loan_age) AS c FROM fx_pd),
s AS (SELECT loan_seq_num, report_date, default_12m, -0.004::DOUBLE * (credit_score - a) AS p1, 2e-6::DOUBLE * (orig_upb - b) AS p2, 0.01::DOUBLE * (loan_age - c) AS p3 FROM fx_pd, m),
l AS (SELECT loan_seq_num, report_date, default_12m, 'credit_score' AS feature, p1 AS phi FROM s UNION ALL SELECT loan_seq_num, report_date, default_12m, 'orig_upb', p2 FROM s UNION ALL SELECT loan_seq_num, report_date, default_12m, 'loan_age', p3 FROM s)
"""


def linear_attributions(spark, sf):
    rows = base.pd_rows(spark, sf)
    mean = encoding.scale_moments(rows, list(LINEAR))
    return rows.withColumns({f"shap_{f}": F.lit(w) * (F.col(f) - F.lit(mean[f][0])) for f, w in LINEAR.items()}).withColumn("base_value", F.lit(-2.0))


@query("linear_attribution_importance", views="fx_pd", sql=LINEAR_SQL + """
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs, round(avg(abs(phi)) * 0.008 * 0.992 * 100, 6) AS mean_abs_pp, CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC) AS INTEGER) AS rank FROM l GROUP BY 1""")
def linear_attribution_importance(spark, sf):
    g = attribution.global_importance(linear_attributions(spark, sf), list(LINEAR))
    return g.withColumns({c: rounded(F.col(c)) for c in ("mean_abs", "mean_abs_pp")})


@query("linear_attribution_waterfall", views="fx_pd", sql=LINEAR_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY loan_seq_num, report_date ORDER BY abs(phi) DESC, feature) AS rn FROM l),
w AS (SELECT loan_seq_num, report_date, CASE WHEN rn <= 2 THEN rn ELSE 3 END AS position, CASE WHEN rn <= 2 THEN feature ELSE '(all other features)' END AS feature, sum(phi) AS phi FROM r GROUP BY 1, 2, 3, 4)
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, CAST(position AS INTEGER) AS position, feature, round(phi, 6) + 0 AS phi,
  round(-2.0 + sum(phi) OVER (PARTITION BY loan_seq_num, report_date ORDER BY position), 6) + 0 AS "end" FROM w""")
def linear_attribution_waterfall(spark, sf):
    w = attribution.waterfall(linear_attributions(spark, sf), list(LINEAR), KEYS, top=2)
    return w.select("loan_seq_num", day("report_date").alias("report_date"), "position", "feature", rounded(F.col("phi")).alias("phi"), rounded(F.col("end")).alias("end"))


# ------------------------------------------------------------------------------------------------ fitted scorers
MACRO_COLS = ["ur_3m_lag", "hpi_change", "loan_age", "credit_score"]


def macro_model(spark, sf):
    rows = featured_rows(spark, sf)
    return rows, saved(spark, sf, "macro", models.BoostedPd, lambda: models.fit_boosted_pd(rows, MACRO_COLS, []))


@query("model_path_losses")
def model_path_losses(spark, sf):
    rows, m = macro_model(spark, sf)
    pds = scenarios.ensemble_path_pds(rows, path_table(spark, sf), m, KEYS)
    return scenarios.ecl_summary(scenarios.path_ecl(pds, PATH_SCENARIOS, KEYS), PATH_SCENARIOS)


@query("model_peak_losses")
def model_peak_losses(spark, sf):
    rows, m = macro_model(spark, sf)
    peaks = scenarios.peak_quarters(peak_table(spark, sf))
    return scenarios.weighted_ecl(scenarios.ensemble_scenario_pds(rows, peaks, m, [*KEYS, "orig_upb"]), PEAK_SCENARIOS)


@query("model_sensitivity")
def model_sensitivity(spark, sf):
    return scenarios.ensemble_sensitivity(*macro_model(spark, sf))


@query("model_path_agreement", views="fx_pd fx_ur", sql=PATHS + """
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, count(*) AS cells, TRUE AS same FROM fx_pd, paths WHERE quarter > 0 GROUP BY ALL""")
def model_path_agreement(spark, sf):
    """Every quarter of every path from the one pass over the trees, beside the score of a row that was changed to that quarter."""
    rows, m = macro_model(spark, sf)
    rows = scenarios.dealt_out(scenarios.filled(rows, m.preparation.fills), KEYS, 20 * len(PATH_SCENARIOS))
    paths = path_table(spark, sf)
    fan = scenarios.stressed_rows(rows.select(*KEYS, *MACRO_COLS), paths)
    one = m.transform(fan, "pd").select(*KEYS, "scenario", "quarter", "pd")
    arrays = scenarios.ensemble_path_pds(rows, paths, m, KEYS)
    cells = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.col(f"pds_{s.name.lower()}").alias("pds")) for s in PATH_SCENARIOS])
    every = arrays.select(*KEYS, F.inline(cells)).select(*KEYS, "scenario", F.posexplode("pds").alias("q", "p")).withColumn("quarter", F.col("q") + 1).drop("q")
    both = one.join(every, [*KEYS, "scenario", "quarter"])
    return both.groupBy("loan_seq_num", day("report_date").alias("report_date")).agg(F.count(F.lit(1)).alias("cells"), F.every(F.abs(F.col("p") - F.col("pd")) < 1e-12).alias("same"))


@query("reloaded_scores", views="fx_pd", sql="""
SELECT loan_seq_num, strftime(report_date, '%Y-%m-%d') AS report_date, TRUE AS logistic, TRUE AS boosted, TRUE AS margin FROM fx_pd""")
def reloaded_scores(spark, sf):
    """Scores of the artefacts as they were fitted beside those of the same ones saved, loaded and run as stages of a pipeline that was itself saved and loaded."""
    rows, trees = boosted(spark, sf)
    fresh = {"logistic": logistic(spark, sf), "boosted": trees}
    path = fresh_path(spark, "pipeline")
    PipelineModel([m.into(k) for k, m in fresh.items()]).write().save(path)
    direct = rows
    for k, m in fresh.items():
        direct = m.transform(direct, f"d_{k}")
    direct = direct.withColumn("d_margin", F.log(F.col("d_boosted") / (1 - F.col("d_boosted"))))
    both = PipelineModel.load(path).transform(direct)
    margin = attribution.tree_attributions(trees.trees, trees.vectors(both.withColumns({f"_{c}": F.col(c) for c in ("logistic", "boosted")})), trees.features, keep=[*KEYS, "d_logistic", "d_boosted", "d_margin", "_logistic", "_boosted"])
    return margin.select(
        "loan_seq_num", day("report_date").alias("report_date"), (F.col("d_logistic") == F.col("_logistic")).alias("logistic"), (F.col("d_boosted") == F.col("_boosted")).alias("boosted"),
        (F.abs(F.col("margin") - F.col("d_margin")) < 1e-9).alias("margin"),
    )
