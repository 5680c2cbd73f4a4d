"""End-to-end jobs: files in, files out. Each is one lazy plan per result; row-level results go to Parquet
partitioned by vintage or split, summaries of a few rows to CSV."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import attribution, calibration, evidence, joins, labels, metrics, models, reports, scenarios, splits, stability, survival
from creditloom.operators.models import LGD_FEATURES, PD_FEATURES
from creditloom.operators.scenarios import PATH_SCENARIOS, PEAK_SCENARIOS
from creditloom.sources import loans, macro, tables

# Covariates of the survival model.
COX_FEATURES = [
    "credit_score", "orig_cltv", "orig_dti", "orig_interest_rate", "orig_upb", "hpi_change",
    "ur_3m_lag", "num_borrowers", "delinquency_indicator",
]
ROW_KEY = ["loan_seq_num", "report_date"]
LOAN_KEY = ["vintage", "loan_seq_num"]


def featured_panel(spark: SparkSession, originations: str, servicing: str, price_index: str | None = None, macro_folder: str | None = None, vintage_pattern: str = loans.VINTAGE_PATTERN) -> DataFrame:
    """All vintages in one plan: scan, clean, join by (vintage, loan), macro features."""
    orig = loans.clean_originations(loans.read_originations(spark, originations, vintage_pattern=vintage_pattern)).select("vintage", *loans.ORIGINATION_USED)
    perf = loans.clean_servicing(loans.read_servicing(spark, servicing, vintage_pattern))
    index = macro.read_price_index(spark, price_index) if price_index else None
    rate = macro.read_unemployment(spark, macro_folder) if macro_folder else None
    return joins.attach_rate_lag(joins.attach_price_change(joins.join_panel(perf, orig), index), rate)


def _rate_of(column: str) -> dict[str, Column]:
    return {"n": F.count(column), "total": F.sum(F.col(column).cast("double"))}


def _rate(seen: dict) -> tuple[int, float | None, float | None]:
    return seen["n"], seen["total"], seen["total"] / seen["n"] if seen["n"] else None


def prepare_tables(
    spark: SparkSession, originations: str, servicing: str, out: str, price_index: str | None = None, macro_folder: str | None = None,
    codes: Sequence[str] = labels.DEFAULT_CODES, split_by_loan: bool = False, vintage_pattern: str = loans.VINTAGE_PATTERN,
) -> dict[str, str]:
    """Default and loss tables per vintage, split tables, null, disposition and class rates, information value and stability summaries.

    Null counts, dispositions and class rates are gathered by the passes that write the tables. The panel is laid out by loan, so labels need no further exchange on it. The joined panel is written first, then the per-vintage tables, each read back: that cuts the lineage, the servicing text is
    parsed once, and every later pass reads pruned Parquet columns.
    """
    text = featured_panel(spark, originations, servicing, price_index, macro_folder, vintage_pattern)
    dates = [c for c, kind in text.dtypes if kind == "date"]
    code, known = F.col("zero_balance_code"), sorted({*labels.DISPOSITION_LABELS, *codes})
    checks = {"n": F.count(F.lit(1)), **{f"null_{d}": F.count_if(F.col(d).isNull()) for d in dates}}
    checks |= {f"code_{k}": F.count_if(code == k) for k in known} | {"code_other": F.count_if(code.isNotNull() & ~code.isin(known))}
    panel, seen = tables.write_observed(text, lambda df: tables.write_by_key(df, f"{out}/panel", LOAN_KEY), checks)
    nulls = [(d, seen["n"], seen[f"null_{d}"], seen[f"null_{d}"] / max(seen["n"], 1)) for d in dates]
    tables.write_summary(spark.createDataFrame(nulls, "date_column string, n long, n_null long, null_rate double"), f"{out}/panel_null_rates")
    held = [(k, labels.DISPOSITION_LABELS.get(k, "other"), int(k in codes), seen[f"code_{k}"]) for k in [*known, "other"]]
    tables.write_summary(spark.createDataFrame(held, "zero_balance_code string, label string, is_default int, n long"), f"{out}/dispositions")
    tables.write_summary(loans.period_null_rates(panel, dates), f"{out}/period_null_rates")
    key = ["loan_seq_num"] if split_by_loan else ROW_KEY
    defaults = labels.default_rows(panel, LOAN_KEY, codes).select("vintage", *PD_FEATURES, *ROW_KEY, "default_12m")
    _, found = tables.write_observed(labels.complete_cases(defaults, PD_FEATURES, "vintage"), lambda df: tables.write_by_vintage(df, f"{out}/pd_rows"), _rate_of("default_12m"))
    rates = [("default_12m", *_rate(found))]
    carry = [c for c in panel.columns if c not in (*LOAN_KEY, "report_date")]
    losses = labels.loss_rows(panel, LOAN_KEY, codes, carry).select("vintage", *LGD_FEATURES, "loan_seq_num", "zero_balance_date", "lgd", "lgd_raw")
    _, found = tables.write_observed(labels.complete_cases(losses, LGD_FEATURES, "vintage"), lambda df: tables.write_by_vintage(df, f"{out}/lgd_rows"), _rate_of("lgd"))
    rates.append(("lgd", *_rate(found)))
    tables.write_summary(spark.createDataFrame(rates, "measure string, n long, total double, mean double"), f"{out}/rates")

    pd_rows = splits.require_in_sample(spark.read.parquet(f"{out}/pd_rows"), "report_date")
    tables.write_by_split(splits.temporal_split(pd_rows, "report_date", key), f"{out}/pd")
    lgd_rows = spark.read.parquet(f"{out}/lgd_rows")
    tables.write_by_split(splits.split_or_empty(lgd_rows, "zero_balance_date", ["loan_seq_num"]), f"{out}/lgd")

    done = spark.read.parquet(f"{out}/pd")
    features = labels.usable_columns(done, PD_FEATURES)
    tables.write_summary(evidence.information_value(done.filter("split = 'train'"), features), f"{out}/pd_iv_summary")
    tables.write_summary(
        stability.stability_summary(done, features, "split", "train", {"oos": "OOS", "oot": "OOT"}), f"{out}/pd_psi_summary"
    )
    return {n: f"{out}/{n}" for n in ("pd", "lgd", "pd_iv_summary", "pd_psi_summary")}


def logistic_pd_job(spark: SparkSession, pd_path: str, out: str, features: Sequence[str] = PD_FEATURES) -> DataFrame:
    """Scores of all splits, metric rows, coefficients, scorecard and feature summary; returns the scores as written."""
    rows = tables.read_columns(spark, pd_path, [*ROW_KEY, "default_12m", "split", *features])
    train = rows.filter("split = 'train'")
    fitted = models.fit_logistic_pd(train, labels.usable_columns(train, features))
    fitted.save(f"{out}/pd_lr_model")
    scored = fitted.transform(rows).select(*ROW_KEY, "default_12m", "score", "split")
    scores = spark.read.parquet(tables.write_by_split(scored, f"{out}/pd_lr_results"))
    tables.write_summary(metrics.evaluate(scores, ["split"], "score", "default_12m"), f"{out}/pd_lr_metrics")
    tables.write_summary(fitted.coefficients(spark), f"{out}/pd_lr_coefs")
    tables.write_summary(metrics.scorecard(scores.filter("split = 'train'"), [], "score", "default_12m"), f"{out}/pd_lr_scorecard")
    tables.write_summary(evidence.iv_from_woe(fitted.woe.table), f"{out}/pd_lr_iv")
    return scores


def boosted_pd_job(
    spark: SparkSession, pd_path: str, out: str, features: Sequence[str] = PD_FEATURES, fitted: models.BoostedPd | None = None, **params
) -> tuple[models.BoostedPd, DataFrame]:
    """Model (fitted on train, or the given one), scores of all splits, metrics and importance; everything after the fit runs on the saved artefact."""
    rows = tables.read_columns(spark, pd_path, [*ROW_KEY, "default_12m", "split", *features])
    fitted = fitted or models.fit_boosted_pd(rows.filter("split = 'train'"), features, **params)
    fitted.save(f"{out}/pd_boosted_model")
    fitted = models.BoostedPd.load(f"{out}/pd_boosted_model")
    scored = fitted.transform(rows).select(*ROW_KEY, "default_12m", "score", "split")
    scores = spark.read.parquet(tables.write_by_split(scored, f"{out}/pd_boosted_results"))
    tables.write_summary(metrics.discrimination(scores, ["split"], "score", "default_12m"), f"{out}/pd_boosted_metrics")
    tables.write_summary(fitted.importance(spark), f"{out}/pd_boosted_importance")
    return fitted, scores


def compare_job(spark: SparkSession, scores: dict[str, DataFrame], out: str) -> DataFrame:
    """Discrimination of all models (name -> scored rows) by split, side by side."""
    tables.write_summary(metrics.compare_models(scores), f"{out}/pd_model_comparison")
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/pd_model_comparison")


def loss_job(spark: SparkSession, lgd_path: str, out: str, fitted: models.LossModels | None = None, **params) -> DataFrame:
    """Predictions of the four loss models (fitted on train, or the given ones) for all splits, and their errors."""
    rows = spark.read.parquet(lgd_path)
    parts = {s: rows.filter(F.col("split") == s) for s in ("train", "oos", "oot")}
    fitted = fitted or models.fit_loss_models(parts["train"], others=[parts["oos"], parts["oot"]], **params)
    fitted.save(f"{out}/lgd_models")
    wide = fitted.transform(rows).select("loan_seq_num", "split", F.col("lgd").alias("actual_lgd"), *fitted.names)
    predictions = spark.read.parquet(tables.write_by_split(wide, f"{out}/lgd_predictions"))
    tables.write_summary(fitted.evaluate(predictions, actual="actual_lgd"), f"{out}/lgd_metrics")
    return predictions


def attribution_job(spark: SparkSession, fitted: models.BoostedPd, rows: DataFrame, out: str) -> DataFrame:
    """Attributions of all given rows, importance, segment and decile reports, density, dependence, and the waterfalls of the riskiest and the safest row."""
    feats = fitted.features
    wide = attribution.tree_attributions(fitted.trees, fitted.vectors(rows), feats, keep=[*ROW_KEY, "default_12m", *feats])
    done = spark.read.parquet(tables.write_rows(wide, f"{out}/shap_values"))
    tables.write_summary(attribution.global_importance(done, feats), f"{out}/shap_importance")
    tables.write_summary(attribution.segment_report(done, feats), f"{out}/shap_segment_report")
    tables.write_summary(attribution.leading_feature_profile(done, feats), f"{out}/shap_decile_profile")
    tables.write_summary(attribution.beeswarm_density(done, feats), f"{out}/shap_density")
    lead = [r["feature"] for r in attribution.global_importance(done, feats).orderBy("rank").limit(2).collect()]
    tables.write_summary(attribution.dependence_bins(done, lead[0], lead[-1]), f"{out}/shap_dependence")
    ends = attribution.extreme_rows(done, "predicted_pd", [*ROW_KEY, "predicted_pd"])
    shown = done.join(F.broadcast(ends.select("which", *ROW_KEY)), ROW_KEY)
    tables.write_summary(attribution.waterfall(shown, feats, ["which", *ROW_KEY]), f"{out}/shap_waterfall")
    return done


def survival_job(spark: SparkSession, pd_path: str, out: str, covariates: Sequence[str] = COX_FEATURES, horizons: Sequence[int] = (12, 24, 36, 60)) -> DataFrame:
    rows = tables.read_columns(spark, pd_path, [*ROW_KEY, "loan_age", "default_12m", "split", *covariates])
    train = survival.survival_table(rows.filter("split = 'train'"), covariates)
    oos = survival.survival_table(rows.filter("split = 'oos'"), covariates)
    by_score = survival.tertiles(train, "credit_score")
    tables.write_summary(survival.kaplan_meier(by_score, ["tertile", "tertile_label"]), f"{out}/survival_km_by_score")
    tables.write_summary(survival.log_rank(by_score, "tertile"), f"{out}/survival_logrank_by_score")
    era = train.withColumn("era", reports.vintage_era(F.col("orig_year")))
    tables.write_summary(survival.kaplan_meier(era, ["era"]), f"{out}/survival_km_by_era")
    survival.CoxArtefact(survival.fit_cox(train, covariates)).save(f"{out}/survival_cox_model")
    cox = survival.CoxArtefact.load(f"{out}/survival_cox_model").model
    tables.write_summary(survival.cox_summary(cox, spark), f"{out}/survival_cox_coefs")
    ranked = train.withColumn("part", F.lit("train")).unionByName(oos.withColumn("part", F.lit("oos"))).dropna(subset=cox.features)
    tables.write_summary(survival.concordance_index(ranked.withColumn("risk", cox.eta()), "risk", ["part"]), f"{out}/survival_c_index")
    trend = survival.linear_trend(survival.schoenfeld_residuals(cox, train), ["feature"], "residual", "duration")
    tables.write_summary(survival.with_correlation_p(trend), f"{out}/survival_residual_trend")
    pds = spark.read.parquet(tables.write_rows(survival.horizon_pds(cox, oos, horizons), f"{out}/survival_pd_horizons"))
    tables.write_summary(reports.horizon_summary(pds, {f"pd_{h}m": f"{h}m" for h in horizons}), f"{out}/survival_horizon_summary")
    tables.write_summary(survival.horizon_calibration(pds, f"pd_{horizons[0]}m"), f"{out}/survival_horizon_calibration")
    return pds


def stress_job(
    spark: SparkSession, fitted: models.BoostedPd, rows: DataFrame, rate_series: DataFrame, out: str, hpi_convention: str = "inverse", pd_period: str = "as_is"
) -> DataFrame:
    """Peak-quarter and full-path losses of ``rows`` under a fitted model; returns the per-row path losses as written."""
    level = macro.latest_level(rate_series)
    peaks = scenarios.peak_quarters(scenarios.macro_paths(level, PEAK_SCENARIOS, floor_state=False))
    pds = scenarios.ensemble_scenario_pds(rows, peaks, fitted, [*ROW_KEY, "default_12m", "orig_upb"], hpi_convention)
    pds = spark.read.parquet(tables.write_rows(pds, f"{out}/scenario_pd_by_loan"))
    tables.write_summary(scenarios.weighted_ecl(pds, PEAK_SCENARIOS), f"{out}/scenario_ecl_summary")
    present = {f: d for f, d in scenarios.SHOCKS.items() if f in fitted.features}
    if present:
        tables.write_summary(scenarios.ensemble_sensitivity(rows, fitted, present), f"{out}/scenario_sensitivity")
    paths = scenarios.macro_paths(level, PATH_SCENARIOS)
    tables.write_summary(paths, f"{out}/macro_paths")
    arrays = scenarios.ensemble_path_pds(rows, paths, fitted, ROW_KEY, hpi_convention=hpi_convention, pd_period=pd_period)
    kept = spark.read.parquet(tables.write_rows(arrays, f"{out}/path_pd_by_loan"))
    ecl = spark.read.parquet(tables.write_rows(scenarios.path_ecl(kept, PATH_SCENARIOS, ROW_KEY), f"{out}/ecl_by_loan"))
    tables.write_summary(scenarios.ecl_summary(ecl, PATH_SCENARIOS), f"{out}/ecl_summary")
    tables.write_summary(scenarios.path_summary(paths), f"{out}/macro_path_summary")
    tables.write_summary(scenarios.mean_array_paths(kept, PATH_SCENARIOS), f"{out}/mean_paths")
    tables.write_summary(scenarios.loss_percentiles(ecl, PATH_SCENARIOS), f"{out}/ecl_percentiles")
    tables.write_summary(scenarios.horizon_growth(ecl, PATH_SCENARIOS), f"{out}/ecl_horizon_growth")
    tables.write_summary(scenarios.recovery_saving(ecl, PATH_SCENARIOS), f"{out}/ecl_recovery_saving")
    tables.write_summary(scenarios.uplift_summary(scenarios.uplift_rows(ecl, ROW_KEY)), f"{out}/ecl_uplift")
    tables.write_summary(scenarios.path_against_peak(ecl, pds, PATH_SCENARIOS), f"{out}/ecl_path_against_peak")
    losses = pds.select((F.col("pd_severe") * scenarios.LOSS_SHARE * F.col("orig_upb") / 1000).alias("loss"))
    tables.write_summary(scenarios.loan_loss_quantile(losses, "loss"), f"{out}/loan_loss_quantile")
    return ecl


def calibration_job(spark: SparkSession, scores: dict[str, DataFrame], out: str) -> DataFrame:
    """Calibrate every score table (name -> frame with loan key, label, ``score`` and ``split``) on one half of its hold-out: one table of metrics
    over all models and methods (returned as written), one of long-run rates, the calibrated rows and the fitted maps of each model."""
    methods = {"score": "Raw", "platt": "Platt", "isotonic": "Isotonic", "temperature": "Temperature"}
    measured, long_run = [], []
    for name, df in scores.items():
        oos = splits.halves(df.filter("split = 'oos'"), ROW_KEY)
        path = calibration.fit_calibrators(oos.filter("half = 'cal'"), "score", "default_12m").save(f"{out}/calibrators_{name.lower()}")
        own = calibration.Calibrators.load(path)
        table, calibrated = calibration.calibrate_models(oos, {"score": name}, "default_12m", keep=ROW_KEY, fitted={name: own})
        measured.append(table.select(F.lit(name).alias("model"), "*"))
        tables.write_rows(calibrated, f"{out}/calibrated_scores_{name.lower()}")
        rest = oos.filter("half = 'eval'").drop("half").withColumn("split", F.lit("oos-eval")).unionByName(df.filter("split = 'oot'"))
        rates = metrics.long_run_default_rate(own.transform(rest, "score"), "split", "default_12m", methods)
        long_run.append(rates.select(F.lit(name).alias("model"), "*"))
    tables.write_summary(reduce(DataFrame.unionByName, long_run), f"{out}/long_run_default_rate")
    tables.write_summary(reduce(DataFrame.unionByName, measured).orderBy("model", "label"), f"{out}/calibration_metrics")
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/calibration_metrics")
