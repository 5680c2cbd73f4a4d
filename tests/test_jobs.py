"""One small book through every job: text files to expected loss."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from creditloom.plans import jobs
from creditloom.sources import loans


def write_book(folder, n=150, seed=4):
    rng = np.random.default_rng(seed)
    orig, perf = [], []
    for i in range(n):
        score, dti = int(rng.integers(500, 800)), int(rng.integers(10, 60))
        orig.append({"loan_seq_num": f"L{i}", "credit_score": score, "first_payment_date": "201601", "occupancy_status": "PIS"[i % 3], "orig_cltv": int(rng.integers(50, 98)),
                     "orig_dti": dti, "orig_upb": int(rng.integers(50, 400)) * 1000, "orig_interest_rate": round(float(rng.uniform(2, 8)), 2), "property_type": "SF",
                     "postal_code": "12345", "num_borrowers": 1 + i % 2, "channel": "R", "mi_pct": 0, "num_units": 1, "first_time_homebuyer": "N", "loan_purpose": "P", "property_state": "NY"})
        fails = rng.random() < 1 / (1 + np.exp((score - 620) / 40))
        stop = int(rng.integers(6, 30)) if fails else 30
        for m in range(stop):
            row = {"loan_seq_num": f"L{i}", "monthly_reporting_period": f"{m % 12 + 1:02d}/{2016 + m // 12}", "current_upb": 100000 - m, "delinquency_status": "0" if m < stop - 2 or not fails else "2", "loan_age": m, "current_interest_rate": 4}
            if fails and m == stop - 1:
                row |= {"zero_balance_code": "03", "zero_balance_date": row["monthly_reporting_period"], "actual_loss": 20000 + i * 100, "zero_balance_removal_upb": 90000}
            perf.append(row)
    for name, columns, rows in (("sample_orig_2016.txt", loans.ORIGINATION_COLUMNS, orig), ("sample_svcg_2016.txt", loans.SERVICING_COLUMNS, perf)):
        (folder / name).write_text("".join("|".join(str(r.get(c, "")) for c in columns) + "\n" for r in rows), encoding="latin-1")


def test_losses_read_the_written_paths(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    rows = spark.createDataFrame([(i, dt.date(2001, 1, 1), int(i % 3 == 0), float(a), float(b), 1000.0 + i) for i, (a, b) in enumerate(x)], "loan_seq_num int, report_date date, default_12m int, loan_age double, ur_3m_lag double, orig_upb double")
    fitted = jobs.models.fit_boosted_pd(rows, ["loan_age", "ur_3m_lag"], [], block=2, maxIter=2, maxDepth=2, minInstancesPerNode=5)
    rate = spark.createDataFrame([(dt.date(2018, 1, 1), 4.0)], "date date, unemployment_rate double")
    plans, plain = [], jobs.scenarios.path_ecl

    def spy(loans, *rest):
        plans.append(loans._jdf.queryExecution().optimizedPlan().toString())
        return plain(loans, *rest)

    monkeypatch.setattr(jobs.scenarios, "path_ecl", spy)
    ecl = jobs.stress_job(spark, fitted, rows, rate, str(tmp_path / "out"))
    assert ecl.count() == 300 and len(plans) == 1 and "PythonUDF" not in plans[0] and "EvalPython" not in plans[0]


def test_jobs_from_text_to_losses(spark, tmp_path):
    write_book(tmp_path)
    out = str(tmp_path / "out")
    paths = jobs.prepare_tables(spark, f"{tmp_path}/sample_orig_*.txt", f"{tmp_path}/sample_svcg_*.txt", out)
    rows = spark.read.parquet(paths["pd"])
    table = lambda name, infer=True: spark.read.option("header", True).option("inferSchema", infer).csv(f"{out}/{name}").collect()
    panel = spark.read.parquet(f"{out}/panel")
    assert {r["zero_balance_code"]: r["n"] for r in table("dispositions", False)}["03"] == str(panel.filter("zero_balance_code = '03'").count())
    assert {r["n"] for r in table("panel_null_rates")} == {panel.count()} and all(r["n_null"] == panel.filter(F.col(r["date_column"]).isNull()).count() for r in table("panel_null_rates"))
    rates = {r["measure"]: r for r in table("rates")}
    assert rates["default_12m"]["n"] == rows.count() and abs(rates["default_12m"]["mean"] - rows.agg(F.avg("default_12m")).first()[0]) < 1e-12
    assert abs(rates["lgd"]["mean"] - spark.read.parquet(paths["lgd"]).agg(F.avg("lgd")).first()[0]) < 1e-12
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "oos", "oot"}
    scores = jobs.logistic_pd_job(spark, paths["pd"], out)
    assert scores.count() == rows.count() and scores.filter("score <= 0 or score >= 1").count() == 0
    measured = {r["split"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/pd_lr_metrics").collect()}
    assert measured["train"]["auroc"] > 0.6
    fitted, boosted = jobs.boosted_pd_job(spark, paths["pd"], out, maxIter=3, maxDepth=3, minInstancesPerNode=5)
    assert "hpi_change" not in fitted.features and "credit_score" in fitted.features
    rate = spark.createDataFrame([(dt.date(2018, 1, 1), 4.0)], "date date, unemployment_rate double")
    ecl = jobs.stress_job(spark, fitted, rows.filter("split = 'oos'"), rate, out)
    assert ecl.filter("ecl_base_1Y > ecl_base_5Y + 1e-9").count() == 0 and ecl.count() == rows.filter("split = 'oos'").count()
    for name, least in (("loan_loss_quantile", 1), ("macro_path_summary", 3), ("mean_paths", 60), ("ecl_percentiles", 12), ("ecl_horizon_growth", 12), ("ecl_recovery_saving", 3), ("ecl_uplift", 2), ("ecl_path_against_peak", 3), ("scenario_sensitivity", 0)):
        assert len(table(name)) == least if least else True, name
    both = jobs.compare_job(spark, {"Logistic Regression": scores, "Boosted Trees": boosted}, out)
    assert both.count() == 2 * scores.select("split").distinct().count()
    measured = jobs.calibration_job(spark, {"LR": scores, "GB": boosted}, out)
    assert measured.count() == 8 and {r["model"] for r in measured.collect()} == {"LR", "GB"} and len(table("long_run_default_rate")) == 2 * 2 * 4
    horizon = jobs.survival_job(spark, paths["pd"], out, ["credit_score", "orig_dti"])
    assert horizon.filter(F.col("pd_60m") < F.col("pd_12m")).count() == 0
    assert len(table("survival_horizon_summary")) == 4 and sum(r["n"] for r in table("survival_horizon_calibration")) == horizon.count()
    shap = jobs.attribution_job(spark, fitted, rows.filter("split = 'oos'"), out)
    total = sum((F.col(f"shap_{f}") for f in fitted.features), F.col("base_value"))
    assert shap.agg(F.max(F.abs(total - F.col("margin")))).first()[0] < 1e-9
    assert {r["which"] for r in table("shap_waterfall")} == {"highest", "lowest"} and sum(r["n"] for r in table("shap_dependence")) == shap.count()
    assert len(table("shap_density")) > 2 and len(table("shap_decile_profile")) >= 5
    losses = jobs.loss_job(spark, paths["lgd"], out, forest_params={"numTrees": 3}, boosted_params={"maxIter": 2})
    assert losses.filter("spline_pred < 0 or spline_pred > 1 or frm_pred is null").count() == 0
