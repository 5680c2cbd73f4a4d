import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditloom.operators import joins, labels, splits
from creditloom.sources import loans, macro, tables


def d(text):
    return dt.date.fromisoformat(text)


def line(columns, **values):
    return "|".join(str(values.get(c, "")) for c in columns) + "\n"


def test_servicing_traps(spark, tmp_path):
    rows = [
        dict(loan_seq_num="A", monthly_reporting_period="01/2000", delinquency_status="X", zero_balance_code="3", loan_age="600"),
        dict(loan_seq_num="A", monthly_reporting_period="02/2000", delinquency_status="R"),
        dict(loan_seq_num="B", monthly_reporting_period="03/2000", delinquency_status="12"),
        dict(loan_seq_num="B", monthly_reporting_period="junk", delinquency_status="3"),
        dict(loan_seq_num="", monthly_reporting_period="03/2000"),
    ]
    (tmp_path / "sample_svcg_2000.txt").write_text("".join(line(loans.SERVICING_COLUMNS, **r) for r in rows), encoding="latin-1")
    formats = {"2001": "200101", "2002": "01-2002", "2003": "2003-01", "2004": "2004-01-01"}
    for year, text in formats.items():
        (tmp_path / f"sample_svcg_{year}.txt").write_text(line(loans.SERVICING_COLUMNS, loan_seq_num="C", monthly_reporting_period=text), encoding="latin-1")
    got = loans.clean_servicing(loans.read_servicing(spark, str(tmp_path))).toPandas()
    first = got[got.vintage == 2000].set_index("monthly_reporting_period")
    assert first.loc["01/2000", "delinquency_status"] == 0 and first.loc["01/2000", "zero_balance_code"] == "03" and first.loc["01/2000", "loan_age"] == 480
    assert first.loc["02/2000"].isna()["delinquency_status"] and first.loc["02/2000", "delinquency_indicator"] == 0
    assert first.loc["03/2000", "delinquency_status"] == 12 and first.loc["03/2000", "report_date"] == d("2000-03-01")
    assert first.loc["junk", "report_date"] is None and len(first) == 4
    for year in formats:
        assert got[got.vintage == int(year)].report_date.iloc[0] == d(f"{year}-01-01")


def test_origination_traps(spark, tmp_path):
    rows = [
        dict(loan_seq_num="A", credit_score="9999", orig_dti="9", postal_code="1234", first_payment_date="200003", seller_name="Crédit"),
        dict(loan_seq_num="B", credit_score="200", orig_dti="120", postal_code="1234567", first_payment_date="x", channel=" "),
    ]
    (tmp_path / "sample_orig_2000.txt").write_text("".join(line(loans.ORIGINATION_COLUMNS, **r) for r in rows), encoding="latin-1")
    got = {r["loan_seq_num"]: r for r in loans.clean_originations(loans.read_originations(spark, str(tmp_path))).collect()}
    assert got["A"]["credit_score"] is None and got["A"]["orig_dti"] is None and got["A"]["zip3"] == "012" and got["A"]["orig_date"] == d("2000-02-01")
    assert got["A"]["seller_name"] == "Crédit" and got["A"]["vintage"] == 2000
    assert got["B"]["credit_score"] == 300 and got["B"]["orig_dti"] == 100 and got["B"]["zip3"] == "123" and got["B"]["orig_date"] is None and got["B"]["channel"] is None
    keep = loans.clean_originations(loans.read_originations(spark, str(tmp_path), {"credit_score": ["9999"]}))
    assert keep.filter("loan_seq_num = 'A'").first()["orig_dti"] == 9


def test_default_window_edges(spark):
    rows = [("A", "2000-01-01", None), ("A", "2000-12-31", "03"), ("A", "2001-01-31", "03"), ("B", "2000-01-01", None), ("B", "2001-01-01", "09"), ("C", "2000-01-01", None), ("C", None, "02"), ("D", "2000-01-01", "01")]
    df = spark.createDataFrame([(a, d(b) if b else None, c) for a, b, c in rows], "loan_seq_num string, report_date date, zero_balance_code string")
    got = {r["loan_seq_num"]: (r["days_to_default"], r["default_12m"]) for r in labels.default_rows(df).collect()}
    assert got == {"A": (365, 1), "B": (366, 0), "C": (None, 0), "D": (None, 0)}


def test_loss_rows_take_last_known_values(spark):
    schema = "loan_seq_num string, report_date date, zero_balance_code string, current_upb double, actual_loss double, zero_balance_removal_upb double"
    rows = [("A", d("2000-01-01"), "03", 90.0, 30.0, None), ("A", d("2000-02-01"), "03", 60.0, None, None), ("B", d("2000-01-01"), "03", 0.0, 5.0, None), ("C", d("2000-01-01"), "03", 10.0, None, 50.0), ("E", d("2000-01-01"), "03", 10.0, 90.0, None)]
    got = {r["loan_seq_num"]: (r["lgd_raw"], r["lgd"]) for r in labels.loss_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"A": (0.5, 0.5), "C": (0.0, 0.0), "E": (9.0, 1.0)}


def test_nearest_rate_tolerance_and_ties(spark):
    series = spark.createDataFrame([(d("2000-01-01"), 1.0), (d("2000-01-11"), 2.0), (d("2000-06-01"), 3.0)], "date date, unemployment_rate double")
    wanted = {"2000-01-06": 1.0, "2000-02-25": 2.0, "2000-02-26": None, "2000-04-17": 3.0, "2000-04-16": None}
    panel = spark.createDataFrame([(d(k),) for k in wanted], "lag date").withColumn("report_date", F.col("lag"))
    got = joins.attach_rate_lag(panel, series, lag_months=0)
    assert {str(r["lag"]): r["ur_3m_lag"] for r in got.collect()} == wanted


def test_complete_cases_per_vintage(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, None), (2, 1.0, 1.0), (2, None, 1.0)], "vintage int, a double, b double")
    assert sorted((r["vintage"], r["b"]) for r in labels.complete_cases(df, ["a", "b"], "vintage").collect()) == [(1, 1.0), (2, 1.0)]


def test_split_guard(spark):
    df = spark.createDataFrame([(1, d("2020-01-01")), (2, None)], "k int, report_date date")
    try:
        splits.require_in_sample(df, "report_date")
        raise AssertionError("no error")
    except ValueError as e:
        assert "2020-01-01" in str(e) and "50.0%" in str(e)
    assert splits.temporal_split(df, "report_date", ["k"]).collect()[0]["split"] == "oot"


def test_missing_macro_files_give_null_features(spark, tmp_path):
    assert macro.read_price_index(spark, str(tmp_path / "none.csv")) is None and macro.read_unemployment(spark, str(tmp_path)) is None
    panel = spark.createDataFrame([("012", d("2000-01-01"), d("2001-01-01"))], "zip3 string, orig_date date, report_date date")
    r = joins.attach_rate_lag(joins.attach_price_change(panel, None), None).first()
    assert r["hpi_change"] is None and r["ur_3m_lag"] is None
    (tmp_path / "unemployment_rate.csv").write_text("Date, Unemployment_Rate \n2000-01-01,4.0\n2000-02-01,x\n")
    assert [tuple(r) for r in macro.read_unemployment(spark, str(tmp_path)).collect()] == [(d("2000-01-01"), 4.0)]
    assert tables.read_csv_or_empty(spark, str(tmp_path / "gone")).columns == tables.SCORE_SCHEMA.fieldNames()


def test_a_path_without_year_is_an_error(spark, tmp_path):
    (tmp_path / "servicing.txt").write_text(line(loans.SERVICING_COLUMNS, loan_seq_num="A", monthly_reporting_period="01/2000"), encoding="latin-1")
    with pytest.raises(Exception, match="no vintage"):
        loans.read_servicing(spark, str(tmp_path)).collect()
    assert loans.read_servicing(spark, str(tmp_path), r"(\d{4})?servicing") is not None


def test_complete_cases_keep_rows_of_a_null_part(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (2001, None)], "vintage int, a double")
    assert sorted(map(tuple, labels.complete_cases(df, ["a"], "vintage").collect()), key=str) == [(2001, None), (None, 1.0)]


def test_a_second_write_leaves_no_old_partition(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1), ("oot", 2)], "split string, x int")
    path = str(tmp_path / "t")
    tables.write_by_split(rows, path)
    tables.write_by_split(rows.filter("split = 'train'"), path)
    assert [tuple(r) for r in spark.read.parquet(path).select("split", "x").collect()] == [("train", 1)]
    tables.write_by(rows.filter("split = 'oot'"), path, "split", incremental=True)
    assert spark.read.parquet(path).count() == 2
