"""Loan text files: headerless, pipe-separated, Latin-1, all text; scans, typing and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.scalars import clip, number, zfill
from creditloom.session import held_side

# Column order of the two file layouts.
ORIGINATION_COLUMNS = [
    "credit_score", "first_payment_date", "first_time_homebuyer", "maturity_date", "msa", "mi_pct", "num_units",
    "occupancy_status", "orig_cltv", "orig_dti", "orig_upb", "orig_ltv", "orig_interest_rate", "channel", "ppm_flag",
    "amortization_type", "property_state", "property_type", "postal_code", "loan_seq_num", "loan_purpose",
    "orig_loan_term", "num_borrowers", "seller_name", "servicer_name", "super_conforming_flag", "pre_harp_seq_num",
    "program_indicator", "harp_indicator", "property_valuation_method", "io_indicator", "mi_cancellation_indicator",
]
SERVICING_COLUMNS = [
    "loan_seq_num", "monthly_reporting_period", "current_upb", "delinquency_status", "loan_age", "remaining_months",
    "defect_settlement_date", "modification_flag", "zero_balance_code", "zero_balance_date", "current_interest_rate",
    "current_deferred_upb", "ddlpi", "mi_recoveries", "net_sale_proceeds", "non_mi_recoveries", "expenses",
    "legal_costs", "maintenance_costs", "taxes_insurance", "misc_expenses", "actual_loss", "modification_cost",
    "step_modification_flag", "deferred_payment_plan", "eltv", "zero_balance_removal_upb",
    "delinquent_accrued_interest", "delinquency_due_to_disaster", "borrower_assistance_status",
    "current_month_modification_cost", "interest_bearing_upb",
]
# The servicing and origination columns that later steps use.
SERVICING_USED = [
    "loan_seq_num", "monthly_reporting_period", "current_upb", "delinquency_status", "loan_age", "zero_balance_code",
    "zero_balance_date", "current_interest_rate", "mi_recoveries", "net_sale_proceeds", "non_mi_recoveries",
    "expenses", "actual_loss", "zero_balance_removal_upb", "delinquent_accrued_interest", "interest_bearing_upb",
]
ORIGINATION_USED = [
    "loan_seq_num", "orig_date", "zip3", "credit_score", "first_time_homebuyer", "mi_pct", "num_units",
    "occupancy_status", "orig_cltv", "orig_dti", "orig_upb", "orig_interest_rate", "channel", "property_state",
    "property_type", "loan_purpose", "num_borrowers",
]
# Texts that mean missing, in every file and in origination files on top.
MISSING_TEXTS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
NUMERIC_SENTINELS = ("9", "99", "999", "9999", "99999", "999999", "9999999")
# Month formats in the order they are tried.
PERIOD_FORMATS = ("M/yyyy", "yyyyMM", "M-yyyy", "yyyy-M", "yyyy-M-d")
# Numeric columns and their admissible ranges.
ORIGINATION_NUMBERS = "credit_score orig_cltv orig_ltv orig_dti orig_upb orig_interest_rate mi_pct num_borrowers orig_loan_term num_units".split()
SERVICING_NUMBERS = [
    "loan_age", "current_upb", "actual_loss", "zero_balance_removal_upb", "mi_recoveries", "net_sale_proceeds",
    "non_mi_recoveries", "expenses", "delinquent_accrued_interest", "interest_bearing_upb", "current_interest_rate",
]
ORIGINATION_RANGES = {"credit_score": (300.0, 850.0), "orig_cltv": (0.0, 200.0), "orig_dti": (0.0, 100.0), "orig_interest_rate": (0.0, 30.0)}
AGE_RANGE = (0.0, 480.0)

VINTAGE_PATTERN = r"[_=](\d{4})(?:\.|/)"


def read_pipe_text(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], used: Sequence[str] | None = None, missing: Sequence[str] = MISSING_TEXTS, vintage_pattern: str = VINTAGE_PATTERN) -> DataFrame:
    """All-text scan of one or many files (a glob covers all years), with ``vintage`` taken from the path.

    ``used`` limits the columns; the parser then skips the others. A path that ``vintage_pattern`` does not match is an error, as
    rows without vintage would be lost in the join by vintage.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema).option("sep", "|").option("header", False).option("encoding", "ISO-8859-1")
        .option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path)
    )
    file = F.col("_metadata.file_path")
    year = F.regexp_extract(file, vintage_pattern, 1).try_cast("int")
    vintage = F.when(year.isNotNull(), year).otherwise(F.raise_error(F.concat(F.lit(f"no vintage by {vintage_pattern} in the path "), file)).cast("int"))
    return raw.select(*[F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) for c in (used or columns)], vintage.alias("vintage"))


def read_originations(spark: SparkSession, path: str | Sequence[str], sentinels: Sequence[str] | Mapping[str, Sequence[str]] = NUMERIC_SENTINELS, vintage_pattern: str = VINTAGE_PATTERN) -> DataFrame:
    """Origination scan. The 9.. texts mean missing in every column; pass a mapping column -> texts to be selective."""
    if not isinstance(sentinels, Mapping):
        return read_pipe_text(spark, path, ORIGINATION_COLUMNS, missing=(*MISSING_TEXTS, *sentinels), vintage_pattern=vintage_pattern)
    raw = read_pipe_text(spark, path, ORIGINATION_COLUMNS, vintage_pattern=vintage_pattern)
    return raw.withColumns({c: F.when(~F.col(c).isin(*texts), F.col(c)) for c, texts in sentinels.items()})


def read_servicing(spark: SparkSession, path: str | Sequence[str], vintage_pattern: str = VINTAGE_PATTERN) -> DataFrame:
    """Servicing scan of the used columns; rows without loan id or period are left out."""
    return read_pipe_text(spark, path, SERVICING_COLUMNS, SERVICING_USED, vintage_pattern=vintage_pattern).dropna(subset=["loan_seq_num", "monthly_reporting_period"])


def _parsed(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit(fmt)).cast("date")


def parse_periods(df: DataFrame, columns: Mapping[str, str], within: str = "vintage", formats: Sequence[str] = PERIOD_FORMATS) -> DataFrame:
    """Parse month texts with one format per column and vintage.

    The format is the first that parses more than half of the rows, else the one that parses most. All
    columns are counted in one aggregate (a row per vintage, written once and broadcast while few), then parsed in one projection.
    ``columns`` maps the text column to the name of the date column.
    """
    n = F.count(F.lit(1))
    measures = [n.alias("_n")]
    for i, c in enumerate(columns):
        measures += [F.count(_parsed(F.col(c), f)).alias(f"_p{i}_{j}") for j, f in enumerate(formats)]
    counts = df.groupBy(within).agg(*measures)
    choices = []
    for i in range(len(columns)):
        parts = [F.col(f"_p{i}_{j}") for j in range(len(formats))]
        choice = None
        for j, p in enumerate(parts):
            hit = p * 2 > F.col("_n")
            choice = F.when(hit, j) if choice is None else choice.when(hit, j)
        best = F.array_position(F.array(*parts), F.array_max(F.array(*parts))) - 1
        choices.append(choice.otherwise(best).cast("int").alias(f"_f{i}"))
    chosen = counts.select(F.col(within).alias("_w"), *choices)
    out = df.join(held_side(chosen), F.col(within).eqNullSafe(F.col("_w")), "left")
    for i, (c, name) in enumerate(columns.items()):
        value = None
        for j, f in enumerate(formats):
            at = F.col(f"_f{i}") == j
            value = F.when(at, _parsed(F.col(c), f)) if value is None else value.when(at, _parsed(F.col(c), f))
        out = out.withColumn(name, value)
    return out.drop("_w", *[f"_f{i}" for i in range(len(columns))])


def period_null_rates(df: DataFrame, dates: Sequence[str], within: str = "vintage", threshold: float = 0.01) -> DataFrame:
    """Share of unparsed dates per vintage and column, with a warning flag above the threshold."""
    agg = df.groupBy(within).agg(*[F.avg(F.col(d).isNull().cast("double")).alias(d) for d in dates])
    cells = F.array(*[F.struct(F.lit(d).alias("date_column"), F.col(d).alias("null_rate")) for d in dates])
    return agg.select(within, F.inline(cells)).withColumn("warning", (F.col("null_rate") > threshold).cast("int"))


def clean_originations(raw: DataFrame) -> DataFrame:
    """Typed origination rows: month of origination (first payment - 1 month), zip3, numbers within their ranges."""
    cols: dict[str, Column] = {}
    for c in ORIGINATION_NUMBERS:
        value = number(F.col(c))
        cols[c] = clip(value, *ORIGINATION_RANGES[c]) if c in ORIGINATION_RANGES else value
    first = F.try_to_timestamp(F.trim("first_payment_date"), F.lit("yyyyMM")).cast("date")
    cols["orig_date"] = F.add_months(first, -1)
    cols["zip3"] = F.substring(zfill(F.trim("postal_code"), 5), 1, 3)
    return raw.withColumns(cols)


def clean_servicing(raw: DataFrame) -> DataFrame:
    """Typed monthly rows: dates, numbers, delinquency (X = 0, R = missing), flag, two-digit code, age 0 to 480."""
    dated = parse_periods(raw, {"monthly_reporting_period": "report_date", "zero_balance_date": "zero_balance_date"})
    cols: dict[str, Column] = {c: number(F.col(c)) for c in SERVICING_NUMBERS}
    cols["loan_age"] = clip(cols["loan_age"], *AGE_RANGE)
    text = F.trim("delinquency_status")
    status = F.when(text == "X", F.lit(0.0)).when(text == "R", None).otherwise(number(text))
    cols["delinquency_status"] = status
    cols["delinquency_indicator"] = F.coalesce(status > 0, F.lit(False)).cast("int")
    cols["zero_balance_code"] = zfill(F.trim("zero_balance_code"), 2)
    return dated.withColumns(cols)
