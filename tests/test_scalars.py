import math

from pyspark.sql import functions as F

from creditloom.functions import scalars
from creditloom.functions.tails import chi2_tail, normal_two_sided, pearson_two_sided, student_two_sided


def one(spark, expr, **values):
    cells = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cells).select(expr.alias("r")).first()["r"]


def test_clip_keeps_missing(spark):
    assert one(spark, scalars.clip(F.col("x").cast("double"), 0.0, 1.0), x=None) is None
    assert one(spark, scalars.clip(F.col("x"), 0.0, 1.0), x=-2.0) == 0.0
    assert one(spark, scalars.clip(F.col("x"), 0.0, 1.0), x=2.0) == 1.0


def test_zfill_never_cuts(spark):
    assert one(spark, scalars.zfill(F.col("x"), 5), x="1234") == "01234"
    assert one(spark, scalars.zfill(F.col("x"), 5), x="1234567") == "1234567"


def test_numbers_and_ratio(spark):
    assert one(spark, scalars.number(F.col("x")), x=" 12.5 ") == 12.5
    assert one(spark, scalars.number(F.col("x")), x="abc") is None
    assert one(spark, scalars.number(F.col("x")), x="NaN") is None
    assert one(spark, scalars.safe_ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None


def test_bins_are_right_closed(spark):
    edges = F.array(*[F.lit(float(e)) for e in (0, 10, 20)])
    got = [one(spark, scalars.right_closed_bin(F.col("x"), edges), x=float(v)) for v in (-1, 0, 5, 10, 10.5, 20, 21)]
    assert got == [None, 1, 1, 1, 2, 2, None]


def test_tails():
    assert abs(chi2_tail(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(chi2_tail(15.507313055865453, 8) - 0.05) < 1e-12
    assert abs(chi2_tail(7.814727903251179, 3) - 0.05) < 1e-12
    assert abs(normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(student_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(student_two_sided(12.706204736432095, 1) - 0.05) < 1e-9
    assert math.isnan(pearson_two_sided(0.5, 2))


def test_hash_bucket_is_layout_free(spark):
    df = spark.range(1000)
    a = {r[0]: r[1] for r in df.repartition(7).select("id", scalars.hash_bucket(["id"])).collect()}
    b = {r[0]: r[1] for r in df.coalesce(1).select("id", scalars.hash_bucket(["id"])).collect()}
    assert a == b
    assert 0.25 < sum(v < 300_000 for v in a.values()) / 1000 < 0.35
