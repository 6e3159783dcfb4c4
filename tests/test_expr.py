"""Row-wise semantics on tiny frames with hand-computed answers."""
import math

import pytest
from pyspark.sql import functions as F

from loanlens.functions import expr as X
from loanlens.operators import clean as CL


def one_col(spark, values, typ="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_ne_keep_null(spark):
    df = one_col(spark, ["XNA", "M", None, "F"], "string")
    got = sorted(r.x or "" for r in CL.filter_ne_keep_null(df, "x", "XNA").collect())
    assert got == ["", "F", "M"]          # NULL row kept, plain != would drop it
    assert df.filter(F.col("x") != "XNA").count() == 2


def test_ge_drop_null_and_nan(spark):
    df = one_col(spark, [-1.0, 0.0, 2.0, None, float("nan")])
    got = sorted(r.x for r in CL.filter_ge_drop_null(df, "x", 0).collect())
    assert got == [0.0, 2.0]              # NaN >= 0 is true in Spark; must be dropped


@pytest.mark.parametrize("v,label", [
    (-1500.0, "Old"), (-1500.5, "Very Old"), (-1000.0, "Recent"), (-999.0, "Recent"),
    (-500.0, "Very Recent"), (-0.5, "Very Recent"), (0.0, "Missing"), (99998.0, "Missing"),
    (99999.0, None), (365243.0, "Very Old"), (None, None), (-1e9, "Very Old")])
def test_bin_days_edges(spark, v, label):
    got = one_col(spark, [v]).select(X.bin_days("x").alias("b")).first().b
    assert got == label


def test_map_status(spark):
    df = one_col(spark, ["C", "0", "5", "X", "Z", None, "1"], "string")
    got = [r.e for r in df.select(X.map_values("x").alias("e")).collect()]
    assert got == [0, 1, 6, 7, None, None, 2]


@pytest.mark.parametrize("vals,mean,median,total", [
    ((None, None, None), None, None, 0.0),
    ((1.0, None, None), 1.0, 1.0, 1.0),
    ((4.0, None, 1.0), 2.5, 2.5, 5.0),
    ((3.0, 1.0, 2.0), 2.0, 2.0, 6.0),
])
def test_row_stats(spark, vals, mean, median, total):
    df = spark.createDataFrame([vals], "a double, b double, c double")
    r = df.select(X.row_mean(["a", "b", "c"]).alias("m"), X.row_median(["a", "b", "c"]).alias("md"),
                  X.row_sum(["a", "b", "c"]).alias("s")).first()
    assert r.m == mean and r.md == median and r.s == total


def test_ratios_and_years(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (1.0, -0.00001)], "a double, b double")
    r = df.select(X.plain_ratio("a", "b").alias("p"), X.guarded_ratio("a", "b").alias("g"),
                  X.days_to_years("a").alias("y")).collect()
    assert [x.p for x in r][:3] == [None, None, 1.5] and r[3].p == pytest.approx(-100000.0)
    assert r[0].g == pytest.approx(1 / 0.00001) and r[3].g is None   # exact zero denominator
    assert r[2].y == pytest.approx(3.0 / -365)


def test_coerce_numeric(spark):
    df = one_col(spark, ["1", " 2.5 ", "1d", "nan", "abc", "1e3", "-.5", None, "inf"], "string")
    got = [r.x for r in CL.coerce_columns(df, ["x"]).collect()]
    assert got == [1.0, 2.5, None, None, None, 1000.0, -0.5, None, None]


def test_sentinel_frame_keeps_keys(spark):
    df = spark.createDataFrame([(365243, 365243.0, "365243")], "SK_ID_CURR long, D double, s string")
    r = CL.sentinel_to_null_frame(df).first()
    assert r.SK_ID_CURR == 365243 and r.D is None and r.s == "365243"


def test_log_transform_branches(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    r = df.select(X.log_transform("x", -2.0, 1.0).alias("neg"), X.log_transform("x", 1.0).alias("pos")).first()
    assert r.neg == pytest.approx(math.log1p(3 + 2 + 1))
    assert r.pos == pytest.approx(math.log1p(3))
