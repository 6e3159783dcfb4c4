"""Aggregate semantics: modes, null groups, distinct counts, skewness."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlens import config as C
from loanlens.functions import aggs as A
from loanlens.functions.aggs import Agg
from loanlens.operators import marts as M


def test_mode_text_tie_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None), (3, "z")], "k int, v string")
    got = {r.k: r.m for r in df.groupBy("k").agg(A.mode_text("v").alias("m")).collect()}
    assert got == {1: "a", 2: None, 3: "z"}


def test_mode_ordinal_tie_bin_order(spark):
    # Missing (bin 4) and Very Old (bin 0) tie: bin order picks Very Old, text order Missing
    df = spark.createDataFrame([(1, "Missing"), (1, "Very Old"), (1, "Missing"), (1, "Very Old")],
                               "k int, v string")
    r = df.groupBy("k").agg(A.mode_ordinal("v", C.DAY_BIN_LABELS).alias("m"),
                            A.mode_text("v").alias("t")).first()
    assert r.m == "Very Old" and r.t == "Missing"


def test_all_null_group(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, 1.0, "a")], "k int, x double, s string")
    out = M.rollup(df, "k", [Agg("mean", "mean", "x"), Agg("sum0", "sum0", "x"),
                             Agg("nd", "nunique", "x"), Agg("ns", "nunique", "s"),
                             Agg("cnt", "count_eq", "s", "a")])
    got = {r.k: r.asDict() for r in out.collect()}
    assert got[1] == {"k": 1, "mean": None, "sum0": 0.0, "nd": 0, "ns": 0, "cnt": 0}
    assert got[2] == {"k": 2, "mean": 1.0, "sum0": 1.0, "nd": 1, "ns": 1, "cnt": 1}


def test_null_keys_dropped(spark):
    df = spark.createDataFrame([(None, 1.0), (1, 2.0)], "k long, x double")
    assert [r.k for r in M.rollup(df, "k", [Agg("m", "mean", "x")]).collect()] == [1]


def test_distinct_separate_equals_native(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 20, 500), "a": rng.integers(0, 30, 500),
                        "b": rng.choice(["x", "y", "z"], 500), "v": rng.random(500)})
    df = spark.createDataFrame(pdf)
    spec = [Agg("na", "nunique", "a"), Agg("nb", "nunique", "b"), Agg("m", "mean", "v"),
            Agg("mx", "max", "v")]
    s = sorted(map(tuple, M.rollup(df, "k", spec).collect()))
    n = sorted(map(tuple, df.groupBy("k").agg(*A.build_all(spec)).collect()))
    assert [r[:3] for r in s] == [r[:3] for r in n]
    exp = pdf.groupby("k").agg(na=("a", "nunique"), nb=("b", "nunique")).reset_index()
    assert [(r[0], r[1], r[2]) for r in s] == list(exp.itertuples(index=False, name=None))


def test_distinct_counts_mixed_types_stay_typed(spark):
    # long, double and text columns in one pass; -0.0 and 0.0 are one value,
    # NULLs are not counted, a key with only NULLs counts 0
    rows = [(1, 7, 0.0, "a"), (1, 7, -0.0, "b"), (1, 8, None, "a"), (2, None, None, None),
            (3, 1, 1.5, "1"), (3, 2, 1.5, "1.0")]
    df = spark.createDataFrame(rows, "k int, i long, d double, s string")
    spec = [Agg("ni", "nunique", "i"), Agg("nd", "nunique", "d"), Agg("ns", "nunique", "s")]
    got = {r.k: (r.ni, r.nd, r.ns) for r in M.rollup(df, "k", spec).collect()}
    assert got == {1: (2, 1, 2), 2: (0, 0, 0), 3: (2, 1, 2)}


@pytest.mark.parametrize("vals", [[1.0, 2.0, 10.0, 3.0, 50.0], [5.0, 1.0, 1.0, 1.0], [2.0, 2.0, 2.0], [1.0, 9.0]])
def test_skewness_matches_pandas(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.agg(A.skewness_unbiased("x").alias("s")).first().s
    exp = pd.Series(vals).skew()
    if len(vals) < 3 or np.isclose(np.std(vals), 0):
        assert got is None          # pandas: NaN for n < 3, 0 for constant; neither is selected
    else:
        assert got == pytest.approx(exp, rel=1e-9)


def test_rollup_distinct_planning_rule(spark):
    df = spark.createDataFrame([(1, 10, "a", 1.0), (1, 11, "b", 2.0), (2, 10, "a", None)],
                               "k long, x long, s string, v double")

    def plan(spec):
        out = M.rollup(df, "k", spec)
        out.collect()
        return out._jdf.queryExecution().executedPlan().toString()

    one = plan([Agg("n", "nunique", "x"), Agg("m", "mean", "v")])
    assert "count(distinct" in one and "Join" not in one          # Spark's one-pass plan
    with_mode = plan([Agg("n", "nunique", "x"), Agg("md", "mode", "s")])
    assert "count(distinct" not in with_mode and "Join" not in with_mode   # stacked, one pass
    two = plan([Agg("n", "nunique", "x"), Agg("ns", "nunique", "s")])
    for p in (with_mode, two):                       # one scan, one copy per valued column, no object buffers
        final = p.split("== Initial Plan ==")[0]
        assert "Expand" not in p and "Join" not in p and "ObjectHash" not in p
        assert final.count("Scan ") == 1 and final.count("Generate inline") == 1
