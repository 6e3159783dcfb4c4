"""Skew transform (batch and fitted), scaler, one-hot, drop/filter, persistence."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel

from loanlens.operators import ml as ML
from loanlens.operators import skew as SK


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(400), "pos": rng.lognormal(0, 1.2, 400),
                        "neg": rng.lognormal(0, 1.2, 400) - 5.0, "flat": rng.normal(0, 1, 400)})
    pdf.loc[5, "pos"] = np.nan
    return spark.createDataFrame(pdf.astype(object).where(pd.notna(pdf), None),
                                 "id long, pos double, neg double, flat double"), pdf


def pandas_reference(pdf, exclude):
    """Own pandas re-derivation of the transform (not the original code)."""
    out = pdf.copy()
    for c in [c for c in pdf.columns if c not in exclude]:
        s = pdf[c]
        if abs(s.skew()) > 1:
            mn = s.min()
            out[c] = np.log1p(s - mn + 1) if mn <= 0 else np.log1p(s)
            out[c] = out[c].fillna(s)
    return out


def test_batch_skew_matches_pandas(skewed):
    df, pdf = skewed
    got = SK.log_transform_skewed(df, exclude=["id"]).toPandas().sort_values("id").reset_index(drop=True)
    exp = pandas_reference(pdf, ["id"])
    for c in ["pos", "neg", "flat"]:
        np.testing.assert_allclose(got[c].astype(float), exp[c].astype(float), rtol=1e-12, equal_nan=True)
    assert got["flat"].equals(pdf["flat"])          # unskewed column untouched


def test_report_and_monotone(skewed):
    df, pdf = skewed
    rep = {r.column_name: r for r in SK.skew_report(df, exclude=["id"]).collect()}
    assert rep["pos"].selected and rep["neg"].selected and not rep["flat"].selected
    assert rep["neg"].min_value == pytest.approx(pdf["neg"].min())
    got = SK.log_transform_skewed(df, exclude=["id"]).toPandas().sort_values("id")
    order_in = pdf.sort_values("neg")["id"].tolist()
    order_out = got.sort_values("neg")["id"].tolist()
    assert order_in == order_out                     # monotone within a column


def test_fitted_equals_batch_and_persists(spark, skewed, tmp_path):
    df, _ = skewed
    model = SK.SkewLogEstimator(inputCols=["pos", "neg", "flat"]).fit(df)
    assert sorted(model.getOrDefault(model.selectedCols)) == ["neg", "pos"]
    path = str(tmp_path / "skew")
    model.write().overwrite().save(path)
    loaded = SK.SkewLogModel.load(path)
    a = loaded.transform(df).orderBy("id").toPandas()
    b = SK.log_transform_skewed(df, exclude=["id"]).orderBy("id").toPandas()
    np.testing.assert_allclose(a["neg"], b["neg"], rtol=1e-12)


def test_values_below_the_fitted_minimum_are_clamped(spark):
    fit = spark.createDataFrame([(float(x),) for x in [0, 0, 0, 1, 1, 2, 3, 500]], "x double")
    model = SK.SkewLogEstimator(inputCols=["x"]).fit(fit)
    got = [r.x for r in model.transform(spark.createDataFrame([(-500.0,), (0.0,), (3.0,), (None,)], "x double")).collect()]
    assert got[0] == got[1] == pytest.approx(math.log1p(1)) and got[2] == pytest.approx(math.log1p(4)) and got[3] is None


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, c double")
    m = ML.PopulationStandardScaler(inputCols=["a", "c"], outputCols=["az", "cz"]).fit(df)
    assert m.getOrDefault(m.scales)[0] == pytest.approx(np.std([1, 2, 4]))   # 1.2472, not 1.5275
    assert m.getOrDefault(m.scales)[1] == 1.0                                 # constant -> divide by 1
    out = m.transform(df).collect()
    assert [r.cz for r in out] == [0.0, 0.0, 0.0]
    batch = ML.standardise_batch(df, ["a"], suffix="_z").collect()
    assert [r.a_z for r in batch] == pytest.approx([r.az for r in out])


def test_drop_filter_transformer(spark):
    df = spark.createDataFrame([(1, "XNA", 1.0), (2, None, 2.0), (3, "M", 3.0)], "k long, g string, x double")
    t = ML.DropFilterTransformer(columnsToDrop=["x", "absent"], filterColumn="g", filterValue="XNA")
    out = t.transform(df)
    assert out.columns == ["k", "g"] and sorted(r.k for r in out.collect()) == [2, 3]


def test_pipeline_unknown_category_and_roundtrip(spark, tmp_path):
    train = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "k long, s string, x double")
    test = spark.createDataFrame([(4, "zzz", 2.0)], "k long, s string, x double")
    pipe = ML.preprocessing_pipeline(["x"], ["s"], filter_column="s", filter_value="XNA")
    model = pipe.fit(train)
    path = str(tmp_path / "prep")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    v = loaded.transform(test).first().features.toArray()
    # numeric block: (2 - mean(1,0,3)) / std_pop ; categorical block a,b,missing -> unknown all zero
    mean, std = np.mean([1, 0, 3]), np.std([1, 0, 3])
    assert v[0] == pytest.approx((2 - mean) / std)
    assert list(v[1:]) == [0.0, 0.0, 0.0]
    tv = loaded.transform(train).orderBy("k").collect()
    assert list(tv[2].features.toArray()[1:]) == [0.0, 0.0, 1.0]   # NULL -> "missing" category


def test_feature_roles_skip_binned_modes(spark):
    df = spark.createDataFrame([(1, 0, 1.0, "a", "Old")],
                               "SK_ID_CURR long, TARGET int, x double, s string, PREV_D_BINNED_MODE string")
    num, cat = ML.feature_roles(df)
    assert num == ["x"] and cat == ["s"]
    assert ML.feature_roles(df, include_binned_modes=True)[1] == ["s", "PREV_D_BINNED_MODE"]


def test_stacked_stats_match_pandas(skewed):
    from pyspark.sql import functions as F

    from loanlens.functions import aggs as A

    df, pdf = skewed
    cols = ["pos", "neg", "flat"]
    rows = {r.idx: r for r in A.stacked_stats(df, cols, skew=A.skewness_unbiased, mn=F.min,
                                               n=F.count, sd=F.stddev_pop).collect()}
    assert sorted(rows) == [0, 1, 2]
    for i, c in enumerate(cols):
        s = pdf[c].dropna()
        assert rows[i].n == len(s)
        assert rows[i].mn == s.min()
        assert rows[i].skew == pytest.approx(s.skew(), rel=1e-9)
        assert rows[i].sd == pytest.approx(s.std(ddof=0), rel=1e-9)


def test_report_on_empty_frame_lists_every_column(skewed):
    df, _ = skewed
    rep = SK.skew_report(df.limit(0), exclude=["id"]).collect()
    assert sorted(r.column_name for r in rep) == ["flat", "neg", "pos"]
    assert all(r.n == 0 and r.skewness is None and not r.selected for r in rep)
    # batch transform of an empty frame keeps the schema, selects nothing
    out = SK.log_transform_skewed(df.limit(0), exclude=["id"])
    assert out.count() == 0 and out.columns == df.columns


@pytest.mark.parametrize("width", [23, 24, 30])
def test_every_width_gives_the_same_form(skewed, width):
    """The same statistics, and every column listed for an empty frame too."""
    from pyspark.sql import functions as F

    from loanlens.functions import aggs as A

    df, pdf = skewed
    names = [f"p{i}" for i in range(width)]
    wide = df.select("id", *[(F.col("pos") + F.lit(float(i))).alias(n) for i, n in enumerate(names)])
    rep = {r.column_name: r for r in SK.skew_report(wide, exclude=["id"]).collect()}
    assert sorted(rep) == sorted(names)
    assert rep["p3"].skewness == pytest.approx(pdf["pos"].skew(), rel=1e-9)
    assert rep["p3"].min_value == pytest.approx(pdf["pos"].min() + 3.0)
    empty = SK.skew_report(wide.limit(0), exclude=["id"]).collect()
    assert len(empty) == width and all(r.n == 0 and not r.selected for r in empty)
    got = SK.log_transform_skewed(wide, exclude=["id"]).select("id", "p0").toPandas()
    exp = pandas_reference(pdf[["id", "pos"]], ["id"])
    got = got.sort_values("id")["p0"].to_numpy()
    np.testing.assert_allclose(got, exp.sort_values("id")["pos"].to_numpy(), rtol=1e-12, equal_nan=True)


def test_standardise_batch_wide_equals_narrow(spark, skewed):
    from pyspark.sql import functions as F

    df, _ = skewed
    names = [f"p{i}" for i in range(30)]
    wide = df.select("id", *[(F.col("pos") * F.lit(float(i + 1))).alias(n) for i, n in enumerate(names)])
    w = ML.standardise_batch(wide, names, suffix="_z").select("id", "p0_z", "p29_z")
    n = ML.standardise_batch(wide, ["p0", "p29"], suffix="_z").select("id", "p0_z", "p29_z")
    a = sorted(map(tuple, w.collect()), key=lambda r: r[0])
    b = sorted(map(tuple, n.collect()), key=lambda r: r[0])
    for x, y in zip(a, b):
        assert x[0] == y[0]
        for u, v in zip(x[1:], y[1:]):
            assert (u is None and v is None) or u == pytest.approx(v, rel=1e-12, abs=1e-12)
