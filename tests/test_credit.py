"""End-to-end credit pipeline on the generated seven-table fixture."""
import os

import numpy as np
import pandas as pd
import pytest

from loanlens import config as C
from loanlens.operators import ml as ML
from loanlens.plans import credit as CR
from loanlens.sources import io as IO


@pytest.fixture(scope="module")
def feats(credit):
    """The mart before the final skew step (the skew step has its own test)."""
    return CR.build_features(credit, skew=False).toPandas().set_index("SK_ID_CURR")


def test_final_skew_step(credit, feats):
    full = CR.build_features(credit).toPandas().set_index("SK_ID_CURR").sort_index()
    raw = feats.sort_index()
    for c in C.SKEW_EXCLUDE:
        if c in raw.columns and c != "SK_ID_CURR":
            pd.testing.assert_series_equal(full[c], raw[c], check_dtype=False)   # excluded: untouched
    s = raw["PREV_APP_COUNT"].astype(float)
    if abs(s.skew()) > 1:
        mn = s.min()
        exp = np.log1p(s - mn + 1) if mn <= 0 else np.log1p(s)
        np.testing.assert_allclose(full["PREV_APP_COUNT"], exp.fillna(s), rtol=1e-9, equal_nan=True)


def test_row_grain(feats, credit_pd):
    app = credit_pd["application_train"]
    kept = app[app["CODE_GENDER"].fillna("") != "XNA"]
    assert len(feats) == len(kept) and feats.index.is_unique
    assert C.DAYS_SENTINEL in feats.index              # key equal to the sentinel survives (D1)
    assert set(feats.index) == set(kept["SK_ID_CURR"])


def test_prev_mart_against_pandas(feats, credit_pd):
    prev = credit_pd["previous_application"]
    prev = prev[prev["AMT_ANNUITY"] >= 0]
    cnt = prev.groupby("SK_ID_CURR")["SK_ID_PREV"].nunique()
    mean = prev.groupby("SK_ID_CURR")["AMT_CREDIT"].mean()
    for k in feats.index:
        if k in cnt.index:
            assert feats.loc[k, "PREV_APP_COUNT"] == cnt[k]
            if not np.isnan(mean[k]):
                assert feats.loc[k, "PREV_AMT_CREDIT_MEAN"] == pytest.approx(mean[k])
        else:
            assert pd.isna(feats.loc[k, "PREV_APP_COUNT"])     # unmatched -> NULL, not 0


def test_mode_ties(feats, credit_pd):
    ids = credit_pd["application_train"]["SK_ID_CURR"].tolist()
    assert feats.loc[ids[-6], "PREV_DAYS_FIRST_DUE_BINNED_MODE"] == "Very Old"    # bin order
    assert feats.loc[ids[-7], "CREDIT_NAME_CONTRACT_STATUS_MODE"] == "Active"     # text order


def test_bureau_counts_against_pandas(feats, credit_pd):
    b, bb = credit_pd["bureau"], credit_pd["bureau_balance"].copy()
    bb["enc"] = bb["STATUS"].map(C.STATUS_MAPPING)
    bal = bb.groupby("SK_ID_BUREAU")["enc"].max().rename("mx")
    m = b.merge(bal, left_on="SK_ID_BUREAU", right_index=True, how="left")
    g = m.groupby("SK_ID_CURR")
    exp = pd.DataFrame({"n": g["SK_ID_BUREAU"].nunique(),
                        "active": g["CREDIT_ACTIVE"].agg(lambda x: (x == "Active").sum()),
                        "cur": g["CREDIT_CURRENCY"].nunique(), "typ": g["CREDIT_TYPE"].nunique(),
                        "mx": g["mx"].max()})
    for k, r in exp.iterrows():
        if k not in feats.index:
            continue
        f = feats.loc[k]
        assert f["BUREAU_SK_ID_BUREAU"] == r["n"] and f["BUREAU_CREDIT_ACTIVE"] == r["active"]
        assert f["BUREAU_CREDIT_CURRENCY"] == r["cur"] and f["BUREAU_CREDIT_TYPE"] == r["typ"]
        if pd.isna(r["mx"]):
            assert pd.isna(f["BUREAU_BUREAU_BAL_STATUS_MAX"])
        else:
            assert f["BUREAU_BUREAU_BAL_STATUS_MAX"] == pytest.approx(r["mx"])


def test_row_features(feats, credit_pd):
    app = credit_pd["application_train"].set_index("SK_ID_CURR")
    k = app.index[9]                                        # CNT_FAM_MEMBERS == 0
    assert pd.isna(feats.loc[k, "CHILDREN_RATIO"])          # x/0 -> NULL (D2)
    k = app.index[8]                                        # DAYS_EMPLOYED sentinel
    assert pd.isna(feats.loc[k, "EMPLOYMENT_YEARS"])
    k = app.index[11]                                       # all EXT_SOURCE missing
    assert pd.isna(feats.loc[k, "EXT_SOURCE_MEAN"]) and pd.isna(feats.loc[k, "EXT_SOURCE_MEDIAN"])
    k = app.index[13]
    e = app.loc[k, C.EXT_SOURCE_COLUMNS[1:]].astype(float)
    assert feats.loc[k, "EXT_SOURCE_MEDIAN"] == pytest.approx(e.mean())
    assert feats.loc[k, "FLAG_DOCUMENT_SUM"] == app.loc[k, C.FLAG_DOCUMENT_COLUMNS].sum()


def test_csv_bundle_matches(spark, credit_pd, feats, tmp_path):
    d = tmp_path / "bundle"
    d.mkdir()
    for name, pdf in credit_pd.items():
        fname = "POS_CASH_balance.csv" if name == "pos_cash_balance" else f"{name}.csv"
        pdf.to_csv(d / fname, index=False)
    bundle = IO.load_bundle(spark, str(d))
    assert bundle["application_train"].schema["AMT_REQ_CREDIT_BUREAU_HOUR"].dataType.simpleString() == "string"
    f2 = CR.build_features(bundle, skew=False).toPandas().set_index("SK_ID_CURR")
    assert len(f2) == len(feats)
    pd.testing.assert_series_equal(f2["PREV_APP_COUNT"].sort_index(), feats["PREV_APP_COUNT"].sort_index(),
                                   check_dtype=False)


def test_missing_table_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        IO.load_bundle(spark, str(tmp_path))


def test_train_save_load_score(spark, credit, tmp_path):
    feats = CR.build_features(credit)
    model = ML.train_classifier(feats, gbt_iter=5, mlp_hidden=(4,))
    path = str(tmp_path / "model")
    IO.save_model(model, path)
    loaded = IO.load_model(path)
    scored = ML.score(loaded, feats).toPandas()
    assert set(scored["SK_ID_CURR"]) == set(r.SK_ID_CURR for r in feats.select("SK_ID_CURR").collect())
    assert set(scored["TARGET"]) <= {0, 1} and scored["probability"].between(0, 1).all()
    again = ML.score(model, feats).toPandas().set_index("SK_ID_CURR").sort_index()
    np.testing.assert_allclose(scored.set_index("SK_ID_CURR").sort_index()["probability"],
                               again["probability"], rtol=1e-9)
    out = str(tmp_path / "pred")
    IO.write_predictions(ML.score(loaded, feats).withColumnRenamed("TARGET", "prediction"), out)
    back = pd.concat(pd.read_csv(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".csv"))
    assert list(back.columns) == ["SK_ID_CURR", "TARGET"] and len(back) == len(scored)


def test_score_of_a_row_does_not_depend_on_its_batch(spark, credit, credit_pd, tmp_path):
    fitted = CR.train_bundle(credit, gbt_iter=3, ensemble=False)
    path = str(tmp_path / "fitted")
    fitted.save(spark, path)
    loaded = CR.CreditModel.load(spark, path)
    assert loaded.types == fitted.types and C.LABEL not in loaded.types.names
    whole = {r.SK_ID_CURR: r.probability for r in CR.score_tables(credit, loaded).collect()}
    keys = sorted(whole)[::17]
    for k in keys[:3]:
        one = dict(credit)
        one[CR.APPLICATION] = credit[CR.APPLICATION].filter(f"SK_ID_CURR = {k}")
        got = CR.score_tables(one, loaded).collect()
        assert len(got) == 1 and got[0].probability == pytest.approx(whole[k], abs=1e-12)


def test_score_bundle_of_unlabelled_applications(spark, credit, credit_pd, tmp_path):
    fitted = CR.train_bundle(credit, gbt_iter=3, ensemble=False)
    d = tmp_path / "bundle"
    d.mkdir()
    for name, pdf in credit_pd.items():
        pdf = pdf.drop(columns=["TARGET"]) if name == CR.APPLICATION else pdf
        pdf.to_csv(d / f"{name.replace('_train', '_test')}.csv", index=False)
    out = str(tmp_path / "out")
    scored = CR.score_bundle(spark, str(d), fitted, out, application="application_test")
    want = {r.SK_ID_CURR: r.probability for r in CR.score_tables(credit, fitted).collect()}
    got = {r.SK_ID_CURR: r.probability for r in scored.collect()}
    assert set(got) == set(want)
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(got)], rtol=1e-6)
    back = pd.concat(pd.read_csv(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".csv"))
    assert len(back) == len(want)


def test_held_out_auc(spark):
    from loanlens.operators import metrics as MT

    rng = np.random.default_rng(4)
    n = 1500
    x, s = rng.normal(size=(n, 2)), rng.choice(["a", "b", "c"], n)
    logit = 1.5 * x[:, 0] - x[:, 1] + np.where(s == "a", 1.0, -0.5)
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "x0": x[:, 0], "x1": x[:, 1], "s": s, "y": y}))
    fit, held = df.filter("k % 10 < 7"), df.filter("k % 10 >= 7")
    model = ML.train_classifier(fit, key="k", label="y", gbt_iter=10, mlp_hidden=(6,), threshold=0.4,
                                filter_column="s", filter_value="XNA")
    scored = ML.score(model, held, key="k", out_col="pred").join(held.select("k", "y"), "k")
    assert MT.roc_auc(scored, "probability", "y").first().auc > 0.8
    assert scored.filter("(probability >= 0.4) <> (pred = 1)").count() == 0


def test_a_column_of_ids_is_refused(spark):
    df = spark.range(200).selectExpr("id as k", "cast(id % 2 as int) as y", "concat('id', id) as s", "1.0 as x")
    with pytest.raises(ValueError, match="s \\(about"):
        ML.train_classifier(df, key="k", label="y", max_categories=50)
