"""Merged moments and sketches, isotonic calibration against full fits and brute force."""
import math
import random

import pandas as pd
import pytest

from loanlens.operators import calibrate as CB
from loanlens.operators import mergeable as MG
from loanlens.operators import ml as ML
from loanlens.operators import skew as SK

# ---- moments -------------------------------------------------------------------

NUMBERS = ["a", "b", "flat", "empty"]


def loans(spark, seed, n=400):
    r = random.Random(seed)
    rows = [(r.choice(["x", "y", None]), r.choice([None, math.nan, r.lognormvariate(3, 1.2)]) if r.random() < .3 else
             r.lognormvariate(3, 1.2), r.gauss(1e6, 3.0), 0.1, None, "text") for _ in range(n)]
    return spark.createDataFrame(rows, "part string, a double, b double, flat double, empty double, n_rows string")


def test_merged_moments_equal_the_moments_of_all_rows(spark):
    df = loans(spark, 1)
    whole = {r["column_name"]: r for r in MG.moment_report(MG.moment_states(df, NUMBERS)).collect()}
    merged = {r["column_name"]: r for r in MG.moment_report(MG.merge_moments(MG.moment_states(df, NUMBERS, ["part"]))).collect()}
    pdf = df.toPandas()
    assert set(whole) == set(merged) == set(NUMBERS)
    for c in NUMBERS:
        x = pdf[c].astype(float).dropna()
        for got in (whole[c], merged[c]):
            assert got["n"] == len(x)
            if c == "empty":
                assert all(got[k] is None for k in ("mean", "std_pop", "skewness", "kurtosis", "low", "high"))
                continue
            assert got["mean"] == pytest.approx(x.mean(), rel=1e-12)
            assert (got["low"], got["high"]) == (x.min(), x.max())
            if c == "flat":
                assert got["std_pop"] == 0.0 and got["skewness"] is None and got["kurtosis"] is None
                continue
            assert got["std_pop"] == pytest.approx(x.std(ddof=0), rel=1e-9)
            assert got["skewness"] == pytest.approx(x.skew(), rel=1e-9, abs=1e-9)
            m = x - x.mean()
            assert got["kurtosis"] == pytest.approx((m ** 4).mean() / (m ** 2).mean() ** 2 - 3, rel=1e-9, abs=1e-9)


def test_states_of_a_new_bundle_are_absorbed_and_merge_in_any_order(spark):
    old, new = loans(spark, 2), loans(spark, 3, 90)
    kept = MG.moment_states(old, NUMBERS, ["part"])
    first = MG.merge_moments(kept, ["part"]).unionByName(MG.moment_states(new, NUMBERS, ["part"]))
    once = {(r["part"], r["column_name"]): r for r in MG.merge_moments(first, ["part"]).collect()}
    full = {(r["part"], r["column_name"]): r for r in MG.moment_states(old.unionByName(new), NUMBERS, ["part"]).collect()}
    assert set(once) == set(full) and len(full) == 3 * len(NUMBERS)     # the null part is a part
    for k, r in full.items():
        std = math.sqrt((r["m2"] or 0.0) / max(r["n"], 1))
        for m in MG.MOMENTS:
            # sums of signed powers can cancel: measured on the scale of n * std^power
            scale = r["n"] * std ** int(m[1]) if m[0] == "m" and m[1:].isdigit() else 1.0
            assert once[k][m] == (r[m] if r[m] is None else pytest.approx(r[m], rel=1e-9, abs=1e-9 * scale))


def test_models_from_states_equal_the_fitted_ones(spark):
    # the estimators take NaN as a value, the states as missing: no NaN here
    old, new = (loans(spark, i, n).replace(math.nan, None, ["a"]) for i, n in ((4, 400), (5, 120)))
    both = old.unionByName(new).repartition(4)
    states = MG.merge_moments(MG.moment_states(old, NUMBERS).unionByName(MG.moment_states(new, NUMBERS)))
    a, b = MG.skew_model(states, NUMBERS), SK.SkewLogEstimator(inputCols=NUMBERS).fit(both)
    assert a.getOrDefault(a.selectedCols) == b.getOrDefault(b.selectedCols) == ["a"]
    assert a.getOrDefault(a.minima) == b.getOrDefault(b.minima)
    c, e = MG.scaler_model(states, NUMBERS), ML.PopulationStandardScaler(inputCols=NUMBERS).fit(both)
    assert c.getOrDefault(c.means) == pytest.approx(e.getOrDefault(e.means), rel=1e-12)
    scales = c.getOrDefault(c.scales)
    assert scales[:2] == pytest.approx(e.getOrDefault(e.scales)[:2], rel=1e-9) and scales[2:] == [1.0, 1.0]
    with pytest.raises(ValueError):
        MG.skew_model(MG.moment_states(both, NUMBERS, ["part"]), NUMBERS)


def test_moments_of_an_empty_table_and_clashing_names(spark):
    df = loans(spark, 6, 5)
    assert MG.moment_states(df.limit(0), NUMBERS, ["part"]).collect() == []
    assert MG.merge_moments(MG.moment_states(df.limit(0), NUMBERS)).collect() == []
    with pytest.raises(ValueError):
        MG.moment_states(df.withColumnRenamed("part", "n"), NUMBERS, ["n"])


# ---- sketches --------------------------------------------------------------------

SPEC = MG.Sketches(distinct=("user",), quantiles=("value",), log_k=9, kll_k=200)


def visits(spark, n=30_000):
    return spark.range(n).selectExpr("if(id % 11 = 0, null, if(id % 3 = 0, 'hot', concat('k', id % 4))) as kind",
                                     "cast(id % 17 as int) as day", "hash(id) % 9000 as user",
                                     "if(id % 13 = 0, double('NaN'), sqrt(id)) as value", "'z' as n_rows_x")


def test_merged_sketches_keep_their_bounds(spark):
    df = visits(spark)
    parts = MG.sketch_parts(df, ["day", "kind"], SPEC)
    # merged twice: days into weeks, weeks into all
    weeks = MG.merge_sketches(parts.selectExpr("*", "day div 7 as week"), ["week", "kind"], SPEC)
    est = MG.estimates(MG.merge_sketches(weeks, ["kind"], SPEC), ["kind"], SPEC, (0.1, 0.5, 0.99))
    got = MG.audit(df, est, ["kind"], SPEC, (0.1, 0.5, 0.99)).toPandas()
    exact = df.groupBy("kind").agg({"*": "count"}).count()
    assert len(got) == exact and got["kind"].isna().sum() == 1
    assert got["user_ok"].all() and got[[f"value_q{i}_ok" for i in range(3)]].all().all()
    assert (got["user_exact"] > 2 ** SPEC.log_k).all()               # beyond the exact range of the sketch
    assert est.agg({"n_rows": "sum"}).first()[0] == df.count()


def test_audit_sees_a_wrong_estimate(spark):
    df = visits(spark, 9_000)
    est = MG.estimates(MG.sketch_parts(df, ["kind"], SPEC), ["kind"], SPEC, (0.5,))
    off = est.selectExpr("kind", "n_rows", "cast(user_count * 1.4 as bigint) as user_count", "value_q0 * 1.3 as value_q0")
    got = MG.audit(df, off, ["kind"], SPEC, (0.5,)).toPandas()
    assert not got["user_ok"].any() and not got["value_q0_ok"].any()


def test_sketches_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, math.nan), ("b", 1, 2.0)], "kind string, user int, value double")
    parts = MG.sketch_parts(df, ["kind"], SPEC)
    got = {r["kind"]: r for r in MG.estimates(MG.merge_sketches(parts, ["kind"], SPEC), ["kind"], SPEC).collect()}
    assert (got["a"]["user_count"], got["a"]["value_q0"], got["a"]["n_rows"]) == (0, None, 2)
    assert (got["b"]["user_count"], got["b"]["value_q0"], got["b"]["value_q1"]) == (1, 2.0, 2.0)
    assert MG.merge_sketches(MG.sketch_parts(df.limit(0), ["kind"], SPEC), ["kind"], SPEC).collect() == []
    ok = {r["kind"]: r for r in MG.audit(df, MG.estimates(parts, ["kind"], SPEC), ["kind"], SPEC).collect()}
    assert ok["a"]["value_q0_ok"] is None and ok["a"]["user_ok"] and ok["b"]["value_q1_ok"]


# ---- calibration -----------------------------------------------------------------

def brute_isotonic(points):
    """score -> value by the max-min formula over {score: (pos, n)}."""
    s = sorted(points)
    out = {}
    for i in range(len(s)):
        best = -1.0
        for a in range(i + 1):
            least = 2.0
            p = sum(points[s[k]][0] for k in range(a, i))
            n = sum(points[s[k]][1] for k in range(a, i))
            for b in range(i, len(s)):
                p, n = p + points[s[b]][0], n + points[s[b]][1]
                least = min(least, p / n)
            best = max(best, least)
        out[s[i]] = best
    return out


@pytest.mark.parametrize("seed, rows_per_bucket, fan_in", [(1, 10**6, 16), (2, 9, 2), (3, 5, 3), (4, 2, 16)])
def test_isotonic_fit_equals_brute_force(spark, seed, rows_per_bucket, fan_in):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        s = r.choice([0.5, round(r.random(), 2), round(r.random(), 2)])      # a third of the rows share a score
        rows.append((s, int(r.random() < (s if seed != 3 else 1 - s)), "x"))
    rows += [(None, 1, "x"), (math.nan, 0, "x"), (0.3, None, "x"), (-0.0, 0, "x"), (0.0, 1, "x")]
    df = spark.createDataFrame(rows, "score double, y int, low string")
    blocks = CB.fit_isotonic(df, "score", "y", rows_per_bucket, fan_in)
    points = {}
    for s, y, _ in rows:
        if s is not None and s == s and y is not None:
            p, n = points.get(s, (0, 0))
            points[s] = (p + y, n + 1)
    want = brute_isotonic(points)
    got = CB.calibrate(df, "score", blocks, rows_per_group=40)
    assert got.columns == ["score", "y", "low", "calibrated"] and got.count() == len(rows)
    for row in got.collect():
        if row["score"] is None or row["score"] != row["score"]:
            assert row["calibrated"] is None
        else:
            assert row["calibrated"] == pytest.approx(want[row["score"]], abs=1e-12)
    b = sorted(blocks.collect(), key=lambda x: x["low"])
    assert sum(x["n"] for x in b) == sum(n for _, n in points.values())
    assert all(x["value"] < y["value"] and x["high"] < y["low"] for x, y in zip(b, b[1:]))


def test_calibration_of_new_scores_and_empty_fits(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.6, 0), (0.8, 1)], "score double, y int")
    blocks = CB.fit_isotonic(df, "score", "y")
    assert [(r["low"], r["high"], r["value"]) for r in blocks.orderBy("low").collect()] == [
        (0.2, 0.2, 0.0), (0.4, 0.6, 0.5), (0.8, 0.8, 1.0)]
    new = spark.createDataFrame([(0.1,), (0.3,), (0.45,), (0.45,), (0.7,), (9.0,), (None,)], "score double")
    got = sorted(((r["score"] is None, r["score"], r["calibrated"]) for r in CB.calibrate(new, "score", blocks).collect()),
                 key=str)
    assert [g[2] for g in got] == [0.0, 0.0, 0.5, 0.5, 0.5, 1.0, None]
    none = CB.fit_isotonic(df.limit(0), "score", "y")
    assert none.count() == 0 and {r["calibrated"] for r in CB.calibrate(new, "score", none).collect()} == {None}
    with pytest.raises(ValueError):
        CB.calibrate(new.selectExpr("score", "1 as calibrated"), "score", blocks)


def test_pooling_keeps_counts_whole():
    big = 2 ** 60                                             # products beyond 64 bits
    assert CB.pool([big, big - 1], [2 * big, 2 * big]) == [(0, 1, 2 * big - 1, 4 * big)]
    assert CB.pool([], []) == []
    assert pd.Series(CB.pool([0, 1, 1], [1, 2, 1])).tolist() == [(0, 0, 0, 1), (1, 1, 1, 2), (2, 2, 1, 1)]
