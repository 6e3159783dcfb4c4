"""Exact AUC and F1 threshold search against brute force."""
import itertools

import numpy as np
import pandas as pd
import pytest

from loanlens.operators import metrics as MT


def brute_auc(scores, labels):
    pos = [s for s, l in zip(scores, labels) if l == 1]
    neg = [s for s, l in zip(scores, labels) if l != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def brute_f1(scores, labels):
    best = None
    for t in sorted(set(scores)):
        tp = sum(1 for s, l in zip(scores, labels) if s >= t and l == 1)
        fp = sum(1 for s, l in zip(scores, labels) if s >= t and l != 1)
        fn = sum(1 for s, l in zip(scores, labels) if s < t and l == 1)
        f1 = 2 * tp / (2 * tp + fp + fn)
        if best is None or f1 > best[1]:
            best = (t, f1)
    return best


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    lab = rng.integers(0, 2, 300)
    sc = np.round(rng.random(300) * 0.6 + lab * 0.3, 2)     # many ties
    return spark.createDataFrame(pd.DataFrame({"s": sc, "y": lab})), sc.tolist(), lab.tolist()


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 7])
def test_auc_exact(scored, rows_per_bucket):
    df, sc, lab = scored
    r = MT.roc_auc(df, "s", "y", rows_per_bucket=rows_per_bucket).first()
    assert r.auc == pytest.approx(brute_auc(sc, lab), abs=1e-12)
    assert r.n_pos == sum(lab)


def test_auc_evaluator_agrees(scored):
    df, sc, lab = scored
    assert MT.auc_evaluator(df, "s", "y") == pytest.approx(brute_auc(sc, lab), abs=1e-9)


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 7])
def test_nan_scores_are_missing(spark, scored, rows_per_bucket):
    df, sc, lab = scored
    more = df.unionByName(spark.createDataFrame([(float("nan"), 1), (None, 0), (float("nan"), 0)], "s double, y long"))
    assert MT.roc_auc(more, "s", "y", rows_per_bucket).first().auc == pytest.approx(brute_auc(sc, lab), abs=1e-12)
    assert MT.best_f1_threshold(more, "s", "y", rows_per_bucket).first().f1 == pytest.approx(brute_f1(sc, lab)[1])
    assert MT.f1_on_grid(more, "s", "y", 20).collect() == MT.f1_on_grid(df, "s", "y", 20).collect()


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 5])
def test_best_f1(scored, rows_per_bucket):
    df, sc, lab = scored
    r = MT.best_f1_threshold(df, "s", "y", rows_per_bucket=rows_per_bucket).first()
    t, f1 = brute_f1(sc, lab)
    assert r.threshold == pytest.approx(t) and r.f1 == pytest.approx(f1)


def test_f1_grid(scored):
    df, sc, lab = scored
    got = {round(r.threshold, 6): r for r in MT.f1_on_grid(df, "s", "y", steps=20).collect()}
    assert len(got) == 21
    for i in range(21):
        t = i / 20
        tp = sum(1 for s, l in zip(sc, lab) if s >= t and l == 1)
        fp = sum(1 for s, l in zip(sc, lab) if s >= t and l != 1)
        fn = sum(1 for s, l in zip(sc, lab) if s < t and l == 1)
        r = got[round(t, 6)]
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn)
        assert r.f1 == (pytest.approx(2 * tp / (2 * tp + fp + fn)) if tp + fp + fn else None)
