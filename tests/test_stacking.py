"""Out-of-fold stacking: no row sees its own label; the combination is no worse than a member."""
import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from loanlens.operators import metrics as MT
from loanlens.operators import ml as ML
from loanlens.operators import stacking as ST

FIT = dict(numeric=["a", "b"], categorical=["c"], gbt_iter=3, mlp_hidden=(4,), filter_column="c", filter_value="XNA")


def people(spark, n=500, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.gauss(0, 1), r.gauss(0, 1), r.choice("xy")
        z = a + (1.5 if c == "x" else -0.5) * b
        rows.append((i, a if r.random() > .05 else None, b, c, int(r.random() < 1 / (1 + math.exp(-2 * z)))))
    rows += [(n, 0.0, 0.0, "x", None)]                         # no label: not scored, not fitted
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y int").coalesce(1)


@pytest.fixture(scope="module")
def stacked(spark):
    return ST.train_stacked(people(spark), key="id", label="y", folds=2, **FIT)


def test_every_labelled_row_has_one_out_of_fold_score(spark, stacked):
    rows = stacked[1].collect()
    assert sorted(r["id"] for r in rows) == list(range(500)) and {r["fold"] for r in rows} == {0, 1}
    want = {r["id"]: r["f"] for r in people(spark).select("id", ST.fold_of("id", 2, 42).alias("f")).collect()}
    assert all(r["fold"] == want[r["id"]] and 0 <= r["stacked"] <= 1 for r in rows)


def test_a_rows_score_does_not_depend_on_its_own_label(spark, stacked):
    before = {r["id"]: (r["gbt"], r["mlp"]) for r in stacked[1].filter("fold = 0").collect()}
    flipped = people(spark).withColumn("y", F.when(ST.fold_of("id", 2, 42) == 0, 1 - F.col("y")).otherwise(F.col("y")))
    got = ST.out_of_fold(flipped, key="id", label="y", folds=2, **FIT).filter("fold = 0").collect()
    assert {r["id"]: (r["gbt"], r["mlp"]) for r in got} == before


def test_held_out_auc_is_not_below_either_member(spark, stacked, tmp_path):
    stacked[0].write().overwrite().save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    new = people(spark, 600, seed=2).filter("y is not null")
    scored = model.transform(new)
    p = {m: ML.vector_to_array(F.col(c)).getItem(1) for m, c in ST.MEMBERS.items()}
    scored = scored.select("y", "score", *[v.alias(m) for m, v in p.items()])
    auc = {m: MT.roc_auc(scored, m, "y").first()["auc"] for m in ("score", *ST.MEMBERS)}
    assert auc["score"] >= max(auc["gbt"], auc["mlp"]) - 0.01 and auc["score"] > 0.8
    assert set(ML.score(model, new, key="id", out_col="y").columns) == {"id", "y", "probability"}


def test_weights_recover_the_better_member(spark):
    r = random.Random(5)
    rows = [(int(r.random() < p), p, r.random()) for p in (r.random() for _ in range(4000))]
    weights, intercept = ST.fit_weights(spark.createDataFrame(rows, "y int, gbt double, mlp double"), "y")
    assert weights[0] == pytest.approx(1.0, abs=0.15) and abs(weights[1]) < 0.1 and abs(intercept) < 0.15


def test_folds_and_extreme_probabilities(spark):
    with pytest.raises(ValueError):
        ST.out_of_fold(people(spark, 5), key="id", label="y", folds=1)
    row = spark.range(1).select(ST.log_odds(F.lit(0.0)).alias("a"), ST.log_odds(F.lit(1.0)).alias("b")).first()
    assert row["a"] == pytest.approx(math.log(1e-6 / (1 - 1e-6))) and row["b"] == pytest.approx(-row["a"])
