"""Best-first boosted trees against a brute-force tree and Spark's own boosted trees."""
import json
import math
import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlens.operators import leafwise as LW
from loanlens.operators import metrics as MT

U = LW.UNIT


def brute_tree(rows, n_features, leaves, reg, min_rows, rate):
    """rows: (g, h, bins). One leaf at a time, every cut tried."""
    def term(g, h):
        return (g / U) * (g / U) / (h / U + reg)

    def best(rs):
        top = None
        tg, th = sum(r[0] for r in rs), sum(r[1] for r in rs)
        for f in range(n_features):
            for b in sorted({r[2][f] for r in rs}):
                ls = [r for r in rs if r[2][f] <= b]
                if len(ls) < min_rows or len(rs) - len(ls) < min_rows:
                    continue
                lg, lh = sum(r[0] for r in ls), sum(r[1] for r in ls)
                gain = term(lg, lh) + term(tg - lg, th - lh) - term(tg, th)
                if top is None or gain > top[0]:
                    top = (gain, f, b)
        return top

    held, out = {0: rows}, {}
    cuts = {0: best(rows)}
    while len(held) < leaves:
        able = [i for i in held if cuts[i] and cuts[i][0] > 0]
        if not able:
            break
        i = max(able, key=lambda j: (cuts[j][0], -j))
        _, f, b = cuts[i]
        rs = held.pop(i)
        out[i] = {"f": f, "b": b}
        for c, part in ((2 * i + 1, [r for r in rs if r[2][f] <= b]), (2 * i + 2, [r for r in rs if r[2][f] > b])):
            held[c], cuts[c] = part, best(part)
    for i, rs in held.items():
        out[i] = {"value": -rate * (sum(r[0] for r in rs) / U) / (sum(r[1] for r in rs) / U + reg)}
    return out


@pytest.mark.parametrize("seed, leaves, min_rows", [(1, 7, 1), (2, 12, 5), (3, 40, 12)])
def test_tree_equals_brute_force(spark, seed, leaves, min_rows):
    r = random.Random(seed)
    rows = []
    for _ in range(220):
        b = (r.choice([0, 1, 2, 3, 3, 3]), r.randint(0, 9), 1)            # the third feature never splits; many ties
        y = int(r.random() < 1 / (1 + math.exp(-(b[0] - 2) * (b[1] - 4) / 2)))
        rows.append((round((0.4 - y) * U), round(0.24 * U), b))
    df = spark.createDataFrame([(g, h, *b) for g, h, b in rows], "g long, h long, b0 int, b1 int, b2 int")
    got = LW.grow_tree(df.repartition(5), ["b0", "b1", "b2"], leaves, 1.0, min_rows, 0.1)
    want = brute_tree(rows, 3, leaves, 1.0, min_rows, 0.1)
    assert got == want and sum("value" in n for n in got.values()) <= leaves


def people(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        z = 2 * a * b + (0.8 if abs(a) > 1 else -0.4)
        rows.append((a, b if r.random() > .1 else r.choice([None, math.nan]), 7.0, None, int(r.random() < 1 / (1 + math.exp(-2 * z)))))
    return spark.createDataFrame(rows, "a double, b double, flat double, empty double, y int")


FEATURES = ["a", "b", "flat", "empty"]


def test_held_out_auc_is_not_below_level_wise_trees(spark, tmp_path):
    train, new = people(spark, 1500, 1), people(spark, 1500, 2)
    model = LW.fit_leafwise(train, FEATURES, "y", trees=8, leaves=8, rate=0.3)
    model.write().overwrite().save(str(tmp_path / "m"))
    ours = MT.roc_auc(LW.LeafwiseModel.load(str(tmp_path / "m")).transform(new), "score", "y").first()["auc"]
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="v")
    flat = lambda d: vec.transform(d.select("y", *[F.coalesce(F.nanvl("a", F.lit(-9.0)), F.lit(-9.0)).alias("a"),
                                                   F.coalesce(F.nanvl("b", F.lit(-9.0)), F.lit(-9.0)).alias("b")]))
    gbt = GBTClassifier(featuresCol="v", labelCol="y", maxIter=8, maxDepth=3, stepSize=0.3, seed=1).fit(flat(train))
    theirs = MT.roc_auc(gbt.transform(flat(new)).select("y", vector_to_array("probability")[1].alias("s")), "s", "y").first()["auc"]
    assert ours >= theirs - 0.005 and ours > 0.75
    assert all(sum("value" in n for n in t.values()) <= 8 for t in model.trees())


def test_fit_does_not_depend_on_partitioning(spark):
    df = people(spark, 400, 3)
    cut = {"a": [-1.0, 0.0, 1.0], "b": [0.0]}
    rows = LW.binned(df, cut, ["b0", "b1"]).withColumn("g", F.round((F.lit(0.37) - F.col("y")) * U).cast("long")).withColumn(
        "h", F.lit(round(0.2331 * U)))
    trees = [LW.grow_tree(rows.repartition(n), ["b0", "b1"], 6, 1.0, 5, 0.1) for n in (1, 7)]
    assert trees[0] == trees[1]


def test_bins_of_missing_and_border_values(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (-5.0,), (1.0,), (1.5,), (2.0,), (math.inf,)], "x double")
    got = [r["b"] for r in LW.binned(df, {"x": [1.0, 2.0]}, ["b"]).collect()]
    assert got == [0, 0, 1, 2, 2, 3, 3]


def test_one_class_empty_tables_and_clashing_columns(spark):
    df = people(spark, 40, 4).withColumn("node", F.lit("text")).withColumn("g", F.lit("x"))
    one = LW.fit_leafwise(df.withColumn("y", F.lit(1)), FEATURES, "y")
    assert one.trees() == [] and one.transform(df).select("score").distinct().count() == 1
    none = LW.fit_leafwise(df.limit(0), FEATURES, "y")
    assert none.trees() == [] and none.transform(df).first()["score"] == 0.5
    kept = LW.fit_leafwise(df.withColumn("y", F.when(F.col("a") > -1, F.col("y"))), FEATURES, "y", trees=2, min_rows=3)
    out = kept.transform(df)
    assert out.columns == [*df.columns, "score", "prediction"] and out.count() == 40
    assert "empty" not in json.loads(kept.getOrDefault(kept.model))["cuts"]
    with pytest.raises(ValueError):
        LW.fit_leafwise(df, FEATURES, "y", leaves=1)
