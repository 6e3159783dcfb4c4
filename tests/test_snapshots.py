"""Snapshot differences and multi-level reports against brute force."""
import itertools
import os
import random
import re
from collections import Counter

import pytest

import __spark_entry__ as E
from loanlens.operators import snapshots as SN
from pyspark.sql import functions as F
from tests.conftest import SF0001

SCHEMA = "k int, a string, b double"


def brute_diff(old, new):
    gone, come = Counter(old) - Counter(new), Counter(new) - Counter(old)
    out = {}
    for k in {r[0] for r in gone} | {r[0] for r in come}:
        o, n = [r for r in gone.elements() if r[0] == k], [r for r in come.elements() if r[0] == k]
        change = "changed" if o and n else "added" if n else "removed"
        names = None
        if len(o) == len(n) == 1:
            names = ",".join(c for c, x, y in zip("ab", o[0][1:], n[0][1:]) if x != y)
        out[k] = (change, len(o), len(n), names)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_diff_equals_brute_force(spark, seed):
    r = random.Random(seed)
    row = lambda: (r.choice([None, 1, 1, 1, *range(2, 40)]), r.choice([None, "x", "y", ""]), r.choice([None, 0.5, 2.0]))
    old = [row() for _ in range(120)]                          # key 1 holds many rows, rows repeat
    new = [x for x in old if r.random() < .8] + [row() for _ in range(40)]
    got = SN.snapshot_diff(spark.createDataFrame(old, SCHEMA),
                           spark.createDataFrame(new, SCHEMA).select("b", "k", "a"), ["k"])     # columns go by name
    assert got.columns == ["k", "change", "n_old", "n_new", "changed_columns"]
    rows = [tuple(x) for x in got.collect()]
    assert len({x[0] for x in rows}) == len(rows)
    assert {x[0]: x[1:] for x in rows} == brute_diff(old, new)


def test_equal_empty_and_key_only_snapshots(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (None, None, None)], SCHEMA)
    assert SN.snapshot_diff(df, df, ["k"]).collect() == []
    assert SN.snapshot_diff(df.limit(0), df.limit(0), ["k"]).collect() == []
    got = {tuple(r) for r in SN.snapshot_diff(df.limit(0), df, ["k"]).collect()}
    assert got == {(1, "added", 0, 2, None), (None, "added", 0, 1, None)}
    # one repeat less is a difference
    assert [tuple(r) for r in SN.snapshot_diff(df, df.distinct(), ["k"]).collect()] == [(1, "removed", 1, 0, None)]
    keys = df.select("k")
    assert [tuple(r) for r in SN.snapshot_diff(keys, keys.distinct(), ["k"]).collect()] == [(1, "removed", 1, 0, None)]
    for bad in (lambda: SN.snapshot_diff(df, df.drop("b"), ["k"]), lambda: SN.snapshot_diff(df, df, ["z"]),
                lambda: SN.snapshot_diff(df, df, []),
                lambda: SN.snapshot_diff(df.withColumnRenamed("k", "change"), df.withColumnRenamed("k", "change"), ["change"])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("min_rows", [0, 6])
def test_cube_equals_brute_force(spark, min_rows):
    r = random.Random(min_rows)
    rows = [(r.choice(["p", "p", "p", "q", None]), r.choice([1, 2, None]), r.choice([True, False, None]), float(r.randint(0, 9)))
            for _ in range(60)]
    df = spark.createDataFrame(rows, "d string, e int, bad boolean, x double")
    got = {(a["d"], a["e"], a["level"]): a for a in SN.cube_report(df, ["d", "e"], F.col("bad"), F.col("x"), min_rows).collect()}
    want = {}
    for up in itertools.product([0, 1], repeat=2):
        for row in rows:
            k = (None if up[0] else row[0], None if up[1] else row[1], up[0] * 2 + up[1])
            want.setdefault(k, []).append(row)
    want = {k: v for k, v in want.items() if len(v) >= min_rows}
    assert set(got) == set(want)
    for k, v in want.items():
        known = [x[2] for x in v if x[2] is not None]
        assert (got[k]["n_rows"], got[k]["n_flagged"]) == (len(v), sum(known))
        assert got[k]["rate"] == (sum(known) / len(known) if known else None)
        assert got[k]["amount"] == sum(x[3] for x in v)


def test_cube_of_nothing_and_clashing_names(spark):
    df = spark.createDataFrame([(1, True)], "d int, bad boolean")
    assert SN.cube_report(df.limit(0), ["d"], F.col("bad")).collect() == []
    assert SN.cube_report(df, ["d"], F.col("bad")).columns == ["d", "level", "n_rows", "n_flagged", "rate"]
    with pytest.raises(ValueError):
        SN.cube_report(df.withColumnRenamed("d", "rate"), ["rate"], F.col("bad"))
    with pytest.raises(ValueError):
        SN.cube_report(df, [], F.col("bad"))


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="driver tables not present")
def test_cube_expands_groups_not_rows(spark):
    plan = E.queries()["default_cube"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("Expand"):].splitlines()
    assert plan.count("Expand") == 1 and plan.count("lineitem.parquet") == 1
    assert re.search(r"HashAggregate", lines[1])              # the finest groups feed it


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="driver tables not present")
def test_snapshots_are_compared_without_a_join_of_both(spark):
    plan = E.queries()["snapshot_diff"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    head = plan[:plan.index("Union")]
    assert "Join" not in head and "Window" not in head
