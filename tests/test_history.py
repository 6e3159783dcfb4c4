"""As-of join, overlap pairs, runs, AUC comparison and stream roll-ups against brute force."""
import datetime as dt
import math
import random

import numpy as np
import pytest

from loanlens.operators import compare as CM
from loanlens.operators import temporal as TP
from loanlens.streaming import rollups as SR


def key(x):
    return tuple((v is None, str(v)) for v in x)


# ---- as-of join -------------------------------------------------------------------

def brute_asof(left, right, inclusive, tolerance):
    out = []
    for row in left:
        k, t = row[0], row[1]
        able = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None
                and (r[1] <= t if inclusive else r[1] < t)]
        best = max(able, key=lambda r: (r[1], r[2])) if able else None
        if best is not None and tolerance is not None and t - best[1] > tolerance:
            best = None
        out.append((*row, *((best[1], best[2], best[3]) if best else (None, None, None))))
    return sorted(out, key=key)


def times(r, n, hot):
    """Half of the rows under one key; ties; nulls."""
    return [(r.choice([1, 1, 1, 2, 3, None] if hot else [1, 2, 3, 4, 5]), r.choice([None, *range(60)]), i) for i in range(n)]


@pytest.mark.parametrize("inclusive, tolerance, rows_per_group, hot",
                         [(True, None, 10**6, False), (True, None, 7, True), (False, None, 7, True),
                          (True, 4, 13, True), (False, 0, 5, True)])
def test_asof_join_equals_brute_force(spark, inclusive, tolerance, rows_per_group, hot):
    r = random.Random(rows_per_group)
    left = times(r, 150, hot) + [(1, 5, 900), (1, 5, 900), (77, 3, 901)]
    right = [(k, t, i, f"x{i % 3}" if i % 4 else None) for k, t, i in times(r, 120, hot)] + [(99, 1, 5, "y")]
    lf = spark.createDataFrame(left, "k int, t int, v1 int")        # v1 clashes with the operator's own names
    rf = spark.createDataFrame(right, "k int, rt int, a int, b string")
    got = TP.asof_join(lf, rf, ["k"], "t", "rt", ["a", "b"], inclusive, tolerance, rows_per_group)
    assert got.columns == ["k", "t", "v1", "asof_rt", "a", "b"]
    assert sorted(map(tuple, got.collect()), key=key) == brute_asof(left, right, inclusive, tolerance)


def test_asof_join_of_timestamps_dates_and_empty_sides(spark):
    day = dt.datetime(2024, 3, 1)
    left = spark.createDataFrame([("a", day, 1)], "k string, t timestamp, n int")
    right = spark.createDataFrame([("a", day - dt.timedelta(seconds=90), 5)], "k string, rt timestamp, x int")
    assert TP.asof_join(left, right, ["k"], "t", "rt", ["x"], tolerance=90).first()["x"] == 5
    assert TP.asof_join(left, right, ["k"], "t", "rt", ["x"], tolerance=89).first()["x"] is None
    assert TP.asof_join(left, right.limit(0), ["k"], "t", "rt", ["x"]).first()["x"] is None
    assert TP.asof_join(left.limit(0), right, ["k"], "t", "rt", ["x"]).collect() == []
    with pytest.raises(ValueError):
        TP.asof_join(left, right.withColumnRenamed("x", "n"), ["k"], "t", "rt", ["n"])


def test_cut_keys_make_bounded_groups(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, id, 1) as k", "id * 7 % 1000 as t")
    cut, any_cut = TP.with_ranges(rows, ["k"], rows["t"].cast("double"), 300)
    groups = {(r["k"], r["__range"]): r["count"] for r in cut.groupBy("k", "__range").count().collect()}
    assert any_cut and max(groups.values()) <= 450 and sum(groups.values()) == 4000
    assert all(g == 0 for k, g in groups if k != 1)


# ---- overlaps -----------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_overlap_pairs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(250):
        s = r.choice([None, *range(-300, 700)])
        size = r.choice([-3, 0, 0, 1, 2, 7, 8, 31, 400, None])
        rows.append((r.choice([1, 1, 1, 2, 3, None]), i, s, None if None in (s, size) else s + size))
    frame = spark.createDataFrame(rows, "c int, id int, opened int, closed int").withColumn("level", TP.F.lit(0))
    got = TP.overlap_pairs(frame, "c", "id", "opened", "closed").collect()
    ok = [x for x in rows if None not in x and x[3] >= x[2]]
    want = [(a[0], a[1], b[1], b[2], min(a[3], b[3])) for a in ok for b in ok
            if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and b[2] <= a[3]]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_overlap_pairs_of_nothing_and_of_repeated_rows(spark):
    frame = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 0, 5), (2, 1, 0, 5)], "c int, id int, s int, e int")
    assert [tuple(x) for x in TP.overlap_pairs(frame, "c", "id", "s", "e").collect()] == [(1, 1, 1, 0, 5)]
    assert TP.overlap_pairs(frame.limit(0), "c", "id", "s", "e").collect() == []


# ---- runs ----------------------------------------------------------------------------

@pytest.mark.parametrize("rows_per_group", [10**6, 40, 3, 1])
def test_runs_equal_brute_force(spark, rows_per_group):
    r = random.Random(rows_per_group)
    rows = [(1 if i % 3 else r.randrange(2, 9), i, r.choice([True, True, False, None])) for i in range(240)]
    rows += [(None, 1, True), (20, 1, True), (21, 1, False), (22, None, True)] + [(30, i, True) for i in range(50)]
    frame = spark.createDataFrame(rows, "k int, t int, late boolean").repartition(3)
    got = {x["k"]: tuple(x)[1:] for x in TP.runs(frame, "k", "t", TP.F.col("late"), rows_per_group).collect()}
    want = {}
    for k in {x[0] for x in rows if x[0] is not None and x[1] is not None}:
        flags = "".join("x" if f else " " for _, _, f in sorted(x for x in rows if x[0] == k and x[1] is not None))
        stretches = [len(s) for s in flags.split()]
        want[k] = (len(flags), flags.count("x"), len(stretches), max(stretches, default=0))
    assert got == want


# ---- AUC comparison --------------------------------------------------------------------

def brute_delong(rows, a, b):
    ok = [x for x in rows if all(v is not None and v == v for v in x)]
    pos, neg = [x for x in ok if x[-1] == 1], [x for x in ok if x[-1] != 1]

    def psi(p, n):
        return 1.0 if p > n else 0.5 if p == n else 0.0
    v1 = np.array([[np.mean([psi(p[m], n[m]) for n in neg]) for p in pos] for m in (a, b)])
    v0 = np.array([[np.mean([psi(p[m], n[m]) for p in pos]) for n in neg] for m in (a, b)])
    cov = np.cov(v1) / len(pos) + np.cov(v0) / len(neg)
    var = cov[0, 0] + cov[1, 1] - 2 * cov[0, 1]
    d = v1[0].mean() - v1[1].mean()
    return (len(pos), len(neg), v1[0].mean(), v1[1].mean(), cov[0, 0], cov[1, 1], cov[0, 1], d, var, d / math.sqrt(var),
            d - CM.Z95 * math.sqrt(var), d + CM.Z95 * math.sqrt(var))


@pytest.mark.parametrize("rows_per_bucket", [10**6, 5])
def test_auc_compare_equals_brute_force(spark, rows_per_bucket):
    r = random.Random(4)
    rows = []
    for _ in range(150):
        y = r.choice([0, 0, 1])
        hot = r.random() < 0.3                                  # a third of the rows share a score
        rows.append((0.5 if hot else round(r.gauss(y, 1), 1), r.gauss(0.5 * y, 1), float(r.randrange(3)), y))
    rows += [(None, 1.0, 1.0, 1), (1.0, float("nan"), 1.0, 0), (1.0, 1.0, 1.0, None), (-0.0, 0.0, 1.0, 1), (0.0, -0.0, 1.0, 0)]
    frame = spark.createDataFrame(rows, "m0 double, m1 double, m2 double, y int").repartition(4)
    got = {(x["model_a"], x["model_b"]): tuple(x)[2:] for x in
           CM.auc_compare(frame, ["m0", "m1", "m2"], "y", rows_per_bucket).collect()}
    assert set(got) == {("m0", "m1"), ("m0", "m2"), ("m1", "m2")}
    for (a, b), line in got.items():
        np.testing.assert_allclose(line, brute_delong(rows, int(a[1]), int(b[1])), rtol=1e-9, atol=1e-12)


def test_auc_compare_without_enough_rows(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 1), (0.5, 3.0, 0)], "a double, b double, y int")
    x = CM.auc_compare(frame, ["a", "b"], "y").first()
    assert (x["auc_a"], x["auc_b"], x["var_a"], x["var_difference"], x["z"]) == (1.0, 0.0, None, None, None)
    x = CM.auc_compare(frame.limit(0), ["a", "b"], "y").first()
    assert x["auc_a"] is None and x["z"] is None
    same = spark.createDataFrame([(float(i % 5), float(i % 5), int(i % 3 == 0)) for i in range(30)], "a double, b double, y int")
    x = CM.auc_compare(same, ["a", "b"], "y").first()
    assert x["difference"] == 0.0 and x["z"] is None and x["var_a"] > 0


# ---- stateful roll-ups -------------------------------------------------------------------

SPEC = SR.StreamRollup("user", "ts", "id", means=("paid",), distinct=("loan",), modes=("status",), salts=3)
SCHEMA = "id long, user long, ts timestamp, paid double, loan long, status string"
T0 = dt.datetime(2024, 1, 1)


def balance_rows(r, n, days):
    return [(i, r.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(hours=r.randrange(24 * days)), r.choice([None, 1.5, 2.0, 7.25]),
             r.choice([None, 10, 11, 12]), r.choice([None, "a", "b", "b", "c"])) for i in range(n)]


def batch_rollup(rows):
    out = {}
    for u in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == u]
        paid = [x[3] for x in own if x[3] is not None]
        labels = [x[5] for x in own if x[5] is not None]
        out[str(u)] = (len(own), sum(paid) / len(paid) if paid else None, len({x[4] for x in own if x[4] is not None}),
                       min(set(labels), key=lambda v: (-labels.count(v), v)) if labels else None)
    return out


def run_stream(spark, src, out, mark, delay, per_trigger=1):
    q = SR.start(SR.parts(SR.read_files(spark, src, spark.createDataFrame([], SCHEMA).schema, per_trigger), SPEC, delay), out, mark)
    q.awaitTermination(300)
    assert q.exception() is None
    rows = SR.current(spark.read.parquet(out), SPEC).collect()
    return {x["key"]: (x["n_rows"], x["paid_mean"], x["loan_count"], x["status_mode"]) for x in rows}, \
        sum(x["n_late"] for x in rows)


def test_stream_equals_batch_in_shuffled_files_and_after_a_restart(spark, tmp_path):
    r = random.Random(9)
    rows = balance_rows(r, 300, 20)
    r.shuffle(rows)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))

    def arrive(n, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{src}/part={n}")

    for n in range(3):
        arrive(n, rows[n * 60:n * 60 + 60])
    src_files = src + "/*"
    got, late = run_stream(spark, src_files, out, mark, "30 days")
    assert got == batch_rollup(rows[:180])
    arrive(3, rows[180:] + [(900, None, T0, 1.0, 1, "a"), (901, 1, None, 1.0, 1, "a")])     # no key, no time: left out
    got, late = run_stream(spark, src_files, out, mark, "30 days")       # same checkpoint folder
    assert got == batch_rollup(rows) and late == 0


def test_one_state_holds_many_applicants(spark, tmp_path):
    r = random.Random(11)
    rows = [(i, r.randrange(400), T0 + dt.timedelta(hours=r.randrange(200)), r.choice([None, 1.5, 2.0, 7.25]),
             r.choice([None, 10, 11, 12]), r.choice([None, "a", "b", "b", "c"])) for i in range(1500)]
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for n in range(3):
        spark.createDataFrame(rows[n::3], SCHEMA).coalesce(1).write.parquet(f"{src}/part={n}")
    got, late = run_stream(spark, src + "/*", out, mark, "30 days")
    assert got == batch_rollup(rows) and late == 0
    written = spark.read.parquet(out)
    assert written.groupBy("key", "salt", "version").count().filter("count > 1").isEmpty()
    # calls of Python: one per bucket and micro-batch, not one per applicant and salt
    states = spark.read.format("statestore").load(mark)
    assert written.select("key", "salt").distinct().count() > 800 and states.count() <= SPEC.buckets
    assert [SR.buckets_for(n, 8) for n in (0, 1000, 10 ** 6)] == [32, 32, 977]


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    r = random.Random(10)
    rows = sorted(balance_rows(r, 120, 30), key=lambda x: x[2])
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    old = [(1000 + i, 1, T0 + dt.timedelta(hours=i), 100.0, 99, "z") for i in range(7)]
    for n, part in enumerate([rows[:60], rows[60:], old]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{src}/part={n}")
        got, late = run_stream(spark, src + "/*", out, mark, "2 days")
    assert late == 7 and got == batch_rollup(rows)
