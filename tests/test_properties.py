"""Property tests: random inputs against straightforward Python re-derivations."""
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loanlens import config as C
from loanlens.functions import expr as X
from loanlens.functions.aggs import Agg
from loanlens.operators import marts as M

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, width=64)
opt = st.one_of(st.none(), finite)


@SETTINGS
@given(st.lists(st.tuples(opt, opt, opt), min_size=1, max_size=30))
def test_row_stats(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select(X.row_mean(["a", "b", "c"]).alias("m"), X.row_median(["a", "b", "c"]).alias("md"),
                    X.row_sum(["a", "b", "c"]).alias("s")).collect()
    for r, g in zip(rows, got):
        v = [x for x in r if x is not None]
        total = ((r[0] or 0.0) + (r[1] or 0.0)) + (r[2] or 0.0)
        assert g.s == total
        assert g.m == (total / len(v) if v else None)
        s = sorted(v)
        med = None if not s else (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        assert g.md == med


edge_days = st.sampled_from([-1500.0, -1000.0, -500.0, 0.0, 99999.0, float(C.DAYS_SENTINEL), -99999.0])


@SETTINGS
@given(st.lists(st.one_of(st.none(), edge_days, finite), min_size=1, max_size=40))
def test_bin_days(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r.b for r in df.select(X.bin_days("d").alias("b")).collect()]
    for v, g in zip(vals, got):
        if v is None:
            assert g is None
            continue
        x = -99999.0 if v == C.DAYS_SENTINEL else v
        edges = C.DAY_BIN_EDGES
        exp = None
        for i in range(len(edges) - 1):
            if edges[i] <= x < edges[i + 1]:
                exp = C.DAY_BIN_LABELS[i]
        assert g == exp


keys = st.one_of(st.none(), st.integers(0, 6))
labels = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))


@SETTINGS
@given(st.lists(st.tuples(keys, labels, st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=60))
def test_rollup_invariants(spark, rows):
    df = spark.createDataFrame(rows, "k long, s string, n long")
    out = M.rollup(df, "k", [Agg("cnt", "count", "n"), Agg("nd", "nunique", "n"),
                             Agg("ns", "nunique", "s"), Agg("mode", "mode", "s"),
                             Agg("sum0", "sum0", "n"), Agg("act", "count_eq", "s", "a")])
    got = {r.k: r for r in out.collect()}
    exp_keys = {k for k, _, _ in rows if k is not None}
    assert set(got) == exp_keys                           # one row per non-NULL key
    for k in exp_keys:
        grp = [(s, n) for kk, s, n in rows if kk == k]
        ss = [s for s, _ in grp if s is not None]
        ns = [n for _, n in grp if n is not None]
        g = got[k]
        assert g.cnt == len(ns) and g.nd == len(set(ns)) and g.ns == len(set(ss))
        assert g.sum0 == sum(ns) and g.act == ss.count("a")
        if ss:
            c = Counter(ss)
            top = max(c.values())
            assert g.mode == min(x for x in c if c[x] == top)
        else:
            assert g.mode is None


bins = st.one_of(st.none(), st.sampled_from(C.DAY_BIN_LABELS + ["unknown"]))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), bins), min_size=1, max_size=60))
def test_mode_ordinal_brute_force(spark, rows):
    """Counter-based ordinal mode = most rows, ties -> lowest bin position;
    unknown labels and NULL never count; none left -> NULL."""
    df = spark.createDataFrame(rows, "k long, b string")
    out = M.rollup(df, "k", [Agg("m", "mode_ordinal", "b", tuple(C.DAY_BIN_LABELS))])
    got = {r.k: r.m for r in out.collect()}
    for k in {k for k, _ in rows}:
        c = Counter(b for kk, b in rows if kk == k and b in C.DAY_BIN_LABELS)
        if not c:
            assert got[k] is None
        else:
            top = max(c.values())
            assert got[k] == min((x for x in c if c[x] == top), key=C.DAY_BIN_LABELS.index)
