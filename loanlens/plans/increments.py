"""Queries on states that are merged instead of recomputed, calibration, snapshots
and multi-level reports on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import calibrate as CB
from ..operators import leafwise as LW
from ..operators import mergeable as MG
from ..operators import metrics as MT
from ..operators import snapshots as SN
from ..operators import stacking as ST
from ..session import materialize
from .catalog import SQL_SHIFT, doc_features, rnd, rnd_doubles, tbl

# -- G1/G2 from states ---------------------------------------------------------------

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def q_moments_merge(spark, d):
    """Statistics of the skew and scaler steps from one state per shipping month."""
    rows = tbl(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    monthly = materialize(MG.moment_states(rows, LINE_NUMBERS, ["month"]))
    out = MG.moment_report(MG.merge_moments(monthly))
    picked = (F.abs("skewness") > F.lit(float(C.SKEW_THRESHOLD))).alias("selected")
    return rnd_doubles(out.select("*", picked))


SQL_MOMENTS = f"""
WITH x AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber
                    FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE v)
SELECT column_name, count(v) AS n, round({SQL_SHIFT}avg(v), 6) AS mean, round({SQL_SHIFT}stddev_pop(v), 6) AS std_pop,
  round({SQL_SHIFT}skewness(v), 6) AS skewness, round({SQL_SHIFT}kurtosis_pop(v), 6) AS kurtosis,
  round({SQL_SHIFT}min(v), 6) AS low, round({SQL_SHIFT}max(v), 6) AS high,
  abs(skewness(v)) > {float(C.SKEW_THRESHOLD)} AS selected
FROM x GROUP BY column_name"""


# -- sketches per day --------------------------------------------------------------------

EVENT_SKETCHES = MG.Sketches(distinct=("user_id", "event_id"), quantiles=("value",))
PROBS = (0.25, 0.5, 0.9, 0.99)


def q_sketch_merge(spark, d):
    """Sketches stored per day and event type, merged over all days, and held
    against the rows: exact counts, and whether each estimate keeps its bound."""
    events = tbl(spark, d, "events")
    daily = materialize(MG.sketch_parts(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], EVENT_SKETCHES))
    merged = MG.merge_sketches(daily, ["event_type"], EVENT_SKETCHES)
    est = materialize(MG.estimates(merged, ["event_type"], EVENT_SKETCHES, PROBS))
    return MG.audit(events, est, ["event_type"], EVENT_SKETCHES, PROBS)


SQL_SKETCH = """
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS user_id_exact, TRUE AS user_id_ok,
  count(DISTINCT event_id) AS event_id_exact, TRUE AS event_id_ok,
  """ + ", ".join(f"CASE WHEN count(value) > 0 THEN TRUE END AS value_q{i}_ok" for i in range(len(PROBS))) + """
FROM events GROUP BY event_type"""


# -- G6 calibration --------------------------------------------------------------------------

def labelled_scores(spark, d) -> DataFrame:
    """The labelled documents with a score from their length."""
    j = tbl(spark, d, "labels").join(tbl(spark, d, "documents"), "doc_id")
    return j.select("doc_id", "quality", (-F.col("n_chars")).cast("double").alias("score"))


def q_calibrated_score(spark, d):
    rows = labelled_scores(spark, d)
    blocks = CB.fit_isotonic(rows, "score", "quality")
    return rnd(CB.calibrate(rows, "score", blocks), ["calibrated"])


# the isotonic fit at i: the largest over a <= i of the smallest over b >= i of the mean of a..b
SQL_CALIBRATED = f"""
WITH r AS (SELECT doc_id, quality, -CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
c AS (SELECT score, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS p
      FROM r WHERE score IS NOT NULL AND quality IS NOT NULL GROUP BY score),
s AS (SELECT score, row_number() OVER (ORDER BY score) AS i, sum(n) OVER (ORDER BY score) AS cn, sum(p) OVER (ORDER BY score) AS cp,
        n, p FROM c),
m AS (SELECT a.i AS a, b.i AS i, CAST(b.cp - a.cp + a.p AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean
      FROM s a JOIN s b ON a.i <= b.i),
l AS (SELECT a, i, min(mean) OVER (PARTITION BY a ORDER BY i DESC) AS least FROM m),
f AS (SELECT i, max(least) AS value FROM l GROUP BY i)
SELECT r.doc_id, r.quality, r.score, round({SQL_SHIFT}f.value, 6) AS calibrated
FROM r LEFT JOIN s ON s.score = r.score LEFT JOIN f ON f.i = s.i"""


# -- snapshots -------------------------------------------------------------------------------

def open_lines(spark, d, day: str) -> DataFrame:
    """What is still to be shipped on ``day`` of the orders made until then, per order."""
    o = tbl(spark, d, "orders").filter(F.col("o_orderdate") <= F.lit(day).cast("timestamp"))
    x = tbl(spark, d, "lineitem").filter(F.col("l_shipdate") > F.lit(day).cast("timestamp"))
    return (x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "o_orderkey")
            .agg(F.count(F.lit(1)).alias("open_lines"), F.min("l_shipdate").alias("next_day"),
                 F.max("l_returnflag").alias("worst")))


DAYS = ("1996-06-30", "1996-08-15")


def q_snapshot_diff(spark, d):
    return SN.snapshot_diff(open_lines(spark, d, DAYS[0]), open_lines(spark, d, DAYS[1]), ["o_custkey"])


def _sql_open(day: str) -> str:
    return f"""SELECT o_custkey, o_orderkey, count(*) AS open_lines, min(l_shipdate) AS next_day, max(l_returnflag) AS worst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate <= TIMESTAMP '{day}' AND l_shipdate > TIMESTAMP '{day}' GROUP BY o_custkey, o_orderkey"""


_DIFFERING = ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END"
                       for c in ("next_day", "o_orderkey", "open_lines", "worst"))
SQL_SNAPSHOT = f"""
WITH a AS ({_sql_open(DAYS[0])}), b AS ({_sql_open(DAYS[1])}),
o AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), n AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a),
c AS (SELECT o_custkey, CAST(sum(i) AS BIGINT) AS n_old, CAST(sum(j) AS BIGINT) AS n_new
      FROM (SELECT o_custkey, 1 AS i, 0 AS j FROM o UNION ALL SELECT o_custkey, 0, 1 FROM n) GROUP BY o_custkey),
w AS (SELECT o.o_custkey, concat_ws(',', {_DIFFERING}) AS names
      FROM o JOIN n ON o.o_custkey = n.o_custkey JOIN c ON c.o_custkey = o.o_custkey WHERE n_old = 1 AND n_new = 1)
SELECT c.o_custkey, CASE WHEN n_old = 0 THEN 'added' WHEN n_new = 0 THEN 'removed' ELSE 'changed' END AS change,
  n_old, n_new, w.names AS changed_columns
FROM c LEFT JOIN w ON w.o_custkey = c.o_custkey"""


# -- levels of a report ------------------------------------------------------------------------

def q_default_cube(spark, d):
    """Share of returned lines by market segment, region and order year, on every level
    with at least 20 lines."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    c = tbl(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    n = (tbl(spark, d, "nation").join(tbl(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
         .select(F.col("n_nationkey").alias("c_nationkey"), "r_name"))
    x = tbl(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    rows = x.join(o, "o_orderkey").join(c, "o_custkey", "left").join(n, "c_nationkey", "left")
    out = SN.cube_report(rows, ["c_mktsegment", "r_name", "order_year"], F.col("l_returnflag") == "R",
                         F.col("l_quantity"), min_rows=20)
    return rnd(out, ["rate", "amount"])


SQL_CUBE = f"""
SELECT c_mktsegment, r_name, CAST(year(o_orderdate) AS INTEGER) AS order_year,
  CAST(grouping(c_mktsegment, r_name, year(o_orderdate)) AS INTEGER) AS level,
  count(*) AS n_rows, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS n_flagged,
  round({SQL_SHIFT}CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / nullif(count(l_returnflag), 0), 6) AS rate,
  round({SQL_SHIFT}sum(l_quantity), 6) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
GROUP BY CUBE (c_mktsegment, r_name, year(o_orderdate)) HAVING count(*) >= 20"""


# -- G7 leaf by leaf, G8 stacked ------------------------------------------------------------------

DOC_NUMBERS = ["n_chars", "n_words", "n_lines"]
FLOOR = 0.6


def leafwise_scores(spark, d) -> DataFrame:
    """doc_id, quality, held_out, score, prediction of all labelled documents; the trees
    are fitted without the fifth that is held out by key."""
    rows = materialize(doc_features(spark, d).withColumn("held_out", ST.fold_of("doc_id", 5, 42) == 0))
    model = LW.fit_leafwise(rows.filter(~F.col("held_out")), DOC_NUMBERS, "quality", trees=6, leaves=8, rate=0.3)
    return model.transform(rows).select("doc_id", "quality", "held_out", "score", "prediction")


def q_leafwise_floor(spark, d):
    """The trees as one row that SQL can state: labelled rows, positives, scores inside
    0..1, and whether the held-out AUC reaches ``FLOOR``."""
    scored = materialize(leafwise_scores(spark, d))
    auc = MT.roc_auc(scored.filter("held_out"), "score", "quality").select((F.col("auc") >= FLOOR).alias("auc_ok"))
    out = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("quality") == 1).alias("n_pos"),
                     F.count_if(F.col("score").between(0.0, 1.0)).alias("n_scores"))
    return out.withColumn("auc_ok", auc.scalar())


SQL_FLOOR = """SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) AS n_scores, TRUE AS auc_ok
FROM labels JOIN documents USING (doc_id)"""


def q_stacked_score(spark, d):
    """Out-of-fold scores of the members and of their learned combination."""
    _, scores = ST.train_stacked(doc_features(spark, d), key="doc_id", label="quality", folds=3, numeric=DOC_NUMBERS,
                                 categorical=["lang", "source"], gbt_iter=10, filter_column="source", filter_value="XNA")
    return scores


QUERIES = {
    "moments_merge": q_moments_merge,
    "sketch_merge": q_sketch_merge,
    "calibrated_score": q_calibrated_score,
    "snapshot_diff": q_snapshot_diff,
    "default_cube": q_default_cube,
    "leafwise_floor": q_leafwise_floor,
    "stacked_score": q_stacked_score,
}
ORACLE_SQL = {
    "moments_merge": SQL_MOMENTS,
    "sketch_merge": SQL_SKETCH,
    "calibrated_score": SQL_CALIBRATED,
    "snapshot_diff": SQL_SNAPSHOT,
    "default_cube": SQL_CUBE,
    "leafwise_floor": SQL_FLOOR,
}
