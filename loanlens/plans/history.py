"""Queries over time, comparisons and streams on the driver's tables, with
their DuckDB SQL.

orders play credits (from the order to the last shipment of its lines),
lineitem monthly statuses, events the balance rows that arrive as files.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as CM
from ..operators import temporal as TP
from ..session import scratch_path
from ..streaming import rollups as SR
from .catalog import SQL_SHIFT, rnd, tbl


# -- G9 variance ----------------------------------------------------------------

def scored_documents(spark, d) -> DataFrame:
    """Two scores of the labelled documents: length, and share of blanks."""
    j = tbl(spark, d, "labels").join(tbl(spark, d, "documents"), "doc_id")
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return j.select("quality", (-F.col("n_chars")).cast("double").alias("by_length"),
                    F.round(blanks.cast("double") / F.greatest(F.length("text"), F.lit(1)).cast("double"), 2)
                    .alias("by_blanks"), F.lit(1.0).alias("constant"))


def q_auc_compare(spark, d):
    out = CM.auc_compare(scored_documents(spark, d), ["by_length", "by_blanks", "constant"], "quality")
    return rnd(out, [c for c, t in out.dtypes if t == "double"])


_AUC_PAIRS = "(VALUES ('by_length', 'by_blanks'), ('by_length', 'constant'), ('by_blanks', 'constant')) AS p(model_a, model_b)"
SQL_AUC_COMPARE = f"""
WITH r AS (SELECT row_number() OVER () AS id, quality, -CAST(n_chars AS DOUBLE) AS by_length,
  round(CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / CAST(greatest(length(text), 1) AS DOUBLE), 2) AS by_blanks,
  CAST(1 AS DOUBLE) AS constant FROM labels JOIN documents USING (doc_id)),
l AS (SELECT id, quality, model, s FROM r UNPIVOT (s FOR model IN (by_length, by_blanks, constant))),
v1 AS (SELECT p.id, p.model, avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) AS v
       FROM l p JOIN l n ON p.model = n.model WHERE p.quality = 1 AND n.quality <> 1 GROUP BY p.id, p.model),
v0 AS (SELECT n.id, n.model, avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) AS v
       FROM l p JOIN l n ON p.model = n.model WHERE p.quality = 1 AND n.quality <> 1 GROUP BY n.id, n.model),
c1 AS (SELECT a.model AS ma, b.model AS mb, covar_samp(a.v, b.v) AS c, count(*) AS n, avg(a.v) AS auc
       FROM v1 a JOIN v1 b ON a.id = b.id GROUP BY ALL),
c0 AS (SELECT a.model AS ma, b.model AS mb, covar_samp(a.v, b.v) AS c, count(*) AS n
       FROM v0 a JOIN v0 b ON a.id = b.id GROUP BY ALL),
cov AS (SELECT ma, mb, c1.c / c1.n + c0.c / c0.n AS cov, c1.n AS n_pos, c0.n AS n_neg, auc
        FROM c1 JOIN c0 USING (ma, mb)),
o AS (SELECT p.model_a, p.model_b, ab.n_pos, ab.n_neg, aa.auc AS auc_a, bb.auc AS auc_b, aa.cov AS var_a, bb.cov AS var_b,
        ab.cov AS cov_ab, aa.auc - bb.auc AS difference, greatest(0, aa.cov + bb.cov - 2 * ab.cov) AS var_difference
      FROM {_AUC_PAIRS} JOIN cov aa ON aa.ma = model_a AND aa.mb = model_a
      JOIN cov bb ON bb.ma = model_b AND bb.mb = model_b JOIN cov ab ON ab.ma = model_a AND ab.mb = model_b)
SELECT model_a, model_b, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
""" + ", ".join(f"round({SQL_SHIFT}{e}, 6) AS {n}" for n, e in [
    ("auc_a", "auc_a"), ("auc_b", "auc_b"), ("var_a", "var_a"), ("var_b", "var_b"), ("cov_ab", "cov_ab"),
    ("difference", "difference"), ("var_difference", "var_difference"),
    ("z", "difference / CASE WHEN var_difference > 1e-30 THEN sqrt(var_difference) END"),
    ("low", f"difference - {CM.Z95} * sqrt(var_difference)"),
    ("high", f"difference + {CM.Z95} * sqrt(var_difference)")]) + " FROM o"


# -- as-of join --------------------------------------------------------------------

def monthly_status(spark, d) -> DataFrame:
    """Per customer and shipping day: the worst line status and the quantity."""
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("s_custkey"))
    return (tbl(spark, d, "lineitem").join(o, "l_orderkey").groupBy("s_custkey", F.col("l_shipdate").alias("status_day"))
            .agg(F.max("l_returnflag").alias("status"), F.sum("l_quantity").alias("quantity")))


def q_asof_status(spark, d):
    apps = tbl(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("s_custkey"), "o_orderdate")
    return TP.asof_join(apps, monthly_status(spark, d), ["s_custkey"], "o_orderdate", "status_day",
                        ["status", "quantity"], time_name="status_day")


SQL_ASOF = """
WITH s AS (SELECT o_custkey AS s_custkey, l_shipdate AS status_day, max(l_returnflag) AS status, sum(l_quantity) AS quantity
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
a AS (SELECT o_orderkey, o_custkey AS s_custkey, o_orderdate FROM orders)
SELECT a.o_orderkey, a.s_custkey, a.o_orderdate, s.status_day, s.status, s.quantity
FROM a ASOF LEFT JOIN s ON a.s_custkey = s.s_custkey AND a.o_orderdate >= s.status_day"""


# -- overlapping credits --------------------------------------------------------------

def credits(spark, d) -> DataFrame:
    last = (tbl(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.max("l_shipdate").alias("closed")))
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.join(last, "o_orderkey", "left").select(
        "o_custkey", "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("opened"),
        F.unix_date(F.to_date("closed")).alias("closed"))


def q_overlap_credits(spark, d):
    return TP.overlap_pairs(credits(spark, d), "o_custkey", "o_orderkey", "opened", "closed")


_SQL_CREDITS = """WITH c AS (SELECT o_custkey, o_orderkey,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s,
    CAST(date_diff('day', DATE '1970-01-01', CAST(max(l_shipdate) AS DATE)) AS BIGINT) AS e
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate) """
SQL_OVERLAP = _SQL_CREDITS + """
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, b.s AS start, least(a.e, b.e) AS "end"
FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND (a.s, a.o_orderkey) < (b.s, b.o_orderkey) AND b.s <= a.e
WHERE a.e >= a.s AND b.e >= b.s"""


# -- arrears runs ------------------------------------------------------------------------

def q_arrears_runs(spark, d):
    """Stretches of returned lines in the order of a customer's shipments."""
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = tbl(spark, d, "lineitem").join(o, "l_orderkey").select("o_custkey", "l_returnflag", day.alias("day"))
    # the shipping day's rows as one state: in arrears if any line of the day was returned
    days = rows.groupBy("o_custkey", "day").agg(F.max(F.col("l_returnflag") == "R").alias("arrears"))
    return TP.runs(days, "o_custkey", "day", F.col("arrears"))


SQL_RUNS = """
WITH x AS (SELECT o_custkey, CAST(l_shipdate AS DATE) AS day, bool_or(l_returnflag = 'R') AS arrears
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT o_custkey, arrears, row_number() OVER (PARTITION BY o_custkey ORDER BY day)
        - row_number() OVER (PARTITION BY o_custkey, arrears ORDER BY day) AS island FROM x),
r AS (SELECT o_custkey, arrears, island, count(*) AS len FROM g GROUP BY ALL)
SELECT o_custkey, CAST(sum(len) AS BIGINT) AS n_rows, CAST(coalesce(sum(len) FILTER (WHERE arrears), 0) AS BIGINT) AS n_active,
  CAST(count(*) FILTER (WHERE arrears) AS BIGINT) AS n_runs,
  CAST(coalesce(max(len) FILTER (WHERE arrears), 0) AS BIGINT) AS longest_run
FROM r GROUP BY o_custkey"""


# -- stateful stream -----------------------------------------------------------------------

EVENT_ROLLUP = SR.StreamRollup(key="user_id", time="ts", row_id="event_id", means=("value",),
                               distinct=("event_type",), modes=("event_type",))


def q_stream_rollup(spark, d):
    """events arriving as files in no order, rolled up by a stateful stream."""
    events = tbl(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    src, out, mark = (scratch_path(spark, n) for n in ("arriving", "parts", "progress"))
    # dealt by a hash, so every file holds rows of the whole period
    events.repartition(6, F.xxhash64("event_id")).write.parquet(src)
    stream = SR.read_files(spark, src, events.schema, max_files_per_trigger=2)
    users = events.agg(F.approx_count_distinct("user_id")).first()[0]
    spec = replace(EVENT_ROLLUP, buckets=SR.buckets_for(users, EVENT_ROLLUP.salts))
    q = SR.start(SR.parts(stream, spec, "60 days"), out, mark)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    rows = SR.current(spark.read.parquet(out), spec)
    return rnd(rows.withColumn("key", F.col("key").cast("long")).withColumnRenamed("key", "user_id"), ["value_mean"])


SQL_STREAM = f"""
WITH m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
           FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type)
SELECT e.user_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_late,
  round({SQL_SHIFT}avg(value), 6) AS value_mean, CAST(count(DISTINCT e.event_type) AS BIGINT) AS event_type_count,
  any_value(m.event_type) AS event_type_mode
FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.r = 1 WHERE e.user_id IS NOT NULL GROUP BY e.user_id"""


QUERIES = {
    "auc_compare": q_auc_compare,
    "asof_status": q_asof_status,
    "overlap_credits": q_overlap_credits,
    "arrears_runs": q_arrears_runs,
    "stream_rollup": q_stream_rollup,
}
ORACLE_SQL = {
    "auc_compare": SQL_AUC_COMPARE,
    "asof_status": SQL_ASOF,
    "overlap_credits": SQL_OVERLAP,
    "arrears_runs": SQL_RUNS,
    "stream_rollup": SQL_STREAM,
}
