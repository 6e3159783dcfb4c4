"""Queries on the driver's tables and their DuckDB oracles.

The credit tables are not available, so every operator runs on an analogue:
customer = applications, orders = previous applications / bureau credits,
lineitem = instalments / monthly balances, events = card / cash balances,
labels x documents = the labelled training set. Each query reads whole
tables; floating results that depend on summation order or on a library
log/pow are rounded to 6 decimals on both sides, plain row arithmetic is not.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import expr as X
from ..functions.aggs import Agg
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import marts as M
from ..operators import metrics as MT
from ..operators import ml as ML
from ..operators import skew as SK
from ..session import scratch_path
from ..sources import io as IO

DAY0 = "2000-01-01"
R = 6
# Comparison rounding: 6 decimals with the boundary moved off the exact
# binary-fraction ties (...5 in the 7th decimal) that means over 32, 64, 128
# rows produce; otherwise last-bit summation-order noise decides the digit.
TIE_SHIFT = 1.3e-9


def tbl(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Parquet table."""
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def day_rel(c, anchor: str = DAY0) -> "F.Column":
    """Days from ``anchor`` (default 2000-01-01) to the date of ``c`` (double)."""
    return F.datediff(F.to_date(X.col(c)), F.lit(anchor).cast("date")).cast("double")


def rnd(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(TIE_SHIFT), R) for c in cols})


def rnd_doubles(df: DataFrame) -> DataFrame:
    return rnd(df, [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)])


# ---------------------------------------------------------------------------
# Shared analogue frames (Spark) and SQL fragments (DuckDB).
# ---------------------------------------------------------------------------

SQL_SHIFT = "CAST(1.3e-9 AS DOUBLE) + "
SQL_DAY = "CAST(date_diff('day', DATE '2000-01-01', CAST({c} AS DATE)) AS DOUBLE)"
SQL_ORDER_DAYS = ("CASE WHEN o_orderstatus = 'P' THEN CAST(365243 AS DOUBLE) ELSE "
                  + SQL_DAY.format(c="o_orderdate") + " END")
SQL_ORDER_DAYS_BINNABLE = ("CASE WHEN o_orderstatus = 'P' THEN CAST(-99999 AS DOUBLE) ELSE "
                           + SQL_DAY.format(c="o_orderdate") + " END")
SQL_STATUS = ("CASE WHEN l_returnflag = 'R' THEN 'C' WHEN l_returnflag = 'A' THEN 'X' "
              "ELSE CAST(l_linenumber - 1 AS VARCHAR) END")
SQL_STATUS_ENC = ("CAST(CASE {s} WHEN 'C' THEN 0 WHEN '0' THEN 1 WHEN '1' THEN 2 WHEN '2' THEN 3 "
                  "WHEN '3' THEN 4 WHEN '4' THEN 5 WHEN '5' THEN 6 WHEN 'X' THEN 7 END AS BIGINT)")
SQL_PAYMENT = "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice * (1 - l_discount) END"


def sql_bin_idx(d: str) -> str:
    return (f"CASE WHEN {d} < -1500 THEN 0 WHEN {d} >= -1500 AND {d} < -1000 THEN 1 "
            f"WHEN {d} >= -1000 AND {d} < -500 THEN 2 WHEN {d} >= -500 AND {d} < 0 THEN 3 "
            f"WHEN {d} >= 0 AND {d} < 99999 THEN 4 END")


def sql_bin_label(d: str) -> str:
    return ("CASE " + sql_bin_idx(d).removeprefix("CASE ")
            .replace("THEN 0", "THEN 'Very Old'").replace("THEN 1", "THEN 'Old'")
            .replace("THEN 2", "THEN 'Recent'").replace("THEN 3", "THEN 'Very Recent'")
            .replace("THEN 4", "THEN 'Missing'"))


def sql_mode(table: str, key: str, value: str, order: str | None = None,
             out: str = "mode_value") -> str:
    """Mode per key: most rows, ties -> smallest ``order`` (default the value)."""
    order = order or value
    return (f"SELECT {key}, {value} AS {out} FROM (SELECT {key}, {value}, row_number() OVER "
            f"(PARTITION BY {key} ORDER BY n DESC, _o) AS rn FROM (SELECT {key}, {value}, "
            f"{order} AS _o, count(*) AS n FROM {table} WHERE {key} IS NOT NULL AND {value} "
            f"IS NOT NULL GROUP BY {key}, {value}, {order})) WHERE rn = 1")


def sql_skew_select(cols, src: str, keep, threshold=1.0, shift=1.0, digits: int | None = R) -> str:
    """Batch skew transform in SQL over ``src``: ``keep`` columns pass through."""
    stats = ", ".join(f"skewness(CAST({c} AS DOUBLE)) AS s{i}, min(CAST({c} AS DOUBLE)) AS m{i}"
                      for i, c in enumerate(cols))
    outs = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        lg = (f"CASE WHEN m{i} <= 0 THEN ln(1 + ({x} - m{i} + {shift})) ELSE ln(1 + {x}) END")
        v = f"CASE WHEN abs(s{i}) > {threshold} THEN coalesce({lg}, {x}) ELSE {x} END"
        outs.append(f"round({SQL_SHIFT}{v}, {digits}) AS {c}" if digits is not None else f"{v} AS {c}")
    sel = ", ".join(list(keep) + outs)
    return f"SELECT {sel} FROM {src}, (SELECT {stats} FROM {src}) AS st"


def orders_days(spark, d) -> DataFrame:
    o = tbl(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                    F.when(F.col("o_orderstatus") == "P", F.lit(float(C.DAYS_SENTINEL)))
                     .otherwise(day_rel("o_orderdate")).alias("days_rel"))


def lineitem_status(spark, d) -> DataFrame:
    li = tbl(spark, d, "lineitem")
    status = (F.when(F.col("l_returnflag") == "R", F.lit("C"))
               .when(F.col("l_returnflag") == "A", F.lit("X"))
               .otherwise((F.col("l_linenumber") - 1).cast("string")))
    return li.select("l_orderkey", "l_linenumber", status.alias("status"),
                     (-F.col("l_linenumber")).cast("double").alias("months"))


def instalments(spark, d) -> DataFrame:
    """lineitem x orders as instalment rows of a customer."""
    li = tbl(spark, d, "lineitem")
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    pay = F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double")) \
           .otherwise(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))
    return j.select("o_custkey", "l_orderkey", "l_linenumber",
                    day_rel("o_orderdate").alias("order_day"),
                    day_rel("l_shipdate").alias("ship_day"),
                    "l_extendedprice", pay.alias("AMT_PAYMENT"))


INST_ANALOG = [
    Agg("INST_COUNT", "nunique", "l_linenumber"),
    Agg("INST_DAYS_INSTALMENT_MEAN", "mean", "order_day"),
    Agg("INST_DAYS_ENTRY_PAYMENT_MEAN", "mean", "ship_day"),
    Agg("INST_AMT_INSTALMENT_MEAN", "mean", "l_extendedprice"),
    Agg("INST_AMT_PAYMENT_MEAN", "mean", "AMT_PAYMENT"),
]

BAL_ANALOG = [
    Agg("BUREAU_BAL_MONTHS_BALANCE_MEAN", "mean", "months"),
    Agg("BUREAU_BAL_STATUS_MEAN", "mean", "STATUS_ENCODED"),
    Agg("BUREAU_BAL_STATUS_MAX", "max", "STATUS_ENCODED"),
    Agg("BUREAU_BAL_STATUS_MIN", "min", "STATUS_ENCODED"),
]

BUREAU_ANALOG = [
    Agg("BUREAU_SK_ID_BUREAU", "nunique", "o_orderkey"),
    Agg("BUREAU_CREDIT_ACTIVE", "count_eq", "o_orderstatus", "F"),
    Agg("BUREAU_CREDIT_CURRENCY", "nunique", "o_orderstatus"),
    Agg("BUREAU_DAYS_CREDIT", "mean", "days_rel"),
    Agg("BUREAU_CNT_CREDIT_PROLONG", "sum0", "o_prio_txt"),
    Agg("BUREAU_AMT_CREDIT_SUM", "mean", "o_totalprice"),
    Agg("BUREAU_CREDIT_TYPE", "nunique", "o_orderpriority"),
    Agg("BUREAU_BUREAU_BAL_MONTHS_BALANCE_MEAN", "mean", "BUREAU_BAL_MONTHS_BALANCE_MEAN"),
    Agg("BUREAU_BUREAU_BAL_STATUS_MEAN", "mean", "BUREAU_BAL_STATUS_MEAN"),
    Agg("BUREAU_BUREAU_BAL_STATUS_MAX", "max", "BUREAU_BAL_STATUS_MAX"),
    Agg("BUREAU_BUREAU_BAL_STATUS_MIN", "min", "BUREAU_BAL_STATUS_MIN"),
]


def merged_bureau(spark, d) -> DataFrame:
    """F7 on orders (credits) and lineitem (monthly balances)."""
    o = tbl(spark, d, "orders")
    ob = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                  "o_orderdate", F.split("o_orderpriority", "-")[0].alias("o_prio_txt"),
                  day_rel("o_orderdate").alias("days_rel"))
    bal = lineitem_status(spark, d).withColumnRenamed("l_orderkey", "o_orderkey")
    return M.merge_bureau_and_balance(
        ob, bal, bureau_key="o_orderkey", keys=["o_orderkey", "o_custkey"], status_col="status",
        balance_spec=BAL_ANALOG,
        clean_kwargs=dict(drop=["o_orderdate", "o_comment"], coerce=["o_prio_txt"]))


SQL_BAL = (f"SELECT l_orderkey, avg(-CAST(l_linenumber AS DOUBLE)) AS BUREAU_BAL_MONTHS_BALANCE_MEAN, "
           f"avg(enc) AS BUREAU_BAL_STATUS_MEAN, max(enc) AS BUREAU_BAL_STATUS_MAX, "
           f"min(enc) AS BUREAU_BAL_STATUS_MIN FROM (SELECT l_orderkey, l_linenumber, "
           f"{SQL_STATUS_ENC.format(s=SQL_STATUS)} AS enc FROM lineitem) GROUP BY l_orderkey")

_B_COLS = ["o_totalprice", "o_prio_txt", "days_rel"]
SQL_MERGED_BUREAU = (
    "WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, "
    "TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS o_prio_txt, "
    + SQL_DAY.format(c="o_orderdate") + " AS days_rel FROM orders), "
    "bt AS (" + sql_skew_select(_B_COLS, "b", ["o_orderkey", "o_custkey", "o_orderstatus",
                                                "o_orderpriority"], digits=None)
    + "), bal AS (" + SQL_BAL + ") "
    "SELECT bt.*, bal.* EXCLUDE (l_orderkey) FROM bt LEFT JOIN bal ON bt.o_orderkey = bal.l_orderkey")

SQL_BUREAU_MART = (
    "SELECT o_custkey, count(DISTINCT o_orderkey) AS BUREAU_SK_ID_BUREAU, "
    "count(*) FILTER (WHERE o_orderstatus = 'F') AS BUREAU_CREDIT_ACTIVE, "
    "count(DISTINCT o_orderstatus) AS BUREAU_CREDIT_CURRENCY, avg(days_rel) AS BUREAU_DAYS_CREDIT, "
    "coalesce(sum(o_prio_txt), 0) AS BUREAU_CNT_CREDIT_PROLONG, "
    "avg(o_totalprice) AS BUREAU_AMT_CREDIT_SUM, count(DISTINCT o_orderpriority) AS BUREAU_CREDIT_TYPE, "
    "avg(BUREAU_BAL_MONTHS_BALANCE_MEAN) AS BUREAU_BUREAU_BAL_MONTHS_BALANCE_MEAN, "
    "avg(BUREAU_BAL_STATUS_MEAN) AS BUREAU_BUREAU_BAL_STATUS_MEAN, "
    "max(BUREAU_BAL_STATUS_MAX) AS BUREAU_BUREAU_BAL_STATUS_MAX, "
    "min(BUREAU_BAL_STATUS_MIN) AS BUREAU_BUREAU_BAL_STATUS_MIN "
    "FROM (" + SQL_MERGED_BUREAU + ") WHERE o_custkey IS NOT NULL GROUP BY o_custkey")

SQL_INST = (
    "SELECT o_custkey, count(DISTINCT l_linenumber) AS INST_COUNT, "
    "avg(order_day) AS INST_DAYS_INSTALMENT_MEAN, avg(ship_day) AS INST_DAYS_ENTRY_PAYMENT_MEAN, "
    "avg(l_extendedprice) AS INST_AMT_INSTALMENT_MEAN, avg(AMT_PAYMENT) AS INST_AMT_PAYMENT_MEAN "
    "FROM (SELECT o_custkey, l_linenumber, l_extendedprice, "
    + SQL_DAY.format(c="o_orderdate") + " AS order_day, " + SQL_DAY.format(c="l_shipdate")
    + " AS ship_day, " + SQL_PAYMENT + " AS AMT_PAYMENT FROM lineitem JOIN orders "
    "ON l_orderkey = o_orderkey) WHERE AMT_PAYMENT >= 0 AND o_custkey IS NOT NULL GROUP BY o_custkey")


# ---------------------------------------------------------------------------
# Queries.
# ---------------------------------------------------------------------------

def q_filter_ne_keep_null(spark, d):
    c = tbl(spark, d, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"))
    return CL.filter_ne_keep_null(c, "c_mktsegment", "AUTOMOBILE")


def q_filter_ge_drop_null(spark, d):
    li = tbl(spark, d, "lineitem")
    o = tbl(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", day_rel("l_shipdate").alias("ship_day"),
        day_rel("o_orderdate").alias("order_day"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))).alias("amt"))
    out = CL.clean_installments(j, entry_col="ship_day", due_col="order_day", amount_col="amt",
                                delay_col="delay_days")
    return out.select("l_orderkey", "l_linenumber", "delay_days", "amt")


def q_drop_then_filter(spark, d):
    c = tbl(spark, d, "customer").withColumn(
        "c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")))
    t = ML.DropFilterTransformer(columnsToDrop=["c_name", "c_phone"], filterColumn="c_mktsegment",
                                 filterValue="MACHINERY")
    return CL.drop_strict(t.transform(c), ["c_nationkey"])


def q_csv_roundtrip(spark, d):
    base = scratch_path(spark, "csv-roundtrip")
    IO.write_csv(tbl(spark, d, "customer"), base + "/customer")
    IO.write_csv(tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                               "o_totalprice", "o_orderpriority"), base + "/orders")
    cs = T.StructType([T.StructField("c_custkey", T.LongType())])
    os_ = T.StructType([T.StructField("o_orderkey", T.LongType()),
                        T.StructField("o_custkey", T.LongType()),
                        T.StructField("o_orderstatus", T.StringType())])
    c2 = IO.read_csv_typed(spark, base + "/customer", cs)
    o2 = IO.read_csv_typed(spark, base + "/orders", os_)
    agg = M.rollup(o2, "o_custkey", [Agg("n_orders", "count", "o_orderkey"),
                                     Agg("total_price", "sum0", "o_totalprice")])
    out = c2.join(agg.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    return rnd(out, ["total_price"])


def q_coerce_numeric(spark, d):
    p = tbl(spark, d, "part").select(
        "p_partkey", F.substring_index("p_brand", "#", -1).alias("brand_num"),
        F.col("p_brand").alias("brand_whole"), F.col("p_type").alias("type_num"),
        F.col("p_size").cast("string").alias("size_num"))
    return CL.coerce_columns(p, ["brand_num", "brand_whole", "type_num", "size_num"])


def q_sentinel_to_null(spark, d):
    o = orders_days(spark, d).select("o_orderkey", "o_custkey", "days_rel", "o_totalprice")
    return CL.sentinel_to_null_frame(o, keep=["o_orderkey", "o_custkey"])


def q_bin_days(spark, d):
    o = orders_days(spark, d)
    return o.select("o_orderkey", X.bin_days("days_rel").alias("days_binned"))


def q_map_status(spark, d):
    li = lineitem_status(spark, d)
    return CL.encode_status(li, status_col="status", out_col="status_encoded") \
             .select("l_orderkey", "l_linenumber", "status", "status_encoded")


def q_guarded_ratio(spark, d):
    li = tbl(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     X.guarded_ratio("l_extendedprice", "l_discount").alias("ratio"))


def q_plain_ratio(spark, d):
    li = tbl(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.plain_ratio("l_tax", "l_discount").alias("ratio"))


def q_days_to_years(spark, d):
    li = tbl(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     X.days_to_years(day_rel("l_shipdate")).alias("ship_years"))


def _row_inputs(spark, d):
    li = tbl(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_discount")).alias("x1"),
        F.when(F.col("l_linestatus") == "F", F.lit(None)).otherwise(F.col("l_tax")).alias("x2"),
        F.when(F.col("l_linenumber") > 4, F.lit(None))
         .otherwise(F.col("l_quantity") / F.lit(50.0)).alias("x3"))


def q_row_mean(spark, d):
    return _row_inputs(spark, d).select("l_orderkey", "l_linenumber",
                                        X.row_mean(["x1", "x2", "x3"]).alias("x_mean"))


def q_row_median(spark, d):
    return _row_inputs(spark, d).select("l_orderkey", "l_linenumber",
                                        X.row_median(["x1", "x2", "x3"]).alias("x_median"))


def q_row_sum(spark, d):
    return _row_inputs(spark, d).select("l_orderkey", "l_linenumber",
                                        X.row_sum(["x1", "x2", "x3"]).alias("x_sum"))


def q_impute_constants(spark, d):
    c = tbl(spark, d, "customer").select("c_custkey")
    r = M.rollup(tbl(spark, d, "events"), "user_id", [
        Agg("ev_count", "nunique", "event_id"), Agg("ev_value_mean", "mean", "value"),
        Agg("ev_type_mode", "mode", "event_type")])
    j = c.join(r.withColumnRenamed("user_id", "c_custkey"), "c_custkey", "left")
    out = CL.fill_constants(j, numeric=["ev_count", "ev_value_mean"], text=["ev_type_mode"])
    return rnd(out, ["ev_value_mean"])


def q_rollup_balance(spark, d):
    li = CL.encode_status(lineitem_status(spark, d), status_col="status")
    return rnd(M.aggregate_balance(li, key="l_orderkey", spec=BAL_ANALOG),
               ["BUREAU_BAL_MONTHS_BALANCE_MEAN", "BUREAU_BAL_STATUS_MEAN"])


def q_join_balance(spark, d):
    return rnd_doubles(merged_bureau(spark, d))


def q_two_level_rollup(spark, d):
    return rnd_doubles(M.bureau_mart(merged_bureau(spark, d), key="o_custkey", spec=BUREAU_ANALOG))


def q_group_null_key(spark, d):
    o = tbl(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_custkey")).alias("k"),
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"))
    out = M.rollup(o, "k", [Agg("n_orders", "nunique", "o_orderkey"),
                            Agg("price_sum", "sum0", "price"),
                            Agg("n_open", "count_eq", "o_orderstatus", "O"),
                            Agg("n_status", "nunique", "o_orderstatus")])
    return rnd(out, ["price_sum"])


def q_mode_text(spark, d):
    return M.rollup(tbl(spark, d, "events"), "user_id", [
        Agg("n_events", "count", "event_id"), Agg("event_type_mode", "mode", "event_type")])


def q_mode_binned(spark, d):
    o = orders_days(spark, d).withColumn("days_binned", X.bin_days("days_rel"))
    return M.rollup(o, "o_custkey", [
        Agg("n_orders", "count", "o_orderkey"),
        Agg("days_binned_mode", "mode_ordinal", "days_binned", tuple(C.DAY_BIN_LABELS))])


def q_instalment_mart(spark, d):
    inst = CL.clean_installments(instalments(spark, d), entry_col="ship_day", due_col="order_day",
                                 amount_col="AMT_PAYMENT")
    return rnd_doubles(M.instalment_mart(inst, key="o_custkey", spec=INST_ANALOG))


def _skew_inputs(spark, d):
    return [("events", tbl(spark, d, "events"), ["event_id", "user_id"]),
            ("documents", tbl(spark, d, "documents"), ["doc_id"]),
            ("part", tbl(spark, d, "part"), ["p_partkey"])]


def q_skew_report(spark, d):
    parts = [SK.skew_report(df, exclude=keys, table_name=name)
             for name, df, keys in _skew_inputs(spark, d)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rnd(out, ["skewness"]).orderBy(F.desc_nulls_last("skewness"))


def q_skew_log_positive(spark, d):
    ev = tbl(spark, d, "events").select("event_id", "user_id", "value")
    return rnd(SK.log_transform_skewed(ev, exclude=["event_id", "user_id"]), ["value"])


def q_skew_log_shifted(spark, d):
    ev = tbl(spark, d, "events").select(
        "event_id", (F.col("value") - F.lit(100.0)).alias("value_shifted"),
        F.hour("ts").cast("double").alias("ctrl"))
    return rnd(SK.log_transform_skewed(ev, exclude=["event_id"]), ["value_shifted", "ctrl"])


# -- the wide mart (F13 + F14 + G1 = F15 on the analogue tables) -------------

WIDE_EXCLUDE = ["c_custkey", "c_nationkey"]
WIDE_F14 = dict(
    keys=["c_custkey"],
    guarded=[("CREDIT_INCOME_RATIO", "PREV_O_TOTALPRICE_MEAN", "c_acctbal")],
    years=[("ORDER_YEARS", "INST_DAYS_INSTALMENT_MEAN")],
    plain=[("PAYMENT_PER_ORDER", "INST_AMT_PAYMENT_MEAN", "PREV_APP_COUNT")],
    mean_median=("EXT_MEAN", "EXT_MEDIAN", ["c_acctbal", "CREDIT_VALUE_MEAN", "POS_K_MEAN"]),
    sums=[("COUNT_SUM", ["PREV_APP_COUNT", "INST_COUNT", "CREDIT_PREV_LOANS_COUNT"])],
)


def wide_mart_unskewed(spark, d) -> DataFrame:
    app = tbl(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_nationkey").cast("double").alias("c_nationkey"),
        "c_acctbal")
    prev = CL.clean_previous_application(orders_days(spark, d), drop=["o_comment"],
                                         amount_col="o_totalprice", days=["days_rel"])
    prev_r = M.rollup(prev, "o_custkey", [
        Agg("PREV_APP_COUNT", "nunique", "o_orderkey"),
        Agg("PREV_O_TOTALPRICE_MEAN", "mean", "o_totalprice"),
        Agg("PREV_DAYS_REL_BINNED_MODE", "mode_ordinal", "days_rel_BINNED", tuple(C.DAY_BIN_LABELS))])
    inst = CL.clean_installments(instalments(spark, d), entry_col="ship_day", due_col="order_day",
                                 amount_col="AMT_PAYMENT")
    inst_r = M.instalment_mart(inst, key="o_custkey", spec=INST_ANALOG)
    ev = tbl(spark, d, "events").select(
        "user_id", "event_type", "value", F.hour("ts").cast("double").alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))
    card_r = M.credit_card_mart(ev, key="user_id", spec=[
        Agg("CREDIT_PREV_LOANS_COUNT", "nunique", "event_type"),
        Agg("CREDIT_VALUE_MEAN", "mean", "value"),
        Agg("CREDIT_EVENT_TYPE_MODE", "mode", "event_type")])
    pos_r = M.pos_cash_mart(ev, key="user_id", spec=[
        Agg("POS_PREV_LOANS_COUNT", "nunique", "hour"),
        Agg("POS_K_MEAN", "mean", "k"), Agg("POS_HOUR_MEAN", "mean", "hour")])
    bur_r = M.bureau_mart(merged_bureau(spark, d), key="o_custkey", spec=BUREAU_ANALOG)
    rollups = [prev_r.withColumnRenamed("o_custkey", "c_custkey"),
               inst_r.withColumnRenamed("o_custkey", "c_custkey"),
               card_r.withColumnRenamed("user_id", "c_custkey"),
               pos_r.withColumnRenamed("user_id", "c_custkey"),
               bur_r.withColumnRenamed("o_custkey", "c_custkey")]
    merged = M.left_join_chain(app, "c_custkey", rollups)
    return FE.feature_engineering(merged, **WIDE_F14)


def q_wide_mart(spark, d):
    return rnd_doubles(SK.log_transform_skewed(wide_mart_unskewed(spark, d), exclude=WIDE_EXCLUDE,
                                               materialize=True))


def _sql_wide_mart(skew: bool = True) -> str:
    num_m = ["c_nationkey", "c_acctbal", "PREV_APP_COUNT", "PREV_O_TOTALPRICE_MEAN",
             "INST_COUNT", "INST_DAYS_INSTALMENT_MEAN", "INST_DAYS_ENTRY_PAYMENT_MEAN",
             "INST_AMT_INSTALMENT_MEAN", "INST_AMT_PAYMENT_MEAN", "CREDIT_PREV_LOANS_COUNT",
             "CREDIT_VALUE_MEAN", "POS_PREV_LOANS_COUNT", "POS_K_MEAN", "POS_HOUR_MEAN",
             "BUREAU_SK_ID_BUREAU", "BUREAU_CREDIT_ACTIVE", "BUREAU_CREDIT_CURRENCY",
             "BUREAU_DAYS_CREDIT", "BUREAU_CNT_CREDIT_PROLONG", "BUREAU_AMT_CREDIT_SUM",
             "BUREAU_CREDIT_TYPE", "BUREAU_BUREAU_BAL_MONTHS_BALANCE_MEAN",
             "BUREAU_BUREAU_BAL_STATUS_MEAN", "BUREAU_BUREAU_BAL_STATUS_MAX",
             "BUREAU_BUREAU_BAL_STATUS_MIN"]
    text_m = ["c_mktsegment", "PREV_DAYS_REL_BINNED_MODE", "CREDIT_EVENT_TYPE_MODE"]
    prev_days = SQL_ORDER_DAYS_BINNABLE
    m_sel = ", ".join(["c_custkey"] + text_m + [f"nullif({c}, 365243) AS {c}" for c in num_m])
    e = ["c_acctbal", "CREDIT_VALUE_MEAN", "POS_K_MEAN"]
    csum = " + ".join(f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE))" for c in e)
    ccnt = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in e)
    counts = ["PREV_APP_COUNT", "INST_COUNT", "CREDIT_PREV_LOANS_COUNT"]
    f14 = (
        "CAST(PREV_O_TOTALPRICE_MEAN AS DOUBLE) / (CAST(c_acctbal AS DOUBLE) + CAST(0.00001 AS DOUBLE)) "
        "AS CREDIT_INCOME_RATIO, "
        "CAST(INST_DAYS_INSTALMENT_MEAN AS DOUBLE) / CAST(-365.0 AS DOUBLE) AS ORDER_YEARS, "
        "CAST(INST_AMT_PAYMENT_MEAN AS DOUBLE) / nullif(CAST(PREV_APP_COUNT AS DOUBLE), 0) "
        "AS PAYMENT_PER_ORDER, "
        f"({csum}) / nullif(CAST({ccnt} AS DOUBLE), 0) AS EXT_MEAN, "
        f"list_sort(list_filter([{', '.join(f'CAST({c} AS DOUBLE)' for c in e)}], "
        "lambda v: v IS NOT NULL)) AS _l, "
        + " + ".join(f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE))" for c in counts)
        + " AS COUNT_SUM")
    median = ("CASE len(_l) WHEN 0 THEN NULL WHEN 1 THEN _l[1] WHEN 2 THEN (_l[1] + _l[2]) / 2.0 "
              "ELSE _l[2] END AS EXT_MEDIAN")
    cands = [c for c in num_m if c not in WIDE_EXCLUDE] + [
        "CREDIT_INCOME_RATIO", "ORDER_YEARS", "PAYMENT_PER_ORDER", "EXT_MEAN", "EXT_MEDIAN",
        "COUNT_SUM"]
    ctes = (
        "WITH app AS (SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS c_nationkey, "
        "c_acctbal FROM customer), "
        f"pv AS (SELECT o_custkey, o_orderkey, o_totalprice, {sql_bin_label(prev_days)} AS bl, "
        f"{sql_bin_idx(prev_days)} AS bi FROM orders WHERE o_totalprice >= 0), "
        "prev AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS PREV_APP_COUNT, "
        "avg(o_totalprice) AS PREV_O_TOTALPRICE_MEAN FROM pv WHERE o_custkey IS NOT NULL "
        "GROUP BY o_custkey), "
        f"prevm AS ({sql_mode('pv', 'o_custkey', 'bl', order='bi', out='PREV_DAYS_REL_BINNED_MODE')}), "
        f"inst AS ({SQL_INST}), "
        "ev AS (SELECT user_id, event_type, value, CAST(hour(ts) AS DOUBLE) AS hr, "
        "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), "
        "card AS (SELECT user_id, count(DISTINCT event_type) AS CREDIT_PREV_LOANS_COUNT, "
        "avg(value) AS CREDIT_VALUE_MEAN FROM ev WHERE user_id IS NOT NULL GROUP BY user_id), "
        f"cardm AS ({sql_mode('ev', 'user_id', 'event_type', out='CREDIT_EVENT_TYPE_MODE')}), "
        "pos AS (SELECT user_id, count(DISTINCT hr) AS POS_PREV_LOANS_COUNT, avg(k) AS POS_K_MEAN, "
        "avg(hr) AS POS_HOUR_MEAN FROM ev WHERE user_id IS NOT NULL GROUP BY user_id), "
        f"bur AS ({SQL_BUREAU_MART}), "
        "j AS (SELECT app.*, prev.PREV_APP_COUNT, prev.PREV_O_TOTALPRICE_MEAN, "
        "prevm.PREV_DAYS_REL_BINNED_MODE, inst.* EXCLUDE (o_custkey), card.* EXCLUDE (user_id), "
        "cardm.CREDIT_EVENT_TYPE_MODE, pos.* EXCLUDE (user_id), bur.* EXCLUDE (o_custkey) "
        "FROM app LEFT JOIN prev ON c_custkey = prev.o_custkey "
        "LEFT JOIN prevm ON c_custkey = prevm.o_custkey "
        "LEFT JOIN inst ON c_custkey = inst.o_custkey LEFT JOIN card ON c_custkey = card.user_id "
        "LEFT JOIN cardm ON c_custkey = cardm.user_id LEFT JOIN pos ON c_custkey = pos.user_id "
        "LEFT JOIN bur ON c_custkey = bur.o_custkey), "
        f"m AS (SELECT {m_sel} FROM j), "
        f"f0 AS (SELECT *, {f14} FROM m), "
        f"f AS (SELECT * EXCLUDE (_l), {median} FROM f0) ")
    text_keep = ["c_custkey", "c_mktsegment", "PREV_DAYS_REL_BINNED_MODE", "CREDIT_EVENT_TYPE_MODE"]
    if skew:
        return ctes + sql_skew_select(
            cands, "f", text_keep + [f"round({SQL_SHIFT}c_nationkey, {R}) AS c_nationkey"])
    counts = {c for c in num_m if c.endswith(("_COUNT", "_MAX", "_MIN")) or c in (
        "BUREAU_SK_ID_BUREAU", "BUREAU_CREDIT_ACTIVE", "BUREAU_CREDIT_CURRENCY", "BUREAU_CREDIT_TYPE")}
    sel = text_keep + [c if c in counts else f"round({SQL_SHIFT}{c}, {R}) AS {c}"
                       for c in ["c_nationkey"] + cands]
    return ctes + f"SELECT {', '.join(sel)} FROM f"


def q_standardise(spark, d):
    c = tbl(spark, d, "customer").select("c_custkey", "c_acctbal")
    r = M.rollup(tbl(spark, d, "orders"), "o_custkey", [Agg("avg_price", "mean", "o_totalprice")])
    j = c.join(r.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    j = CL.fill_constants(j, numeric=["avg_price"], text=[])
    out = ML.standardise_batch(j, ["c_acctbal", "avg_price"], suffix="_z")
    return rnd(out.select("c_custkey", "c_acctbal_z", "avg_price_z"), ["c_acctbal_z", "avg_price_z"])


def _encoded(spark, df: DataFrame, pipeline, numeric, categorical, key: str) -> DataFrame:
    """Fit, save, load and apply an encoder pipeline; its vector as columns:
    ``z_<numeric>``, then ``<column>_<category>``."""
    path = scratch_path(spark, "encoder")
    IO.save_model(pipeline.fit(df), path)
    model = IO.load_model(path)
    names = [f"z_{c}" for c in numeric]
    index = next((s for s in model.stages if hasattr(s, "labelsArray")), None)
    for c, labels in zip(categorical, index.labelsArray if index else []):
        names += [f"{c}_{x}" for x in labels]
    out = model.transform(df).withColumn("arr", vector_to_array("features"))
    return out.select(key, *[F.col("arr")[i].alias(n) for i, n in enumerate(names)])


def q_one_hot(spark, d):
    """G3 through the preprocessing pipeline: NULL -> "missing", one column per category."""
    c = tbl(spark, d, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    pipe = ML.preprocessing_pipeline([], ["seg"], filter_column="seg", filter_value="XNA")
    return _encoded(spark, c, pipe, [], ["seg"], "c_custkey")


def q_encode_matrix(spark, d):
    """Column roles from the schema, drop/filter, impute,
    z-score and one-hot in one pipeline, saved, loaded and applied."""
    r = M.rollup(tbl(spark, d, "orders"), "o_custkey", [Agg("avg_price", "mean", "o_totalprice"),
                                                       Agg("n_orders", "count", "o_orderkey")])
    c = tbl(spark, d, "customer").select(
        "c_custkey", (F.col("c_custkey") % 2).cast("int").alias("label"), "c_acctbal",
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"),
        F.when(F.col("c_nationkey") > 5, F.col("c_nationkey") % 3).cast("string").alias("zone"),
        F.col("c_mktsegment").alias("X_BINNED_MODE"))
    j = c.join(r.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    numeric, categorical = ML.feature_roles(j, key="c_custkey", label="label")
    ML.check_categories(j, categorical)
    pipe = ML.preprocessing_pipeline(numeric, categorical, filter_column="seg", filter_value="MACHINERY",
                                     columns_to_drop=["X_BINNED_MODE", "absent"])
    out = _encoded(spark, j, pipe, numeric, categorical, "c_custkey")
    return rnd(out, [f"z_{n}" for n in numeric])


def q_score_average(spark, d):
    """G8's rule, G6's class and B11: two probability vectors averaged, class 1
    from the threshold on, key + class + probability."""
    li = tbl(spark, d, "lineitem")
    vec = lambda p: array_to_vector(F.array(F.lit(1.0) - p, p))
    x = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key"),
                  vec(F.col("l_discount") * 8).alias("p_trees"), vec(F.col("l_tax") * 8).alias("p_net"))
    model = PipelineModel(stages=[ML.ProbabilityAverager(probabilityCols=["p_trees", "p_net"], threshold=0.5)])
    return ML.score(model, x, key="line_key")


def q_bundle_load(spark, d):
    """A3 + A2: customer and orders as CSV, lineitem as Parquet in one folder,
    loaded by name (timestamps and quoted text included), then joined."""
    base = scratch_path(spark, "bundle")
    IO.write_csv(tbl(spark, d, "customer").withColumn(
        "c_name", F.concat(F.lit('says "hi", '), F.col("c_name"))), base + "/Customer.csv")
    IO.write_csv(tbl(spark, d, "orders"), base + "/orders.csv")
    tbl(spark, d, "lineitem").write.parquet(base + "/LINEITEM.parquet")
    L = T.LongType()
    b = IO.load_bundle(spark, base, ["customer", "orders", "lineitem"], {
        "customer": T.StructType([T.StructField("c_custkey", L)]),
        "orders": T.StructType([T.StructField("o_orderkey", L), T.StructField("o_custkey", L),
                                T.StructField("o_orderdate", tbl(spark, d, "orders").schema["o_orderdate"].dataType)])})
    lines = M.rollup(b["lineitem"], "l_orderkey", [Agg("n_lines", "count", "l_linenumber"),
                                                   Agg("n_flags", "nunique", "l_returnflag")])
    o = b["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("o_orderkey").alias("n_orders"), F.sum("n_lines").alias("n_lines"), F.sum("n_flags").alias("n_flags"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_order"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order"))
    return b["customer"].select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").join(per, "c_custkey", "left")


def _scored_docs(spark, d) -> DataFrame:
    j = tbl(spark, d, "labels").join(tbl(spark, d, "documents"), "doc_id")
    j = X.attach_scalar(j, "__st", j.agg(F.struct(F.max("n_chars").alias("mx"),
                                                 F.min("n_chars").alias("mn"))))
    mx, mn = F.col("__st.mx"), F.col("__st.mn")
    score = (mx - F.col("n_chars")).cast("double") / (mx - mn).cast("double")
    return j.select("doc_id", "quality", score.alias("score"))


def q_auc_rank(spark, d):
    return rnd(MT.roc_auc(_scored_docs(spark, d), "score", "quality"), ["auc"])


def q_f1_threshold(spark, d):
    return rnd(MT.best_f1_threshold(_scored_docs(spark, d), "score", "quality"), ["threshold", "f1"])


SQL_SCORED = (
    "WITH j AS (SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)), "
    "st AS (SELECT max(n_chars) AS mx, min(n_chars) AS mn FROM j), "
    "s AS (SELECT doc_id, quality, CAST(mx - n_chars AS DOUBLE) / CAST(mx - mn AS DOUBLE) AS score "
    "FROM j, st), "
    "dd AS (SELECT score, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos, "
    "CAST(sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM s "
    "WHERE score IS NOT NULL AND quality IS NOT NULL GROUP BY score), "
    "c AS (SELECT score, pos, neg, "
    "CAST(coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pb, "
    "CAST(coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS nb "
    "FROM dd) ")


def q_f1_grid(spark, d):
    return rnd(MT.f1_on_grid(_scored_docs(spark, d), "score", "quality", steps=20), ["threshold", "f1"])


def doc_features(spark, d) -> DataFrame:
    """Labelled training rows from documents (numeric + text features)."""
    j = tbl(spark, d, "labels").join(tbl(spark, d, "documents"), "doc_id")
    return j.select("doc_id", "quality", "lang", "source",
                    F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
                    F.size(F.split("text", "\n")).cast("double").alias("n_lines"))


def q_train_score(spark, d):
    feats = doc_features(spark, d)
    model = ML.train_classifier(feats, key="doc_id", label="quality", numeric=["n_chars", "n_words",
                                "n_lines"], categorical=["lang", "source"],
                                filter_column="source", filter_value="XNA")
    return ML.score(model, feats, key="doc_id")


# -- single marts and cleaning steps (F1, F2, F8, F10, F11, F13, F14) --------

def q_clean_application(spark, d):
    """unknown segment removed (NULL kept), text counters coerced."""
    c = tbl(spark, d, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"),
        F.substring_index("c_name", "#", -1).alias("name_num"), F.col("c_name").alias("name_whole"),
        F.col("c_nationkey").cast("string").alias("nation_txt"),
        F.col("c_acctbal").cast("string").alias("acctbal_txt"))
    return CL.clean_application(c, gender_col="c_mktsegment", drop_value="AUTOMOBILE",
                                coerce=["name_num", "name_whole", "nation_txt", "acctbal_txt"])


PREV_DAYS_ANALOG = ["days_rel", "days_to_end", "days_mid"]


def prev_rows(spark, d) -> DataFrame:
    """orders as previous applications: an annuity with negatives and NULLs,
    three day columns (one with the sentinel, one with NULLs)."""
    o = tbl(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderpriority",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") - F.lit(20000.0)).alias("amt_annuity"),
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "P", F.lit(float(C.DAYS_SENTINEL)))
         .otherwise(day_rel("o_orderdate")).alias("days_rel"),
        day_rel("o_orderdate", "2001-08-01").alias("days_to_end"),
        F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("double"))
         .otherwise(day_rel("o_orderdate", "1998-01-01")).alias("days_mid"))


def clean_prev(spark, d) -> DataFrame:
    return CL.clean_previous_application(prev_rows(spark, d), drop=["o_orderpriority", "o_comment"],
                                         amount_col="amt_annuity", days=PREV_DAYS_ANALOG)


def q_clean_previous(spark, d):
    """tolerant drop, annuity >= 0 (NULL dropped), five-bin day labels, strict drop."""
    return clean_prev(spark, d)


PREV_ANALOG = (
    [Agg("PREV_APP_COUNT", "nunique", "o_orderkey"),
     Agg("PREV_AMT_ANNUITY_MEAN", "mean", "amt_annuity"),
     Agg("PREV_O_TOTALPRICE_MEAN", "mean", "o_totalprice")]
    + [Agg(f"PREV_{c.upper()}_BINNED_MODE", "mode_ordinal", f"{c}_BINNED", tuple(C.DAY_BIN_LABELS))
       for c in PREV_DAYS_ANALOG])


def q_prev_mart(spark, d):
    """F8: distinct count, means and three binned-day modes (bin-order ties)."""
    return rnd_doubles(M.previous_application_mart(clean_prev(spark, d), key="o_custkey",
                                                   spec=PREV_ANALOG))


def card_rows(spark, d) -> DataFrame:
    """events as monthly card balances of a user."""
    ev = tbl(spark, d, "events")
    return ev.select(
        "user_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), "value",
        F.hour("ts").cast("double").alias("hour"), F.dayofmonth("ts").cast("double").alias("dom"),
        F.minute("ts").cast("double").alias("minute"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("status"))


CARD_ANALOG = [
    Agg("CREDIT_PREV_LOANS_COUNT", "nunique", "k"),
    Agg("CREDIT_AMT_BALANCE_MEAN", "mean", "value"),
    Agg("CREDIT_MONTHS_BALANCE_MEAN", "mean", "dom"),
    Agg("CREDIT_AMT_DRAWINGS_POS_CURRENT_MEAN", "mean", "purchase_value"),
    Agg("CREDIT_CNT_DRAWINGS_CURRENT_MEAN", "mean", "hour"),
    Agg("CREDIT_NAME_CONTRACT_STATUS_MODE", "mode", "status"),
    Agg("CREDIT_SK_DPD_MEAN", "mean", "minute"),
    Agg("CREDIT_SK_DPD_DEF_MEAN", "mean", "k"),
]


def q_card_mart(spark, d):
    """distinct count, means (one with NULL rows), text mode with NULLs."""
    return rnd_doubles(M.credit_card_mart(card_rows(spark, d), key="user_id", spec=CARD_ANALOG))


def pos_rows(spark, d) -> DataFrame:
    """lineitem x orders as monthly cash-loan balances of a customer."""
    li = tbl(spark, d, "lineitem")
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    dpd = day_rel("l_shipdate") - day_rel("o_orderdate")
    return j.select(
        "o_custkey", "l_orderkey", (-F.col("l_linenumber")).cast("double").alias("months"),
        "l_quantity", (F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount"))).alias("qty_future"),
        F.concat("l_returnflag", "l_linestatus").alias("status"), dpd.alias("dpd"),
        F.greatest(dpd - F.lit(60.0), F.lit(0.0)).alias("dpd_def"))


POS_ANALOG = [
    Agg("POS_PREV_LOANS_COUNT", "nunique", "l_orderkey"),
    Agg("POS_MONTHS_BALANCE_MEAN", "mean", "months"),
    Agg("POS_CNT_INSTALMENT_MEAN", "mean", "l_quantity"),
    Agg("POS_CNT_INSTALMENT_FUTURE_MEAN", "mean", "qty_future"),
    Agg("POS_NAME_CONTRACT_STATUS_MODE", "mode", "status"),
    Agg("POS_SK_DPD_MEAN", "mean", "dpd"),
    Agg("POS_SK_DPD_DEF_MEAN", "mean", "dpd_def"),
]


def q_pos_mart(spark, d):
    """F11 over a join: distinct orders, means, status mode (text ties)."""
    return rnd_doubles(M.pos_cash_mart(pos_rows(spark, d), key="o_custkey", spec=POS_ANALOG))


ROW_KEYS = ["l_orderkey", "l_linenumber"]
ROW_F14 = dict(
    keys=ROW_KEYS,
    guarded=[("R_PRICE_DISCOUNT", "l_extendedprice", "l_discount"),
             ("R_PRICE_TAX", "l_extendedprice", "l_tax"),
             ("R_QTY_DISCOUNT", "l_quantity", "l_discount"),
             ("R_ORDER_LINE", "o_totalprice", "l_extendedprice")],
    years=[("SHIP_YEARS", "ship_day"), ("ORDER_YEARS", "order_day"),
           ("LEAD_YEARS", "lead_days"), ("SHIP_END_YEARS", "ship_end_day")],
    plain=[("TAX_PER_DISCOUNT", "l_tax", "l_discount"),
           ("QTY_PER_PRIOR_LINE", "l_quantity", "prior_lines")],
    mean_median=("X_MEAN", "X_MEDIAN", ["x1", "x2", "x3"]),
    sums=[("FLAG_SUM_A", ["f_r", "f_f", "f_big"]), ("FLAG_SUM_B", ["f_disc", "f_tax"])],
)


def row_feature_input(spark, d) -> DataFrame:
    li = tbl(spark, d, "lineitem")
    o = tbl(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    one, zero = F.lit(1.0), F.lit(0.0)
    return j.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity",
        "o_totalprice", day_rel("l_shipdate").alias("ship_day"),
        F.when(F.col("o_orderstatus") == "P", F.lit(float(C.DAYS_SENTINEL)))
         .otherwise(day_rel("o_orderdate")).alias("order_day"),
        (F.col("l_linenumber") - 1).cast("double").alias("prior_lines"),
        (day_rel("l_shipdate") - day_rel("o_orderdate")).alias("lead_days"),
        day_rel("l_shipdate", "2001-08-01").alias("ship_end_day"),
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_discount")).alias("x1"),
        F.when(F.col("l_linestatus") == "F", F.lit(None)).otherwise(F.col("l_tax")).alias("x2"),
        F.when(F.col("l_linenumber") > 4, F.lit(None))
         .otherwise(F.col("l_quantity") / F.lit(50.0)).alias("x3"),
        F.when(F.col("l_returnflag") == "R", one).when(F.col("l_returnflag") == "A", zero).alias("f_r"),
        F.when(F.col("l_linestatus") == "F", one).otherwise(zero).alias("f_f"),
        F.when(F.col("l_quantity") > 25, one).otherwise(zero).alias("f_big"),
        F.when(F.col("l_discount") > 0.05, one).otherwise(zero).alias("f_disc"),
        F.when(F.col("l_tax") != 0, one).alias("f_tax"))


def q_row_features(spark, d):
    """F14 in full: sentinel -> NULL on every non-key number, 4 guarded ratios,
    4 day -> year columns, 2 plain ratios, row mean / median, 2 row sums.
    Plain row arithmetic, the same IEEE operations on both sides: compared unrounded."""
    return FE.feature_engineering(row_feature_input(spark, d), **ROW_F14)


def q_feature_mart(spark, d):
    """F13 + F14 without the final skew step: five roll-ups (one two-level)
    left-joined onto the customers, then the row-wise features."""
    return rnd_doubles(wide_mart_unskewed(spark, d))


def _sql_prev_rows() -> str:
    d1 = SQL_DAY.format(c="o_orderdate")
    d2 = "CAST(date_diff('day', DATE '2001-08-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"
    d3 = "CAST(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"
    rows = (
        "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE "
        "o_totalprice - CAST(20000.0 AS DOUBLE) END AS amt_annuity, o_totalprice, "
        f"CASE WHEN o_orderstatus = 'P' THEN CAST(-99999 AS DOUBLE) ELSE {d1} END AS d_days_rel, "
        f"{d2} AS d_days_to_end, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE {d3} END AS d_days_mid "
        "FROM orders")
    bins = ", ".join(f"{sql_bin_label('d_' + c)} AS {c}_BINNED, {sql_bin_idx('d_' + c)} AS {c}_IDX"
                     for c in PREV_DAYS_ANALOG)
    return f"SELECT o_orderkey, o_custkey, amt_annuity, o_totalprice, {bins} FROM ({rows}) WHERE amt_annuity >= 0"


def _sql_clean_previous() -> str:
    cols = ", ".join(f"{c}_BINNED" for c in PREV_DAYS_ANALOG)
    return (f"SELECT o_orderkey, o_custkey, amt_annuity, "
            f"o_totalprice, {cols} FROM ({_sql_prev_rows()})")


def _sql_prev_mart() -> str:
    modes = ", ".join(
        f"m{i} AS ({sql_mode('p', 'o_custkey', c + '_BINNED', order=c + '_IDX', out='v')})"
        for i, c in enumerate(PREV_DAYS_ANALOG))
    sel = ", ".join(f"m{i}.v AS PREV_{c.upper()}_BINNED_MODE" for i, c in enumerate(PREV_DAYS_ANALOG))
    joins = " ".join(f"LEFT JOIN m{i} ON g.o_custkey = m{i}.o_custkey" for i in range(len(PREV_DAYS_ANALOG)))
    return (
        f"WITH p AS ({_sql_prev_rows()}), "
        "g AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS PREV_APP_COUNT, "
        f"round({SQL_SHIFT}avg(amt_annuity), {R}) AS PREV_AMT_ANNUITY_MEAN, "
        f"round({SQL_SHIFT}avg(o_totalprice), {R}) AS PREV_O_TOTALPRICE_MEAN "
        f"FROM p WHERE o_custkey IS NOT NULL GROUP BY o_custkey), {modes} "
        f"SELECT g.o_custkey, PREV_APP_COUNT, PREV_AMT_ANNUITY_MEAN, PREV_O_TOTALPRICE_MEAN, {sel} "
        f"FROM g {joins}")


def _sql_rollup(rows: str, key: str, spec, mode_out="v") -> str:
    """Roll-up oracle: means rounded, distinct counts, text modes by count then value."""
    aggs, modes, sel, joins = [], [], [], []
    for s in spec:
        if s.fn == "nunique":
            aggs.append(f"count(DISTINCT {s.col}) AS {s.out}")
        elif s.fn == "mean":
            aggs.append(f"round({SQL_SHIFT}avg({s.col}), {R}) AS {s.out}")
        elif s.fn == "mode":
            i = len(modes)
            modes.append(f"m{i} AS ({sql_mode('r', key, s.col, out=mode_out)})")
            joins.append(f"LEFT JOIN m{i} ON g.{key} = m{i}.{key}")
            sel.append(f"m{i}.{mode_out} AS {s.out}")
            continue
        else:
            raise ValueError(s.fn)
        sel.append(s.out)
    return (f"WITH r AS ({rows}), g AS (SELECT {key}, {', '.join(aggs)} FROM r WHERE {key} IS NOT NULL "
            f"GROUP BY {key}), {', '.join(modes)} SELECT g.{key}, {', '.join(sel)} FROM g {' '.join(joins)}")


SQL_CARD_ROWS = (
    "SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value, "
    "CAST(hour(ts) AS DOUBLE) AS hour, CAST(dayofmonth(ts) AS DOUBLE) AS dom, "
    "CAST(minute(ts) AS DOUBLE) AS minute, CASE WHEN event_type = 'purchase' THEN value END "
    "AS purchase_value, nullif(event_type, 'error') AS status FROM events")

_SQL_DPD = SQL_DAY.format(c="l_shipdate") + " - " + SQL_DAY.format(c="o_orderdate")
SQL_POS_ROWS = (
    "SELECT o_custkey, l_orderkey, CAST(-l_linenumber AS DOUBLE) AS months, l_quantity, "
    "l_quantity * (CAST(1.0 AS DOUBLE) - l_discount) AS qty_future, "
    f"concat(l_returnflag, l_linestatus) AS status, {_SQL_DPD} AS dpd, "
    f"greatest({_SQL_DPD} - CAST(60.0 AS DOUBLE), CAST(0.0 AS DOUBLE)) AS dpd_def "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def _sql_row_features() -> str:
    dd = SQL_DAY.format
    inputs = (
        "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity, o_totalprice, "
        f"{dd(c='l_shipdate')} AS ship_day, CASE WHEN o_orderstatus = 'P' THEN CAST(365243 AS DOUBLE) "
        f"ELSE {dd(c='o_orderdate')} END AS order_day, CAST(l_linenumber - 1 AS DOUBLE) AS prior_lines, "
        f"{dd(c='l_shipdate')} - {dd(c='o_orderdate')} AS lead_days, "
        "CAST(date_diff('day', DATE '2001-08-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS ship_end_day, "
        "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS x1, "
        "CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_tax END AS x2, "
        "CASE WHEN l_linenumber > 4 THEN NULL ELSE l_quantity / CAST(50 AS DOUBLE) END AS x3, "
        "CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.0 END::DOUBLE AS f_r, "
        "CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_f, "
        "CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS f_big, "
        "CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS f_disc, "
        "CASE WHEN l_tax <> 0 THEN 1.0 END::DOUBLE AS f_tax "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    nums = ["l_extendedprice", "l_discount", "l_tax", "l_quantity", "o_totalprice", "ship_day",
            "order_day", "prior_lines", "lead_days", "ship_end_day", "x1", "x2", "x3",
            "f_r", "f_f", "f_big", "f_disc", "f_tax"]
    s_sel = ", ".join(ROW_KEYS + [f"nullif({c}, 365243) AS {c}" for c in nums])
    f = ROW_F14
    feats = [f"{a} / ({b} + CAST(0.00001 AS DOUBLE)) AS {n}" for n, a, b in f["guarded"]]
    feats += [f"{c} / CAST(-365.0 AS DOUBLE) AS {n}" for n, c in f["years"]]
    feats += [f"{a} / nullif({b}, 0) AS {n}" for n, a, b in f["plain"]]
    mean_n, med_n, xs = f["mean_median"]
    csum = " + ".join(f"coalesce({c}, CAST(0 AS DOUBLE))" for c in xs)
    ccnt = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in xs)
    feats.append(f"({csum}) / nullif(CAST({ccnt} AS DOUBLE), 0) AS {mean_n}")
    feats.append(f"list_sort(list_filter([{', '.join(xs)}], lambda v: v IS NOT NULL)) AS _l")
    feats += [" + ".join(f"coalesce({c}, CAST(0 AS DOUBLE))" for c in cols) + f" AS {n}"
              for n, cols in f["sums"]]
    median = (f"CASE len(_l) WHEN 0 THEN NULL WHEN 1 THEN _l[1] WHEN 2 THEN (_l[1] + _l[2]) / 2.0 "
              f"ELSE _l[2] END AS {med_n}")
    outs = (nums + [n for n, _a, _b in f["guarded"]] + [n for n, _c in f["years"]]
            + [n for n, _a, _b in f["plain"]] + [mean_n, med_n] + [n for n, _c in f["sums"]])
    final = ", ".join(ROW_KEYS + outs)
    return (f"WITH b AS ({inputs}), s AS (SELECT {s_sel} FROM b), "
            f"f0 AS (SELECT *, {', '.join(feats)} FROM s), "
            f"f AS (SELECT * EXCLUDE (_l), {median} FROM f0) SELECT {final} FROM f")


NEW_ORACLES = {
    "clean_application":
        "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, "
        "TRY_CAST(split_part(c_name, '#', 2) AS DOUBLE) AS name_num, "
        "TRY_CAST(c_name AS DOUBLE) AS name_whole, CAST(c_nationkey AS DOUBLE) AS nation_txt, "
        "c_acctbal AS acctbal_txt FROM customer "
        "WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'AUTOMOBILE'",
    "clean_previous": _sql_clean_previous(),
    "prev_mart": _sql_prev_mart(),
    "card_mart": _sql_rollup(SQL_CARD_ROWS, "user_id", CARD_ANALOG),
    "pos_mart": _sql_rollup(SQL_POS_ROWS, "o_custkey", POS_ANALOG),
    "row_features": _sql_row_features(),
    "feature_mart": _sql_wide_mart(skew=False),
}


# ---------------------------------------------------------------------------
# Registry.
# ---------------------------------------------------------------------------

QUERIES = {
    "filter_ne_keep_null": q_filter_ne_keep_null,
    "filter_ge_drop_null": q_filter_ge_drop_null,
    "drop_then_filter": q_drop_then_filter,
    "csv_roundtrip": q_csv_roundtrip,
    "coerce_numeric": q_coerce_numeric,
    "sentinel_to_null": q_sentinel_to_null,
    "bin_days": q_bin_days,
    "map_status": q_map_status,
    "guarded_ratio": q_guarded_ratio,
    "plain_ratio": q_plain_ratio,
    "days_to_years": q_days_to_years,
    "row_mean": q_row_mean,
    "row_median": q_row_median,
    "row_sum": q_row_sum,
    "impute_constants": q_impute_constants,
    "rollup_balance": q_rollup_balance,
    "join_balance": q_join_balance,
    "two_level_rollup": q_two_level_rollup,
    "group_null_key": q_group_null_key,
    "mode_text": q_mode_text,
    "mode_binned": q_mode_binned,
    "instalment_mart": q_instalment_mart,
    "skew_report": q_skew_report,
    "skew_log_positive": q_skew_log_positive,
    "skew_log_shifted": q_skew_log_shifted,
    "wide_mart": q_wide_mart,
    "standardise": q_standardise,
    "one_hot": q_one_hot,
    "encode_matrix": q_encode_matrix,
    "score_average": q_score_average,
    "bundle_load": q_bundle_load,
    "auc_rank": q_auc_rank,
    "f1_threshold": q_f1_threshold,
    "f1_grid": q_f1_grid,
    "train_score": q_train_score,
    "clean_application": q_clean_application,
    "clean_previous": q_clean_previous,
    "prev_mart": q_prev_mart,
    "card_mart": q_card_mart,
    "pos_mart": q_pos_mart,
    "row_features": q_row_features,
    "feature_mart": q_feature_mart,
}

_ROWS = ("x1", "x2", "x3")
SQL_ROW_INPUTS = (
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS x1, "
    "CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_tax END AS x2, "
    "CASE WHEN l_linenumber > 4 THEN NULL ELSE l_quantity / CAST(50 AS DOUBLE) END AS x3 FROM lineitem")


def _skew_report_sql() -> str:
    parts = []
    for name, cols in [("events", ["value"]), ("documents", ["n_chars"]),
                       ("part", ["p_size", "p_retailprice"])]:
        for c in cols:
            x = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"SELECT '{name}' AS table_name, '{c}' AS column_name, round({SQL_SHIFT}skewness({x}), {R}) AS skewness, "
                f"min({x}) AS min_value, count({x}) AS n, "
                f"coalesce(abs(skewness({x})) > 1.0, false) AS selected FROM {name}")
    return " UNION ALL ".join(parts)


SEGMENTS = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY", "missing"]
ENCODED_NUMBERS = ["c_acctbal", "avg_price", "n_orders"]


def _sql_flags(col: str, values) -> str:
    return ", ".join(f"CAST(CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{col}_{v}\"" for v in values)


ORACLE_SQL = {
    "filter_ne_keep_null":
        "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer "
        "WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'AUTOMOBILE'",
    "filter_ge_drop_null":
        "SELECT * FROM (SELECT l_orderkey, l_linenumber, "
        + SQL_DAY.format(c="l_shipdate") + " - " + SQL_DAY.format(c="o_orderdate")
        + " AS delay_days, CASE WHEN l_returnflag = 'R' THEN NULL "
        "ELSE l_extendedprice * (l_discount - CAST(0.05 AS DOUBLE)) END AS amt "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE amt >= 0",
    "drop_then_filter":
        "SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment FROM customer "
        "WHERE nullif(c_mktsegment, 'HOUSEHOLD') IS DISTINCT FROM 'MACHINERY'",
    "csv_roundtrip":
        "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, "
        "r.n_orders, round(" + SQL_SHIFT + "r.total_price, 6) AS total_price FROM customer LEFT JOIN "
        "(SELECT o_custkey, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0) AS total_price "
        "FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey) r ON c_custkey = r.o_custkey",
    "coerce_numeric":
        "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_num, "
        "TRY_CAST(p_brand AS DOUBLE) AS brand_whole, TRY_CAST(p_type AS DOUBLE) AS type_num, "
        "CAST(p_size AS DOUBLE) AS size_num FROM part",
    "sentinel_to_null":
        f"SELECT o_orderkey, o_custkey, nullif({SQL_ORDER_DAYS}, 365243) AS days_rel, "
        "nullif(o_totalprice, 365243) AS o_totalprice FROM orders",
    "bin_days":
        "SELECT o_orderkey, " + sql_bin_label(
            "(CASE WHEN o_orderstatus = 'P' THEN CAST(-99999 AS DOUBLE) ELSE "
            + SQL_DAY.format(c="o_orderdate") + " END)") + " AS days_binned FROM orders",
    "map_status":
        f"SELECT l_orderkey, l_linenumber, {SQL_STATUS} AS status, "
        f"{SQL_STATUS_ENC.format(s=SQL_STATUS)} AS status_encoded FROM lineitem",
    "guarded_ratio":
        "SELECT l_orderkey, l_linenumber, l_extendedprice / (l_discount + CAST(0.00001 AS DOUBLE)) "
        "AS ratio FROM lineitem",
    "plain_ratio":
        "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem",
    "days_to_years":
        "SELECT l_orderkey, l_linenumber, " + SQL_DAY.format(c="l_shipdate")
        + " / CAST(-365.0 AS DOUBLE) AS ship_years FROM lineitem",
    "row_mean":
        "SELECT l_orderkey, l_linenumber, (coalesce(x1, 0.0) + coalesce(x2, 0.0) + coalesce(x3, 0.0)) "
        "/ nullif(CAST((x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT AS DOUBLE), 0) "
        f"AS x_mean FROM ({SQL_ROW_INPUTS})",
    "row_median":
        "SELECT l_orderkey, l_linenumber, CASE len(l) WHEN 0 THEN NULL WHEN 1 THEN l[1] "
        "WHEN 2 THEN (l[1] + l[2]) / 2.0 ELSE l[2] END AS x_median FROM (SELECT l_orderkey, "
        "l_linenumber, list_sort(list_filter([x1, x2, x3], lambda v: v IS NOT NULL)) AS l "
        f"FROM ({SQL_ROW_INPUTS}))",
    "row_sum":
        "SELECT l_orderkey, l_linenumber, coalesce(x1, 0.0) + coalesce(x2, 0.0) + coalesce(x3, 0.0) "
        f"AS x_sum FROM ({SQL_ROW_INPUTS})",
    "impute_constants":
        "WITH r AS (SELECT user_id, count(DISTINCT event_id) AS ev_count, avg(value) AS ev_value_mean "
        "FROM events WHERE user_id IS NOT NULL GROUP BY user_id), "
        f"m AS ({sql_mode('events', 'user_id', 'event_type')}) "
        "SELECT c_custkey, coalesce(r.ev_count, 0) AS ev_count, "
        "round(" + SQL_SHIFT + "coalesce(r.ev_value_mean, 0.0), 6) AS ev_value_mean, "
        "coalesce(m.mode_value, 'missing') AS ev_type_mode FROM customer "
        "LEFT JOIN r ON c_custkey = r.user_id LEFT JOIN m ON c_custkey = m.user_id",
    "rollup_balance":
        "SELECT l_orderkey, round(" + SQL_SHIFT + "BUREAU_BAL_MONTHS_BALANCE_MEAN, 6) AS BUREAU_BAL_MONTHS_BALANCE_MEAN, "
        "round(" + SQL_SHIFT + "BUREAU_BAL_STATUS_MEAN, 6) AS BUREAU_BAL_STATUS_MEAN, BUREAU_BAL_STATUS_MAX, "
        f"BUREAU_BAL_STATUS_MIN FROM ({SQL_BAL})",
    "join_balance":
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round(" + SQL_SHIFT + "o_totalprice, 6) AS o_totalprice, "
        "round(" + SQL_SHIFT + "o_prio_txt, 6) AS o_prio_txt, round(" + SQL_SHIFT + "days_rel, 6) AS days_rel, "
        "round(" + SQL_SHIFT + "BUREAU_BAL_MONTHS_BALANCE_MEAN, 6) AS BUREAU_BAL_MONTHS_BALANCE_MEAN, "
        "round(" + SQL_SHIFT + "BUREAU_BAL_STATUS_MEAN, 6) AS BUREAU_BAL_STATUS_MEAN, BUREAU_BAL_STATUS_MAX, "
        f"BUREAU_BAL_STATUS_MIN FROM ({SQL_MERGED_BUREAU})",
    "two_level_rollup":
        "SELECT o_custkey, BUREAU_SK_ID_BUREAU, BUREAU_CREDIT_ACTIVE, BUREAU_CREDIT_CURRENCY, "
        "round(" + SQL_SHIFT + "BUREAU_DAYS_CREDIT, 6) AS BUREAU_DAYS_CREDIT, "
        "round(" + SQL_SHIFT + "BUREAU_CNT_CREDIT_PROLONG, 6) AS BUREAU_CNT_CREDIT_PROLONG, "
        "round(" + SQL_SHIFT + "BUREAU_AMT_CREDIT_SUM, 6) AS BUREAU_AMT_CREDIT_SUM, BUREAU_CREDIT_TYPE, "
        "round(" + SQL_SHIFT + "BUREAU_BUREAU_BAL_MONTHS_BALANCE_MEAN, 6) AS BUREAU_BUREAU_BAL_MONTHS_BALANCE_MEAN, "
        "round(" + SQL_SHIFT + "BUREAU_BUREAU_BAL_STATUS_MEAN, 6) AS BUREAU_BUREAU_BAL_STATUS_MEAN, "
        "BUREAU_BUREAU_BAL_STATUS_MAX, BUREAU_BUREAU_BAL_STATUS_MIN "
        f"FROM ({SQL_BUREAU_MART})",
    "group_null_key":
        "SELECT k, count(DISTINCT o_orderkey) AS n_orders, round(" + SQL_SHIFT + "coalesce(sum(price), 0), 6) AS price_sum, "
        "count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(DISTINCT o_orderstatus) AS n_status "
        "FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k, o_orderkey, "
        "o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders) "
        "WHERE k IS NOT NULL GROUP BY k",
    "mode_text":
        "SELECT u.user_id, u.n_events, m.mode_value AS event_type_mode FROM (SELECT user_id, count(event_id) "
        "AS n_events FROM events WHERE user_id IS NOT NULL GROUP BY user_id) u LEFT JOIN "
        f"({sql_mode('events', 'user_id', 'event_type')}) m ON u.user_id = m.user_id",
    "mode_binned":
        f"WITH o AS (SELECT o_custkey, o_orderkey, {sql_bin_label('d')} AS bl, {sql_bin_idx('d')} AS bi "
        f"FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CAST(-99999 AS DOUBLE) "
        f"ELSE {SQL_DAY.format(c='o_orderdate')} END AS d FROM orders)) "
        "SELECT u.o_custkey, u.n_orders, m.mode_value AS days_binned_mode FROM (SELECT o_custkey, "
        "count(o_orderkey) AS n_orders FROM o WHERE o_custkey IS NOT NULL GROUP BY o_custkey) u "
        f"LEFT JOIN ({sql_mode('o', 'o_custkey', 'bl', order='bi')}) m ON u.o_custkey = m.o_custkey",
    "instalment_mart":
        "SELECT o_custkey, INST_COUNT, round(" + SQL_SHIFT + "INST_DAYS_INSTALMENT_MEAN, 6) AS INST_DAYS_INSTALMENT_MEAN, "
        "round(" + SQL_SHIFT + "INST_DAYS_ENTRY_PAYMENT_MEAN, 6) AS INST_DAYS_ENTRY_PAYMENT_MEAN, "
        "round(" + SQL_SHIFT + "INST_AMT_INSTALMENT_MEAN, 6) AS INST_AMT_INSTALMENT_MEAN, "
        "round(" + SQL_SHIFT + f"INST_AMT_PAYMENT_MEAN, 6) AS INST_AMT_PAYMENT_MEAN FROM ({SQL_INST})",
    "skew_report": _skew_report_sql(),
    "skew_log_positive":
        sql_skew_select(["value"], "events", ["event_id", "user_id"]),
    "skew_log_shifted":
        sql_skew_select(["value_shifted", "ctrl"],
                        "(SELECT event_id, value - 100.0 AS value_shifted, CAST(hour(ts) AS DOUBLE) "
                        "AS ctrl FROM events) AS e", ["event_id"]),
    "wide_mart": _sql_wide_mart(),
    "standardise":
        "WITH j AS (SELECT c_custkey, c_acctbal, coalesce(r.avg_price, 0.0) AS avg_price FROM customer "
        "LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS avg_price FROM orders WHERE o_custkey IS NOT NULL "
        "GROUP BY o_custkey) r ON c_custkey = r.o_custkey), "
        "st AS (SELECT avg(c_acctbal) AS a1, stddev_pop(c_acctbal) AS s1, avg(avg_price) AS a2, "
        "stddev_pop(avg_price) AS s2 FROM j) "
        "SELECT c_custkey, round(" + SQL_SHIFT + "(c_acctbal - a1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1.0 ELSE s1 END, 6) "
        "AS c_acctbal_z, round(" + SQL_SHIFT + "(avg_price - a2) / CASE WHEN s2 = 0 OR s2 IS NULL THEN 1.0 ELSE s2 END, 6) "
        "AS avg_price_z FROM j, st",
    "one_hot":
        "SELECT c_custkey, " + _sql_flags("seg", SEGMENTS) + " FROM (SELECT c_custkey, "
        "coalesce(nullif(c_mktsegment, 'BUILDING'), 'missing') AS seg FROM customer)",
    "encode_matrix":
        "WITH j AS (SELECT c_custkey, c_acctbal, coalesce(avg_price, 0.0) AS avg_price, "
        "CAST(coalesce(n_orders, 0) AS DOUBLE) AS n_orders, "
        "coalesce(nullif(c_mktsegment, 'BUILDING'), 'missing') AS seg, "
        "coalesce(CAST(CASE WHEN c_nationkey > 5 THEN c_nationkey % 3 END AS VARCHAR), 'missing') AS zone "
        "FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS avg_price, count(o_orderkey) AS n_orders "
        "FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey) ON c_custkey = o_custkey "
        "WHERE c_mktsegment <> 'MACHINERY'), st AS (SELECT "
        + ", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in ENCODED_NUMBERS)
        + " FROM j) SELECT c_custkey, "
        + ", ".join(f"round({SQL_SHIFT}({c} - a_{c}) / s_{c}, {R}) AS z_{c}" for c in ENCODED_NUMBERS) + ", "
        + _sql_flags("seg", [x for x in SEGMENTS if x != "MACHINERY"]) + ", "
        + _sql_flags("zone", ["0", "1", "2", "missing"]) + " FROM j, st",
    "score_average":
        "SELECT line_key, CAST(probability >= 0.5 AS INTEGER) AS \"TARGET\", probability FROM (SELECT "
        "l_orderkey * 10 + l_linenumber AS line_key, (l_discount * 8 + l_tax * 8) / CAST(2.0 AS DOUBLE) "
        "AS probability FROM lineitem)",
    "bundle_load":
        "SELECT c_custkey, 'says \"hi\", ' || c_name AS c_name, c_mktsegment, c_acctbal, n_orders, n_lines, n_flags, "
        "first_order, last_order FROM customer LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n_orders, "
        "CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_flags) AS BIGINT) AS n_flags, "
        "strftime(min(o_orderdate), '%Y-%m-%d') AS first_order, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order "
        "FROM orders LEFT JOIN (SELECT l_orderkey, count(l_linenumber) AS n_lines, count(DISTINCT l_returnflag) "
        "AS n_flags FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL "
        "GROUP BY o_custkey) ON c_custkey = o_custkey",
    "auc_rank":
        SQL_SCORED + "SELECT round(" + SQL_SHIFT + "sum(CAST(pos AS DOUBLE) * (CAST(nb AS DOUBLE) + CAST(neg AS DOUBLE) / "
        "CAST(2.0 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * "
        "CAST(sum(neg) AS DOUBLE)), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, "
        "CAST(sum(neg) AS BIGINT) AS n_neg FROM c",
    "f1_threshold":
        SQL_SCORED + ", t AS (SELECT CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM dd), "
        "f AS (SELECT score AS threshold, P - pb AS tp, N - nb AS fp, pb AS fn, "
        "(CAST(2.0 AS DOUBLE) * (P - pb)) / (CAST(2.0 AS DOUBLE) * (P - pb) + (N - nb) + pb) AS f1 "
        "FROM c, t) "
        "SELECT round(" + SQL_SHIFT + "threshold, 6) AS threshold, tp, fp, fn, round(" + SQL_SHIFT + "f1, 6) AS f1 FROM f "
        "ORDER BY f1 DESC, threshold ASC LIMIT 1",
    "f1_grid":
        SQL_SCORED + ", g AS (SELECT CAST(i AS DOUBLE) / CAST(20 AS DOUBLE) AS threshold "
        "FROM range(0, 21) t(i)) "
        "SELECT round(" + SQL_SHIFT + "threshold, 6) AS threshold, "
        "CAST(coalesce(sum(pos) FILTER (WHERE score >= threshold), 0) AS BIGINT) AS tp, "
        "CAST(coalesce(sum(neg) FILTER (WHERE score >= threshold), 0) AS BIGINT) AS fp, "
        "CAST(coalesce(sum(pos) FILTER (WHERE score < threshold), 0) AS BIGINT) AS fn, "
        "round(" + SQL_SHIFT + "CAST(2.0 AS DOUBLE) * coalesce(sum(pos) FILTER (WHERE score >= threshold), 0) / "
        "nullif(CAST(2.0 AS DOUBLE) * coalesce(sum(pos) FILTER (WHERE score >= threshold), 0) "
        "+ coalesce(sum(neg) FILTER (WHERE score >= threshold), 0) "
        "+ coalesce(sum(pos) FILTER (WHERE score < threshold), 0), 0), 6) AS f1 "
        "FROM g, dd GROUP BY threshold",
}
ORACLE_SQL.update(NEW_ORACLES)
