"""F15 on the driver's tables: ``credit.build_features`` as it stands, on a
bundle of seven tables with the credit column names.

The bundle is derived from whole tables by expressions that Spark SQL and
DuckDB read alike (``BUNDLE``). They cover what the cleaning steps are for:
text that is no number, the unknown gender, NULL keys, negative and NULL
amounts, the day sentinel, unmapped status codes, x/0, rows without sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import catalog as Q
from . import credit


def _double(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def _day(c: str, year: int = 2002) -> str:
    """Days before about the end of ``year``, by months of 30 days."""
    return _double(f"(year({c}) - {year}) * 365 + month({c}) * 30 + day({c})")


_ORDER, _SHIP = _day("o_orderdate"), _day("l_shipdate")
_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"

#: table -> (source, {column: expression})
BUNDLE = {
    "application_train": ("customer", {
        "SK_ID_CURR": "c_custkey",
        "TARGET": "CAST(c_custkey % 2 AS INT)",
        "CODE_GENDER": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'XNA' WHEN 'BUILDING' THEN NULL "
                       "WHEN 'HOUSEHOLD' THEN 'F' ELSE 'M' END",
        "NAME_EDUCATION_TYPE": "c_mktsegment",
        "AMT_REQ_CREDIT_BUREAU_HOUR": "CASE WHEN c_nationkey % 5 = 0 THEN '1d' ELSE CAST(c_nationkey % 4 AS STRING) END",
        "AMT_REQ_CREDIT_BUREAU_DAY": "CASE WHEN c_nationkey % 7 = 0 THEN 'nan' "
                                     "ELSE CAST(c_nationkey * c_nationkey AS STRING) END",
        "REGION_RATING_CLIENT": "' ' || CAST(c_nationkey % 3 + 1 AS STRING) || ' '",
        "AMT_REQ_CREDIT_BUREAU_WEEK": "CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey % 11 AS STRING) END",
        "DEF_30_CNT_SOCIAL_CIRCLE": "CAST(c_custkey % 3 AS STRING)",
        "DEF_60_CNT_SOCIAL_CIRCLE": "c_name",
        "REGION_RATING_CLIENT_W_CITY": "CAST(c_custkey % 6 AS STRING) || 'e0'",
        "AMT_CREDIT": "c_acctbal * 10 + 200000",
        "AMT_INCOME_TOTAL": _double("1000000") + " / (c_custkey % 97 + 1)",
        "AMT_GOODS_PRICE": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal * 9 + 180000 END",
        "AMT_ANNUITY": "c_acctbal + 5000",
        "DAYS_BIRTH": _double("-(7000 + c_custkey % 18000)"),
        "DAYS_EMPLOYED": _double("CASE WHEN c_nationkey = 3 THEN 365243 ELSE -(c_custkey % 4000) END"),
        "DAYS_REGISTRATION": _double("-(c_custkey * 7 % 15000)"),
        "DAYS_ID_PUBLISH": _double("-(c_custkey * 11 % 6000)"),
        "CNT_CHILDREN": _double("c_custkey % 4"),
        "CNT_FAM_MEMBERS": _double("c_custkey % 4 + c_nationkey % 2"),
        **{c: f"CASE WHEN c_custkey % {n} = 0 THEN NULL ELSE {_double(f'c_custkey * {n} % 101')} / 101 END"
           for c, n in zip(C.EXT_SOURCE_COLUMNS, (2, 3, 5))},
        **{c: _double(f"CASE WHEN c_custkey % {i} = 0 THEN 1 ELSE 0 END")
           for i, c in enumerate(C.FLAG_DOCUMENT_COLUMNS, 2)},
        **{c: _double(f"CASE WHEN c_nationkey % {i} = 0 THEN NULL WHEN c_custkey % {i} = 1 THEN 1 ELSE 0 END")
           for i, c in enumerate(C.FLAG_PHONE_COLUMNS, 3)},
    }),
    "previous_application": ("orders", {
        "SK_ID_PREV": "o_orderkey",
        "SK_ID_CURR": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END",
        "AMT_ANNUITY": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice - 20000 END",
        "AMT_APPLICATION": "o_totalprice",
        "AMT_CREDIT": f"o_totalprice * {_double('1.5')}",
        "AMT_GOODS_PRICE": f"CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice * {_double('0.75')} END",
        "DAYS_FIRST_DRAWING": f"CASE WHEN o_orderstatus = 'P' THEN {_double('365243')} ELSE {_ORDER} END",
        "DAYS_FIRST_DUE": f"CASE WHEN o_orderstatus = 'F' THEN NULL ELSE {_ORDER} + 800 END",
        "DAYS_LAST_DUE_1ST_VERSION": f"{_ORDER} + 1500",
        "DAYS_LAST_DUE": f"{_ORDER} + 400",
        "DAYS_TERMINATION": f"CASE WHEN o_orderkey % 4 = 0 THEN {_double('365243')} ELSE {_ORDER} + 1000 END",
        "RATE_INTEREST_PRIMARY": _double("0.125"),
        "AMT_DOWN_PAYMENT": "o_totalprice",
    }),
    "installments_payments": (_LINES, {
        "SK_ID_PREV": "l_orderkey",
        "SK_ID_CURR": "o_custkey",
        "NUM_INSTALMENT_NUMBER": "CAST(l_linenumber AS BIGINT)",
        "DAYS_INSTALMENT": _ORDER,
        "DAYS_ENTRY_PAYMENT": _SHIP,
        "AMT_INSTALMENT": "l_extendedprice",
        "AMT_PAYMENT": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice * (1 - l_discount) END",
    }),
    "credit_card_balance": ("events", {
        "SK_ID_PREV": "event_id % 7",
        "SK_ID_CURR": "user_id",
        "MONTHS_BALANCE": _double("-day(ts)"),
        **{c: f"CASE WHEN event_id % {i + 3} = 0 THEN NULL ELSE value * {i} - event_id % 17 END"
           for i, c in enumerate(C.CARD_MEAN_COLUMNS) if c != "MONTHS_BALANCE"},
        "NAME_CONTRACT_STATUS": "nullif(event_type, 'error')",
        "SK_DPD": _double("hour(ts)"),
        "SK_DPD_DEF": _double("event_id % 3"),
    }),
    "pos_cash_balance": (_LINES, {
        "SK_ID_PREV": "l_orderkey",
        "SK_ID_CURR": "o_custkey",
        "MONTHS_BALANCE": _double("-l_linenumber"),
        "CNT_INSTALMENT": "l_quantity",
        "CNT_INSTALMENT_FUTURE": "l_quantity * (1 - l_discount)",
        "NAME_CONTRACT_STATUS": "l_returnflag || l_linestatus",
        "SK_DPD": f"greatest({_SHIP} - ({_ORDER}), {_double('0')})",
        "SK_DPD_DEF": f"greatest({_SHIP} - ({_ORDER}) - 60, {_double('0')})",
    }),
    "bureau": ("orders", {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_BUREAU": "o_orderkey",
        "CREDIT_ACTIVE": "CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'P' THEN NULL ELSE 'Closed' END",
        "CREDIT_CURRENCY": "'currency ' || CAST(o_orderkey % 3 AS STRING)",
        "CREDIT_TYPE": "o_orderpriority",
        "DAYS_CREDIT": _ORDER,
        "CREDIT_DAY_OVERDUE": _double("CASE WHEN o_orderkey % 50 = 0 THEN 2000 ELSE o_orderkey % 3 END"),
        "DAYS_ENDDATE_FACT": f"CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {_ORDER} + 90 END",
        "DAYS_CREDIT_UPDATE": f"{_ORDER} - o_orderkey % 30",
        "AMT_CREDIT_SUM": "o_totalprice",
        "AMT_CREDIT_SUM_DEBT": f"{_double('1000000')} / (o_orderkey % 61 + 1)",
        "AMT_CREDIT_SUM_LIMIT": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice - 250000 END",
        "AMT_CREDIT_SUM_OVERDUE": "CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice ELSE 0 END",
        "CNT_CREDIT_PROLONG": "CASE WHEN o_orderkey % 8 = 0 THEN o_orderpriority ELSE CAST(o_orderkey % 5 AS STRING) END",
        "AMT_ANNUITY": "o_totalprice",
    }),
    "bureau_balance": ("lineitem", {
        "SK_ID_BUREAU": "l_orderkey",
        "MONTHS_BALANCE": _double("-l_linenumber"),
        "STATUS": "CASE WHEN l_returnflag = 'R' THEN 'C' WHEN l_returnflag = 'A' THEN 'X' "
                  "ELSE CAST(l_linenumber - 1 AS STRING) END",
    }),
}


def credit_bundle(spark, d: str) -> dict[str, DataFrame]:
    t = {name: Q.tbl(spark, d, name) for name in ("customer", "orders", "lineitem", "events")}
    t[_LINES] = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return {name: t[source].selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
            for name, (source, cols) in BUNDLE.items()}


def q_credit_features(spark, d: str) -> DataFrame:
    """the seven tables to one feature row per application, both skew steps included."""
    return Q.rnd_doubles(credit.build_features(credit_bundle(spark, d)))


# ---------------------------------------------------------------------------
# The same in DuckDB SQL, written from SURVEY §2.F.
# ---------------------------------------------------------------------------

_TEXT = {"CODE_GENDER", "NAME_EDUCATION_TYPE", "CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"}


def _number(c: str) -> str:
    """Text that is a plain decimal number, else NULL."""
    return (rf"CASE WHEN regexp_full_match({c}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


def _means(prefix: str, cols) -> list[str]:
    return [f"avg({c}) AS {prefix}_{c}_MEAN" for c in cols]


def _grouped(src: str, exprs, modes=()) -> str:
    """One row per non-NULL applicant; ``modes``: (output, value, order)."""
    out = (f"SELECT * FROM (SELECT SK_ID_CURR, {', '.join(exprs)} FROM {src} "
           "WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR)")
    for name, value, order in modes:
        out += f" LEFT JOIN ({Q.sql_mode(src, 'SK_ID_CURR', value, order, name)}) USING (SK_ID_CURR)"
    return out


def credit_features_sql() -> str:
    raw = {name: f"SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {source}"
           for name, (source, cols) in BUNDLE.items()}
    coerced = ", ".join(f"{_number(c)} AS {c}" for c in C.APP_COERCE_COLUMNS)
    day = {c: f"(CASE WHEN {c} = 365243 THEN -99999 ELSE {c} END)" for c in C.PREV_DAYS_COLUMNS}
    bins = ", ".join(f"{Q.sql_bin_label(e)} AS {c}_BINNED, {Q.sql_bin_idx(e)} AS {c}_IDX" for c, e in day.items())
    b_drop = [c for c in BUNDLE["bureau"][1] if c in C.BUREAU_DROP_COLUMNS]
    b_num = [c for c in BUNDLE["bureau"][1] if c not in {*C.KEYS, *b_drop, *_TEXT}]
    b_keep = ["SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"]
    how = {"nunique": "count(DISTINCT {c})", "count_active": "count(*) FILTER (WHERE {c} = 'Active')",
           "mean": "avg({c})", "sum": "coalesce(sum({c}), 0)", "max": "max({c})", "min": "min({c})"}
    prev = ["count(DISTINCT SK_ID_PREV) AS PREV_APP_COUNT", *_means("PREV", C.PREV_MEAN_COLUMNS)]
    inst = ["count(DISTINCT NUM_INSTALMENT_NUMBER) AS INST_COUNT", *_means("INST", C.INST_MEAN_COLUMNS)]
    card = ["count(DISTINCT SK_ID_PREV) AS CREDIT_PREV_LOANS_COUNT",
            *_means("CREDIT", C.CARD_MEAN_COLUMNS + C.DPD_MEAN_COLUMNS)]
    pos = ["count(DISTINCT SK_ID_PREV) AS POS_PREV_LOANS_COUNT",
           *_means("POS", C.POS_MEAN_COLUMNS + C.DPD_MEAN_COLUMNS)]
    bureau = [f"{how[h].format(c=c)} AS BUREAU_{c}" for c, h in C.BUREAU_AGGREGATIONS]
    modes = {
        "prev": [(f"PREV_{c}_BINNED_MODE", f"{c}_BINNED", f"{c}_IDX") for c in C.PREV_DAYS_COLUMNS],
        "t_credit_card_balance": [("CREDIT_NAME_CONTRACT_STATUS_MODE", "NAME_CONTRACT_STATUS", None)],
        "t_pos_cash_balance": [("POS_NAME_CONTRACT_STATUS_MODE", "NAME_CONTRACT_STATUS", None)],
    }
    app_num = [c for c in BUNDLE["application_train"][1] if c not in {"SK_ID_CURR", *_TEXT}]
    mart_num = [e.rsplit(" AS ", 1)[1] for e in (*prev, *inst, *card, *pos, *bureau)]
    all_modes = [name for group in modes.values() for name, _, _ in group]
    cleared = ", ".join(f"nullif({c}, 365243) AS {c}" for c in app_num + mart_num)
    some = [f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in C.EXT_SOURCE_COLUMNS]
    a, b, c = C.EXT_SOURCE_COLUMNS
    derived = {
        **{n: f"{x} / ({y} + CAST(0.00001 AS DOUBLE))" for n, x, y in C.GUARDED_RATIOS},
        **{n: f"{x} / CAST(-365 AS DOUBLE)" for n, x in C.YEAR_FEATURES},
        **{n: f"{x} / nullif({y}, 0)" for n, x, y in C.PLAIN_RATIOS},
        "EXT_SOURCE_MEAN": f"(coalesce({a}, 0) + coalesce({b}, 0) + coalesce({c}, 0)) / nullif({' + '.join(some)}, 0)",
        "EXT_SOURCE_MEDIAN": f"list_median([{a}, {b}, {c}])",
        **{n: " + ".join(f"coalesce({x}, 0)" for x in cols) for n, cols in
           (("FLAG_DOCUMENT_SUM", C.FLAG_DOCUMENT_COLUMNS), ("FLAG_PHONE_SUM", C.FLAG_PHONE_COLUMNS))},
    }
    final = [x for x in (*app_num, *mart_num, *derived) if x not in C.SKEW_EXCLUDE]
    kept = [x for x in app_num if x in C.SKEW_EXCLUDE]
    keep = ["SK_ID_CURR", "CODE_GENDER", "NAME_EDUCATION_TYPE", "TARGET", *all_modes,
            *[f"round({Q.SQL_SHIFT}{x}, {Q.R}) AS {x}" for x in kept if x != "TARGET"]]
    ctes = {f"t_{n}": q for n, q in raw.items()}
    ctes |= {
        "app": f"SELECT * EXCLUDE ({', '.join(C.APP_COERCE_COLUMNS)}), {coerced} FROM t_application_train "
               "WHERE CODE_GENDER IS DISTINCT FROM 'XNA'",
        "prev": f"SELECT SK_ID_CURR, SK_ID_PREV, {', '.join(C.PREV_MEAN_COLUMNS)}, {bins} "
                "FROM t_previous_application WHERE AMT_ANNUITY >= 0",
        "inst": "SELECT * FROM t_installments_payments WHERE AMT_PAYMENT >= 0",
        "b": "SELECT * " + (f"EXCLUDE ({', '.join(b_drop)}) " if b_drop else "")
             + f"REPLACE ({_number('CNT_CREDIT_PROLONG')} AS CNT_CREDIT_PROLONG) FROM t_bureau",
        "bt": Q.sql_skew_select(b_num, "b", b_keep, digits=None),
        "bal": "SELECT SK_ID_BUREAU, avg(MONTHS_BALANCE) AS BUREAU_BAL_MONTHS_BALANCE_MEAN, "
               "avg(e) AS BUREAU_BAL_STATUS_MEAN, max(e) AS BUREAU_BAL_STATUS_MAX, min(e) AS BUREAU_BAL_STATUS_MIN "
               f"FROM (SELECT *, {Q.SQL_STATUS_ENC.format(s='STATUS')} AS e FROM t_bureau_balance) "
               "WHERE SK_ID_BUREAU IS NOT NULL GROUP BY SK_ID_BUREAU",
        "bb": "SELECT * FROM bt LEFT JOIN bal USING (SK_ID_BUREAU)",
        "r1": _grouped("prev", prev, modes["prev"]),
        "r2": _grouped("inst", inst),
        "r3": _grouped("t_credit_card_balance", card, modes["t_credit_card_balance"]),
        "r4": _grouped("t_pos_cash_balance", pos, modes["t_pos_cash_balance"]),
        "r5": _grouped("bb", bureau),
        "m": "SELECT * FROM app " + " ".join(f"LEFT JOIN r{i} USING (SK_ID_CURR)" for i in range(1, 6)),
        "n": f"SELECT SK_ID_CURR, CODE_GENDER, NAME_EDUCATION_TYPE, {', '.join(all_modes)}, {cleared} FROM m",
        "f": "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in derived.items()) + " FROM n",
    }
    return ("WITH " + ", ".join(f"{n} AS ({q})" for n, q in ctes.items()) + " "
            + Q.sql_skew_select(final, "f", keep))


QUERIES = {"credit_features": q_credit_features}
ORACLE_SQL = {"credit_features": credit_features_sql()}
