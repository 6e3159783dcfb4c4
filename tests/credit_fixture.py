"""Seeded seven-table credit fixture with the edge cases of FIXTURES.md.

Small on purpose: it feeds unit/property tests and the end-to-end pipeline
test, never a registered query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from loanlens import config as C

STATUSES = ["C", "0", "1", "2", "3", "4", "5", "X", "Z", None]


def make_tables(n_app: int = 60, seed: int = 7) -> dict[str, pd.DataFrame]:
    rng = np.random.default_rng(seed)
    ids = list(range(100001, 100001 + n_app - 1)) + [C.DAYS_SENTINEL]  # one key equals the sentinel

    app = pd.DataFrame({"SK_ID_CURR": ids})
    app["TARGET"] = rng.integers(0, 2, n_app)
    app["CODE_GENDER"] = rng.choice(["M", "F"], n_app).astype(object)
    app.loc[3, "CODE_GENDER"] = "XNA"
    app.loc[4, "CODE_GENDER"] = None
    for c in C.APP_COERCE_COLUMNS:
        app[c] = [str(x) for x in rng.integers(0, 4, n_app)]
    app.loc[5, "AMT_REQ_CREDIT_BUREAU_HOUR"] = "1d"
    app.loc[6, "AMT_REQ_CREDIT_BUREAU_DAY"] = "nan"
    app.loc[7, "REGION_RATING_CLIENT"] = " 2 "
    app["AMT_INCOME_TOTAL"] = np.round(rng.lognormal(11.5, 0.6, n_app), 1)
    app["AMT_CREDIT"] = np.round(rng.lognormal(13, 0.5, n_app), 1)
    app["AMT_GOODS_PRICE"] = np.round(app["AMT_CREDIT"] * 0.9, 1)
    app["AMT_ANNUITY"] = np.round(app["AMT_CREDIT"] / 20, 1)
    app["DAYS_BIRTH"] = -rng.integers(7000, 25000, n_app).astype(float)
    app["DAYS_EMPLOYED"] = -rng.integers(0, 10000, n_app).astype(float)
    app.loc[8, "DAYS_EMPLOYED"] = float(C.DAYS_SENTINEL)
    app["DAYS_REGISTRATION"] = -rng.integers(0, 15000, n_app).astype(float)
    app["DAYS_ID_PUBLISH"] = -rng.integers(0, 6000, n_app).astype(float)
    app["CNT_CHILDREN"] = rng.integers(0, 3, n_app).astype(float)
    app["CNT_FAM_MEMBERS"] = app["CNT_CHILDREN"] + rng.integers(0, 2, n_app)
    app.loc[9, "CNT_FAM_MEMBERS"] = 0.0
    app.loc[10, "CNT_FAM_MEMBERS"] = np.nan
    for i, c in enumerate(C.EXT_SOURCE_COLUMNS):
        app[c] = rng.random(n_app)
    app.loc[11, C.EXT_SOURCE_COLUMNS] = np.nan
    app.loc[12, C.EXT_SOURCE_COLUMNS[:2]] = np.nan
    app.loc[13, C.EXT_SOURCE_COLUMNS[0]] = np.nan
    for c in C.FLAG_DOCUMENT_COLUMNS + C.FLAG_PHONE_COLUMNS:
        app[c] = rng.integers(0, 2, n_app).astype(float)
    app["NAME_CONTRACT_TYPE"] = rng.choice(["Cash loans", "Revolving loans"], n_app)

    # previous applications: applicants 0..n-6 have some; one orphan parent; a null key
    rows = []
    prev_id = 1
    for i, k in enumerate(ids[:-5]):
        for _ in range(int(rng.integers(1, 5))):
            r = {"SK_ID_PREV": prev_id, "SK_ID_CURR": k,
                 "AMT_ANNUITY": float(np.round(rng.normal(5000, 4000), 1)),
                 "AMT_APPLICATION": float(np.round(rng.lognormal(11, 1), 1)),
                 "AMT_CREDIT": float(np.round(rng.lognormal(11, 1), 1)),
                 "AMT_GOODS_PRICE": float(np.round(rng.lognormal(11, 1), 1)),
                 "RATE_INTEREST_PRIMARY": 0.1}
            for d in C.PREV_DAYS_COLUMNS:
                r[d] = float(rng.choice([-2000, -1500, -1200, -1000, -700, -500, -100, 0, 500,
                                         99999, C.DAYS_SENTINEL, np.nan]))
            rows.append(r)
            prev_id += 1
    rows.append({"SK_ID_PREV": prev_id, "SK_ID_CURR": 999999, "AMT_ANNUITY": 1.0})
    rows.append({"SK_ID_PREV": prev_id + 1, "SK_ID_CURR": None, "AMT_ANNUITY": 1.0})
    # mode tie in bin order vs text order: Missing (0) twice, Very Old (-99999 via sentinel) twice
    for j, v in enumerate([0.0, 0.0, float(C.DAYS_SENTINEL), float(C.DAYS_SENTINEL)]):
        r = {"SK_ID_PREV": prev_id + 2 + j, "SK_ID_CURR": ids[-6], "AMT_ANNUITY": 10.0}
        for d in C.PREV_DAYS_COLUMNS:
            r[d] = v
        rows.append(r)
    prev = pd.DataFrame(rows)

    inst_rows = []
    for k in ids[: n_app // 2]:
        for n in range(1, int(rng.integers(2, 8))):
            pay = float(np.round(rng.lognormal(8, 1), 2)) if rng.random() > 0.1 else np.nan
            inst_rows.append({"SK_ID_PREV": 1, "SK_ID_CURR": k, "NUM_INSTALMENT_NUMBER": n,
                              "DAYS_INSTALMENT": float(-n * 30),
                              "DAYS_ENTRY_PAYMENT": float(-n * 30 + rng.integers(-5, 10)),
                              "AMT_INSTALMENT": float(np.round(rng.lognormal(8, 1), 2)),
                              "AMT_PAYMENT": pay})
    inst = pd.DataFrame(inst_rows)

    def balance(prefix_cols, n_keys):
        out = []
        for k in ids[:n_keys]:
            for m in range(int(rng.integers(1, 6))):
                r = {"SK_ID_PREV": int(rng.integers(1, 4)), "SK_ID_CURR": k, "MONTHS_BALANCE": float(-m)}
                for c in prefix_cols:
                    r[c] = float(np.round(rng.lognormal(5, 2), 2))
                r["NAME_CONTRACT_STATUS"] = rng.choice(["Active", "Completed", "Signed", None])
                r["SK_DPD"] = float(rng.integers(0, 3))
                r["SK_DPD_DEF"] = float(rng.integers(0, 2))
                out.append(r)
        return pd.DataFrame(out)

    card = balance([c for c in C.CARD_MEAN_COLUMNS if c != "MONTHS_BALANCE"], n_app // 3)
    # tie for the text mode: two statuses, twice each -> the smaller text wins
    for s in ["Signed", "Active", "Signed", "Active"]:
        card.loc[len(card)] = {**card.iloc[0].to_dict(), "SK_ID_CURR": ids[-7], "NAME_CONTRACT_STATUS": s}
    pos = balance(["CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE"], n_app // 2)

    b_rows, bb_rows = [], []
    bid = 5000000
    for k in ids[5: n_app - 10]:
        for _ in range(int(rng.integers(1, 4))):
            b_rows.append({"SK_ID_CURR": k, "SK_ID_BUREAU": bid,
                           "CREDIT_ACTIVE": rng.choice(["Active", "Closed", None]),
                           "CREDIT_CURRENCY": rng.choice(["currency 1", "currency 2"]),
                           "CREDIT_TYPE": rng.choice(["Consumer credit", "Credit card", "Car loan"]),
                           "DAYS_CREDIT": float(-rng.integers(0, 3000)),
                           "CREDIT_DAY_OVERDUE": float(rng.choice([0, 0, 0, 30, 2000])),
                           "DAYS_ENDDATE_FACT": float(-rng.integers(0, 3000)),
                           "DAYS_CREDIT_UPDATE": float(-rng.integers(0, 100)),
                           "CNT_CREDIT_PROLONG": rng.choice(["0", "1", "x", None]),
                           "AMT_CREDIT_SUM": float(np.round(rng.lognormal(11, 1.5), 1)),
                           "AMT_CREDIT_SUM_DEBT": float(np.round(rng.lognormal(9, 2), 1)),
                           "AMT_CREDIT_SUM_LIMIT": 0.0,
                           "AMT_CREDIT_SUM_OVERDUE": float(rng.choice([0.0, 0.0, 100.0])),
                           "AMT_ANNUITY": 1.0})
            if rng.random() > 0.2:  # some credits without balance months
                for m in range(int(rng.integers(1, 6))):
                    bb_rows.append({"SK_ID_BUREAU": bid, "MONTHS_BALANCE": float(-m),
                                    "STATUS": STATUSES[int(rng.integers(0, len(STATUSES)))]})
            bid += 1
    bb_rows.append({"SK_ID_BUREAU": 1, "MONTHS_BALANCE": -1.0, "STATUS": "C"})  # no bureau row
    bureau = pd.DataFrame(b_rows)
    bb = pd.DataFrame(bb_rows)
    return {"application_train": app, "bureau": bureau, "bureau_balance": bb,
            "previous_application": prev, "pos_cash_balance": pos,
            "credit_card_balance": card, "installments_payments": inst}


def to_spark(spark, tables: dict[str, pd.DataFrame]):
    """pandas -> Spark with the declared schema (extra columns as inferred)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    out = {}
    for name, pdf in tables.items():
        pdf = pdf.astype(object).where(pd.notna(pdf), None)
        schema = C.SCHEMAS.get(name)
        declared = {f.name: f.dataType for f in schema.fields} if schema else {}
        fields = []
        for c in pdf.columns:
            t = declared.get(c)
            if t is None:
                kind = pd.Series([v for v in pdf[c] if v is not None]).map(type).unique()
                t = T.StringType() if any(k is str for k in kind) else T.DoubleType()
            fields.append(T.StructField(c, t, True))
        rows = []
        for rec in pdf.itertuples(index=False):
            row = []
            for v, f in zip(rec, fields):
                if v is None:
                    row.append(None)
                elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
                    row.append(int(v))
                elif isinstance(f.dataType, T.DoubleType):
                    row.append(float(v))
                else:
                    row.append(str(v))
            rows.append(row)
        out[name] = spark.createDataFrame(rows, T.StructType(fields))
    return out
