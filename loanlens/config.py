"""Fixed values and default column roles for the credit-risk tables.

Every operator in the package takes column names as parameters; the names
below are only the defaults for the seven credit tables. Queries on other
tables pass their own names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES. These must equal the behaviour being reproduced; do not edit.
# ---------------------------------------------------------------------------

# Day value that stands for "no date" in every DAYS_* column.
DAYS_SENTINEL = 365243

# Value the sentinel is mapped to before the day columns are binned.
BIN_SENTINEL_REPLACEMENT = -99999

# Day-bin edges (left-closed, right-open) and their labels, in bin order.
DAY_BIN_EDGES = [float("-inf"), -1500, -1000, -500, 0, 99999]
DAY_BIN_LABELS = ["Very Old", "Old", "Recent", "Very Recent", "Missing"]

# Credit-bureau monthly STATUS code -> ordinal.
STATUS_MAPPING = {"C": 0, "0": 1, "1": 2, "2": 3, "3": 4, "4": 5, "5": 6, "X": 7}

# Gender code whose rows are removed from the application table.
GENDER_COLUMN = "CODE_GENDER"
GENDER_DROP_VALUE = "XNA"

# Denominator guard of the four guarded ratios.
RATIO_EPSILON = 0.00001

# Days per year used by the day -> year conversion (the divisor is negative).
DAYS_PER_YEAR = -365.0

# Skew transform defaults.
SKEW_THRESHOLD = 1.0
SKEW_SHIFT = 1.0

# Columns kept out of the final log transform.
SKEW_EXCLUDE = [
    "TARGET",
    "SK_ID_CURR",
    "SK_ID_PREV",
    "SK_ID_BUREAU",
    "FLAG_DOCUMENT_12",
    "FLAG_DOCUMENT_10",
    "FLAG_DOCUMENT_2",
    "FLAG_DOCUMENT_4",
    "FLAG_DOCUMENT_7",
    "FLAG_DOCUMENT_17",
    "FLAG_DOCUMENT_21",
    "FLAG_DOCUMENT_20",
    "FLAG_DOCUMENT_19",
    "FLAG_DOCUMENT_15",
    "FLAG_DOCUMENT_14",
    "FLAG_DOCUMENT_13",
    "FLAG_DOCUMENT_9",
    "FLAG_DOCUMENT_11",
    "FLAG_DOCUMENT_18",
    "FLAG_DOCUMENT_16",
    "FLAG_DOCUMENT_8",
    "FLAG_DOCUMENT_6",
    "FLAG_DOCUMENT_5",
    "FLAG_MOBIL",
    "FLAG_EMP_PHONE",
    "FLAG_CONT_MOBILE",
    "FLAG_EMAIL",
    "FLAG_WORK_PHONE",
    "FLAG_PHONE",
    "REG_REGION_NOT_LIVE_REGION",
    "REG_REGION_NOT_WORK_REGION",
    "LIVE_REGION_NOT_WORK_REGION",
    "REG_CITY_NOT_LIVE_CITY",
    "REG_CITY_NOT_WORK_CITY",
    "LIVE_CITY_NOT_WORK_CITY",
    "NAME_CONTRACT_STATUS",
    "NAME_TYPE_SUITE",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS",
    "NAME_HOUSING_TYPE",
    "OCCUPATION_TYPE",
    "ORGANIZATION_TYPE",
    "WALLSMATERIAL_MODE",
    "FONDKAPREMONT_MODE",
    "HOUSETYPE_MODE",
    "WEEKDAY_APPR_PROCESS_START",
    "CODE_GENDER",
    "DEF_60_CNT_SOCIAL_CIRCLE",
    "DEF_30_CNT_SOCIAL_CIRCLE",
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "OBS_60_CNT_SOCIAL_CIRCLE",
    "CNT_CHILDREN",
    "CNT_FAM_MEMBERS",
]

# Application columns coerced to numbers (unparsable -> null).
APP_COERCE_COLUMNS = [
    "AMT_REQ_CREDIT_BUREAU_HOUR",
    "AMT_REQ_CREDIT_BUREAU_DAY",
    "REGION_RATING_CLIENT",
    "AMT_REQ_CREDIT_BUREAU_WEEK",
    "DEF_30_CNT_SOCIAL_CIRCLE",
    "DEF_60_CNT_SOCIAL_CIRCLE",
    "REGION_RATING_CLIENT_W_CITY",
]

# Previous-application columns dropped if present.
PREV_DROP_COLUMNS = ["RATE_INTEREST_PRIMARY", "RATE_INTEREST_PRIVILEGED", "AMT_DOWN_PAYMENT"]

# Previous-application day columns that are binned (and then dropped).
PREV_DAYS_COLUMNS = [
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
]

# Bureau columns dropped if present, and coerced to numbers.
BUREAU_DROP_COLUMNS = ["AMT_ANNUITY", "AMT_CREDIT_MAX_OVERDUE"]
BUREAU_COERCE_COLUMNS = ["CNT_CREDIT_PROLONG"]

# Bureau credit state counted per applicant.
BUREAU_ACTIVE_VALUE = "Active"

# Roll-up inputs per child table, in output order.
PREV_MEAN_COLUMNS = ["AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_GOODS_PRICE"]
INST_MEAN_COLUMNS = ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"]
CARD_MEAN_COLUMNS = [
    "MONTHS_BALANCE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT",
    "AMT_DRAWINGS_CURRENT", "AMT_DRAWINGS_OTHER_CURRENT", "AMT_DRAWINGS_POS_CURRENT",
    "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_TOTAL_CURRENT", "AMT_RECEIVABLE_PRINCIPAL",
    "AMT_RECIVABLE", "AMT_TOTAL_RECEIVABLE", "CNT_DRAWINGS_ATM_CURRENT",
    "CNT_DRAWINGS_CURRENT", "CNT_DRAWINGS_OTHER_CURRENT", "CNT_DRAWINGS_POS_CURRENT",
    "CNT_INSTALMENT_MATURE_CUM",
]
POS_MEAN_COLUMNS = ["MONTHS_BALANCE", "CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE"]
DPD_MEAN_COLUMNS = ["SK_DPD", "SK_DPD_DEF"]
# Second-level bureau roll-up: (column, aggregate), output name BUREAU_<column>.
BUREAU_AGGREGATIONS = [
    ("SK_ID_BUREAU", "nunique"),
    ("CREDIT_ACTIVE", "count_active"),
    ("CREDIT_CURRENCY", "nunique"),
    ("DAYS_CREDIT", "mean"),
    ("CREDIT_DAY_OVERDUE", "mean"),
    ("DAYS_ENDDATE_FACT", "mean"),
    ("CNT_CREDIT_PROLONG", "sum"),
    ("AMT_CREDIT_SUM", "mean"),
    ("AMT_CREDIT_SUM_DEBT", "mean"),
    ("AMT_CREDIT_SUM_LIMIT", "mean"),
    ("AMT_CREDIT_SUM_OVERDUE", "mean"),
    ("CREDIT_TYPE", "nunique"),
    ("DAYS_CREDIT_UPDATE", "mean"),
    ("BUREAU_BAL_MONTHS_BALANCE_MEAN", "mean"),
    ("BUREAU_BAL_STATUS_MEAN", "mean"),
    ("BUREAU_BAL_STATUS_MAX", "max"),
    ("BUREAU_BAL_STATUS_MIN", "min"),
]

# Row-wise features: guarded ratios (name, numerator, denominator).
GUARDED_RATIOS = [
    ("CREDIT_INCOME_RATIO", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
    ("CREDIT_GOODS_RATIO", "AMT_CREDIT", "AMT_GOODS_PRICE"),
    ("ANNUITY_INCOME_RATIO", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    ("CREDIT_ANNUITY_RATIO", "AMT_CREDIT", "AMT_ANNUITY"),
]
# Day -> year conversions (name, source).
YEAR_FEATURES = [
    ("AGE_YEARS", "DAYS_BIRTH"),
    ("EMPLOYMENT_YEARS", "DAYS_EMPLOYED"),
    ("REGISTRATION_YEARS", "DAYS_REGISTRATION"),
    ("ID_PUBLISH_YEARS", "DAYS_ID_PUBLISH"),
]
# Plain ratios (name, numerator, denominator).
PLAIN_RATIOS = [
    ("CHILDREN_RATIO", "CNT_CHILDREN", "CNT_FAM_MEMBERS"),
    ("INCOME_PER_FAM_MEMBER", "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
]
EXT_SOURCE_COLUMNS = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
FLAG_DOCUMENT_COLUMNS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]
FLAG_PHONE_COLUMNS = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE"]

# Encoder pipeline defaults.
NUMERIC_FILL = 0.0
TEXT_FILL = "missing"

# pandas' default NA tokens for CSV input.
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# Keys and table names.
# ---------------------------------------------------------------------------

APP_KEY = "SK_ID_CURR"
PREV_KEY = "SK_ID_PREV"
BUREAU_KEY = "SK_ID_BUREAU"
LABEL = "TARGET"
KEYS = [APP_KEY, PREV_KEY, BUREAU_KEY]

TABLES = [
    "application_train",
    "bureau",
    "bureau_balance",
    "previous_application",
    "pos_cash_balance",
    "credit_card_balance",
    "installments_payments",
]

# ---------------------------------------------------------------------------
# Explicit schemas for the columns the operators read. Extra columns in a
# file are read as strings (text) unless listed here.
# ---------------------------------------------------------------------------

_D = T.DoubleType()
_L = T.LongType()
_S = T.StringType()


def _fields(*groups):
    out = []
    for typ, names in groups:
        out += [T.StructField(n, typ, True) for n in names]
    return T.StructType(out)


SCHEMAS: dict[str, T.StructType] = {
    "application_train": _fields(
        (_L, ["SK_ID_CURR"]),
        (T.IntegerType(), ["TARGET"]),
        (_S, ["CODE_GENDER"]),
        (_S, APP_COERCE_COLUMNS),
        (_D, ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_GOODS_PRICE", "AMT_ANNUITY",
              "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH",
              "CNT_CHILDREN", "CNT_FAM_MEMBERS"]),
        (_D, EXT_SOURCE_COLUMNS),
        (_D, FLAG_DOCUMENT_COLUMNS),
        (_D, FLAG_PHONE_COLUMNS),
        # only named in SKEW_EXCLUDE; declared so that no batch types them by its rows
        (_D, ["FLAG_EMAIL", "FLAG_PHONE", "REG_REGION_NOT_LIVE_REGION", "REG_REGION_NOT_WORK_REGION",
              "LIVE_REGION_NOT_WORK_REGION", "REG_CITY_NOT_LIVE_CITY", "REG_CITY_NOT_WORK_CITY",
              "LIVE_CITY_NOT_WORK_CITY", "OBS_30_CNT_SOCIAL_CIRCLE", "OBS_60_CNT_SOCIAL_CIRCLE"]),
        (_S, ["NAME_TYPE_SUITE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS",
              "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "WALLSMATERIAL_MODE",
              "FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WEEKDAY_APPR_PROCESS_START"]),
    ),
    "previous_application": _fields(
        (_L, ["SK_ID_PREV", "SK_ID_CURR"]),
        (_D, ["AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_GOODS_PRICE"]),
        (_D, PREV_DAYS_COLUMNS),
        (_D, PREV_DROP_COLUMNS),
    ),
    "installments_payments": _fields(
        (_L, ["SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_NUMBER"]),
        (_D, ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"]),
    ),
    "credit_card_balance": _fields(
        (_L, ["SK_ID_PREV", "SK_ID_CURR"]),
        (_D, ["MONTHS_BALANCE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL",
              "AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT",
              "AMT_DRAWINGS_OTHER_CURRENT", "AMT_DRAWINGS_POS_CURRENT",
              "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_TOTAL_CURRENT",
              "AMT_RECEIVABLE_PRINCIPAL", "AMT_RECIVABLE", "AMT_TOTAL_RECEIVABLE",
              "CNT_DRAWINGS_ATM_CURRENT", "CNT_DRAWINGS_CURRENT",
              "CNT_DRAWINGS_OTHER_CURRENT", "CNT_DRAWINGS_POS_CURRENT",
              "CNT_INSTALMENT_MATURE_CUM", "SK_DPD", "SK_DPD_DEF"]),
        (_S, ["NAME_CONTRACT_STATUS"]),
    ),
    "pos_cash_balance": _fields(
        (_L, ["SK_ID_PREV", "SK_ID_CURR"]),
        (_D, ["MONTHS_BALANCE", "CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE",
              "SK_DPD", "SK_DPD_DEF"]),
        (_S, ["NAME_CONTRACT_STATUS"]),
    ),
    "bureau": _fields(
        (_L, ["SK_ID_CURR", "SK_ID_BUREAU"]),
        (_S, ["CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"]),
        (_D, ["DAYS_CREDIT", "CREDIT_DAY_OVERDUE", "DAYS_ENDDATE_FACT",
              "DAYS_CREDIT_UPDATE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT",
              "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_SUM_OVERDUE"]),
        (_S, BUREAU_COERCE_COLUMNS),
        (_D, BUREAU_DROP_COLUMNS),
    ),
    "bureau_balance": _fields(
        (_L, ["SK_ID_BUREAU"]),
        (_D, ["MONTHS_BALANCE"]),
        (_S, ["STATUS"]),
    ),
}
