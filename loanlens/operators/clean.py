"""Per-table cleaning (drops, filters, coercion, binning, status encoding).

All steps are narrow transformations: they pipeline into the scan's
whole-stage-codegen stage, and filters written here are pushed into the
Parquet reader by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import expr as X


def drop_if_present(df: DataFrame, cols) -> DataFrame:
    """Tolerant drop: absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_strict(df: DataFrame, cols) -> DataFrame:
    """Drop that fails when a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def filter_ne_keep_null(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(X.ne_keep_null(column, value))


def filter_ge_drop_null(df: DataFrame, column: str, bound) -> DataFrame:
    return df.filter(X.ge_drop_null(column, bound))


def coerce_columns(df: DataFrame, cols) -> DataFrame:
    """Coerce each listed column to double; unparsable values -> NULL."""
    types = dict(df.dtypes)
    return df.withColumns({c: X.coerce_numeric(c, types[c]) for c in cols})


def clean_application(df: DataFrame, *, gender_col=C.GENDER_COLUMN,
                      drop_value=C.GENDER_DROP_VALUE,
                      coerce=C.APP_COERCE_COLUMNS) -> DataFrame:
    """remove the unknown-gender rows (NULL kept), coerce the text counters."""
    return coerce_columns(filter_ne_keep_null(df, gender_col, drop_value), coerce)


def clean_previous_application(df: DataFrame, *, drop=C.PREV_DROP_COLUMNS,
                               amount_col="AMT_ANNUITY", days=C.PREV_DAYS_COLUMNS,
                               edges=C.DAY_BIN_EDGES, labels=C.DAY_BIN_LABELS) -> DataFrame:
    """drop rate columns, keep non-negative annuities, bin the day columns.

    Each day column ``D`` becomes a label column ``D_BINNED``; the sources are
    then dropped (strictly: they must exist).
    """
    df = drop_if_present(df, drop)
    df = filter_ge_drop_null(df, amount_col, 0)
    df = df.withColumns({f"{d}_BINNED": X.bin_days(d, edges, labels) for d in days})
    return drop_strict(df, days)


def clean_installments(df: DataFrame, *, entry_col="DAYS_ENTRY_PAYMENT",
                       due_col="DAYS_INSTALMENT", amount_col="AMT_PAYMENT",
                       delay_col="PAYMENT_DELAY") -> DataFrame:
    """payment delay = entry day - due day; missed payments (NULL) dropped."""
    df = df.withColumn(delay_col, X.col(entry_col) - X.col(due_col))
    return filter_ge_drop_null(df, amount_col, 0)


def clean_bureau(df: DataFrame, *, drop=C.BUREAU_DROP_COLUMNS,
                 coerce=C.BUREAU_COERCE_COLUMNS) -> DataFrame:
    """drop the annuity columns, coerce the prolongation count."""
    return coerce_columns(drop_if_present(df, drop), coerce)


def encode_status(df: DataFrame, *, status_col="STATUS", out_col="STATUS_ENCODED",
                  mapping=C.STATUS_MAPPING) -> DataFrame:
    """monthly status letter -> ordinal (unmapped -> NULL)."""
    return df.withColumn(out_col, X.map_values(status_col, mapping).cast(T.LongType()))


def sentinel_to_null_frame(df: DataFrame, *, sentinel=C.DAYS_SENTINEL,
                           keep=C.KEYS) -> DataFrame:
    """C1 over every numeric column except the keys."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(keep)]
    return df.withColumns({c: X.sentinel_to_null(c, sentinel) for c in cols})


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def fill_constants(df: DataFrame, numeric=None, text=None,
                   numeric_value=C.NUMERIC_FILL, text_value=C.TEXT_FILL) -> DataFrame:
    """NULL -> 0 in numeric columns, NULL -> "missing" in text ones."""
    numeric = numeric_columns(df) if numeric is None else list(numeric)
    text = text_columns(df) if text is None else list(text)
    types = dict(df.dtypes)
    if numeric:
        df = df.withColumns({c: F.coalesce(X.col(c), F.lit(numeric_value).cast(types[c]))
                             for c in numeric})
    if text:
        df = df.withColumns({c: F.coalesce(X.col(c), F.lit(text_value)) for c in text})
    return df
