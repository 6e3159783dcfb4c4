"""Roll-ups of the child tables and the left-join feature mart.

Plan shape (checked with ``explain``): each roll-up is one partial/final hash
aggregate around one exchange on its key; the five roll-ups come out
hash-partitioned on the applicant key, so the left-join chain only has to
shuffle the application side once and joins the rest in place. AQE turns a
join into a broadcast only when the runtime size of a roll-up is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise it stays a sort-merge join
(and the skew-join split handles a hot key). Nothing is collected.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as X
from ..functions.aggs import Agg, build_all
from . import clean as CL
from . import skew as SK

# ---------------------------------------------------------------------------
# Default specs for the credit tables (output names are part of the contract).
# ---------------------------------------------------------------------------

BALANCE_SPEC = [
    Agg("BUREAU_BAL_MONTHS_BALANCE_MEAN", "mean", "MONTHS_BALANCE"),
    Agg("BUREAU_BAL_STATUS_MEAN", "mean", "STATUS_ENCODED"),
    Agg("BUREAU_BAL_STATUS_MAX", "max", "STATUS_ENCODED"),
    Agg("BUREAU_BAL_STATUS_MIN", "min", "STATUS_ENCODED"),
]

PREV_SPEC = (
    [Agg("PREV_APP_COUNT", "nunique", C.PREV_KEY)]
    + [Agg(f"PREV_{c}_MEAN", "mean", c) for c in C.PREV_MEAN_COLUMNS]
    + [Agg(f"PREV_{d}_BINNED_MODE", "mode_ordinal", f"{d}_BINNED", tuple(C.DAY_BIN_LABELS))
       for d in C.PREV_DAYS_COLUMNS]
)

INST_SPEC = (
    [Agg("INST_COUNT", "nunique", "NUM_INSTALMENT_NUMBER")]
    + [Agg(f"INST_{c}_MEAN", "mean", c) for c in C.INST_MEAN_COLUMNS]
)


def _balance_spec(prefix: str, means) -> list[Agg]:
    """Card / cash roll-up: distinct earlier loans, means, status mode, DPD means."""
    return ([Agg(f"{prefix}_PREV_LOANS_COUNT", "nunique", C.PREV_KEY)]
            + [Agg(f"{prefix}_{c}_MEAN", "mean", c) for c in means]
            + [Agg(f"{prefix}_NAME_CONTRACT_STATUS_MODE", "mode", "NAME_CONTRACT_STATUS")]
            + [Agg(f"{prefix}_{c}_MEAN", "mean", c) for c in C.DPD_MEAN_COLUMNS])


CARD_SPEC = _balance_spec("CREDIT", C.CARD_MEAN_COLUMNS)
POS_SPEC = _balance_spec("POS", C.POS_MEAN_COLUMNS)

def _bureau_agg(col: str, how: str) -> Agg:
    out = f"BUREAU_{col}"
    if how == "count_active":
        return Agg(out, "count_eq", col, C.BUREAU_ACTIVE_VALUE)
    if how == "nunique":
        return Agg(out, "nunique", col)
    if how == "sum":
        return Agg(out, "sum0", col)
    return Agg(out, how, col)


BUREAU_SPEC = [_bureau_agg(c, h) for c, h in C.BUREAU_AGGREGATIONS]


# ---------------------------------------------------------------------------
# Generic building blocks.
# ---------------------------------------------------------------------------

def _partials(s: Agg, c) -> dict:
    """First-level columns of an aggregate that is finished by :func:`_final`."""
    if s.fn == "mean":
        return {"s": F.sum(c.cast("double")), "c": F.count(c)}
    if s.fn == "mode_ordinal":
        idx = X.label_to_index(c, list(s.arg))
        return {str(i): F.count_if(idx == F.lit(i)) for i in range(len(s.arg))}
    how = {"max": F.max(c), "min": F.min(c), "sum0": F.sum(c), "count": F.count(c)}
    return {"v": F.count_if(X.equals_flag(c, s.arg)) if s.fn == "count_eq" else how[s.fn]}


def _final(s: Agg, name: str):
    if s.fn == "mean":
        return F.try_divide(F.sum(f"{name}s"), F.sum(f"{name}c").cast("double"))
    if s.fn == "mode_ordinal":
        k = len(s.arg)
        code = F.greatest(*[F.sum(f"{name}{i}") * F.lit(k) + F.lit(k - 1 - i) for i in range(k)])
        pos = F.when(code >= F.lit(k), F.lit(k - 1) - (code % F.lit(k)))
        return X.index_to_label(pos.cast("int"), list(s.arg))
    if s.fn in ("max", "min"):
        return getattr(F, s.fn)(f"{name}v")
    return F.coalesce(F.sum(f"{name}v"), F.lit(0))


def stacked_rollup(df: DataFrame, key: str, specs) -> DataFrame:
    """Roll-up with several distinct counts or a text mode, reading ``df`` once.

    Each row becomes one base row with the other aggregates' inputs and one
    (slot, typed value) row per distinct or mode column. These are grouped by
    (key, slot, value) -- pre-aggregated map-side, and a hot key is spread over
    its values -- and the small result by key: a distinct count is the number
    of a slot's rows, a mode the value with most rows (ties: the smallest).
    No object buffers, and no second pass over the input.
    """
    specs = list(specs)
    valued = list(dict.fromkeys(s.col for s in specs if s.fn in ("nunique", "mode")))
    others = [s for s in specs if s.fn not in ("nunique", "mode")]
    inputs = list(dict.fromkeys(s.col for s in others))
    types = {f.name: f.dataType for f in df.schema.fields}
    # one value field per data type, so every value keeps its own type
    kinds = list(dict.fromkeys(types[c] for c in valued))
    fields = [f"v{j}" for j in range(len(kinds))]

    def entry(slot, col):
        vals = [F.col(col).alias(f) if col and types[col] == t else F.lit(None).cast(t).alias(f)
                for f, t in zip(fields, kinds)]
        own = [(F.lit(None).cast(types[c]) if col else F.col(c)).alias(f"o{i}") for i, c in enumerate(inputs)]
        return F.struct(F.lit(slot).alias("slot"), *vals, *own)

    rows = F.array(entry(-1, None), *[entry(i, c) for i, c in enumerate(valued)])
    present = reduce(or_, [F.col(f).isNotNull() for f in fields], F.col("slot") == -1)
    stacked = df.select(F.col(key), F.inline(rows)).filter(present)
    parts = [e.alias(f"p{i}_{n}") for i, s in enumerate(others)
             for n, e in _partials(s, F.col(f"o{inputs.index(s.col)}")).items()]
    first = stacked.groupBy(key, "slot", *fields).agg(F.count(F.lit(1)).alias("rows"), *parts)
    out = []
    for s in specs:
        if s.fn in ("nunique", "mode"):
            here = F.col("slot") == valued.index(s.col)
            value = F.col(fields[kinds.index(types[s.col])])
            e = F.count_if(here) if s.fn == "nunique" else F.min_by(
                value, F.when(here, F.struct((-F.col("rows")).alias("n"), value.alias("v"))))
        else:
            e = _final(s, f"p{others.index(s)}_")
        out.append(e.alias(s.out))
    return first.groupBy(key).agg(*out)


def rollup(df: DataFrame, key: str, specs) -> DataFrame:
    """One row per non-NULL key with the features in ``specs`` (E1 + E2..E9).

    Without distinct counts and text modes: one ``agg``. One distinct column
    and no text mode: ``count_distinct`` inside the same ``agg`` (Spark groups
    by (key, value) first, so a hot key spreads over its values). Else
    :func:`stacked_rollup`. All three read the input once.
    """
    df = df.filter(F.col(key).isNotNull())
    specs = list(specs)
    distinct = {s.col for s in specs if s.fn == "nunique"}
    if len(distinct) > 1 or any(s.fn == "mode" for s in specs):
        return stacked_rollup(df, key, specs)
    return df.groupBy(key).agg(*build_all(specs))


def left_join_chain(base: DataFrame, key: str, rollups) -> DataFrame:
    """Left-join each roll-up (unique on ``key``) onto ``base`` in order.

    Row count equals ``base``'s; unmatched features stay NULL.
    """
    out = base
    for r in rollups:
        out = out.join(r, on=key, how="left")
    return out


# ---------------------------------------------------------------------------
# Credit marts (F6 - F13). Column names are parameters with credit defaults.
# ---------------------------------------------------------------------------

def aggregate_balance(balance: DataFrame, *, key=C.BUREAU_KEY, spec=BALANCE_SPEC) -> DataFrame:
    """monthly balance rows -> one row per external credit."""
    return rollup(balance, key, spec)


def merge_bureau_and_balance(bureau: DataFrame, balance: DataFrame, *,
                             bureau_key=C.BUREAU_KEY, keys=C.KEYS,
                             status_col="STATUS", balance_spec=BALANCE_SPEC,
                             clean_kwargs=None, skew_threshold=C.SKEW_THRESHOLD,
                             skew_model=None) -> DataFrame:
    """clean bureau -> skew-log its numeric columns (keys exempt) ->
    left-join the per-credit balance roll-up. With ``skew_model`` the fitted
    choice of columns and minima is used (scoring)."""
    b = CL.clean_bureau(bureau, **(clean_kwargs or {}))
    b = (skew_model.transform(b) if skew_model is not None
         else SK.log_transform_skewed(b, threshold=skew_threshold, exclude=keys))
    bal = CL.encode_status(balance, status_col=status_col)
    agg = aggregate_balance(bal, key=bureau_key, spec=balance_spec)
    return b.join(agg, on=bureau_key, how="left")


def previous_application_mart(prev: DataFrame, *, key=C.APP_KEY, spec=PREV_SPEC) -> DataFrame:
    """F8."""
    return rollup(prev, key, spec)


def instalment_mart(inst: DataFrame, *, key=C.APP_KEY, spec=INST_SPEC) -> DataFrame:
    """F9."""
    return rollup(inst, key, spec)


def credit_card_mart(card: DataFrame, *, key=C.APP_KEY, spec=CARD_SPEC) -> DataFrame:
    """F10."""
    return rollup(card, key, spec)


def pos_cash_mart(pos: DataFrame, *, key=C.APP_KEY, spec=POS_SPEC) -> DataFrame:
    """F11."""
    return rollup(pos, key, spec)


def bureau_mart(merged_bureau: DataFrame, *, key=C.APP_KEY, spec=BUREAU_SPEC) -> DataFrame:
    """second level of the bureau roll-up."""
    return rollup(merged_bureau, key, spec)
