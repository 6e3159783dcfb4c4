"""Row-wise column expressions (all built-in Spark functions, codegen-friendly).

Each function returns a ``Column``; none touches the driver or a Python UDF.
Null is the only missing marker: NaN never leaves these functions, because in
Spark ``NaN >= 0`` is true and NaN sorts above every number.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def attach_scalar(df, name: str, one_row_df) -> "DataFrame":
    """Attach the single value of a one-row, one-column frame as column ``name``.

    It is a scalar subquery (``DataFrame.scalar()``): Spark evaluates it once,
    reuses shuffles it shares with ``df`` and broadcasts the value to the
    tasks -- no join. Projecting it once and reading fields from the column
    keeps the plan small however many expressions use it.
    """
    return df.withColumn(name, one_row_df.scalar())


def nan_to_null(c) -> Column:
    """Double NaN -> NULL (other values untouched)."""
    c = col(c)
    return F.when(~F.isnan(c), c)


# -- predicates -------------------------------------------------------------

def ne_keep_null(c, value) -> Column:
    """``c != value`` where NULL counts as different (NULL rows are kept)."""
    return ~col(c).eqNullSafe(F.lit(value))


def ge_drop_null(c, bound) -> Column:
    """``c >= bound`` where NULL and NaN rows are dropped."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (c >= F.lit(bound))


def equals_flag(c, value) -> Column:
    """``c == value`` as a boolean where NULL gives False."""
    return F.coalesce(col(c) == F.lit(value), F.lit(False))


# -- scalar transforms ------------------------------------------------------

def sentinel_to_null(c, sentinel=C.DAYS_SENTINEL) -> Column:
    """Every value equal to the sentinel becomes NULL."""
    return F.nullif(col(c), F.lit(sentinel))


def remap_value(c, value=C.DAYS_SENTINEL, to=C.BIN_SENTINEL_REPLACEMENT) -> Column:
    """One value replaced by another (the sentinel before binning)."""
    c = col(c)
    return F.when(c == F.lit(value), F.lit(to)).otherwise(c)


def guarded_ratio(a, b, eps=C.RATIO_EPSILON) -> Column:
    """``a / (b + eps)``; an exact zero denominator gives NULL (never an error)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double") + F.lit(eps))


def plain_ratio(a, b) -> Column:
    """``a / b``; division by zero gives NULL instead of inf/NaN."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def days_to_years(c, days_per_year=C.DAYS_PER_YEAR) -> Column:
    return col(c).cast("double") / F.lit(float(days_per_year))


def row_sum(cols) -> Column:
    """Sum across columns with NULL counted as 0 (all NULL -> 0)."""
    return reduce(add, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_count(cols) -> Column:
    return reduce(add, [F.when(col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols])


def row_mean(cols) -> Column:
    """Mean of the non-NULL values in a row; all NULL -> NULL."""
    return F.try_divide(row_sum(cols), row_count(cols).cast("double"))


def row_median(cols) -> Column:
    """Median of the non-NULL values in a row (even count -> mean of the middle two)."""
    arr = F.sort_array(F.array_compact(F.array(*[col(c).cast("double") for c in cols])))
    n = F.size(arr)
    lo = F.floor((n - F.lit(1)) / F.lit(2)).cast("int")
    hi = F.floor(n / F.lit(2)).cast("int")
    return F.when(n > 0, (F.get(arr, lo) + F.get(arr, hi)) / F.lit(2.0))


_NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_numeric(c, dtype=None) -> Column:
    """Parse to double; anything that is not a plain decimal number -> NULL.

    ``try_cast`` alone would accept ``"1d"`` and ``"nan"``; the pattern keeps
    only ordinary decimal / scientific notation. Numeric input is cast as is.
    """
    c = col(c)
    if dtype is not None and dtype != "string":
        return nan_to_null(c.cast("double"))
    s = c.cast("string")
    return F.when(s.rlike(_NUMERIC_TEXT), F.trim(s).try_cast("double"))


def bin_index(c, edges=C.DAY_BIN_EDGES) -> Column:
    """0-based bin number for left-closed, right-open edges; outside -> NULL."""
    c = col(c)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = c < F.lit(hi)
        if lo != float("-inf"):
            cond = (c >= F.lit(lo)) & cond
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def bin_label(c, edges=C.DAY_BIN_EDGES, labels=C.DAY_BIN_LABELS) -> Column:
    """Label of the bin holding ``c`` (see :func:`bin_index`)."""
    return index_to_label(bin_index(c, edges), labels)


def index_to_label(idx, labels) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), col(idx))


def label_to_index(c, labels) -> Column:
    c = col(c)
    expr = None
    for i, lab in enumerate(labels):
        cond = c == F.lit(lab)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def bin_days(c, edges=C.DAY_BIN_EDGES, labels=C.DAY_BIN_LABELS,
             sentinel=C.DAYS_SENTINEL, replacement=C.BIN_SENTINEL_REPLACEMENT) -> Column:
    """Sentinel -> replacement, then fixed-edge binning to a label."""
    return bin_label(remap_value(col(c).cast("double"), sentinel, float(replacement)), edges, labels)


def map_values(c, mapping=C.STATUS_MAPPING) -> Column:
    """Dictionary lookup; keys not in the mapping (and NULL) -> NULL."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, col(c).cast("string"))


def log_transform(c, minimum, shift=C.SKEW_SHIFT) -> Column:
    """log1p(c - min + shift) when min <= 0, else log1p(c)."""
    c = col(c).cast("double")
    minimum = col(minimum) if isinstance(minimum, (str, Column)) else F.lit(float(minimum))
    return F.when(minimum <= F.lit(0.0), F.log1p(c - minimum + F.lit(float(shift)))) \
            .otherwise(F.log1p(c))


def overwrite_non_null(new, old) -> Column:
    """Take ``new`` where it is not NULL, else keep ``old``."""
    return F.coalesce(col(new), col(old))
