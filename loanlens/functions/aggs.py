"""Aggregate column builders.

A roll-up is declared as a list of :class:`Agg` specs and built into one
``groupBy().agg()`` so every feature of a table comes out of a single
shuffle with map-side partial aggregation (a hot key is pre-combined in each
task before the exchange, so one applicant with a third of the rows does not
become one giant task).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr as X


@dataclass(frozen=True)
class Agg:
    """One output column of a roll-up.

    fn: mean | max | min | sum0 | count | nunique |
        count_eq | mode | mode_ordinal
    arg: the compared value for ``count_eq``; the ordered labels for
         ``mode_ordinal``.
    """

    out: str
    fn: str
    col: str
    arg: object = None


def mean(c) -> Column:
    """Mean skipping NULLs; all NULL -> NULL."""
    return F.avg(X.col(c))


def sum_or_zero(c) -> Column:
    """Sum skipping NULLs; an all-NULL (or empty) group gives 0."""
    return F.coalesce(F.sum(X.col(c)), F.lit(0))


def nunique(c) -> Column:
    """Exact distinct count, NULLs excluded."""
    return F.count_distinct(X.col(c))


def count_eq(c, value) -> Column:
    """Number of rows where ``c == value`` (NULL never matches)."""
    return F.count_if(X.equals_flag(c, value))


def mode_text(c) -> Column:
    """Most frequent non-NULL value; ties -> smallest value; none -> NULL."""
    return F.mode(X.col(c), True)


def mode_ordinal(c, labels) -> Column:
    """Mode of an ordered label column; ties -> lowest position in ``labels``;
    no known label -> NULL.

    The label set is fixed and small, so each label gets a plain counter
    (``count_if``) and the winner is decoded from ``count * k + (k - 1 - i)``:
    a larger count wins, then a lower position. Fixed-width buffers keep the
    roll-up a Tungsten hash aggregate (no per-group object map, no
    sort-based fallback), and a hot key costs k counters per map task.
    """
    labels = list(labels)
    k = len(labels)
    idx = X.label_to_index(c, labels)
    code = F.greatest(*[F.count_if(idx == F.lit(i)) * F.lit(k) + F.lit(k - 1 - i)
                        for i in range(k)])
    pos = F.when(code >= F.lit(k), F.lit(k - 1) - (code % F.lit(k)))
    return X.index_to_label(pos.cast("int"), labels)


def skewness_unbiased(c) -> Column:
    """Adjusted Fisher-Pearson skewness (G1), NULLs skipped, NULL if n < 3.

    Spark's ``skewness`` is the plain moment ratio g1; G1 = g1 * sqrt(n(n-1)) / (n-2).
    A constant column has no skewness (NULL).
    """
    c = X.col(c).cast("double")
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= F.lit(3.0), g1 * F.sqrt(n * (n - F.lit(1.0))) / (n - F.lit(2.0)))


def stacked_stats(df, cols, **stats) -> "DataFrame":
    """Per-column statistics in one pass, one row per column at every width.

    ``stats`` maps an output name to a function of a double column; the result
    has ``idx`` (position in ``cols``) and one field per statistic. Rows are
    stacked into ``(idx, x)`` pairs inside the scan's pipeline and aggregated
    by ``idx``: the aggregate has a handful of functions whatever the column
    count, so its generated code stays small (one global ``agg`` with hundreds
    of moment aggregates outgrows the JVM method limit), and the partial
    aggregate holds one small buffer per column. The result (at most one row
    per column) is joined onto the column indices, so an empty input has a row
    of NULL statistics for every column too.
    """
    cols = list(cols)
    pairs = F.array(*[F.struct(F.lit(i).alias("idx"), X.col(c).cast("double").alias("x"))
                      for i, c in enumerate(cols)])
    per_col = (df.select(F.inline(pairs))
                 .groupBy("idx").agg(*[fn(F.col("x")).alias(name) for name, fn in stats.items()]))
    every = df.sparkSession.createDataFrame([(i,) for i in range(len(cols))], "idx int")
    return every.join(per_col, "idx", "left")


def build(spec: Agg) -> Column:
    fn, c = spec.fn, spec.col
    if fn == "mean":
        e = mean(c)
    elif fn == "max":
        e = F.max(X.col(c))
    elif fn == "min":
        e = F.min(X.col(c))
    elif fn == "sum0":
        e = sum_or_zero(c)
    elif fn == "count":
        e = F.count(X.col(c))
    elif fn == "nunique":
        e = nunique(c)
    elif fn == "count_eq":
        e = count_eq(c, spec.arg)
    elif fn == "mode":
        e = mode_text(c)
    elif fn == "mode_ordinal":
        e = mode_ordinal(c, list(spec.arg))
    else:
        raise ValueError(f"unknown aggregate {fn!r}")
    return e.alias(spec.out)


def build_all(specs) -> list[Column]:
    return [build(s) for s in specs]
