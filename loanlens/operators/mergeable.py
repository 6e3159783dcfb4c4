"""Aggregates kept as states: computed per part (a day, a bundle) and merged later.

A new part is read once; the parts before it are not read again, only their
states, whose size depends on the number of parts and columns and not on the
rows.

* Moments (G1, G2): count, mean, sums of the second to fourth powers of the
  distances from the mean, minimum and maximum of each column. Merging gives
  the skewness and the standard deviation of all rows, so the skew step and the
  scaler are fitted from states.
* Sketches: Theta (distinct values) and KLL (quantiles) from Spark's own
  aggregates, with the error each promises.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as X
from . import ml as ML
from . import skew as SK

MOMENTS = ["n", "mean", "m2", "m3", "m4", "low", "high"]


# -- moments ---------------------------------------------------------------------

def moment_states(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """One row per group of ``by`` and column: by..., column_name, n, mean, m2, m3,
    m4 (sums of powers of the distance from the mean), low, high.

    One pass with partial aggregation, whatever the number of columns. Null and
    NaN values are left out; a column without values has n = 0 and null
    moments. A null in ``by`` is a group. An empty table has no states.
    """
    by = list(by)
    clash = set(by) & {"column_name", *MOMENTS}
    if clash:
        raise ValueError(f"grouping columns named {sorted(clash)}")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), X.nan_to_null(F.col(c).cast("double")).alias("x"))
                      for c in cols])
    x, n, m2 = F.col("x"), F.col("n").cast("double"), F.col("m2")
    got = (df.select(*by, F.inline(pairs)).groupBy(*by, "column_name")
           .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
                F.skewness(x).alias("__skew"), F.kurtosis(x).alias("__kurt"),
                F.min(x).alias("low"), F.max(x).alias("high")))
    third = F.col("__skew") * F.pow(m2, F.lit(1.5)) / F.sqrt(n)
    fourth = (F.col("__kurt") + 3.0) * m2 * m2 / n
    return _exact_constants(got.withColumns({"m3": third, "m4": fourth}).select(*by, "column_name", *MOMENTS))


def _exact_constants(states: DataFrame) -> DataFrame:
    """A constant column has no spread, whatever the rounding of its mean."""
    flat = F.col("low") == F.col("high")
    return states.withColumns({m: F.when(flat, F.lit(0.0)).otherwise(F.col(m)) for m in ("m2", "m3", "m4")})


def merge_moments(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """The states of the union of parts, per group of ``by`` (columns of the
    states) and column: the same row that :func:`moment_states` gives for all
    the rows at once, up to rounding. States of several bundles are united
    first (``unionByName``); other columns of the states are dropped.

    The mean of all parts comes first, then each part's powers are moved to it,
    so no large numbers are subtracted. Both are sums with partial aggregation.
    """
    keys = [*by, "column_name"]
    n = F.col("n").cast("double")
    means = states.groupBy(*keys).agg(F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("__mean"))
    a, b = states.alias("a"), means.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    moved = a.join(b, same, "left").select("a.*", "b.__mean")
    d, m2, m3, m4 = F.col("mean") - F.col("__mean"), F.col("m2"), F.col("m3"), F.col("m4")
    out = moved.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.any_value("__mean").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3.0 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4.0 * d * m3 + 6.0 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    return _exact_constants(out.select(*keys, *MOMENTS))


def moment_report(states: DataFrame) -> DataFrame:
    """The states' groups with n, mean, std_pop, skewness (bias-corrected; null
    below three values or without spread), kurtosis (population, excess), low,
    high."""
    n, m2 = F.col("n").cast("double"), F.col("m2")
    spread = F.when(m2 > 0, m2)
    g1 = F.col("m3") * F.sqrt(n) / F.pow(spread, F.lit(1.5))
    keys = [c for c in states.columns if c not in MOMENTS]
    return states.select(
        *keys, "n", "mean", F.sqrt(m2 / n).alias("std_pop"),
        F.when(n >= 3, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0)).alias("skewness"),
        (F.col("m4") * n / (spread * spread) - 3.0).alias("kurtosis"), "low", "high")


def _rows(states: DataFrame, cols: list[str]) -> dict:
    # bounded: one row per column
    rows = moment_report(states.filter(F.col("column_name").isin(list(cols)))).collect()
    out = {r["column_name"]: r for r in rows}
    if len(out) < len(rows):
        raise ValueError("several states of one column: merge them first")
    return out


def skew_model(states: DataFrame, cols: list[str], threshold: float = C.SKEW_THRESHOLD,
               shift: float = C.SKEW_SHIFT) -> SK.SkewLogModel:
    """The G1 step fitted from merged states: what ``SkewLogEstimator`` fits on
    all the rows. A column without a state is not transformed."""
    rows, chosen, minima = _rows(states, cols), [], []
    for c in cols:
        r = rows.get(c)
        if r is not None and r["skewness"] is not None and abs(r["skewness"]) > threshold:
            chosen.append(c)
            minima.append(float(r["low"]))
    return SK.SkewLogModel(inputCols=list(cols), selectedCols=chosen, minima=minima, shift=shift)


def scaler_model(states: DataFrame, cols: list[str], output_cols: list[str] | None = None):
    """The G2 scaler fitted from merged states: what ``PopulationStandardScaler``
    fits on all the rows. A column without values is moved by 0 and divided by 1."""
    rows = _rows(states, cols)
    means = [float(rows[c]["mean"] or 0.0) if c in rows else 0.0 for c in cols]
    scales = [float(rows[c]["std_pop"] or 1.0) if c in rows else 1.0 for c in cols]
    return ML.PopulationStandardScalerModel(inputCols=list(cols), outputCols=list(output_cols or cols),
                                            means=means, scales=scales)


# -- sketches ---------------------------------------------------------------------

@dataclass(frozen=True)
class Sketches:
    """Which columns are sketched, and how finely.

    ``distinct``: number of different values by a Theta sketch of 2^``log_k``
    entries: exact up to that many values, beyond it with a relative standard
    error of 1 / sqrt(2^log_k - 1). ``quantiles``: KLL sketch of size ``kll_k``
    whose ranks are off by at most ``rank_error`` with 99 % confidence. Merging
    does not add to either error.
    """

    distinct: tuple[str, ...] = ()
    quantiles: tuple[str, ...] = ()
    log_k: int = 12
    kll_k: int = 800

    @property
    def distinct_error(self) -> float:
        return 1.0 / (2 ** self.log_k - 1) ** 0.5

    @property
    def rank_error(self) -> float:
        """The library's published fit of the normalised rank error, 99 %."""
        return 2.296 / self.kll_k ** 0.9723


def sketch_parts(df: DataFrame, by: list[str], spec: Sketches) -> DataFrame:
    """by..., n_rows, and per column ``<c>_theta`` or ``<c>_kll`` (binary): the part
    to store per day. Null and NaN values are left out of a sketch; a group whose
    values are all null has an empty sketch."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.theta_sketch_agg(F.col(c), spec.log_k).alias(f"{c}_theta") for c in spec.distinct]
    aggs += [F.kll_sketch_agg_double(X.nan_to_null(F.col(c).cast("double")), spec.kll_k).alias(f"{c}_kll")
             for c in spec.quantiles]
    return df.groupBy(*by).agg(*aggs)


def merge_sketches(parts: DataFrame, by: list[str], spec: Sketches) -> DataFrame:
    """Parts (of any days, united) merged per group of ``by``; can be merged again."""
    aggs = [F.sum("n_rows").alias("n_rows")]
    aggs += [F.theta_union_agg(F.col(f"{c}_theta"), spec.log_k).alias(f"{c}_theta") for c in spec.distinct]
    aggs += [F.kll_merge_agg_double(F.col(f"{c}_kll"), spec.kll_k).alias(f"{c}_kll") for c in spec.quantiles]
    return parts.groupBy(*by).agg(*aggs)


def estimates(parts: DataFrame, by: list[str], spec: Sketches, probs=(0.5, 0.9)) -> DataFrame:
    """by..., n_rows, ``<c>_count`` (distinct) and ``<c>_q0``, ``<c>_q1``, ... (quantiles
    at ``probs``; null where a group has no value)."""
    cols = [F.theta_sketch_estimate(F.col(f"{c}_theta")).alias(f"{c}_count") for c in spec.distinct]
    for c in spec.quantiles:
        held = F.kll_sketch_get_n_double(F.col(f"{c}_kll")) > 0
        cols += [F.when(held, F.kll_sketch_get_quantile_double(F.col(f"{c}_kll"), F.lit(float(p)))).alias(f"{c}_q{i}")
                 for i, p in enumerate(probs)]
    return parts.select(*by, "n_rows", *cols)


def audit(df: DataFrame, est: DataFrame, by: list[str], spec: Sketches, probs=(0.5, 0.9),
          margin: float = 2.0) -> DataFrame:
    """The estimates held against the rows: by..., n_rows, per distinct column its
    exact ``<c>_exact`` and ``<c>_ok`` (within ``margin`` x 2.576 standard errors), per
    quantile ``<c>_q<i>_ok`` (its rank range in the rows comes within ``margin`` x
    ``rank_error`` of the asked one; null without values).

    The estimates have one row per group, so the join does not multiply rows;
    ranks are counts with partial aggregation.
    """
    on = reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in by], F.lit(True))
    rows = df.select(*by, *dict.fromkeys([*spec.distinct, *spec.quantiles])).alias("r")
    j = rows.join(est.withColumnRenamed("n_rows", "__n").alias("e"), on, "left")
    aggs, oks = [F.count(F.lit(1)).alias("n_rows")], []
    for c in spec.quantiles:
        x = X.nan_to_null(F.col(f"r.{c}").cast("double"))
        aggs.append(F.count(x).alias(f"{c}__n"))
        for i, p in enumerate(probs):
            q = F.col(f"e.{c}_q{i}")
            aggs += [F.count_if(x < q).alias(f"{c}__lt{i}"), F.count_if(x <= q).alias(f"{c}__le{i}")]
            n = F.col(f"{c}__n")
            off = F.greatest(F.try_divide(F.col(f"{c}__lt{i}"), n) - p, p - F.try_divide(F.col(f"{c}__le{i}"), n))
            oks.append((off <= margin * spec.rank_error).alias(f"{c}_q{i}_ok"))
    for c in spec.distinct:
        aggs += [F.count_distinct(F.col(f"r.{c}")).alias(f"{c}_exact"), F.any_value(f"e.{c}_count").alias(f"{c}__est")]
        exact = F.col(f"{c}_exact")
        slack = F.when(exact > 2 ** spec.log_k, margin * 2.576 * spec.distinct_error * exact).otherwise(0.0)
        oks += [exact, (F.abs(F.col(f"{c}__est") - exact) <= slack).alias(f"{c}_ok")]
    out = j.groupBy(*[F.col(f"r.{k}").alias(k) for k in by]).agg(*aggs)
    return out.select(*by, "n_rows", *oks)
