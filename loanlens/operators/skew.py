"""G1: skewness detection and log transform.

Two forms:

* ``log_transform_skewed(df)`` -- batch form: fits on ``df`` itself (one
  bounded row of statistics per column) and applies the choice to it.
* ``SkewLogEstimator`` / ``SkewLogModel`` -- fit once (bounded stats, one row
  per column), then apply the stored choice to any later batch. This is the
  form for scoring, where the batch form would pick columns from whoever is
  in the batch.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import aggs as A
from ..functions import expr as X


def candidate_columns(df: DataFrame, exclude=None, columns=None) -> list[str]:
    """Numeric columns of ``df`` minus ``exclude`` (or the given ``columns``)."""
    ex = set(exclude or [])
    if columns is not None:
        return [c for c in columns if c not in ex]
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def column_stats(df: DataFrame, cols) -> DataFrame:
    """One row per candidate column (``idx`` = position in ``cols``): bias-corrected
    skewness and minimum in one pass (:func:`aggs.stacked_stats`)."""
    return A.stacked_stats(df, cols, skew=A.skewness_unbiased, mn=F.min)


def skew_selected(skewness: Column, threshold: float) -> Column:
    """abs(G1) > threshold; NULL/NaN skewness never selects (NaN > x is true in Spark)."""
    return F.coalesce((F.abs(skewness) > F.lit(float(threshold))) & ~F.isnan(skewness),
                      F.lit(False))


def log_transform_skewed(df: DataFrame, threshold=C.SKEW_THRESHOLD, exclude=None,
                         shift=C.SKEW_SHIFT, columns=None, materialize: bool = False) -> DataFrame:
    """Batch G1: log-transform every candidate column with abs(skewness) > threshold.

    Candidate columns come out as double; a NULL result keeps the old value.
    The statistics are one bounded row per column, collected first and inlined
    as literals at every width. ``materialize`` writes ``df`` before that as a
    table in the shared checkpoint folder (use it when ``df`` is an expensive
    plan such as the joined mart): the statistics and the rows are then read
    off that table.
    """
    cols = candidate_columns(df, exclude, columns)
    if not cols:
        return df
    if materialize:
        from ..session import materialize as _mat
        df = _mat(df)
    model = SkewLogEstimator(inputCols=cols, threshold=threshold, shift=shift).fit(df)
    return model.transform(df)


def skew_report(df: DataFrame, threshold=C.SKEW_THRESHOLD, exclude=None,
                columns=None, table_name: str | None = None) -> DataFrame:
    """One row per candidate column: skewness, min, non-null count, selected.

    Sorted by skewness, highest first (the printed list of the original).
    """
    cols = candidate_columns(df, exclude, columns)
    names = F.array(*[F.lit(c) for c in cols])
    stats = A.stacked_stats(df, cols, skewness=A.skewness_unbiased,
                            min_value=F.min, n=F.count)
    fields = [F.get(names, F.col("idx")).alias("column_name"), "skewness", "min_value",
              F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"),
              skew_selected(F.col("skewness"), threshold).alias("selected")]
    if table_name is not None:
        fields.insert(0, F.lit(table_name).alias("table_name"))
    return stats.select(*fields).orderBy(F.desc_nulls_last("skewness"))


# ---------------------------------------------------------------------------
# Estimator / Model form.
# ---------------------------------------------------------------------------

class _SkewParams(HasInputCols):
    threshold = Param(Params._dummy(), "threshold", "abs(skewness) above this is transformed",
                      typeConverter=TypeConverters.toFloat)
    shift = Param(Params._dummy(), "shift", "constant added after the minimum shift",
                  typeConverter=TypeConverters.toFloat)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(threshold=C.SKEW_THRESHOLD, shift=C.SKEW_SHIFT)


class SkewLogEstimator(Estimator, _SkewParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit: one global aggregate (bounded, one row) decides the columns."""

    @keyword_only
    def __init__(self, *, inputCols=None, threshold=C.SKEW_THRESHOLD, shift=C.SKEW_SHIFT):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SkewLogModel":
        cols = self.getInputCols()
        thr = self.getOrDefault(self.threshold)
        # bounded: one row per column
        rows = {r["idx"]: r for r in column_stats(df, cols).collect()} if cols else {}
        chosen, minima = [], []
        for i, c in enumerate(cols):
            r = rows.get(i)
            sk, mn = (r["skew"], r["mn"]) if r is not None else (None, None)
            if sk is not None and sk == sk and abs(sk) > thr:
                chosen.append(c)
                minima.append(float(mn) if mn is not None else 0.0)
        return SkewLogModel(inputCols=cols, selectedCols=chosen, minima=minima,
                            shift=self.getOrDefault(self.shift))


class SkewLogModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """All candidate columns come out as double. A value below the fit-time
    minimum is logged as that minimum, so a column never mixes both scales; a
    NULL stays NULL."""

    selectedCols = Param(Params._dummy(), "selectedCols", "columns chosen at fit",
                         typeConverter=TypeConverters.toListString)
    minima = Param(Params._dummy(), "minima", "fit-time minimum per chosen column",
                   typeConverter=TypeConverters.toListFloat)
    shift = Param(Params._dummy(), "shift", "shift constant",
                  typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, selectedCols=None, minima=None, shift=C.SKEW_SHIFT):
        super().__init__()
        self._setDefault(selectedCols=[], minima=[], shift=C.SKEW_SHIFT)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.selectedCols)
        mins = self.getOrDefault(self.minima)
        shift = self.getOrDefault(self.shift)
        low = dict(zip(cols, mins))
        new = {}
        for c in dict.fromkeys([*(self.getInputCols() if self.isDefined(self.inputCols) else []), *cols]):
            if c not in df.columns:
                continue
            new[c] = X.col(c).cast("double")
            if c in low:
                held = F.when(new[c].isNotNull(), F.greatest(new[c], F.lit(low[c])))
                new[c] = X.overwrite_non_null(X.log_transform(held, low[c], shift), new[c])
        return df.withColumns(new) if new else df
