"""Encoder pipeline, training and scoring on Spark ML.

Every custom stage is a ``pyspark.ml`` Transformer/Estimator with
DefaultParams persistence, so a fitted ``PipelineModel`` saves and loads as
one artefact. Fitting needs one bounded one-row statistics job (scaler) and
the category vocabulary (StringIndexer); transforming is a lazy projection.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import aggs as A
from ..functions import expr as X

# ---------------------------------------------------------------------------
# Drop-then-filter transformer.
# ---------------------------------------------------------------------------


class DropFilterTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drop ``columnsToDrop`` (absent ignored), then keep rows where
    ``filterColumn != filterValue`` (NULL rows are kept). No-op fit."""

    columnsToDrop = Param(Params._dummy(), "columnsToDrop", "columns to drop",
                          typeConverter=TypeConverters.toListString)
    filterColumn = Param(Params._dummy(), "filterColumn", "column compared",
                         typeConverter=TypeConverters.toString)
    filterValue = Param(Params._dummy(), "filterValue", "value whose rows are removed",
                        typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columnsToDrop=None, filterColumn=None, filterValue=None):
        super().__init__()
        self._setDefault(columnsToDrop=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        drop = self.getOrDefault(self.columnsToDrop)
        if drop:
            df = df.drop(*[c for c in drop if c in df.columns])
        if self.isDefined(self.filterColumn) and self.isDefined(self.filterValue):
            col, val = self.getOrDefault(self.filterColumn), self.getOrDefault(self.filterValue)
            if col in df.columns:
                df = df.filter(X.ne_keep_null(col, val))
        return df


# ---------------------------------------------------------------------------
# Constant imputation.
# ---------------------------------------------------------------------------


class ConstantImputer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """NULL (and NaN) -> a constant: ``numericValue`` in numeric columns,
    ``textValue`` in string columns."""

    numericValue = Param(Params._dummy(), "numericValue", "fill for numeric columns",
                         typeConverter=TypeConverters.toFloat)
    textValue = Param(Params._dummy(), "textValue", "fill for text columns",
                      typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, numericValue=C.NUMERIC_FILL, textValue=C.TEXT_FILL):
        super().__init__()
        self._setDefault(numericValue=C.NUMERIC_FILL, textValue=C.TEXT_FILL)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        nv = self.getOrDefault(self.numericValue)
        tv = self.getOrDefault(self.textValue)
        new = {}
        for c in self.getInputCols():
            t = types[c]
            if isinstance(t, T.StringType):
                new[c] = F.coalesce(F.col(c), F.lit(tv))
            elif isinstance(t, (T.DoubleType, T.FloatType)):
                new[c] = F.coalesce(X.nan_to_null(c), F.lit(nv)).cast("double")
            else:
                new[c] = F.coalesce(F.col(c).cast("double"), F.lit(nv))
        return df.withColumns(new)


# ---------------------------------------------------------------------------
# Standardisation with the population standard deviation.
# ---------------------------------------------------------------------------


def standardise_batch(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """(x - mean) / std_pop with the statistics of ``df`` itself; a constant
    column is divided by 1. The fitted scaler at every width: bounded
    per-column statistics collected, then literals."""
    cols = list(cols)
    if not cols:
        return df
    return PopulationStandardScaler(inputCols=cols, outputCols=[c + suffix for c in cols]).fit(df).transform(df)


class PopulationStandardScaler(Estimator, HasInputCols, HasOutputCols,
                               DefaultParamsReadable, DefaultParamsWritable):
    """Per-column z-score with population std (Spark ML's scaler uses the
    sample std). Fit = one stacked aggregate, one row per column."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationStandardScalerModel":
        cols = self.getInputCols()
        outs = self.getOutputCols() if self.isDefined(self.outputCols) else cols
        means, scales = [], []
        if cols:
            # bounded: one row per column
            rows = {r["idx"]: r for r in A.stacked_stats(df, cols, a=F.avg, s=F.stddev_pop).collect()}
            for i in range(len(cols)):
                r = rows.get(i)
                m, s = (r["a"], r["s"]) if r is not None else (None, None)
                means.append(float(m) if m is not None else 0.0)
                scales.append(float(s) if s not in (None, 0.0) and s == s else 1.0)
        return PopulationStandardScalerModel(inputCols=cols, outputCols=outs,
                                             means=means, scales=scales)


class PopulationStandardScalerModel(Model, HasInputCols, HasOutputCols,
                                    DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "fit-time means", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fit-time population std (0 -> 1)",
                   typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, outs = self.getInputCols(), self.getOutputCols()
        ms, ss = self.getOrDefault(self.means), self.getOrDefault(self.scales)
        return df.withColumns({o: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                               for c, o, m, s in zip(cols, outs, ms, ss)})


# ---------------------------------------------------------------------------
# G8 helper: average of two probability columns.
# ---------------------------------------------------------------------------


class ProbabilityAverager(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of P(class 1) over several probability-vector columns, and the
    hard label at ``threshold``."""

    probabilityCols = Param(Params._dummy(), "probabilityCols", "probability vector columns",
                            typeConverter=TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "averaged P(class 1)",
                      typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "hard label column",
                          typeConverter=TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "P(class 1) >= threshold -> 1",
                      typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, probabilityCols=None, outputCol="score", predictionCol="prediction",
                 threshold=0.5):
        super().__init__()
        self._setDefault(outputCol="score", predictionCol="prediction", threshold=0.5)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.probabilityCols)
        p1 = [vector_to_array(F.col(c)).getItem(1) for c in cols]
        score = sum(p1[1:], p1[0]) / F.lit(float(len(p1)))
        out = self.getOrDefault(self.outputCol)
        return (df.withColumn(out, score)
                  .withColumn(self.getOrDefault(self.predictionCol),
                              (F.col(out) >= F.lit(self.getOrDefault(self.threshold))).cast("double")))


# ---------------------------------------------------------------------------
# Column roles and the encoder pipeline.
# ---------------------------------------------------------------------------


def feature_roles(df: DataFrame, *, key=C.APP_KEY, label=C.LABEL, exclude=(),
                  include_binned_modes=False) -> tuple[list[str], list[str]]:
    """Numeric (key and label removed) and text feature columns.

    The binned-mode label columns are left out by default, as in the
    original, where their categorical dtype made the text selector skip them.
    """
    ex = set(exclude) | {key, label}
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in ex:
            continue
        if isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            if f.name.endswith("_BINNED_MODE") and not include_binned_modes:
                continue
            cat.append(f.name)
    return num, cat


def preprocessing_pipeline(numeric, categorical, *, features_col="features",
                           filter_column=C.GENDER_COLUMN, filter_value=C.GENDER_DROP_VALUE,
                           columns_to_drop=()) -> Pipeline:
    """G5 (unfitted): drop/filter -> {impute 0 -> z-score} + {impute "missing"
    -> one-hot, unknown -> all zeros} -> one vector (numeric block first)."""
    numeric, categorical = list(numeric), list(categorical)
    stages = [DropFilterTransformer(columnsToDrop=list(columns_to_drop),
                                    filterColumn=filter_column, filterValue=filter_value)]
    scaled = [f"{c}__z" for c in numeric]
    if numeric:
        stages += [ConstantImputer(inputCols=numeric),
                   PopulationStandardScaler(inputCols=numeric, outputCols=scaled)]
    ohe = [f"{c}__ohe" for c in categorical]
    if categorical:
        idx = [f"{c}__idx" for c in categorical]
        stages += [ConstantImputer(inputCols=categorical),
                   StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True)]
    stages.append(VectorAssembler(inputCols=scaled + ohe, outputCol=features_col,
                                  handleInvalid="keep"))
    return Pipeline(stages=stages)


def check_categories(df: DataFrame, cols, limit: int = 10_000) -> None:
    """Raise if a text column has more than about ``limit`` different values:
    its vocabulary would go to the driver and its one-hot block into every
    model. Such a column is an id or free text and must be declared so."""
    cols = list(cols)
    if not cols:
        return
    row = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    wide = [f"{c} (about {row[f'n{i}']})" for i, c in enumerate(cols) if row[f"n{i}"] > limit]
    if wide:
        raise ValueError(f"too many categories (limit {limit}): {', '.join(wide)}; exclude these columns")


def vector_size(df: DataFrame, col: str = "features") -> int:
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return len(df.select(col).first()[0])


def train_classifier(df: DataFrame, *, key=C.APP_KEY, label=C.LABEL, numeric=None,
                     categorical=None, gbt_iter: int = 30, mlp_hidden=(16,),
                     ensemble: bool = True, seed: int = 42, threshold: float = 0.5,
                     max_categories: int = 10_000,
                     filter_column=C.GENDER_COLUMN, filter_value=C.GENDER_DROP_VALUE) -> PipelineModel:
    """G5 + G7 (+ G8): fit the encoder, a boosted-tree classifier and, with
    ``ensemble``, an MLP whose P(class 1) is averaged with the trees'.

    ``threshold``: P(class 1) from which the hard label is 1 (for example
    from ``metrics.best_f1_threshold`` on held-out rows). Returns one
    PipelineModel whose output has ``score`` (P(class 1)) and
    ``prediction`` (hard label).
    """
    # GBT checkpoints its state every 10 iterations only when the context has
    # a checkpoint folder: register the shared one (executor loss then replays
    # at most 10 rounds)
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    if numeric is None or categorical is None:
        n, c = feature_roles(df, key=key, label=label)
        numeric = n if numeric is None else numeric
        categorical = c if categorical is None else categorical
    check_categories(df, categorical, max_categories)
    prep = preprocessing_pipeline(numeric, categorical, filter_column=filter_column,
                                  filter_value=filter_value).fit(df)
    data = prep.transform(df).withColumn("__label", F.col(label).cast("double"))
    data = data.select(key, "features", "__label").persist()
    try:
        gbt = (GBTClassifier(featuresCol="features", labelCol="__label", maxIter=gbt_iter,
                             seed=seed, predictionCol="gbt_prediction")
               .setProbabilityCol("gbt_probability").setRawPredictionCol("gbt_raw").fit(data))
        stages = list(prep.stages) + [gbt]
        cols = ["gbt_probability"]
        if ensemble:
            n_in = vector_size(data)
            mlp = MultilayerPerceptronClassifier(
                featuresCol="features", labelCol="__label",
                layers=[n_in, *mlp_hidden, 2], seed=seed, maxIter=100,
                predictionCol="mlp_prediction", probabilityCol="mlp_probability",
                rawPredictionCol="mlp_raw").fit(data)
            stages.append(mlp)
            cols.append("mlp_probability")
        stages.append(ProbabilityAverager(probabilityCols=cols, threshold=threshold))
    finally:
        data.unpersist()
    return PipelineModel(stages=stages)


def score(model: PipelineModel, features: DataFrame, *, key=C.APP_KEY,
          out_col=C.LABEL) -> DataFrame:
    """G6 + B11: key, hard class label (int) and P(class 1)."""
    return (model.transform(features)
            .select(key, F.col("prediction").cast("int").alias(out_col),
                    F.col("score").alias("probability")))
