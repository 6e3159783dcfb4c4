"""G8 with learned weights: members combined by their out-of-fold scores.

Rows fall into folds by a hash of their key. For each fold the members (boosted
trees and the network, with the encoder) are fitted on the other folds and score
it, so no row's score depends on its own label. A logistic regression on the
members' log odds, fitted on those scores, gives the weights; the members are
then fitted on all rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import materialize
from . import ml as ML

#: members of ``ml.train_classifier`` and their probability columns
MEMBERS = {"gbt": "gbt_probability", "mlp": "mlp_probability"}
_EDGE = 1e-6


def log_odds(p: Column) -> Column:
    """ln(p / (1 - p)), with p kept a millionth away from 0 and 1."""
    p = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1.0 - _EDGE))
    return F.log(p / (F.lit(1.0) - p))


def fold_of(key, folds: int, seed: int) -> Column:
    """Fold of a row, from its key alone: repeated keys share a fold."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(folds)).cast("int")


class LogOddsStacker(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """P(class 1) = 1 / (1 + exp(-(intercept + sum of weight x log odds))) over several
    probability-vector columns, and the hard label at ``threshold``."""

    probabilityCols = Param(Params._dummy(), "probabilityCols", "probability vector columns",
                            typeConverter=TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "weight per column", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant", typeConverter=TypeConverters.toFloat)
    outputCol = Param(Params._dummy(), "outputCol", "P(class 1)", typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "hard label", typeConverter=TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "P(class 1) >= threshold -> 1", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, probabilityCols=None, weights=None, intercept=0.0, outputCol="score",
                 predictionCol="prediction", threshold=0.5):
        super().__init__()
        self._setDefault(intercept=0.0, outputCol="score", predictionCol="prediction", threshold=0.5)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        z = F.lit(self.getOrDefault(self.intercept))
        for c, w in zip(self.getOrDefault(self.probabilityCols), self.getOrDefault(self.weights)):
            z = z + F.lit(w) * log_odds(vector_to_array(F.col(c)).getItem(1))
        out = self.getOrDefault(self.outputCol)
        df = df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        return df.withColumn(self.getOrDefault(self.predictionCol),
                             (F.col(out) >= F.lit(self.getOrDefault(self.threshold))).cast("double"))


def out_of_fold(df: DataFrame, *, key=C.APP_KEY, label=C.LABEL, folds: int = 5, seed: int = 42, **fit) -> DataFrame:
    """key, label, fold and one P(class 1) per member (named as in ``MEMBERS``) of every
    row with a label: scored by members that were fitted without its fold.

    ``fit`` goes to ``ml.train_classifier`` (its row filter applies to fitting and
    scoring). Each fold's fit is its own distributed job; its scores are a table in
    the shared checkpoint folder, so a lost executor does not repeat a fit.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    rows = materialize(df.filter(F.col(label).isNotNull()).withColumn("__fold", fold_of(key, folds, seed)))
    out = None
    for f in range(folds):
        train, held = rows.filter(F.col("__fold") != f), rows.filter(F.col("__fold") == f)
        model = ML.train_classifier(train.drop("__fold"), key=key, label=label, seed=seed, ensemble=True, **fit)
        p = [vector_to_array(F.col(c)).getItem(1).alias(m) for m, c in MEMBERS.items()]
        part = materialize(model.transform(held).select(key, label, F.col("__fold").alias("fold"), *p))
        out = part if out is None else out.unionByName(part)
    return out


def fit_weights(scores: DataFrame, label: str, members=tuple(MEMBERS), reg: float = 1e-4) -> tuple[list[float], float]:
    """(weight per member, intercept) of the logistic regression on the members' log odds."""
    x = scores.select(F.col(label).cast("double").alias("y"), *[log_odds(F.col(m)).alias(m) for m in members])
    x = VectorAssembler(inputCols=list(members), outputCol="x").transform(x)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=reg, standardization=False).fit(x)
    return [float(v) for v in model.coefficients], float(model.intercept)


def train_stacked(df: DataFrame, *, key=C.APP_KEY, label=C.LABEL, folds: int = 5, seed: int = 42,
                  threshold: float = 0.5, **fit) -> tuple[PipelineModel, DataFrame]:
    """(model, out-of-fold scores). The model has the stages of ``ml.train_classifier``
    fitted on all labelled rows, with the learned combination in place of the mean;
    it can be saved and used with ``ml.score``. The scores (see :func:`out_of_fold`)
    also have ``stacked``, the combination of the members' out-of-fold scores."""
    scores = out_of_fold(df, key=key, label=label, folds=folds, seed=seed, **fit)
    weights, intercept = fit_weights(scores, label)
    whole = ML.train_classifier(df.filter(F.col(label).isNotNull()), key=key, label=label, seed=seed, ensemble=True, **fit)
    stacker = LogOddsStacker(probabilityCols=list(MEMBERS.values()), weights=weights, intercept=intercept,
                             threshold=threshold)
    z = F.lit(intercept)
    for m, w in zip(MEMBERS, weights):
        z = z + F.lit(w) * log_odds(F.col(m))
    return (PipelineModel(stages=[*whole.stages[:-1], stacker]),
            scores.withColumn("stacked", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))
