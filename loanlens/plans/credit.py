"""End-to-end credit plans: features (F15), training, batch scoring job.

``build_features``: per-table cleaning, two-level bureau roll-up, five
roll-ups joined onto the applications, row-wise features and two skew steps
(the bureau columns and the final row). In the batch form both steps are
fitted on the bundle itself: bounded statistics are collected, and before the
final step the mart is written once to the checkpoint folder. With a fitted
``CreditModel`` everything is one lazy plan without a statistics pass, and a
row's features and score do not depend on which other rows are scored with it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import config as C
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import marts as M
from ..operators import ml as ML
from ..operators import skew as SK
from ..session import materialize
from ..sources import io as IO

APPLICATION = "application_train"


@dataclass
class CreditModel:
    """Everything scoring needs: both fitted skew steps, the encoder with the
    classifier, and the column types of the application table."""

    bureau_skew: SK.SkewLogModel
    skew: SK.SkewLogModel
    model: PipelineModel
    types: T.StructType

    def save(self, spark: SparkSession, path: str) -> None:
        base = path.rstrip("/")
        for name in ("bureau_skew", "skew", "model"):
            getattr(self, name).write().overwrite().save(f"{base}/{name}")
        (spark.createDataFrame([(json.dumps(self.types.jsonValue()),)], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{base}/types"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CreditModel":
        base = path.rstrip("/")
        types = T.StructType.fromJson(json.loads(spark.read.text(f"{base}/types").first()[0]))
        return cls(SK.SkewLogModel.load(f"{base}/bureau_skew"), SK.SkewLogModel.load(f"{base}/skew"),
                   IO.load_model(f"{base}/model"), types)


def load(spark: SparkSession, path: str, application: str = APPLICATION,
         types: T.StructType | None = None, **kw) -> dict[str, DataFrame]:
    """A2 with the application table of the given name (``application_test``
    has no label); ``types`` fixes its column types (those seen in training)."""
    tables = [application if t == APPLICATION else t for t in C.TABLES]
    declared = types or C.SCHEMAS[APPLICATION]
    bundle = IO.load_bundle(spark, path, tables, {**C.SCHEMAS, application: declared}, **kw)
    bundle[APPLICATION] = bundle.pop(application)
    return bundle


def child_rollups(bundle: dict[str, DataFrame], *, threshold=C.SKEW_THRESHOLD,
                  bureau_skew: SK.SkewLogModel | None = None) -> list[DataFrame]:
    """The five per-applicant roll-ups (F8 - F12 with their cleaning steps),
    in join order. Each is unique on the applicant key."""
    prev = CL.clean_previous_application(bundle["previous_application"])
    inst = CL.clean_installments(bundle["installments_payments"])
    bureau = M.merge_bureau_and_balance(bundle["bureau"], bundle["bureau_balance"],
                                        skew_threshold=threshold, skew_model=bureau_skew)
    return [M.previous_application_mart(prev), M.instalment_mart(inst),
            M.credit_card_mart(bundle["credit_card_balance"]),
            M.pos_cash_mart(bundle["pos_cash_balance"]), M.bureau_mart(bureau)]


def build_features(bundle: dict[str, DataFrame], *, skew: bool = True,
                   skew_exclude=C.SKEW_EXCLUDE, threshold=C.SKEW_THRESHOLD,
                   bureau_skew: SK.SkewLogModel | None = None,
                   skew_model: SK.SkewLogModel | None = None) -> DataFrame:
    """the seven tables -> one feature row per application. The skew
    steps are fitted on the bundle unless their fitted models are given."""
    app = CL.clean_application(bundle[APPLICATION])
    merged = M.left_join_chain(app, C.APP_KEY, child_rollups(bundle, threshold=threshold, bureau_skew=bureau_skew))
    feats = FE.feature_engineering(merged)
    if skew_model is not None:
        return skew_model.transform(feats)
    if skew:
        feats = SK.log_transform_skewed(feats, threshold=threshold, exclude=skew_exclude,
                                        materialize=True)
    return feats


def fit_skew(features_unskewed: DataFrame, *, exclude=C.SKEW_EXCLUDE,
             threshold=C.SKEW_THRESHOLD) -> SK.SkewLogModel:
    """Fit-once form of the final skew step (for scoring later batches)."""
    cols = SK.candidate_columns(features_unskewed, exclude)
    return SK.SkewLogEstimator(inputCols=cols, threshold=threshold).fit(features_unskewed)


def fit_bureau_skew(bundle: dict[str, DataFrame], *, threshold=C.SKEW_THRESHOLD) -> SK.SkewLogModel:
    """Fit-once form of the bureau-level skew step."""
    return fit_skew(CL.clean_bureau(bundle["bureau"]), exclude=C.KEYS, threshold=threshold)


def train_bundle(bundle: dict[str, DataFrame], **kwargs) -> CreditModel:
    """Fit both skew steps, the encoder and the classifier on a labelled bundle."""
    bureau_skew = fit_bureau_skew(bundle)
    feats = materialize(build_features(bundle, skew=False, bureau_skew=bureau_skew))
    skew = fit_skew(feats)
    model = ML.train_classifier(skew.transform(feats), **kwargs)
    types = T.StructType([f for f in bundle[APPLICATION].schema if f.name != C.LABEL])
    return CreditModel(bureau_skew, skew, model, types)


def train(spark: SparkSession, bundle_path: str, model_path: str | None = None,
          **kwargs) -> CreditModel:
    """Labelled bundle -> fitted artefact (G5, G7, G8), saved where asked."""
    fitted = train_bundle(load(spark, bundle_path), **kwargs)
    if model_path:
        fitted.save(spark, model_path)
    return fitted


def score_tables(bundle: dict[str, DataFrame], fitted: CreditModel) -> DataFrame:
    feats = build_features(bundle, bureau_skew=fitted.bureau_skew, skew_model=fitted.skew)
    return ML.score(fitted.model, feats)


def score_bundle(spark: SparkSession, bundle_path: str, model: CreditModel | str,
                 out_path: str | None = None, application: str = APPLICATION) -> DataFrame:
    """Batch scoring job (the upload route, re-aimed): A2 -> F15 -> G6 -> A3.
    ``application``: the application table's name, e.g. ``application_test``."""
    fitted = CreditModel.load(spark, model) if isinstance(model, str) else model
    scored = score_tables(load(spark, bundle_path, application, fitted.types), fitted)
    if out_path:
        IO.write_predictions(scored.withColumnRenamed(C.LABEL, "prediction"), out_path)
    return scored
