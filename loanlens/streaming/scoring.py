"""Score application rows as they arrive (the upload route, re-aimed).

New application files land in a folder; a Structured Streaming query reads
them with the declared schema, cleans them (row-wise), left-joins the static
per-applicant roll-ups of the child tables (stream-static join: the roll-ups
are an ordinary batch plan, typically refreshed by the batch job), adds the
row-wise features, applies the *fitted* skew model (the batch form would pick
columns from whoever is in the micro-batch) and the fitted encoder +
classifier. Every step is stateless per row, so no streaming state is kept;
progress is tracked in the checkpoint folder given.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import config as C
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import marts as M
from ..operators import ml as ML
from ..operators.skew import SkewLogModel


def read_applications(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over a folder of application files (explicit schema)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_applications(apps: DataFrame, rollups: list[DataFrame], model: PipelineModel,
                       skew_model: SkewLogModel | None = None, *, key=C.APP_KEY) -> DataFrame:
    """Streaming (or batch) applications -> key, TARGET, probability."""
    app = CL.clean_application(apps)
    feats = FE.feature_engineering(M.left_join_chain(app, key, rollups))
    if skew_model is not None:
        feats = skew_model.transform(feats)
    return ML.score(model, feats, key=key)


def start(scored: DataFrame, out_path: str, checkpoint: str,
          fmt: str = "parquet", available_now: bool = True,
          query_name: str | None = None) -> StreamingQuery:
    """Append the scores to ``out_path``; ``checkpoint`` is the query's own
    folder, the same at every restart."""
    w = (scored.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(out_path) if fmt != "memory" else w.start()
