"""G9 exact ROC-AUC and G10 decision-threshold search by F1.

Both need, for every distinct score s, the number of positives and negatives
with a score strictly below s. A plain ``Window.orderBy(score)`` would put all
distinct scores into one task; instead the distinct scores are cut into
quantile buckets of similar size, bucket totals are prefix-summed over a table
with one row per bucket (bounded), broadcast back (bounded), and the prefix
inside a bucket is a window partitioned by bucket. Exact, and no task holds
more than about one bucket's share of the distinct scores. The per-score
counts are written once to the shared checkpoint folder, so sizing the
buckets does not re-run the aggregation over the scored rows.
"""

from __future__ import annotations

import math

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X


def score_label_counts(df: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """Distinct scores with their positive / negative counts (partial aggregation
    makes a hot score cheap). NULL and NaN scores and NULL labels are missing."""
    lab = F.col(label_col)
    score = F.col(score_col).cast("double")
    return (df.filter(score.isNotNull() & ~F.isnan(score) & lab.isNotNull())
              .groupBy(F.col(score_col).cast("double").alias("score"))
              .agg(F.sum(F.when(lab == 1, 1).otherwise(0)).cast("long").alias("pos"),
                   F.sum(F.when(lab == 1, 0).otherwise(1)).cast("long").alias("neg")))


def materialized_counts(df: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """Per-score counts written once to the shared checkpoint folder: sizing
    the buckets (count, quantiles) and the prefix pass then read this compact
    table instead of re-running the aggregation over every scored row."""
    from ..session import materialize
    return materialize(score_label_counts(df, score_col, label_col))


def _bucketize(counts: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Bucket id by approximate quantiles of the distinct scores (B - 1 split
    points come back to the driver: bounded by the bucket count)."""
    n = counts.count()
    b = max(1, math.ceil(n / rows_per_bucket))
    splits = [float("-inf")]
    if b > 1:
        qs = counts.approxQuantile("score", [i / b for i in range(1, b)], 0.5 / b)
        for q in sorted(set(qs)):
            if q > splits[-1]:
                splits.append(q)
    splits.append(float("inf"))
    if len(splits) < 3:
        return counts.withColumn("bucket", F.lit(0.0)), 1
    return (Bucketizer(splits=splits, inputCol="score", outputCol="bucket").transform(counts),
            len(splits) - 1)


def prefix_counts(counts: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Adds ``pos_before`` / ``neg_before``: totals over strictly smaller scores."""
    bucketed, n_buckets = _bucketize(counts, rows_per_bucket)
    w = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    if n_buckets == 1:     # at most rows_per_bucket distinct scores: no offsets to add
        return bucketed.select(
            "score", "pos", "neg",
            F.coalesce(F.sum("pos").over(w), F.lit(0)).alias("pos_before"),
            F.coalesce(F.sum("neg").over(w), F.lit(0)).alias("neg_before"))
    totals = bucketed.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    # One row per bucket: this window is over a small, bounded table.
    w_b = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket",
                            F.coalesce(F.sum("bp").over(w_b), F.lit(0)).alias("pos_off"),
                            F.coalesce(F.sum("bn").over(w_b), F.lit(0)).alias("neg_off"))
    return (bucketed.join(F.broadcast(offsets), "bucket")
            .select("score", "pos", "neg",
                    (F.col("pos_off") + F.coalesce(F.sum("pos").over(w), F.lit(0))).alias("pos_before"),
                    (F.col("neg_off") + F.coalesce(F.sum("neg").over(w), F.lit(0))).alias("neg_before")))


def roc_auc(df: DataFrame, score_col: str, label_col: str,
            rows_per_bucket: int = 1_000_000) -> DataFrame:
    """One row: exact ROC-AUC (ties count one half), positives, negatives."""
    pc = prefix_counts(materialized_counts(df, score_col, label_col), rows_per_bucket)
    return pc.agg(
        (F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
         / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def f1_by_threshold(df: DataFrame, score_col: str, label_col: str,
                    rows_per_bucket: int = 1_000_000) -> DataFrame:
    """F1 at every distinct score used as threshold (predict 1 iff score >= t)."""
    counts = materialized_counts(df, score_col, label_col)
    pc = prefix_counts(counts, rows_per_bucket)
    # totals straight from the per-score counts (no windows in the subquery)
    pc = X.attach_scalar(pc, "__tot", counts.agg(F.struct(F.sum("pos").alias("P"),
                                                         F.sum("neg").alias("N"))))
    tp = F.col("__tot.P") - F.col("pos_before")
    fp = F.col("__tot.N") - F.col("neg_before")
    fn = F.col("pos_before")
    return pc.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                     fn.alias("fn"),
                     F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"))


def best_f1_threshold(df: DataFrame, score_col: str, label_col: str,
                      rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Top-1 threshold by F1 (ties -> the lower threshold)."""
    return (f1_by_threshold(df, score_col, label_col, rows_per_bucket)
            .orderBy(F.desc_nulls_last("f1"), F.asc("threshold")).limit(1))


def f1_on_grid(df: DataFrame, score_col: str, label_col: str, steps: int = 100) -> DataFrame:
    """F1 at thresholds t_i = i / steps, i = 0..steps (predict 1 iff score >= t_i).

    Each row falls in the bucket of the largest grid threshold <= its score;
    the per-bucket counts (at most steps + 2 rows, whatever the data size) are
    suffix-summed, so no row is ever paired with the thresholds.
    """
    grid = [i / steps for i in range(steps + 1)]
    counts = score_label_counts(df, score_col, label_col)
    per = (Bucketizer(splits=[float("-inf")] + grid + [float("inf")], inputCol="score",
                      outputCol="bucket").transform(counts)
           .groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn")))
    # bucket 0: score < t_0; bucket i + 1: t_i <= score < t_(i+1)
    ids = counts.sparkSession.createDataFrame(
        [(float(k), grid[k - 1] if k > 0 else None) for k in range(steps + 2)],
        "bucket double, threshold double")
    full = ids.join(F.broadcast(per), "bucket", "left").fillna(0, ["bp", "bn"])
    # windows over the bounded bucket table only
    suffix = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    out = full.select(
        "bucket", "threshold",
        F.sum("bp").over(suffix).alias("tp"), F.sum("bn").over(suffix).alias("fp"),
        (F.sum("bp").over(every) - F.sum("bp").over(suffix)).alias("fn"))
    out = out.filter(F.col("bucket") > 0).withColumn(
        "f1", F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn")))
    return out.select("threshold", F.col("tp").cast("long").alias("tp"),
                      F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), "f1")


def auc_evaluator(df: DataFrame, score_col: str, label_col: str) -> float:
    """ROC-AUC through Spark ML's evaluator (exact with numBins=0)."""
    ev = BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol=label_col,
                                       metricName="areaUnderROC", numBins=0)
    return ev.evaluate(df.select(F.col(score_col).cast("double"),
                                 F.col(label_col).cast("double")))
