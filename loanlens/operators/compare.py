"""G9 with its uncertainty: DeLong variances and paired comparison of ROC-AUCs.

The placement value of a positive is the share of negatives it beats (ties one
half), that of a negative the share of positives that beat it. A model's AUC is
the mean placement value; the covariances of two models' placement values over
the same rows give the variance of the difference of their AUCs.

The scored rows are reduced first to counts of equal (score of each model,
label) rows, so a score that a third of the rows share is one row from there
on. Per model, the prefix counts of the exact AUC (``metrics.prefix_counts``,
bucketed, no single-task window) give each distinct score its two placement
values; joining them back to the counts is an equi-join whose other side has
one row per distinct score, sorted so that Spark can split a hot score.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import materialize
from . import metrics as MT

Z95 = 1.959963984540054


def joint_counts(df: DataFrame, score_cols: list[str], label_col: str) -> DataFrame:
    """s0, s1, ..., pos, neg: complete rows (no null or NaN score, no null
    label) counted by their scores."""
    scores = [X.nan_to_null(F.col(c).cast("double")) for c in score_cols]
    # -0.0 and 0.0 are one score
    rows = df.select(*[(s + F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(scores)], F.col(label_col).alias("y"))
    return (rows.dropna().groupBy(*[f"s{i}" for i in range(len(scores))])
            .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")))


def placements(counts: DataFrame, i: int, totals: Column, rows_per_bucket: int) -> DataFrame:
    """(s_i, v_pos_i, v_neg_i): placement values of a positive and a negative of
    each distinct score of model ``i``."""
    per = materialize(counts.groupBy(F.col(f"s{i}").alias("score")).agg(F.sum("pos").alias("pos"),
                                                                       F.sum("neg").alias("neg")))
    pc = X.attach_scalar(MT.prefix_counts(per, rows_per_bucket), "__tot", totals)
    below = F.col("neg_before") + F.col("neg") / F.lit(2.0)
    above = F.col("__tot.P") - F.col("pos_before") - F.col("pos") / F.lit(2.0)
    return pc.select(F.col("score").alias(f"s{i}"),
                     F.try_divide(below, F.col("__tot.N").cast("double")).alias(f"v_pos{i}"),
                     F.try_divide(above, F.col("__tot.P").cast("double")).alias(f"v_neg{i}"))


def _moments(i: int, j: int) -> list[Column]:
    """Sums that give the covariance of the placement values of two models, taken
    around one half."""
    out = []
    for side, weight in (("pos", "pos"), ("neg", "neg")):
        a, b, w = F.col(f"v_{side}{i}") - 0.5, F.col(f"v_{side}{j}") - 0.5, F.col(weight).cast("double")
        out += [F.sum(w * a * b).alias(f"{side}_{i}_{j}")]
    return out


def auc_compare(df: DataFrame, score_cols: list[str], label_col: str,
                rows_per_bucket: int = 1_000_000) -> DataFrame:
    """One row per pair of models: model_a, model_b, n_pos, n_neg, auc_a, auc_b,
    var_a, var_b, cov_ab, difference (a - b), var_difference, z, and the 95 %
    interval low, high of the difference.

    Rows with a missing score of any model or a missing label are left out, so
    that the comparison is paired. With fewer than two positives or negatives
    the variances are null; z is null where the variance of the difference is 0.
    """
    if len(score_cols) < 2:
        raise ValueError("at least two score columns are compared")
    counts = materialize(joint_counts(df, score_cols, label_col))
    totals = counts.agg(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    rows = counts
    for i in range(len(score_cols)):
        rows = rows.join(placements(counts, i, totals, rows_per_bucket).hint("merge"), f"s{i}")
    n = range(len(score_cols))
    sums = [F.sum("pos").alias("P"), F.sum("neg").alias("N")]
    for i in n:
        for side in ("pos", "neg"):
            sums.append(F.sum(F.col(side).cast("double") * (F.col(f"v_{side}{i}") - 0.5)).alias(f"{side}_{i}"))
        for j in range(i, len(score_cols)):
            sums += _moments(i, j)
    one = rows.agg(*sums)
    size = {"pos": F.col("P").cast("double"), "neg": F.col("N").cast("double")}

    def auc(i):
        return F.try_divide(F.col(f"pos_{i}"), size["pos"]) + 0.5

    def cov(i, j):
        """Covariance of two AUCs: the sides' sample covariances over their sizes."""
        total = F.lit(0.0)
        for side, w in size.items():
            spread = F.col(f"{side}_{i}_{j}") - F.try_divide(F.col(f"{side}_{i}") * F.col(f"{side}_{j}"), w)
            total = total + F.try_divide(F.try_divide(spread, F.when(w > 1, w - 1)), w)
        return total

    lines = []
    for i, j in combinations(n, 2):
        lines.append(F.struct(
            F.lit(score_cols[i]).alias("model_a"), F.lit(score_cols[j]).alias("model_b"),
            F.col("P").alias("n_pos"), F.col("N").alias("n_neg"), auc(i).alias("auc_a"), auc(j).alias("auc_b"),
            cov(i, i).alias("var_a"), cov(j, j).alias("var_b"), cov(i, j).alias("cov_ab")))
    out = one.select(F.inline(F.array(*lines)))
    out = out.withColumn("difference", F.col("auc_a") - F.col("auc_b"))
    out = out.withColumn("var_difference", F.greatest(F.lit(0.0), F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab"))
                         + F.lit(0.0) * F.col("var_a"))
    error = F.sqrt("var_difference")
    return out.withColumns({"z": F.try_divide(F.col("difference"), F.when(F.col("var_difference") > 1e-30, error)),
                            "low": F.col("difference") - Z95 * error, "high": F.col("difference") + Z95 * error})
