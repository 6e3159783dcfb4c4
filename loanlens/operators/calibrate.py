"""Calibrated probabilities by isotonic regression.

Neighbouring scores whose observed rates fall are pooled until the rates rise
with the score (pool adjacent violators). Pooling inside a range of scores is
part of the pooling of all scores, so it runs in score ranges first, then over
the blocks of neighbouring ranges, ``fan_in`` of them at a time, until one
group is left. All comparisons are between whole counts, so the fit does not
depend on how the ranges are cut.

What one task holds: a range's distinct scores (``rows_per_bucket``, or one
range of that size), then blocks. The blocks of one group have rising rates,
each a fraction of two counts that sum to the rows: N labelled rows have at
most about 0.9 * N^(2/3) different ones (900,000 for 10^9 rows). Only their
number of ranges reaches the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import materialize
from . import metrics as MT
from . import temporal as TP

_BLOCK = "grp long, low double, high double, pos long, n long"


def pool(pos, n) -> list[tuple[int, int, int, int]]:
    """(first, last, pos, n) per block: the counts in score order, neighbours
    pooled while a rate does not exceed the one before it."""
    out: list[tuple[int, int, int, int]] = []
    for i, (p, w) in enumerate(zip(pos, n)):
        first = i
        while out and out[-1][2] * w >= p * out[-1][3]:
            first, _, q, v = out.pop()
            p, w = p + q, w + v
        out.append((first, i, p, w))
    return out


def _pool_group(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("low")
    blocks = pool([int(v) for v in g["pos"]], [int(v) for v in g["n"]])
    low, high = g["low"].to_numpy(), g["high"].to_numpy()
    return pd.DataFrame({"grp": int(g["grp"].iloc[0]), "low": [low[b[0]] for b in blocks],
                         "high": [high[b[1]] for b in blocks], "pos": [b[2] for b in blocks], "n": [b[3] for b in blocks]})


def fit_isotonic(df: DataFrame, score_col: str, label_col: str, rows_per_bucket: int = 500_000,
                 fan_in: int = 16) -> DataFrame:
    """The fit as blocks: low, high (smallest and largest score), pos, n, value
    (pos / n, strictly rising with low).

    Label 1 counts as positive, any other as negative. Rows with a missing score
    (null, NaN) or label are left out; equal scores are one point. Without rows
    there are no blocks.
    """
    counts = MT.materialized_counts(df, score_col, label_col)
    cut, ranges = MT._bucketize(counts, rows_per_bucket)
    score = F.col("score") + F.lit(0.0)
    blocks = cut.select(F.col("bucket").cast("long").alias("grp"), score.alias("low"), score.alias("high"), "pos",
                        (F.col("pos") + F.col("neg")).alias("n"))
    while True:
        blocks = blocks.groupBy("grp").applyInPandas(_pool_group, _BLOCK)
        if ranges <= 1:
            break
        ranges = -(-ranges // fan_in)
        blocks = blocks.withColumn("grp", F.floor(F.col("grp") / F.lit(fan_in)).cast("long"))
    return materialize(blocks.select("low", "high", "pos", "n", (F.col("pos") / F.col("n")).alias("value")))


def calibrate(df: DataFrame, score_col: str, blocks: DataFrame, out_col: str = "calibrated",
              rows_per_group: int = 1_000_000) -> DataFrame:
    """``df`` with ``out_col``: the value of the last block that begins at or below
    the score, below all blocks the first block's value. Null or NaN scores, and
    an empty fit, give null. All rows stay, repeated ones too.

    Distinct scores look their block up by an as-of join cut into score ranges;
    the rows then join on the score, sorted, so that a hot score can be split.
    """
    if out_col in df.columns:
        raise ValueError(f"the rows have a column named {out_col}")
    score = X.nan_to_null(F.col(score_col).cast("double")) + F.lit(0.0)
    one = F.lit(1).alias("__all")
    points = df.select(score.alias("__score")).dropna().distinct().withColumn("__all", one)
    steps = blocks.select(one, F.col("low").alias("__low"), F.col("value").alias("__value"))
    found = TP.asof_join(points, steps, ["__all"], "__score", "__low", ["__value"], rows_per_group=rows_per_group)
    found = X.attach_scalar(found, "__first", blocks.agg(F.min("value")))
    found = found.select("__score", F.coalesce("__value", "__first").alias(out_col))
    keyed = df.withColumn("__score", score)
    return keyed.join(found.hint("merge"), "__score", "left").select(*df.columns, out_col)
