"""G7 best-first: boosted trees that grow leaf by leaf under a leaf budget.

Features are cut into at most ``max_bins`` quantile bins. A tree is grown from sums of
the logistic loss's first and second derivatives, grouped by (node, feature, bin)
with partial aggregation: whatever the rows, a node's sums are features x bins
rows, the best cut of a node is found in the tasks, and one row per node comes
back. The leaf with the greatest gain is split next. So that not every split
costs a pass over the rows, one pass looks at the children of all current leaves;
the order of the splits is the same.

Derivatives are summed as whole numbers (units of 2^-30, for up to 8 x 10^9 rows), so a
fit does not depend on how the rows are partitioned, nor on a task that runs
again. After each tree the bins and the margins are a table in the shared
checkpoint folder.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import materialize

UNIT = 2.0 ** 30


def feature_cuts(df: DataFrame, features: list[str], max_bins: int) -> dict[str, list[float]]:
    """Ascending cut points per feature (approximate quantiles of its values, at most
    ``max_bins`` - 1); a feature without values has none and is left out."""
    probs = [i / max_bins for i in range(1, max_bins)]
    got = df.select(*[X.nan_to_null(F.col(c).cast("double")).alias(c) for c in features]).approxQuantile(
        list(features), probs, 0.25 / max_bins)
    return {c: sorted(set(q)) for c, q in zip(features, got) if q}


def binned(df: DataFrame, cuts: dict[str, list[float]], names: list[str]) -> DataFrame:
    """``df`` with a bin per feature: 0 for a missing value, else 1 + how many cuts are at
    or below the value."""
    values = {f"__x{i}": X.nan_to_null(F.col(c).cast("double")) for i, c in enumerate(cuts)}
    out = Bucketizer(inputCols=list(values), outputCols=[f"__y{i}" for i in range(len(cuts))], handleInvalid="keep",
                     splitsArray=[[float("-inf"), *q, float("inf")] for q in cuts.values()]).transform(df.withColumns(values))
    bins = {b: F.when(F.col(f"__x{i}").isNull(), 0).otherwise(F.col(f"__y{i}") + 1).cast("int") for i, b in enumerate(names)}
    return out.withColumns(bins).drop(*values, *[f"__y{i}" for i in range(len(cuts))])


def best_cuts(rows: DataFrame, bins: list[str], reg: float, min_rows: int) -> DataFrame:
    """Per node of ``rows`` (node, g, h, bins): n, sum_g, sum_h, and the cut of greatest
    gain as f, b, gain (bins <= b go left). Both sides hold at least ``min_rows``
    rows; equal gains go to the first feature, then to the lowest bin; a node without
    a cut has nulls."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("b")) for i, c in enumerate(bins)])
    hist = rows.select("node", "g", "h", F.inline(pairs)).groupBy("node", "f", "b").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("node", "f")                 # at most max_bins + 1 rows
    left = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.select("node", "f", "b", *[F.sum(c).over(w).alias(f"{s}{c}") for s, w in (("l", left), ("t", whole))
                                       for c in ("g", "h", "n")])

    def term(g: Column, h: Column) -> Column:
        g = g.cast("double") / UNIT
        return g * g / (h.cast("double") / UNIT + F.lit(float(reg)))

    gain = (term(F.col("lg"), F.col("lh")) + term(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh"))
            - term(F.col("tg"), F.col("th")))
    able = (F.col("ln") >= min_rows) & (F.col("tn") - F.col("ln") >= min_rows)
    cut = F.when(able, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b")))
    got = x.groupBy("node").agg(F.max("tn").alias("n"), F.max("tg").alias("sum_g"), F.max("th").alias("sum_h"),
                                F.max(cut).alias("c"))
    return got.select("node", "n", "sum_g", "sum_h", (-F.col("c.f")).alias("f"), (-F.col("c.b")).alias("b"), "c.gain")


def _place(nodes: dict, bins: list[str], split, end, i: int = 0) -> Column:
    """Column that follows the cuts of the nodes for which ``split`` holds, and gives
    ``end`` of the node it arrives at."""
    if not split(i):
        return end(i)
    n = nodes[i]
    return (F.when(F.col(bins[n["f"]]) <= n["b"], _place(nodes, bins, split, end, 2 * i + 1))
            .otherwise(_place(nodes, bins, split, end, 2 * i + 2)))


def grow_tree(rows: DataFrame, bins: list[str], leaves: int, reg: float, min_rows: int, rate: float) -> dict:
    """{node: {f, b}} of the split nodes and {node: {value}} of the leaves; the children
    of node i are 2i + 1 and 2i + 2. ``rows`` has g, h and the bins."""
    nodes: dict[int, dict] = {}

    def look(ids: list[int], opened: set[int]) -> None:
        at = _place(nodes, bins, lambda i: i in opened, lambda i: F.lit(i).cast("long"))
        placed = rows.withColumn("node", at).filter(F.col("node").isin(ids))
        # bounded: one row per node, at most twice the leaf budget
        nodes.update({r["node"]: r.asDict() for r in best_cuts(placed, bins, reg, min_rows).collect()})

    look([0], set())
    if not nodes:
        return {0: {"value": 0.0}}
    frontier, inner = [0], set()
    while len(frontier) < leaves:
        able = [i for i in frontier if nodes[i]["gain"] is not None and nodes[i]["gain"] > 0]
        if not able:
            break
        top = max(able, key=lambda i: (nodes[i]["gain"], -i))
        if 2 * top + 1 not in nodes:
            ahead = [i for i in able if 2 * i + 1 not in nodes]
            look([c for i in ahead for c in (2 * i + 1, 2 * i + 2)], inner | set(ahead))
        frontier.remove(top)
        inner.add(top)
        frontier += [2 * top + 1, 2 * top + 2]
    out = {i: {"f": nodes[i]["f"], "b": nodes[i]["b"]} for i in inner}
    for i in frontier:
        out[i] = {"value": -rate * (nodes[i]["sum_g"] / UNIT) / (nodes[i]["sum_h"] / UNIT + reg)}
    return out


def _margin(tree: dict, bins: list[str]) -> Column:
    return _place(tree, bins, lambda i: "f" in tree[i], lambda i: F.lit(float(tree[i]["value"])))


class LeafwiseModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``score`` (P(class 1)) and ``prediction`` (score >= threshold). Missing and new
    values fall into the bins of the fit."""

    model = Param(Params._dummy(), "model", "cuts, start and trees as JSON", typeConverter=TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "score >= threshold -> 1", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, model=None, threshold=0.5):
        super().__init__()
        self._setDefault(threshold=0.5)
        self._set(**self._input_kwargs)

    def trees(self) -> list[dict]:
        return [{int(i): n for i, n in t.items()} for t in json.loads(self.getOrDefault(self.model))["trees"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        m = json.loads(self.getOrDefault(self.model))
        names = [f"__bin{i}" for i in range(len(m["cuts"]))]
        out = binned(df, m["cuts"], names) if names else df
        z = F.lit(float(m["start"]))
        for tree in self.trees():
            z = z + _margin(tree, names)
        out = out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop(*names)
        return out.withColumn("prediction", (F.col("score") >= self.getOrDefault(self.threshold)).cast("double"))


def fit_leafwise(df: DataFrame, features: list[str], label: str, trees: int = 20, leaves: int = 15, rate: float = 0.1,
                 reg: float = 1.0, max_bins: int = 64, min_rows: int = 20, threshold: float = 0.5) -> LeafwiseModel:
    """Boosted best-first trees for label 1 against any other; rows without a label are left
    out. Numeric features only (encode text first); nulls and NaN are a bin of their
    own, below all values. Leaf values are -rate x sum of first derivatives / (sum of
    second derivatives + reg). With one class only, or no rows, there are no
    splits and every score is the smoothed share of label 1.
    """
    if leaves < 2:
        raise ValueError("a tree has at least two leaves")
    rows = df.filter(F.col(label).isNotNull())
    cuts = feature_cuts(rows, features, max_bins)
    names = [f"__bin{i}" for i in range(len(cuts))]
    y = (F.col(label) == 1).cast("int").alias("__y")
    data = materialize((binned(rows, cuts, names) if names else rows).select(y, *names))
    n, pos = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("__y"), F.lit(0))).first()
    start = float(data.sparkSession.range(1).select(F.log(F.lit((pos + 0.5) / (n - pos + 0.5)))).first()[0])
    data, grown = data.withColumn("__z", F.lit(start)), []
    for k in range(trees if names and 0 < pos < n else 0):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__z")))
        slopes = data.withColumns({"g": F.round((p - F.col("__y")) * UNIT).cast("long"),
                                   "h": F.round(p * (F.lit(1.0) - p) * UNIT).cast("long")})
        tree = grow_tree(slopes, names, leaves, reg, min_rows, rate)
        grown.append(tree)
        if len(tree) == 1:
            break
        if k + 1 < trees:
            data = materialize(data.withColumn("__z", F.col("__z") + _margin(tree, names)))
    return LeafwiseModel(model=json.dumps({"cuts": cuts, "start": start, "trees": grown}), threshold=threshold)
