"""Toxicity: a counterfactually regularised logistic classifier.

Features are the different words of a text and their beginnings of 3 to 7
bytes (lower-cased, told apart by 64-bit hashes), so that inflected forms of
an abusive stem count together. From the labelled training rows Spark counts
in how many texts of each label every feature occurs; those in at least
``min_docs`` texts are ranked by how far the two rates lie apart (a
two-proportion z score), the first ``max_words`` and those of the identity
terms are kept, and a logistic regression is fitted to them. For every training text with identity terms a twin is made in
which each term is swapped for the next of its group; the loss has the squared
change of the linear score between a text and its twin, so that a text scores
alike whichever group it mentions.

Fitting uses at most about ``max_rows`` labelled rows, chosen by a hash of the
id (the documented bound); scoring reads every text whole, in one pass without
a shuffle.

Edge cases: null and empty texts have no words and get the score of the
intercept; labels that are null, or of unknown documents, are not used; a
document labelled more than once counts as its largest label; without labels
of both kinds the score is the smoothed share of label 1, (n1 + 0.5) / (n + 2),
for every text;
repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import bytewords as W

#: groups of identity terms; a term is swapped for the next one of its group
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("disabled", "abled"),
    ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"),
)

#: lengths in bytes of the word beginnings that are features of their own
STEMS = (3, 4, 5, 6, 7)
#: text bytes handled at a time: words and their beginnings take some 200 times as much
SLICE = 1 << 19


@dataclass
class ToxicityModel:
    """Sorted word hashes, their weights and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float
    near: np.ndarray = field(repr=False, default=None)

    def __post_init__(self):
        # 16-bit sieve: most words of a text are not in the model
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts of a byte buffer."""
        h, doc = word_hashes(data, offsets)
        z = np.full(len(offsets) - 1, self.intercept)
        if len(h) and len(self.words):
            at = np.flatnonzero(self.near[(h & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
            hit = self.words[place] == h[at]
            pair = np.unique(doc[at[hit]] * len(self.words) + place[hit])
            z += np.bincount(pair // len(self.words), weights=self.weights[pair % len(self.words)],
                             minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def word_hashes(data, offsets, stems=STEMS):
    """(hash, text) of every word and word beginning, words first."""
    raw = W.lower_table()[data]
    starts, ends, first = W.find_words(raw, offsets, W.byte_class("alnum"))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h, owner = [W.hash_words(raw, starts, ends)], [doc]
    for m in stems:
        long = np.flatnonzero(ends - starts > m)
        h.append(W.mix(W.hash_words(raw, starts[long], starts[long] + m) + np.uint64(m)))
        owner.append(doc[long])
    return np.concatenate(h), np.concatenate(owner)


def hash_terms(terms, stems=()) -> np.ndarray:
    raw = " ".join(terms).encode()
    return word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), stems)[0]


def swapper(groups):
    """Function that swaps every identity term of a text for the next of its group."""
    after = {g[i]: g[(i + 1) % len(g)] for g in groups for i in range(len(g))}
    if not after:
        return lambda text: text
    # the words of the features: a term stands alone between other bytes
    pattern = re.compile(r"(?<![0-9a-z\x80-\U0010ffff])(?:" + "|".join(map(re.escape, after))
                         + r")(?![0-9a-z\x80-\U0010ffff])", re.I | re.A)
    return lambda text: pattern.sub(lambda m: after[m[0].lower()], text)


def _training_rows(docs: DataFrame, labels: DataFrame, groups, max_rows: int, id_col, text_col, label_col):
    """label, words (different hashes), twin (hashes after the swap; null
    where a text has no identity term), written once."""
    one = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    one = materialize(one)
    total = one.count()
    share = min(1.0, max_rows / max(total, 1))
    # the bound: about max_rows rows whatever the number of labels
    picked = one.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < int(share * 1_000_003))
    frame = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(picked), "__id").select("label", "text"))
    swap = swapper(groups)

    def features(texts):
        data, offsets = W.buffers(pa.array(texts, pa.large_string()))
        h, doc = word_hashes(data, offsets)
        order = np.argsort(doc, kind="stable")
        return [np.unique(x).view(np.int64) for x in
                np.split(h[order], np.searchsorted(doc[order], np.arange(1, len(texts))))]

    def run(batches):
        for b in batches:
            for rows, _, _ in W.slices(b, SLICE):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                words, twins = features(texts), [None] * len(texts)
                changed = [(i, s) for i, (t, s) in enumerate(zip(texts, map(swap, texts))) if s != t]
                if changed:
                    for (i, _), x in zip(changed, features([s for _, s in changed])):
                        twins[i] = x
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("label"), pa.array(words, kind), pa.array(twins, kind)],
                    ["label", "words", "twin"])

    return materialize(W.small_batches(frame).mapInArrow(run, "label int, words array<bigint>, twin array<bigint>"))


def _optimise(rows, cols, y, n_words, twin_rows, twin_cols, twin_sign, n_twins, l2, swap_weight,
              steps, positive_weight):
    """Full-batch Adam on weighted mean log loss + l2/2 |w|^2 + swap_weight * mean
    squared score change; the step falls to zero over its second half."""
    n = len(y)
    weight = np.where(y > 0, positive_weight, 1.0)
    weight /= weight.sum()
    w = np.zeros(n_words + 1)                     # the intercept comes last
    first, second, beta1, beta2 = np.zeros_like(w), np.zeros_like(w), 0.9, 0.99
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, weights=w[cols], minlength=n)
        d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g = np.append(np.bincount(cols, weights=d[rows], minlength=n_words) + l2 * w[:-1], d.sum())
        if n_twins:
            change = np.bincount(twin_rows, weights=twin_sign * w[twin_cols], minlength=n_twins)
            g[:-1] += 2 * swap_weight / n_twins * np.bincount(
                twin_cols, weights=twin_sign * change[twin_rows], minlength=n_words)
        first = beta1 * first + (1 - beta1) * g
        second = beta2 * second + (1 - beta2) * g * g
        rate = 0.1 * min(1.0, 2 * (1 - t / (steps + 1)))
        w = w - rate * (first / (1 - beta1 ** t)) / (np.sqrt(second / (1 - beta2 ** t)) + 1e-10)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, max_rows: int = 12_000,
          max_words: int = 4096, min_docs: int = 5, l2: float = 1e-4, swap_weight: float = 1.0,
          steps: int = 400, positive_weight: float = 2.0, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> ToxicityModel:
    """Fit on the labelled rows given (callers leave held-out rows out)."""
    rows = _training_rows(docs, labels, groups, max_rows, id_col, text_col, label_col)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not pos or not neg:
        p = (pos + 0.5) / (pos + neg + 2)
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    counts = (rows.select((F.col("label") == 1).cast("long").alias("y"), F.explode("words").alias("word"))
              .groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
              .filter(F.col("p") + F.col("n") >= min_docs))
    a, b = F.col("p") / F.lit(pos), F.col("n") / F.lit(neg)
    rate = (F.col("p") + F.col("n") + 1) / F.lit(pos + neg + 2)
    z = F.abs(a - b) / F.sqrt(rate * (1 - rate) * F.lit(1 / pos + 1 / neg))
    top = counts.select("word", z.alias("z")).orderBy(F.desc("z"), "word").limit(max_words)
    chosen = np.array([r["word"] for r in top.collect()], np.int64).view(np.uint64)
    words = np.unique(np.concatenate((chosen, hash_terms([t for g in groups for t in g], STEMS))))
    kept = words.view(np.int64)

    def reduce(batches):
        known = np.sort(kept)
        back = np.argsort(kept, kind="stable")

        def to_cols(values):
            if values is None:
                return None
            v = np.array(values, np.int64)
            at = np.minimum(np.searchsorted(known, v), len(known) - 1)
            return back[at[known[at] == v]].astype(np.int32)

        kind = pa.list_(pa.int32())
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(map(to_cols, b.column("words").to_pylist()), kind),
                 pa.array(map(to_cols, b.column("twin").to_pylist()), kind)], ["label", "words", "twin"])

    got = W.small_batches(rows).mapInArrow(reduce, "label int, words array<int>, twin array<int>").toArrow()
    y = (got.column("label").to_numpy() == 1).astype(float)
    lists = got.column("words").combine_chunks()
    cols = lists.flatten().to_numpy()
    r = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    tr, tc, ts, n_twins = [], [], [], 0
    for own, twin in zip(lists, got.column("twin").combine_chunks()):
        if twin.is_valid:
            own, twin = np.array(own.as_py()), np.array(twin.as_py())
            for c, s in ((np.setdiff1d(own, twin), 1.0), (np.setdiff1d(twin, own), -1.0)):
                tr += [n_twins] * len(c)
                tc += c.tolist()
                ts += [s] * len(c)
            n_twins += 1
    order = np.argsort(r * len(words) + cols, kind="stable")      # row order of the collect is not fixed
    w, b0 = _optimise(r[order], cols[order], y, len(words), np.array(tr, np.int64), np.array(tc, np.int64),
                      np.array(ts), n_twins, l2, swap_weight, steps, positive_weight)
    return ToxicityModel(words, w, float(b0))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Rows whose crc32(id as text) leaves the remainder ``fold``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (score >= 0.5) for every row."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b, SLICE):
                s = model.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    return W.small_batches(frame).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; rows pass as they are."""
    schema = docs.schema

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b, SLICE, text_col):
                yield rows.filter(pa.array(model.score(data, offsets) < 0.5))

    return W.small_batches(docs).mapInArrow(run, schema)


def train_fold(docs: DataFrame, labels: DataFrame, **kw) -> ToxicityModel:
    """Fitted on the labels whose document is not held out."""
    return train(docs, labels.filter(~held_out()), **kw)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
