"""Language identification as multilingual mixture inference.

Per language, Spark counts byte trigrams inside words (words padded with a
space; ASCII lower-cased) over all training texts. A document's trigrams are
taken as drawn from a mixture of these models; expectation-maximisation
estimates the proportions of the languages. Which languages belong to the
mixture is decided by penalised likelihood: languages are added in the order
of their proportions in the full mixture as long as the gain in log likelihood
(a third of it, since trigrams overlap) exceeds ``penalty`` times half the log
of the number of trigrams. The prediction is the language with the largest
proportion, its score that proportion.

The corpus counts cover all training rows and texts whole; what reaches the
driver is one count per language and bucket.

Edge cases: a null text and one without a letter are ``und`` with score 0; a
text whose letters give no known trigram gets the most common language; ties
go to the language that sorts first; null languages are not learned from;
without training rows everything is ``und``; repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as W

BUCKETS = 1 << 14


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (texts x BUCKETS) of the hashed byte trigrams."""
    n = len(offsets) - 1
    cls = W.byte_class("letter")
    low = W.lower_table()[data]
    low[~cls[low]] = 32
    low = np.insert(low, offsets, 32)                 # a space before, after and between texts
    owner = np.repeat(np.arange(n), np.diff(offsets) + 1)
    mid = np.flatnonzero(low[1:-1] != 32) + 1         # of trigrams inside a word or at its ends
    code = ((low[mid - 1].astype(np.uint32) << 16) | (low[mid].astype(np.uint32) << 8) | low[mid + 1])
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(18)
    return np.bincount(owner[mid] * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)


def train(docs: DataFrame, alpha: float = 0.5, text_col: str = "text", lang_col: str = "lang"):
    """(languages, log probabilities BUCKETS x languages, log shares) from all rows."""
    frame = docs.select(F.col(lang_col).cast("string").alias("lang"),
                        F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            for rows, data, offsets in W.slices(b, 1 << 20, rows=256):
                langs = np.array(rows.column("lang").to_pylist(), object)
                counts = gram_counts(data, offsets)
                for lang in set(langs):
                    own = counts[langs == lang]
                    if lang not in total:
                        total[lang], seen[lang] = np.zeros(BUCKETS, np.int64), 0
                    total[lang] += own.sum(axis=0)
                    seen[lang] += len(own)
        for lang in total:      # one small partial result per task and language
            at = np.flatnonzero(total[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()),
                 pa.array(np.r_[at, -1].astype(np.int32)),
                 pa.array(np.r_[total[lang][at], seen[lang]])], ["lang", "bucket", "n"])

    got = (frame.mapInArrow(run, "lang string, bucket int, n bigint")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    col = np.array([place[x] for x in names], np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros((BUCKETS, max(len(langs), 1)))
    grams = bucket >= 0
    counts[bucket[grams], col[grams]] = n[grams]
    shares = np.ones(max(len(langs), 1))
    shares[col[~grams]] = n[~grams]
    return langs, np.log((counts + alpha) / (counts + alpha).sum(axis=0)), np.log(shares / shares.sum())


def _mix(prob, count, head, n, start, rounds):
    """EM for the mixtures of consecutive texts. ``prob``: trigram x language;
    returns (proportions, log likelihoods)."""
    pi = start
    size = np.diff(np.r_[head, len(count)])
    for _ in range(rounds):
        joint = prob * np.repeat(pi, size, axis=0)
        joint *= (count / joint.sum(axis=1))[:, None]
        pi = np.add.reduceat(joint, head, axis=0) / n[:, None]
    like = np.log((prob * np.repeat(pi, size, axis=0)).sum(axis=1)) * count
    return pi, np.add.reduceat(like, head)


def infer(counts: np.ndarray, logp: np.ndarray, prior: np.ndarray, penalty: float = 3.0,
          rounds: int = 12) -> np.ndarray:
    """Proportions (texts x languages) of the selected mixtures."""
    n_docs, n_lang = len(counts), logp.shape[1]
    out = np.zeros((n_docs, n_lang))
    total = counts.sum(axis=1)
    out[total == 0, np.argmax(prior)] = 1.0
    docs = np.flatnonzero(total)
    if not len(docs):
        return out
    row, bucket = np.nonzero(counts[docs])
    count = counts[docs][row, bucket].astype(float)
    head = np.flatnonzero(np.r_[True, np.diff(row) != 0])
    n = total[docs].astype(float)
    log = logp[bucket]
    single = np.add.reduceat(log * count[:, None], head, axis=0) + prior
    best = single.argmax(axis=1)
    out[docs, best] = 1.0
    if n_lang == 1:
        return out
    prob = np.exp(log)
    full, _ = _mix(prob, count, head, n, np.full((len(docs), n_lang), 1.0 / n_lang), rounds)
    full[np.arange(len(docs)), best] += 1.0           # the best single language comes first
    order = np.argsort(-full, axis=1, kind="stable")
    size = np.diff(np.r_[head, len(count)])
    like = (single - prior)[np.arange(len(docs)), best]
    active = np.flatnonzero(full[np.arange(len(docs)), order[:, 1]] > 0.01)
    for m in range(2, n_lang + 1):
        if not len(active):
            break
        take = np.repeat(np.isin(np.arange(len(docs)), active), size)
        chosen = order[active, :m]
        p = np.take_along_axis(prob[take], np.repeat(chosen, size[active], axis=0), axis=1)
        h = np.r_[0, np.cumsum(size[active])[:-1]]
        pi, got = _mix(p, count[take], h, n[active], np.full((len(active), m), 1.0 / m), rounds)
        better = (got - like[active]) / 3 > penalty * 0.5 * np.log(n[active] + 1)
        for i, d in zip(np.flatnonzero(better), active[better]):
            out[docs[d]] = 0
            out[docs[d], chosen[i]] = pi[i]
        like[active[better]] = got[better]
        active = active[better]
        if m < n_lang:
            active = active[full[active, order[active, m]] > 0.01]
    return out


def _has_letter(data, offsets) -> np.ndarray:
    """Whether each text has a letter (ASCII by table, others by Unicode)."""
    n = len(offsets) - 1
    ascii_ = np.zeros(256, bool)
    ascii_[[*range(65, 91), *range(97, 123)]] = True
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ascii_[data], out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode(errors="replace"))
    return out if n else np.zeros(0, bool)


def predict(docs: DataFrame, model, penalty: float = 3.0, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and the mixture (language -> proportion)."""
    langs, logp, prior = model
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((logp, prior))

    def run(batches):
        logp, prior = held.value
        for b in batches:
            for rows, data, offsets in W.slices(b, 1 << 20, rows=256):
                known = _has_letter(data, offsets) if langs else np.zeros(len(offsets) - 1, bool)
                if langs:
                    pi = infer(gram_counts(data, offsets), logp, prior, penalty)
                else:
                    pi = np.zeros((len(known), 1))
                top = pi.argmax(axis=1)
                names = [langs[t] if k else "und" for t, k in zip(top, known)]
                value = np.where(known, np.clip(pi[np.arange(len(top)), top], 0, 1), 0.0)
                mixture = [[(langs[j], float(p[j])) for j in np.flatnonzero(p > 0)] if k else []
                           for p, k in zip(pi, known)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(names, pa.string()), pa.array(value),
                     pa.array(mixture, pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "lang_pred", "score", "mixture"])

    return frame.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(F.coalesce(~held_out(), F.lit(True))))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
