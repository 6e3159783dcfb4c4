"""Target-distribution importance resampling over hashed word runs.

Two corpora, the raw documents and the target texts, are reduced to counts of
hashed features; a document's weight is the sum, over its features, of the log
ratio of the two smoothed distributions; adding seeded Gumbel noise to the
weights and taking the highest scores draws without replacement in proportion
to the exponential of the weights.

Words come from bytes: a 256-entry table lower-cases A-Z and blanks every
separator of the UTF-8 text, ``bytes.split`` yields the words. A run's hash is
a CRC-32 carried on from the hash of the run without its last word. Counters
reduce a text before anything is looked up, so each different word of a piece
is hashed once. Long texts are taken in pieces of bounded size that carry the
last words over the cut.

The bucket counts are one partial sum per task, added up by Spark; the gains
(one number per bucket, a parameter) are all that is broadcast. Ranks come
from a range partitioning of (score, doc_id): rows per range are counted, and
each range numbers its own rows from its offset. A column of row hashes
breaks ties between repeated rows, so that such a group can be split too.

Edge cases: null and empty texts have no features and weight 0; a null doc_id
takes the noise of the empty id and stands after others of equal score;
repeated rows get equal scores and ranks of their own; extra columns are
ignored; empty documents give an empty result, an empty target weighs by the
raw distribution alone.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import bytewords as W

#: A-Z lower-cased, 0-9, a-z and non-ASCII bytes kept, all else blank
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def pieces(data: bytes, limit: int = 1 << 20):
    """``data`` cut at blanks into pieces of about ``limit`` bytes."""
    lo = 0
    while len(data) - lo > limit:
        cut = data.rfind(b" ", lo + 1, lo + limit)
        if cut < 0:
            cut = data.find(b" ", lo + limit)
            if cut < 0:
                break
        yield data[lo:cut]
        lo = cut
    yield data[lo:] if lo else data


def features(data: bytes, order: int = 1, limit: int = 1 << 20):
    """(words, Counter of CRC-32 values of the runs of 1 to ``order`` words),
    one pair per piece of a text."""
    tail: list[bytes] = []
    for piece in pieces(data.translate(TABLE), limit):
        words = piece.split()
        count: Counter = Counter()
        for word, n in Counter(words).items():
            count[crc32(word)] += n
        if order > 1:
            run = tail + words
            seeds = [crc32(word) for word in run]
            for j in range(1, order):
                seeds = [crc32(b" " + word, seed) for word, seed in zip(run[j:], seeds)]
                count.update(seeds[max(0, len(tail) - j):])      # runs that end in this piece
            tail = run[max(0, len(run) - order + 1):]
        yield len(words), count


def _texts(table):
    for rows, data, offsets in W.slices(table):
        cut = offsets.tolist()
        yield rows, [data[a:z].tobytes() for a, z in zip(cut, cut[1:])]


def _arrays(count: Counter, buckets: int):
    n = len(count)
    return (np.fromiter(count.keys(), np.int64, n) % buckets, np.fromiter(count.values(), np.int64, n))


def bucket_counts(texts: DataFrame, buckets: int, order: int = 1, text_col: str = "text") -> np.ndarray:
    """Features of all texts per bucket."""
    frame = texts.select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, group in _texts(b):
                for data in group:
                    for _, count in features(data, order):
                        at, n = _arrays(count, buckets)
                        np.add.at(total, at, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    got = (frame.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed distributions) per bucket."""
    size = len(raw)
    below, above = float(raw.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * below / ((s + 1.0) * above)))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains, order: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, tie (a hash of the row's place)."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        gain, seen = gains.value, 0
        place = np.uint64(TaskContext.get().partitionId()) << np.uint64(40)
        for b in batches:
            for rows, group in _texts(b):
                out = np.zeros((3, len(group)), np.int64)
                for i, data in enumerate(group):
                    for n_words, count in features(data, order):
                        at, n = _arrays(count, len(gain))
                        out[:, i] += n_words, n.sum(), gain[at] @ n
                tie = W.mix(place + np.arange(seen, seen + len(group), dtype=np.uint64)).view(np.int64)
                seen += len(group)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *map(pa.array, out), pa.array(tie)],
                    ["doc_id", "n_words", "n_features", "weight", "tie"])

    return frame.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, tie bigint")


def gumbel(seed: int, doc_id) -> "F.Column":
    """floor(-1000 ln(-ln u)) for the number u in (0, 1) that seed and id give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def rank_highest(rows: DataFrame, draw: int) -> DataFrame:
    """``rows`` with rank 1..draw by (score, doc_id); null for the others."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
               .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")))
    placed = dealt.join(F.broadcast(offsets), "part")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    inside = placed.filter(F.col("offset") < draw).withColumn("rank", F.col("offset") + own)
    outside = placed.filter(F.col("offset") >= draw).withColumn("rank", F.lit(None).cast("long"))
    return inside.unionByName(outside).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = 10000,
             order: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: ``percent`` of the
    documents of at least ``min_words`` words are drawn and ranked."""
    raw = bucket_counts(docs, buckets, order, text_col)
    gains = bucket_gains(raw, bucket_counts(target, buckets, order, target_text_col))
    held = docs.sparkSession.sparkContext.broadcast(gains)
    rows = weigh(docs, held, order, id_col, text_col)
    rows = materialize(rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))))
    able = rows.filter(F.col("n_words") >= min_words)
    ranked = rank_highest(able, percent * able.count() // 100)
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(rest.select(names))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = resample(docs, target, percent=10, min_words=20, buckets=10000, order=1, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

# CRC-32 by its table of 256 remainders (reflected polynomial 0xEDB88320)
ORACLE = f"""
WITH RECURSIVE tab(i, step, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END
  FROM tab WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE step = 8),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY ALL),
words AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bucket AS (SELECT word, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x) // 2 + 1),
                 lambda i: CAST('0x' || substr(x, CAST(2 * i - 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM words, crc),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM dw JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM bw JOIN bucket USING (word) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))
                             AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), tot),
w AS (SELECT doc_id, sum(n * gain) AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
sc AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8)
       AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able
      FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM sc LEFT JOIN r USING (doc_id)
"""
