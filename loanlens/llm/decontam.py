"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of every w consecutive
k-grams, so any shared run of ``window = w + k - 1`` words has a fingerprint
in common, at the same place of the run. Document fingerprints are joined with
benchmark fingerprints; every hit carries the words (as 64-bit hashes) that
surround it on both sides, and is extended word by word in both directions.
Runs of at least ``window`` words are hits. An item of fewer words is one
window: for such lengths L, all L-grams of the documents are joined.

Where the benchmark has at most ``max_index`` fingerprints (checked), their
sorted hashes are broadcast and the tasks emit only document fingerprints that
occur there; beyond that size all are emitted and the join alone decides. The
result is the same.

Edge cases: null and empty texts have no words and no hits; null item texts
have no windows; an item without item_id marks words but is not listed; the
same item_id twice is listed once; repeated document rows each get their row;
two different texts under one doc_id are judged separately; extra columns are
ignored; an empty table on either side leaves no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import bytewords as W

FP = "family int, fp bigint, pos int, near array<bigint>, at int"


def _words(data, offsets):
    raw = W.lower_table()[data]
    starts, ends, first = W.find_words(raw, offsets, W.byte_class("alnum"))
    return W.hash_words(raw, starts, ends), first


def _around(h, first, doc, pos, k, side):
    """Flat surroundings of every k-gram: (values, offsets, place of the k-gram)."""
    lo = np.maximum(pos - side, first[doc])
    hi = np.minimum(pos + k + side, first[doc + 1])
    size = hi - lo
    off = np.r_[0, np.cumsum(size)]
    where = np.repeat(lo - off[:-1], size) + np.arange(off[-1])
    return h[where].view(np.int64), off, pos - lo


def _fingerprints(h, first, families, k, window, index):
    """(family, fp, text index, word index in the buffer, flat surroundings)."""
    for family in families:
        n, side = (k, window - k) if family == 0 else (family, 0)
        g, at, doc = W.kgrams(h, first, n)
        if family == 0:
            keep = W.winnow(g, doc, window + 1 - k)
            g, at, doc = g[keep], at[keep], doc[keep]
        if index is not None and len(g):
            known = index[family]
            place = np.minimum(np.searchsorted(known, g.view(np.int64)), max(len(known) - 1, 0))
            keep = known[place] == g.view(np.int64) if len(known) else np.zeros(len(g), bool)
            g, at, doc = g[keep], at[keep], doc[keep]
        yield family, g, at, doc, _around(h, first, doc, at, n, side)


def benchmark_fingerprints(bench: DataFrame, window: int, k: int, id_col: str = "item_id",
                           text_col: str = "text") -> DataFrame:
    """item, family, fp, pos, near, at: family 0 for items of at least
    ``window`` words, else the item's number of words."""
    frame = bench.select(F.col(id_col).cast("string").alias("item"),
                         F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b):
                h, first = _words(data, offsets)
                size = np.diff(first)
                for family in [0, *range(1, window)]:
                    own = (size >= window) if family == 0 else (size == family)
                    if not own.any():
                        continue
                    for _, g, at, doc, (near, off, place) in _fingerprints(h, first, [family], k, window, None):
                        keep = np.flatnonzero(own[doc])
                        near = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(near))
                        yield pa.RecordBatch.from_arrays([
                            rows.column("item").take(pa.array(doc[keep])),
                            pa.array(np.full(len(keep), family, np.int32)),
                            pa.array(g[keep].view(np.int64)),
                            pa.array((at - first[doc])[keep].astype(np.int32)),
                            near.take(pa.array(keep)), pa.array(place[keep].astype(np.int32))],
                            ["item", "family", "fp", "pos", "near", "at"])

    return W.small_batches(frame).mapInArrow(run, "item string, " + FP)


def _in_common(x, y):
    """Length of the common beginning of two arrays."""
    end = F.array_position(F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(end == 0, F.size(x)).otherwise(end - 1).cast("bigint")


def _extended(met: DataFrame, k: int, window: int) -> DataFrame:
    """Hits to word ranges [s, e), extended word by word in both directions;
    document rows (family -1) pass without a range. In DataFrame functions: a
    second Python worker per task would stand beside the one that finds the
    fingerprints."""
    family = F.col("family")
    left = _in_common(F.reverse(F.slice("near", F.lit(1), F.col("at"))),
                      F.reverse(F.slice("b_near", F.lit(1), F.col("b_at"))))
    right = _in_common(F.slice("near", F.col("at") + 1, F.size("near")),
                       F.slice("b_near", F.col("b_at") + 1, F.size("b_near")))
    hit = family >= 0
    met = met.withColumns({"left": F.when(hit, left), "right": F.when(hit, right)})
    found = (hit & (F.col("right") >= F.when(family == 0, k).otherwise(family))
             & (F.col("left") + F.col("right") >= F.when(family == 0, window).otherwise(family)))
    return met.select("doc_id", "version", "n_words", (~hit).cast("int").alias("copy"),
                      F.when(found, F.col("pos") - F.col("left")).alias("s"),
                      F.when(found, F.col("pos") + F.col("right")).alias("e"), "item")


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 13, k: int = 5,
                       share: int = 20, max_index: int = 2_000_000, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, version (hash of the text),
    n_words, n_hit, n_items, items (sorted strings), spans (merged word
    ranges), contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    if not 1 <= k <= window:
        raise ValueError("k is at least 1 and at most the window")
    spark = docs.sparkSession
    items = benchmark_fingerprints(bench, window, k, item_col, item_text_col)
    sizes = {r["family"]: r["n"] for r in items.groupBy("family").agg(F.count("*").alias("n")).collect()}
    families = sorted(sizes)
    held = None
    if sum(sizes.values()) <= max_index:
        got = items.select("family", "fp").distinct().toArrow()       # 12 bytes a row on the driver
        family, fp = got.column("family").to_numpy(), got.column("fp").to_numpy()
        held = spark.sparkContext.broadcast({f: np.sort(fp[family == f]) for f in families})
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(text_col).alias("version"),
                        F.col(text_col).cast("string").alias("text"))

    def run(batches):
        index = held.value if held else None
        for b in batches:
            for rows, data, offsets in W.slices(b):
                h, first = _words(data, offsets)
                n, count = len(offsets) - 1, np.diff(first)
                none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))
                spread = W.mix(rows.column("version").to_numpy().view(np.uint64)).view(np.int64)
                zero = pa.array(np.zeros(n, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("version"), pa.array(count.astype(np.int64)),
                     pa.array(np.full(n, -1, np.int32)), pa.array(spread), zero, none, zero],
                    ["doc_id", "version", "n_words", "family", "fp", "pos", "near", "at"])
                for family, g, at, doc, (near, off, place) in _fingerprints(h, first, families, k, window, index):
                    if not len(g):
                        continue
                    take = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").take(take), rows.column("version").take(take),
                         pa.array(count[doc].astype(np.int64)),
                         pa.array(np.full(len(g), family, np.int32)), pa.array(g.view(np.int64)),
                         pa.array((at - first[doc]).astype(np.int32)),
                         pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(near)),
                         pa.array(place.astype(np.int32))],
                        ["doc_id", "version", "n_words", "family", "fp", "pos", "near", "at"])

    prints = W.small_batches(frame).mapInArrow(run, "doc_id bigint, version bigint, n_words bigint, " + FP)
    b = items.select("family", "fp", "item", F.col("near").alias("b_near"), F.col("at").alias("b_at"))
    # a document row meets no item (family -1) and stays through the left join
    met = prints.join(b, ["family", "fp"], "left").filter("family = -1 or b_near is not null")
    ranges = _extended(met, k, window)
    per = ranges.groupBy("doc_id", "version").agg(
        F.max("n_words").alias("n_words"), F.sum("copy").alias("copies"),
        F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e"))).alias("hits"),
        F.collect_set(F.when(F.col("s").isNotNull(), F.col("item"))).alias("items"))
    return _finish(per, share)


def _finish(per: DataFrame, share: int) -> DataFrame:
    # merged, disjoint ranges in order
    merged = F.aggregate(
        F.array_sort("hits"), F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                                       F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"),
                                                        F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    out = (per.withColumn("spans", merged).withColumn("n_hit", n_hit)
           .withColumn("items", F.array_sort("items"))
           .withColumn("n_items", F.size("items").cast("long"))
           .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))
    again = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")      # repeated rows
    return out.select("doc_id", "version", "n_words", "n_hit", "n_items", "items", "spans",
                      "contaminated", again).drop("copy")


def drop_contaminated(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """``docs`` without the contaminated rows."""
    found = find_contamination(docs, bench, **kw).filter("contaminated").select("doc_id", "version")
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    # written first: its size is then known, and Spark broadcasts it where it is small instead of shuffling texts
    bad = materialize(found.distinct().withColumnsRenamed({"doc_id": "bad_id", "version": "bad_version"}))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["bad_id"])
                     & (F.xxhash64(docs[text_col]) == bad["bad_version"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = find_contamination(docs, bench, window=13, k=5, share=20)
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
      FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
            FROM (SELECT item_id, ws, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0))),
p AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
            FROM d, (SELECT DISTINCT size FROM w) WHERE len(ws) >= size)),
h AS (SELECT doc_id, i, size, item_id FROM p JOIN w USING (size, gram)),
n AS (SELECT doc_id, CAST(count(DISTINCT place) AS BIGINT) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
