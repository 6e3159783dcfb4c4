"""Ranked lexical search: dense blocked matrix products with exact integers.

Every item of a stated query set is scored against all documents. The items
are dealt into groups of at most ``max_postings`` (item, term) entries, so what
a group broadcasts has a bound of its own whatever the size of the query set
(an item with more terms than that is a group by itself). For a group

1. one pass over the texts keeps, per document, its number of terms and the
   frequencies of the terms that occur in the group's items; the pass is
   written to the shared checkpoint folder;
2. document frequencies are counted from that table, and with the totals they
   give one integer weight per term;
3. tiles of documents are laid out as dense float64 impact matrices over a tile
   of a block's compact vocabulary and multiplied with the block's dense
   weight matrix (BLAS). All entries are whole numbers and a tile of the
   vocabulary is cut before the largest possible sum reaches 2**53, so every
   partial sum is exact; tiles are added up as 64-bit integers;
4. each task keeps the best ``k`` documents of every item, ties by the smaller
   doc_id; the tasks' lists are merged in two steps (by hundreds of tasks, then
   all), so that no step sorts more than a bounded number of rows per item.

Edge cases: null and empty texts have no terms and no score; an item without
terms, or whose terms no document holds, has no rows; equal (item_id, text)
rows are one item, different texts under one item_id are ranked separately; a
null item_id is an item like any other; repeated document rows are documents
of their own; rows with a null doc_id stand after others of equal score; extra
columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import bytewords as W

#: largest impact: (10**9 * tf) div (1000 * tf + 20 * m) stays below it
TOP_IMPACT = 1_000_000
EXACT = 1 << 53


def term_array(data: np.ndarray, offsets: np.ndarray):
    """(terms of all texts as one Arrow string array, first term of every text)."""
    raw = W.lower_table()[data]
    cls = W.byte_class("alnum")
    starts, ends, first = W.find_words(raw, offsets, cls)
    cut = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cut[1:])
    kept = raw[cls[raw]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(kept))
    return terms, first


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, terms: the distinct terms of every different (item, text)."""
    frame = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    kind = frame.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b):
                terms, first = term_array(data, offsets)
                lists = pa.array([pc.unique(terms.slice(a, z - a)).to_pylist()
                                  for a, z in zip(first[:-1].tolist(), first[1:].tolist())],
                                 pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column("item"), lists], ["item", "terms"])

    return frame.mapInArrow(run, f"item {kind}, terms array<string>").filter("size(terms) > 0")


def deal_items(terms: DataFrame, max_postings: int):
    """(``terms`` with a group number, number of groups): groups of at most
    ``max_postings`` entries, or of one item."""
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = max(1, -(-total // max_postings))
    while True:
        dealt = terms.withColumn("group", F.pmod(F.xxhash64("item", "terms"), F.lit(groups)).cast("int"))
        over = (dealt.groupBy("group").agg(F.sum(F.size("terms")).alias("n"), F.count(F.lit(1)).alias("items"))
                .filter((F.col("n") > max_postings) & (F.col("items") > 1)))
        if groups == 1 or over.isEmpty():
            return dealt, groups
        groups *= 2


def impacts_table(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tfs: all terms counted, those of ``vocabulary`` (a
    broadcast sorted Arrow array) kept by number."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        known = pa.array(vocabulary.value, pa.large_string())
        for b in batches:
            for rows, data, offsets in W.slices(b):
                terms, first = term_array(data, offsets)
                count = np.diff(first)
                at = pc.index_in(terms, value_set=known)
                at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(count)), count)
                held = at >= 0
                key, tf = np.unique(doc[held] * max(len(known), 1) + at[held], return_counts=True)
                own, term = np.divmod(key, max(len(known), 1))
                lists = np.searchsorted(own, np.arange(len(count) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(count.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(tf.astype(np.int64)))],
                    ["doc_id", "n", "terms", "tfs"])

    return frame.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def document_frequencies(table: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the ``size`` terms: one partial count per
    task, added up by Spark."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(flat(b.column("terms"))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    got = (table.select("terms").mapInArrow(run, "term int, df bigint")
           .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
    out = np.zeros(size, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def flat(lists):
    """(values, offsets) of an Arrow list column, its offsets from 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]], off - off[0]


def length_norms(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """50 + (50 * n * docs) div words, in whole numbers of any size."""
    if not len(n) or not words:
        return np.full(len(n), 50, np.int64)
    if 50 * int(n.max()) * docs < 1 << 63:
        return 50 + 50 * n * docs // words
    return np.array([50 + 50 * int(x) * docs // words for x in n], np.int64)


def vocabulary_tiles(off, terms, weights, lo, hi, tile_terms):
    """Tiles (term numbers, dense weight matrix) of the items lo..hi's own
    vocabulary, each short enough for exact float64 sums."""
    own = terms[off[lo]:off[hi]]
    item = np.repeat(np.arange(hi - lo), np.diff(off[lo:hi + 1]))
    vocabulary = np.unique(own)
    vocabulary = vocabulary[weights[vocabulary] > 0]
    # a tile's sums stay below the sum of its weights times the largest impact
    if len(vocabulary) and int(weights[vocabulary].max()) * TOP_IMPACT >= EXACT:
        raise ValueError("a weight is too large for exact products")
    a = 0
    while a < len(vocabulary):
        reach = np.cumsum(weights[vocabulary[a:a + tile_terms]])
        b = a + max(1, int(np.searchsorted(reach, (EXACT - 1) // TOP_IMPACT, side="right")))
        part = vocabulary[a:b]
        place = np.minimum(np.searchsorted(part, own), len(part) - 1)
        hit = part[place] == own
        dense = np.zeros((len(part), hi - lo))
        dense[place[hit], item[hit]] = weights[own[hit]]
        yield part, dense
        a = b


class Best:
    """The best ``k`` (score, doc) of every item seen so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)       # a score below it cannot enter
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.missing = np.zeros(0, bool)

    def offer(self, lo: int, scores: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        """``scores``: documents x items from item ``lo`` on."""
        d, i = np.nonzero(scores >= self.least[lo:lo + scores.shape[1]])
        if not len(d):
            return
        item = np.concatenate((self.item, i + lo))
        score = np.concatenate((self.score, scores[d, i]))
        ids = np.concatenate((self.doc, doc[d]))
        none = np.concatenate((self.missing, missing[d]))
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        head = np.searchsorted(item, item)          # first row of the item
        keep = np.arange(len(item)) - head < self.k
        order = order[keep]
        self.item, self.score, self.doc, self.missing = item[keep], score[order], ids[order], none[order]
        heads, size = np.unique(self.item, return_counts=True)
        full = size == self.k
        last = np.searchsorted(self.item, heads[full], side="right") - 1
        self.least[heads[full]] = np.maximum(1, self.score[last])


def best_of_tasks(table: DataFrame, held, kind: str, k: int, n_docs: int, n_words: int,
                  tile_docs: int = 1024, tile_terms: int = 2048, block_items: int = 256) -> DataFrame:
    """item number, part, doc_id, score: every task's best documents."""
    def run(batches):
        from pyspark import TaskContext

        off, terms, weights = held.value
        items = len(off) - 1
        best = Best(items, k)
        for b in batches:
            ids = b.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            m = length_norms(b.column("n").to_numpy(), n_docs, n_words)
            term, cut = flat(b.column("terms"))
            tf, _ = flat(b.column("tfs"))
            size = np.diff(cut)
            impact = (10**9 * tf // (1000 * tf + 20 * np.repeat(m, size))).astype(np.float64)
            for lo in range(0, len(doc), tile_docs):
                hi = min(len(doc), lo + tile_docs)
                t, x = term[cut[lo]:cut[hi]], impact[cut[lo]:cut[hi]]
                row = np.repeat(np.arange(hi - lo), size[lo:hi])
                for first in range(0, items, block_items):
                    last = min(items, first + block_items)
                    scores = np.zeros((hi - lo, last - first), np.int64)
                    for part, dense in vocabulary_tiles(off, terms, weights, first, last, tile_terms):
                        place = np.minimum(np.searchsorted(part, t), len(part) - 1)
                        hit = part[place] == t
                        tile = np.zeros((hi - lo, len(part)))
                        tile[row[hit], place[hit]] = x[hit]
                        scores += (tile @ dense).astype(np.int64)
                    best.offer(first, scores, doc[lo:hi], missing[lo:hi])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)),
             pa.array(np.full(len(best.item), TaskContext.get().partitionId(), np.int32)),
             pa.array(best.doc, mask=best.missing), pa.array(best.score)],
            ["number", "part", "doc_id", "score"])
        W.release()

    return table.mapInArrow(run, "number int, part int, doc_id bigint, score bigint")


def _top(rows: DataFrame, by: list, k: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, max_postings: int = 2_000_000,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", fan_in: int = 256) -> DataFrame:
    """item, rank (from 1), doc_id, score of every item's ``k`` best documents."""
    spark = docs.sparkSession
    dealt, groups = deal_items(materialize(item_terms(items, item_col, item_text_col)), max_postings)
    out = []
    for g in range(groups):
        got = dealt.filter(F.col("group") == g).select("item", "terms").toArrow()
        lists = got.column("terms").combine_chunks().cast(pa.list_(pa.large_string()))
        vocabulary = pc.unique(lists.flatten()).sort() if len(got) else pa.array([], pa.large_string())
        _, off = flat(lists) if len(got) else (None, np.zeros(1, np.int64))
        numbers = pc.index_in(lists.flatten(), value_set=vocabulary).to_numpy().astype(np.int32) if len(got) \
            else np.zeros(0, np.int32)
        known = spark.sparkContext.broadcast(vocabulary.to_pylist())
        table = materialize(impacts_table(docs, known, id_col, text_col))
        stats = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(table, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * stats[0] + 2) / (2 * x + 1))) for x in df.tolist()],
                           np.int64)
        held = spark.sparkContext.broadcast((off, numbers, weights))
        rows = best_of_tasks(table, held, "bigint", k, stats[0], stats[1])
        rows = _top(rows.withColumn("step", F.floor(F.col("part") / fan_in)), ["number", "step"], k, "rank")
        rows = _top(rows.drop("rank", "step", "part"), ["number"], k, "rank")
        kind = dealt.schema["item"].dataType
        names = spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(got)), pa.int32()),
                                                "item": got.column("item")}))
        names = names.select("number", F.col("item").cast(kind).alias("item"))
        out.append(rows.join(names, "number").select("item", F.col("rank").cast("int").alias("rank"),
                                                     "doc_id", "score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(docs, items, k=50).withColumnRenamed("item", "item_id")


_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_TERM}) AS ws FROM documents),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_TERM}))) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT CAST(count(*) FILTER (WHERE len(ws) > 0) AS BIGINT) AS n_docs,
             CAST(sum(len(ws)) AS BIGINT) AS n_words FROM d),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM f
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, s GROUP BY term, n_docs),
sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))
              AS BIGINT) AS score
       FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
             doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
