"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: 64 bits over word shingles; a bit is set when it is set in more
than half of the shingle hashes. Two fingerprints link when at most
``max_bits`` bits differ. The fingerprint is cut into ``blocks`` blocks; two
that differ in at most d bits agree on some ``blocks - d`` blocks, so joining
on every choice of that many blocks finds every close pair; the Hamming
distance is then verified.

Copies never meet as pairs: equal fingerprints are one node. A block bucket
with more than ``hot_bucket`` different fingerprints is not paired either. Its
members are linked exactly through balls: with d = 2, two fingerprints are
close if and only if some 64-bit point differs from each of them in at most
one bit; every member emits its 65 points, and a point has at most 65
neighbours, whatever the data. With d = 1 the points are (i, fingerprint with
bit i cleared), shared by two at most. Nothing is dropped either way. Distances
over 2 are refused.

The nodes are the fingerprints themselves, so two texts under one doc_id are
two nodes, and rows without an id link and bridge like all others.

Edge cases: a null or empty text has the zero fingerprint and links like any
other; repeated rows are one node and each gets its row; a row with a null
doc_id gets the smallest non-null doc_id reachable, null if there is none;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import bytewords as W

SEED = 42


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of every text of an Arrow column."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data, offsets = W.buffers(texts)
    out = np.zeros(len(offsets) - 1, np.uint64)
    cls, low = W.byte_class("nonspace"), W.lower_table()
    for i in range(len(out)):
        raw = low[data[offsets[i]:offsets[i + 1]]]
        starts, ends, _ = W.find_words(raw, np.array([0, len(raw)]), cls)
        n = len(starts)
        if n == 0:
            continue
        if np.any(starts[1:] - ends[:-1] != 1) or np.any(raw[ends[:-1]] != 32):
            # runs of white space: join the words with one space each
            text = b" ".join(raw.tobytes().split())
            sizes = ends - starts + 1
            ends = np.cumsum(sizes) - 1
            starts = ends - sizes + 1
        else:
            text = raw.tobytes()
        k = min(shingle, n)
        count = np.zeros(64, np.int64)
        m = n - k + 1
        for lo in range(0, m, 1 << 16):      # bounded working memory for very long texts
            hi = min(m, lo + (1 << 16))
            h = np.fromiter((digest(text[a:b], SEED) for a, b in
                             zip(starts[lo:hi].tolist(), ends[lo + k - 1:hi + k - 1].tolist())),
                            np.uint64, hi - lo)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * count > m, bitorder="little").view(np.uint64)[0]
    return out


def signatures(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, version, fp bigint): one row per row of ``docs``; version is a
    hash of the text."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_version(F.col(text_col)).alias("version"),
                        F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fp = fingerprints_of(b.column("text"), shingle)
            W.release()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("version"), pa.array(fp.view(np.int64))], ["doc_id", "version", "fp"])

    return W.small_batches(frame).mapInArrow(run, "doc_id bigint, version bigint, fp bigint")


def text_version(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """One bit mask for every choice of blocks - max_bits of the blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(one, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, max_bits: int = 2, blocks: int = 5,
          hot_bucket: int = 64) -> DataFrame:
    """Edges (a, b) whose connected components are those of "at most
    ``max_bits`` differing bits". ``nodes``: (node bigint, fp bigint), one row
    per distinct fingerprint, to be read several times."""
    if not 0 <= max_bits <= 2 or blocks <= max_bits:
        raise ValueError("max_bits is 0, 1 or 2, and blocks is larger")
    masks = block_masks(blocks, max_bits)
    keyed = nodes.select("node", "fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = materialize(keyed.join(sizes, ["choice", "key"]))
    small = met.filter(F.col("members") <= hot_bucket).select("choice", "key", "node", "fp")
    a, b = small.alias("a"), small.alias("b")
    pairs = (a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key"))
                    & (F.col("a.fp") < F.col("b.fp")))
             .filter(hamming(F.col("a.fp"), F.col("b.fp")) <= max_bits)
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    hot = met.filter(F.col("members") > hot_bucket).select("node", "fp").distinct()
    own = F.struct(F.lit(-1).alias("bit"), F.col("fp").alias("rest"))
    if max_bits == 2:
        flips = [own] + [F.struct(F.lit(-1).alias("bit"), F.col("fp").bitwiseXOR(
            F.lit(_signed(1 << i))).alias("rest")) for i in range(64)]
    elif max_bits == 1:
        flips = [F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(
            F.lit(_signed(~(1 << i) & (1 << 64) - 1))).alias("rest")) for i in range(64)]
    else:
        flips = [own]
    points = hot.select("node", F.explode(F.array(*flips)).alias("point"))
    first = points.groupBy("point").agg(F.min("node").alias("b"), F.max("node").alias("top"),
                                        F.collect_list("node").alias("all")).filter("b < top")
    stars = first.select(F.explode("all").alias("a"), "b").filter("a != b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node
    reachable. Alternating large-star and small-star steps; every step is two
    shuffles of the remaining edges, written to the checkpoint folder."""
    e = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"),
                                                  F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        e1 = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
              .filter("a != b").distinct())
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        moved = e1.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        got = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == state:
            break
        state = got
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _grouped(docs: DataFrame, shingle: int, max_bits: int, blocks: int, hot_bucket: int, id_col: str,
             text_col: str) -> tuple[DataFrame, DataFrame]:
    """(signatures, (fp, root) of the fingerprints that link with others)."""
    sig = materialize(signatures(docs, shingle, id_col, text_col))
    nodes = materialize(sig.select("fp").distinct().select("fp", F.col("fp").alias("node")))
    comp = materialize(components(links(nodes, max_bits, blocks, hot_bucket)))
    return sig, comp.select(F.col("node").alias("fp"), F.col("component").alias("root"))


def simhash_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 5,
                            hot_bucket: int = 64, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id."""
    sig, roots = _grouped(docs, shingle, max_bits, blocks, hot_bucket, id_col, text_col)
    least = sig.groupBy("fp").agg(F.min("doc_id").alias("own")).join(roots, "fp", "left")
    root = F.coalesce("root", "fp")
    ids = least.groupBy(root.alias("root")).agg(F.min("own").alias("component_id"))
    named = least.select("fp", root.alias("root")).join(ids, "root").select("fp", "component_id")
    return sig.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 5,
                         hot_bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id,
    then the smallest hash of its text (two texts may share an id). Of rows that
    agree in id and text one stays. Rows without an id cannot be named: they
    stay. Only the keys of the rows that go are computed and written; the texts
    are shuffled for them only where these keys are too many to broadcast by
    Spark's own threshold."""
    sig, roots = _grouped(docs, shingle, max_bits, blocks, hot_bucket, id_col, text_col)
    keys = (sig.filter("doc_id is not null").groupBy("fp", "doc_id", "version")
            .agg(F.count(F.lit(1)).alias("rows")))
    grouped = materialize(keys.join(roots, "fp", "left").select(
        F.coalesce("root", "fp").alias("root"), "rows", F.struct("doc_id", "version").alias("key")))
    first = (grouped.groupBy("root").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("members"))
             .filter("members > 1").select("root", "first"))
    # sorted, so that Spark can split a group that holds a large share of the rows
    gone = materialize(grouped.join(first.hint("merge"), "root").filter("key != first").select("key"))
    again = materialize(grouped.filter("rows > 1").select("key"))
    own = F.struct(docs[id_col].cast("long").alias("doc_id"), text_version(docs[text_col]).alias("version"))
    if again.isEmpty():
        return docs.join(gone, own == gone["key"], "left_anti")
    twice = again.join(gone, "key", "left_anti")
    out = gone.unionByName(again).distinct()
    return (docs.join(out, own == out["key"], "left_anti")
            .unionByName(docs.join(twice, own == twice["key"], "left_semi").dropDuplicates([id_col, text_col])))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_near_duplicates(docs, shingle=3, max_bits=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      "component_id")
