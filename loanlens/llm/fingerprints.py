"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its paragraphs (non-empty lines). Every paragraph is
hashed to a wide vector, and the fingerprint is the sum of the vectors, lane
by lane modulo a power of two. So the order of paragraphs does not matter, and
a paragraph can be added to or taken from a fingerprint without the rest of
the text (``insert``, ``delete``); fingerprints of parts add up (``combine``).

The vector has two blocks. IDENTITY lanes modulo 2**64 come from a 512-bit
hash of the paragraph's bytes and decide equality. LIKENESS lanes modulo 2**32
hold the paragraph's word pairs (its first word counts as a pair with the
start), each adding +1 or -1 to one lane: inner products of such sums estimate
inner products of the pair counts, so two fingerprints tell how alike the
texts are: 2 <a, b> / (<a, a> + <b, b>), between 0 and 1.

Edge cases: null and empty texts, and texts of line feeds only, are the empty
multiset with the zero fingerprint; equal texts have equal fingerprints, also
in repeated rows; two empty fingerprints are alike (1).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as W

IDENTITY, LIKENESS = 8, 256
ROWS = 2048      # rows to a slice: lanes are dense


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(identity uint64, likeness int32) sums of every text."""
    n = len(offsets) - 1
    ident = np.zeros((n, IDENTITY), np.uint64)
    like = np.zeros((n, LIKENESS), np.int32)
    line = np.ones(256, bool)
    line[10] = False
    starts, ends, first = W.find_words(data, offsets, line)
    if not len(starts):
        return ident, like
    raw, blake = data.tobytes(), hashlib.blake2b
    lanes = np.frombuffer(b"".join(blake(raw[a:b]).digest() for a, b in
                                   zip(starts.tolist(), ends.tolist())), "<u8").reshape(-1, IDENTITY)
    total = np.zeros((len(starts) + 1, IDENTITY), np.uint64)
    np.cumsum(lanes, axis=0, dtype=np.uint64, out=total[1:])
    ident = total[first[1:]] - total[first[:-1]]
    doc = np.repeat(np.arange(n), np.diff(first))
    # words, with a paragraph as the unit that pairs stay inside
    ws, we, _ = W.find_words(data, offsets, W.byte_class("nonspace"))
    if len(ws):
        h = W.hash_words(data, ws, we)
        para = np.searchsorted(starts, ws, side="right") - 1
        prev = np.full(len(h), np.uint64(0x5bd1e995), np.uint64)
        inside = np.flatnonzero(para[1:] == para[:-1]) + 1
        prev[inside] = h[inside - 1]
        with np.errstate(over="ignore"):
            g = W.mix(prev * np.uint64(0xD6E8FEB86659FD93) + h)
        lane = doc[para] * LIKENESS + (g & np.uint64(LIKENESS - 1)).astype(np.int64)
        sign = np.where(g >> np.uint64(63), 1.0, -1.0)
        got = np.bincount(lane, weights=sign, minlength=n * LIKENESS).reshape(n, LIKENESS)
        like = got.astype(np.int64).astype(np.uint32).view(np.int32).reshape(n, LIKENESS)
    return ident, like


def to_text(ident: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints as lowercase hex."""
    raw = np.concatenate((ident.astype("<u8").view(np.uint8), like.astype("<i4").view(np.uint8)), axis=1)
    size, whole = raw.shape[1] * 2, raw.tobytes().hex()
    return [whole[i * size:(i + 1) * size] for i in range(len(raw))]


def from_text(prints) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)
    cut = IDENTITY * 8
    return raw[:, :cut].copy().view("<u8"), raw[:, cut:].copy().view("<i4")


def _of(text: str | None):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return vectors(raw, np.array([0, len(raw)]))


def fingerprint(text: str | None) -> str:
    return to_text(*_of(text))[0]


def _plus(a: str, b, sign: int) -> str:
    (i, l), (j, m) = from_text([a]), b
    with np.errstate(over="ignore"):
        return to_text(i + j if sign > 0 else i - j, l + m if sign > 0 else l - m)[0]


def insert(print_: str, paragraphs: str) -> str:
    """The fingerprint with the paragraphs of a text added."""
    return _plus(print_, _of(paragraphs), 1)


def delete(print_: str, paragraphs: str) -> str:
    """The fingerprint with the paragraphs of a text taken away."""
    return _plus(print_, _of(paragraphs), -1)


def combine(a: str, b: str) -> str:
    """The fingerprint of two texts' paragraphs together."""
    return _plus(a, from_text([b]), 1)


def likeness(a, b) -> np.ndarray:
    """Row-wise likeness of two (identity, likeness) pairs of arrays."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    dot = 2 * (x * y).sum(axis=1)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    out = np.clip(np.divide(dot, norm, out=np.zeros(len(x)), where=norm > 0), 0.0, 1.0)
    return np.where(same, 1.0, out)


def _slice_vectors(texts: pa.Array):
    return vectors(*W.buffers(texts))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for every row of ``docs``."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b, rows=ROWS):
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(to_text(*vectors(data, offsets)), pa.string())],
                    ["doc_id", "fingerprint"])

    return frame.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def in_order_with_next(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Rows (part, extra, doc_id, text), sorted by falling doc_id within each
    part: a part holds a range of ids, and after its last document a copy of
    the document that follows (extra = 1), round the end to the first. One
    shuffle of the texts. Only range bounds and one id per part reach the
    driver. Null ids come last; rows of one id are ordered by their texts' hash."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(lowest))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(key.alias("key"))
    bounds = sorted(set(ids.approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts))) \
        if parts > 1 else []
    bounds = [int(b) for b in bounds]

    # number of bounds above the id (part 0 holds the largest ids), by two short searches
    step = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[i:i + step] for i in range(0, len(bounds), step)]

    def part_of(c):
        if not bounds:
            return F.lit(0)
        chunk = F.size(F.filter(F.array(*[F.lit(x[0]) for x in chunks]), lambda b: b <= c))
        held = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in chunks]), F.greatest(chunk, F.lit(1)))
        below = (F.greatest(chunk, F.lit(1)) - 1) * step + F.size(F.filter(held, lambda b: b <= c))
        return len(bounds) - below

    heads = [(r["part"], r["head"]) for r in
             ids.select(part_of(F.col("key")).alias("part"), "key").groupBy("part")
             .agg(F.max("key").alias("head")).collect()]
    heads.sort()
    owner = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]      # the part before needs it
    wanted = spark.createDataFrame(owner, T.StructType([T.StructField("head", T.LongType()),
                                                       T.StructField("before", T.IntegerType())]))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        key.alias("key"))
            .withColumn("part", part_of(F.col("key")).cast("int"))
            .join(F.broadcast(wanted), F.col("key") == F.col("head"), "left"))
    at = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("extra")))
    more = F.array(F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))
    rows = (rows.select("doc_id", "key", "text", F.explode(
        F.when(F.col("before").isNull(), at).otherwise(F.concat(at, more))).alias("to"))
        .select(F.col("to.part").alias("part"), F.col("to.extra").alias("extra"), "key", "doc_id", "text"))
    return (rows.repartitionById(max(parts, 1), F.col("part"))
            .sortWithinPartitions("part", "extra", F.desc("key"), F.xxhash64("text"))
            .select("part", "extra", "doc_id", "text"))


def edited_text(text: str, after: str) -> str:
    """``text`` with its last third (floor(n/3) code points) replaced by the
    first as many of ``after``."""
    n = len(text) // 3
    return text[:len(text) - n] + after[:n] if n else text


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, the edited text's SHA-256, both fingerprints,
    and likeness to the edited text and to the next document."""
    rows = in_order_with_next(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def emit(block: pa.Table):
        """Results of all rows but the last, whose next is not known yet."""
        texts = [t or "" for t in block.column("text").to_pylist()]
        own = _slice_vectors(block.column("text").combine_chunks())
        edits = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
        edited = _slice_vectors(pa.array(edits, pa.large_string()))
        here, after = tuple(v[:-1] for v in own), tuple(v[1:] for v in own)
        out = pa.RecordBatch.from_arrays([
            block.column("doc_id").combine_chunks()[:-1],
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
            pa.array(to_text(*here), pa.string()), pa.array(to_text(*edited), pa.string()),
            pa.array(likeness(here, edited)), pa.array(likeness(here, after))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"])
        return out.filter(pa.array(block.column("extra").to_numpy()[:-1] == 0))

    def run(batches):
        held = None
        for b in batches:
            for part, _, _ in W.slices(b, rows=ROWS):
                block = pa.Table.from_batches([part] if held is None else [held, part])
                if len(block) > 1:
                    yield emit(block)
                held = part.slice(len(part) - 1)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, "
                                "fingerprint string, edited_fingerprint string, "
                                "near_edited double, near_next double")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
