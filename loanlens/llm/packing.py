"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. Whole windows of ``capacity`` ids
are cut off its front; the remainder (shorter than a window) stays in one
piece. The pieces are dealt by a hash to groups of about ``windows`` windows'
worth of tokens, however many there are, and every group is packed by itself:
partial partitions are kept in a heap by the spread of their sums, and the two
with the largest spread are merged, the largest bin of one with the smallest
of the other, so opposing imbalances cancel. The windows come out nearly
equal; whenever one exceeds the capacity, the window count rises by the excess
(one at least) and the group is packed anew.

Token ids are read once: the pieces' lengths and checksums (or the ids, on
request) are written to the checkpoint folder, and the packing reads those.

Edge cases: null and empty texts are the end id alone; repeated rows are
packed as often as they occur; ties in length are broken by the pieces' row
keys, so the result is repeatable; an empty table gives no sequences; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import bytewords as W
from .tokens import Encoder, batches_of, segments


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False,
              id_col: str = "doc_id", text_col: str = "text", segment: int = 1 << 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, row (unique key), and the
    ids where asked for: the windows cut off each document and its remainder."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc, n = Encoder.shared(path), 0
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            for rows, _, texts in batches_of(b, segment):
                if len(texts) == 1:
                    got = [enc.ids([s])[0] for s in segments(texts[0].as_py() or "", segment)]
                    ids = np.concatenate(got)
                    off = np.array([0, len(ids)])
                else:
                    ids, off = enc.ids(texts)
                out = {k: [] for k in ("at", "start", "length", "crc", "total", "row", "ids")}
                for i in range(len(off) - 1):
                    own = np.append(ids[off[i]:off[i + 1]], end_id).astype("<u4")
                    for a in range(0, len(own), capacity):
                        part = own[a:a + capacity]
                        out["at"].append(i)
                        out["start"].append(a)
                        out["length"].append(len(part))
                        out["crc"].append(zlib.crc32(part.tobytes()))
                        out["total"].append(len(own))
                        out["row"].append(base + n)
                        n += 1
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                cols = [rows.column("doc_id").take(pa.array(out["at"], pa.int64()))]
                cols += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "total", "row")]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"]
                if with_ids:
                    cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return W.small_batches(frame).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, "
                                 "doc_tokens bigint, row bigint" + ", ids array<int>" * with_ids)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of every item, sums): Karmarkar-Karp into ``k`` windows. Equal
    items keep their order."""
    n = len(sizes)
    parent = np.arange(n)
    held = {t: (sizes[i:i + 1].astype(np.int64), np.array([i]))
            for t, i in enumerate(np.argsort(-sizes, kind="stable"))}
    # a partition is its bins' sums in falling order (empty bins left out, the
    # smallest sum taken off once all k are used) and an item of each bin
    heap = [(-int(s[0] - (s[-1] if k == 1 else 0)), t) for t, (s, _) in held.items()]
    heapq.heapify(heap)
    for t in range(n, 2 * n - 1):
        (sa, ba), (sb, bb) = held.pop(heapq.heappop(heap)[1]), held.pop(heapq.heappop(heap)[1])
        if len(sa) + len(sb) <= k:
            s, b = np.concatenate((sa, sb)), np.concatenate((ba, bb))
        else:
            s, b = np.zeros(k, np.int64), np.full(k, -1)
            s[:len(sa)], b[:len(ba)] = sa, ba
            into = np.arange(k - 1, k - 1 - len(sb), -1)
            both = b[into] >= 0
            parent[bb[both]] = b[into[both]]
            s[into] += sb
            b[into] = np.where(both, b[into], bb)
        order = np.argsort(-s, kind="stable")
        s, b = s[order], b[order]
        if len(s) == k:
            s = s - s[-1]
        held[t] = (s, b)
        heapq.heappush(heap, (-int(s[0]), t))
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    _, window = np.unique(parent, return_inverse=True)
    return window, np.bincount(window, weights=sizes, minlength=1).astype(np.int64)


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of every piece (each at most ``capacity``): full pieces have one
    to themselves, the others are differenced into as few windows as it takes."""
    out = np.empty(len(sizes), np.int64)
    full = sizes == capacity
    n = int(full.sum())
    out[full] = np.arange(n)
    rest = np.flatnonzero(~full)
    if len(rest):
        own = sizes[rest]
        k = max(1, math.ceil(own.sum() / capacity))
        while True:
            window, sums = differencing(own, k)
            over = int(np.maximum(sums - capacity, 0).sum())
            if not over:
                break
            k = min(len(rest), k + max(1, math.ceil(over / capacity)))
        out[rest] = n + window
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, windows: int = 128,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids)."""
    found = materialize(pieces_of(docs, path, capacity, end_id, with_ids, id_col, text_col))
    tokens = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (windows * capacity)))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(groups)))
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
              + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint")

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("row").to_numpy(), kind="stable")))
        length = t.column("length").to_numpy()
        window = pack_group(length, capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        heads = np.r_[True, np.diff(window[order]) != 0]
        offset = before - np.maximum.accumulate(np.where(heads, before, 0))
        sequence = (t.column("shard").to_numpy()[order].astype(np.int64) << 32) + window[order]
        t = t.select(names).take(pa.array(order))
        return (t.append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset.astype(np.int64))))

    return dealt.groupBy("shard").applyInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)
