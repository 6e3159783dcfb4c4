"""Per-applicant roll-ups kept up to date from a stream (F9, F11, F12 forms).

Child rows (payments, monthly balances, events) arrive as files. A stateful
query keeps, per applicant and salt, the mergeable parts of a roll-up: sums and
counts for means, the different values for distinct counts, counts per label
for a mode. After every micro-batch it appends the new parts of the applicants
it touched; :func:`current` takes the newest parts of each and merges them into
one row per applicant. The salt (a hash of the row's own id) spreads an
applicant with a third of all rows over ``salts`` parts. A state holds the parts of a
bucket of (applicant, salt) pairs, by hash, and is updated from Arrow batches
for all of them at once, never from a collected group: a call of Python for
every applicant and salt would cost more than its few rows.

Event time: rows older than the watermark when they arrive are *late*. They do
not enter the roll-up; they are counted (``n_late``). Without late rows the
result equals the batch roll-up of the same rows, whatever their order and
however they fell into files. State, watermark and file progress live in the
query's checkpoint folder, so a restart goes on where the last run ended; a
micro-batch that is run again writes the same parts under the same version, and
:func:`current` takes one of them.

The state of an applicant grows with its different values of the ``distinct``
columns and labels of the ``modes`` columns only. A micro-batch reads and writes
the states of the buckets it touches: take ``buckets`` in proportion to the
applicants (:func:`buckets_for`); it stays the same for a checkpoint folder.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PARTS = ("key string, salt int, version bigint, n_rows bigint, n_late bigint, sums array<double>, "
         "counts array<bigint>, seen array<array<string>>, labels array<map<string,bigint>>")


@dataclass(frozen=True)
class StreamRollup:
    """Columns of the roll-up: ``means`` (numeric), ``distinct`` and ``modes``
    (compared as text)."""

    key: str
    time: str
    row_id: str
    means: tuple[str, ...] = ()
    distinct: tuple[str, ...] = ()
    modes: tuple[str, ...] = ()
    salts: int = 8
    buckets: int = 32


def buckets_for(keys: int, salts: int, each: int = 8192) -> int:
    """Buckets with about ``each`` (key, salt) pairs, 32 at least."""
    return max(32, -(-keys * salts // each))


def read_files(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def _update(spec: StreamRollup):
    def run(key, batches, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else {
            "key": [], "salt": [], "v": [], "n": [], "late": [], "s": [[] for _ in spec.means],
            "c": [[] for _ in spec.means], "d": [[] for _ in spec.distinct], "m": [[] for _ in spec.modes]}
        place = {pair: i for i, pair in enumerate(zip(held["key"], held["salt"]))}
        mark = state.getCurrentWatermarkMs()
        touched = set()
        for part in batches:
            own, pairs = pd.MultiIndex.from_frame(part[["key", "salt"]]).factorize()
            for pair in pairs:
                if pair not in place:
                    place[pair] = len(place)
                    for name, new in (("key", pair[0]), ("salt", int(pair[1])), ("v", 0), ("n", 0), ("late", 0)):
                        held[name].append(new)
                    for name, new in (("s", float), ("c", int), ("d", list), ("m", dict)):
                        for column in held[name]:
                            column.append(new())
            where = np.array([place[pair] for pair in pairs], np.int64)[own]
            touched.update(where.tolist())
            on_time = (part["time"] >= mark).to_numpy()

            def add(column, rows, weights=None):
                at, own = np.unique(where[rows], return_inverse=True)
                for i, x in zip(at.tolist(), np.bincount(own, weights).tolist()):
                    column[i] += x

            add(held["late"], ~on_time)
            add(held["n"], on_time)
            for i in range(len(spec.means)):
                x = part[f"x{i}"].to_numpy(dtype=float, na_value=np.nan)
                rows = on_time & ~np.isnan(x)
                add(held["s"][i], rows, x[rows])
                add(held["c"][i], rows)
            for i in range(len(spec.distinct)):
                x = part[f"d{i}"]
                rows = on_time & x.notna().to_numpy()
                for (at, value) in set(zip(where[rows].tolist(), x[rows].tolist())):
                    if value not in held["d"][i][at]:
                        held["d"][i][at].append(value)
            for i in range(len(spec.modes)):
                x = part[f"m{i}"]
                rows = on_time & x.notna().to_numpy()
                labels, names = pd.factorize(x[rows])
                codes, n = np.unique(where[rows] * max(len(names), 1) + labels, return_counts=True)
                for code, more in zip(codes.tolist(), n.tolist()):
                    own_labels, label = held["m"][i][code // len(names)], names[code % len(names)]
                    own_labels[label] = own_labels.get(label, 0) + more
        touched = sorted(touched)
        for at in touched:
            held["v"][at] += 1
            for values in held["d"]:
                values[at].sort()
        state.update((json.dumps(held),))
        for lo in range(0, len(touched), 5000):
            some = touched[lo:lo + 5000]

            def rows(column):
                return [column[at] for at in some]

            def nested(columns):
                return [[column[at] for column in columns] for at in some]

            yield pd.DataFrame({"key": rows(held["key"]), "salt": rows(held["salt"]), "version": rows(held["v"]),
                                "n_rows": rows(held["n"]), "n_late": rows(held["late"]), "sums": nested(held["s"]),
                                "counts": nested(held["c"]), "seen": nested(held["d"]), "labels": nested(held["m"])})

    return run


def parts(stream: DataFrame, spec: StreamRollup, delay: str) -> DataFrame:
    """The stream of updated parts. ``delay``: how far a row may lie behind the
    newest time seen (by earlier micro-batches) without being late. Rows with a
    null key or time are left out."""
    rows = (stream.filter(F.col(spec.key).isNotNull() & F.col(spec.time).isNotNull())
            .withColumn(spec.time, F.col(spec.time).cast("timestamp")).withWatermark(spec.time, delay)
            .select(F.col(spec.key).cast("string").alias("key"),
                    F.pmod(F.xxhash64(spec.row_id), F.lit(spec.salts)).cast("int").alias("salt"),
                    F.col(spec.time).alias("at"), F.unix_millis(spec.time).alias("time"),
                    *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(spec.means)],
                    *[F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(spec.distinct)],
                    *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(spec.modes)]))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "salt"), F.lit(spec.buckets)).cast("int"))
    return rows.groupBy("bucket").applyInPandasWithState(
        _update(spec), PARTS, "state string", "append", GroupStateTimeout.NoTimeout)


def start(updates: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the parts to ``out_path``; ``checkpoint`` is the query's own folder."""
    w = updates.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(out_path)


def current(written: DataFrame, spec: StreamRollup) -> DataFrame:
    """One row per applicant from the parts written so far: key (as text),
    n_rows, n_late, <column>_mean, <column>_count (distinct values),
    <column>_mode (most frequent, ties the smallest)."""
    newest = (written.groupBy("key", "salt").agg(F.max_by(F.struct(*[c for c in written.columns if c not in ("key", "salt")]),
                                                          "version").alias("p")).select("key", "salt", "p.*"))
    aggs = [F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late")]
    for i, c in enumerate(spec.means):
        aggs.append(F.try_divide(F.sum(F.col("sums")[i]), F.sum(F.col("counts")[i])).alias(f"{c}_mean"))
    # at most ``salts`` lists a key
    for i, c in enumerate(spec.distinct):
        aggs.append(F.size(F.array_distinct(F.flatten(F.collect_list(F.col("seen")[i])))).cast("long").alias(f"{c}_count"))
    for i, c in enumerate(spec.modes):
        aggs.append(F.flatten(F.collect_list(F.map_entries(F.col("labels")[i]))).alias(f"__m{i}"))
    out = newest.groupBy("key").agg(*aggs)
    for i, c in enumerate(spec.modes):
        entries = F.col(f"__m{i}")
        totals = F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(
            (-F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("long"),
                          lambda a, e: a + e["value"])).alias("n"), k.alias("label")))
        out = out.withColumn(f"{c}_mode", F.array_min(totals)["label"]).drop(f"__m{i}")
    return out
