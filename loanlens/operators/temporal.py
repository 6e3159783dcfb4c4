"""Joins over time: as-of join, interval overlap join, runs of a state.

None of them pairs rows beyond its result, and none sorts a hot key in one task:

* the as-of join is a tagged union, one shuffle by key and a carry of the last
  right row; keys with very many rows are cut into time ranges, and what a
  range inherits from the ranges before it travels as one extra row;
* the overlap join looks every pair up in exactly one cell of a dyadic grid of
  time, so it is an equi-join on (key, level, cell);
* runs of a state are found inside blocks of a key's sequence and joined again
  across the blocks' borders.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def _number(c: Column, kind: T.DataType) -> Column:
    """A monotone double of a time (timestamp, date or number)."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        c = c.cast("timestamp")
    return c.cast("double")


def time_cuts(rows: DataFrame, at: str, n_rows: int, rows_per_group: int) -> list[float]:
    """Borders that cut ``rows`` (``n_rows`` of them) into ranges of about
    ``rows_per_group`` rows; one number per range comes back."""
    b = math.ceil(n_rows / rows_per_group)
    if b <= 1:
        return []
    return sorted(set(rows.approxQuantile(at, [i / b for i in range(1, b)], 0.5 / b)))


def hot_keys(rows: DataFrame, keys: list[str], rows_per_group: int) -> tuple[DataFrame, int, int]:
    """(keys with more than ``rows_per_group`` rows, how many keys, their rows)."""
    hot = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
                      .filter(F.col("__n") > rows_per_group))
    got = hot.agg(F.count(F.lit(1)), F.sum("__n")).first()
    return hot.drop("__n"), got[0], got[1] or 0


def with_ranges(rows: DataFrame, keys: list[str], at: Column, rows_per_group: int) -> tuple[DataFrame, bool]:
    """(``rows`` with ``__range``, whether any key was cut): the time range of a
    hot key's rows, 0 for all other keys. A (key, range) group holds about
    ``rows_per_group`` rows at most (more only where one instant does)."""
    rows = rows.withColumn("__at", at)
    hot, n_keys, n_rows = hot_keys(rows, keys, rows_per_group)
    if not n_keys:
        return rows.withColumn("__range", F.lit(0)).drop("__at"), False
    flagged = hot.withColumn("__hot", F.lit(True))
    cuts = time_cuts(rows.join(flagged.drop("__hot"), keys, "left_semi"), "__at", n_rows, rows_per_group)
    rows = rows.join(flagged, keys, "left")       # Spark broadcasts the hot keys where they are few
    splits = [float("-inf"), *[c for c in cuts if math.isfinite(c)], float("inf")]
    if len(splits) < 3:
        return rows.withColumn("__range", F.lit(0)).drop("__at", "__hot"), False
    cut = Bucketizer(splits=splits, inputCol="__at", outputCol="__cell", handleInvalid="keep").transform(rows)
    return (cut.withColumn("__range", F.when(F.col("__hot"), F.col("__cell").cast("int")).otherwise(0))
            .drop("__at", "__hot", "__cell")), True


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
              values: list[str], inclusive: bool = True, tolerance=None,
              rows_per_group: int = 1_000_000, time_name: str | None = None) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the latest row of ``right``
    of the same keys at or before its time (before it, if not ``inclusive``),
    and that row's time as ``time_name``.

    Rows of ``left`` without such a row, with a null key or a null time keep
    null values; rows of ``right`` with a null key or time never match; of
    several right rows at one time the greatest by ``values`` is taken. With
    ``tolerance`` (in the unit of the times; seconds for timestamps) older
    matches count as none. Repeated left rows stay repeated. The values' names
    must not occur in ``left``.
    """
    time_name = time_name or f"asof_{right_time}"
    clash = set(left.columns) & {*values, time_name}
    if clash:
        raise ValueError(f"left has columns named {sorted(clash)}")
    kind = left.schema[left_time].dataType
    own = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    key_cols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    r_kind = T.StructType(right.select(found.alias("x")).schema["x"].dataType.fields)
    l_kind = left.select(own.alias("x")).schema["x"].dataType
    l = left.select(*key_cols, F.col(left_time).alias("__t"), F.lit(1 if inclusive else 0).alias("__tag"),
                    own.alias("__left"), F.lit(None).cast(r_kind).alias("__right"))
    r = right.dropna(subset=[*keys, right_time]).select(
        *key_cols, F.col(right_time).cast(kind).alias("__t"), F.lit(0 if inclusive else 1).alias("__tag"),
        F.lit(None).cast(l_kind).alias("__left"), found.alias("__right"))
    complete = F.lit(True)
    for c in [*names, "__t"]:
        complete = complete & F.col(c).isNotNull()
    rows = l.filter(complete).unionByName(r)
    rows, cut = with_ranges(rows, names, _number(F.col("__t"), kind), rows_per_group)
    group = [*names, "__range"]
    if cut:
        # what each range of a cut key inherits: the last right row of the ranges before it
        last = rows.groupBy(*group).agg(F.max("__right").alias("__right"), F.min("__t").alias("__t"))
        before = Window.partitionBy(*names).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carry = (last.withColumn("__right", F.last("__right", ignorenulls=True).over(before))
                 .filter((F.col("__range") > 0) & F.col("__right").isNotNull())
                 .select(*names, "__t", F.lit(-1).alias("__tag"), F.lit(None).cast(l_kind).alias("__left"),
                         "__right", "__range"))
        rows = rows.unionByName(carry)
    w = (Window.partitionBy(*group).orderBy("__t", "__tag", "__right")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).filter("__left is not null")
    if tolerance is not None:
        age = _number(F.col("__t"), kind) - _number(F.col("__right.t").cast(kind), kind)
        met = met.withColumn("__right", F.when(age <= F.lit(float(tolerance)), F.col("__right")))
    out = met.select("__left", "__right").unionByName(
        l.filter(~complete).select("__left", "__right"))
    return out.select("__left.*", F.col("__right.t").alias(time_name),
                      *[F.col(f"__right.v{i}").alias(c) for i, c in enumerate(values)])


def overlap_pairs(rows: DataFrame, key: str, id_col: str, start: str, end: str) -> DataFrame:
    """(key, a, b, start, end) of all pairs of rows of one key whose closed
    intervals [start, end] (whole numbers, e.g. days) have a point in common;
    start and end are those of the common part, a begins first (equal starts:
    the smaller id).

    The pair is found at the start of the later interval: every interval covers
    at most two cells of the dyadic level that fits its length, and every start
    is looked up in its cell of each level that occurs (a few dozen at most), so
    a pair meets in one cell only. Rows with a null key, start or end, or an end
    before the start, are in no pair; rows that agree in key, id and interval
    are each other's pair once, in no defined order.
    """
    base = (rows.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
            .select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(start).cast("long").alias("s"),
                    F.col(end).cast("long").alias("e"), F.monotonically_increasing_id().alias("n")))
    base = materialize(base.withColumn("level", F.length(F.bin(F.col("e") - F.col("s")))))
    levels = sorted(r["level"] for r in base.select("level").distinct().collect())      # at most 64
    if not levels:
        levels = [1]

    def cell(t, level):
        return F.call_function("shiftright", t, level)

    cover = base.select("k", "id", "s", "e", "n", "level", F.explode(F.array_distinct(F.array(
        cell(F.col("s"), F.col("level")), cell(F.col("e"), F.col("level"))))).alias("cell"))
    begin = base.select("k", "id", "s", "e", "n", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    begin = begin.withColumn("cell", cell(F.col("s"), F.col("level")))
    a, b = cover.alias("a"), begin.alias("b")
    first = F.struct(F.col("a.s"), F.col("a.id"), F.col("a.n"))
    then = F.struct(F.col("b.s"), F.col("b.id"), F.col("b.n"))
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.level") == F.col("b.level"))
                 & (F.col("a.cell") == F.col("b.cell")) & (F.col("b.s") <= F.col("a.e")) & (first < then))
    return met.select(F.col("a.k").alias(key), F.col("a.id").alias("a"), F.col("b.id").alias("b"),
                      F.col("b.s").alias("start"), F.least("a.e", "b.e").alias("end"))


def runs(rows: DataFrame, key: str, order: str, active: Column, rows_per_group: int = 1_000_000) -> DataFrame:
    """Per key: n_rows, n_active, n_runs (maximal stretches of consecutive
    active rows in the order of ``order``) and longest_run.

    A key with very many rows is cut into ranges of ``order``; each range gives
    its runs' number and longest, and the lengths of the runs that touch its two
    borders, and ranges are put together in order (one row per range). Null
    ``active`` is not active; rows with a null key or order are left out;
    ``order`` is unique per key (of equal ones the active come first).
    """
    rows = (rows.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
            .select(F.col(key).alias("__k0"), F.col(order).alias("__t"),
                    F.coalesce(active, F.lit(False)).alias("__on")))
    rows, _ = with_ranges(rows, ["__k0"], _number(F.col("__t"), rows.schema["__t"].dataType), rows_per_group)
    w = Window.partitionBy("__k0", "__range").orderBy("__t", F.desc("__on"))
    # rows of a run share the number of inactive rows before them
    marked = rows.withColumn("__off", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = marked.groupBy("__k0", "__range", "__off").agg(
        F.count_if("__on").alias("len"), F.count(F.lit(1)).alias("n"))
    per = pieces.groupBy("__k0", "__range").agg(
        F.sum("n").alias("n"), F.sum("len").alias("on"), F.count_if(F.col("len") > 0).alias("n_runs"),
        F.max("len").alias("longest"), F.max("__off").alias("offs"),
        F.max_by("len", -F.col("__off")).alias("first_len"), F.min("__off").alias("first_off"),
        F.max_by("len", "__off").alias("last_len"))
    piece = F.struct(
        F.col("__range").alias("r"), F.col("n"), F.col("on"), F.col("n_runs"), F.col("longest"),
        # the run that touches the lower border (its pieces begin with no inactive row) and the upper one
        F.when(F.col("first_off") == 0, F.col("first_len")).otherwise(0).alias("head"),
        F.col("last_len").alias("tail"), (F.col("offs") == 0).alias("whole"))
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "on", "n_runs", "longest", "tail")])

    def step(acc, x):
        joined = acc["tail"] + x["head"]
        return F.struct((acc["n"] + x["n"]).alias("n"), (acc["on"] + x["on"]).alias("on"),
                        (acc["n_runs"] + x["n_runs"]
                         - F.when((acc["tail"] > 0) & (x["head"] > 0), 1).otherwise(0)).alias("n_runs"),
                        F.greatest(acc["longest"], x["longest"], joined).alias("longest"),
                        F.when(x["whole"], joined).otherwise(x["tail"]).alias("tail"))

    out = per.groupBy("__k0").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    out = out.select("__k0", F.aggregate("p", start, step).alias("a"))
    return out.select(F.col("__k0").alias(key), F.col("a.n").alias("n_rows"), F.col("a.on").alias("n_active"),
                      F.col("a.n_runs").alias("n_runs"), F.col("a.longest").alias("longest_run"))
