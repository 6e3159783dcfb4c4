"""Difference of two snapshots of a table, and reports over all levels of a grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows whose number differs: all columns of the snapshots, and ``__old``,
    ``__new`` (how often each holds the row beyond the other).

    Columns are matched by name and must be the same; the types of ``old`` are kept
    where both have them, else Spark's common type. Nulls are equal here. Both
    snapshots go through one shuffle by whole row with partial counts, so repeated
    rows are one row there, and rows that did not change end in it.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    clash = set(old.columns) & {"__old", "__new", "__side", "__net"}
    if clash:
        raise ValueError(f"columns named {sorted(clash)}")
    cols = old.columns
    both = (old.withColumn("__side", F.lit(-1).cast("long"))
            .unionByName(new.withColumn("__side", F.lit(1).cast("long"))))
    net = both.groupBy(*cols).agg(F.sum("__side").alias("__net")).filter(F.col("__net") != 0)
    return net.select(*cols, F.greatest(-F.col("__net"), F.lit(0)).alias("__old"),
                      F.greatest(F.col("__net"), F.lit(0)).alias("__new"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key whose rows differ: keys..., change, n_old, n_new, changed_columns.

    ``change`` is ``added`` (the differing rows are all new), ``removed`` (all old) or
    ``changed`` (both); ``n_old``, ``n_new`` count them, repeats included. Where
    exactly one row was replaced by one, ``changed_columns`` names the columns that
    differ (sorted, comma-joined), else it is null. A null key is a key. Keys without
    a difference have no row.

    Only differing rows reach the second grouping, pre-aggregated by key.
    """
    keys = list(keys)
    missing = [k for k in keys if k not in old.columns]
    if missing or not keys:
        raise ValueError(f"keys {keys} must be columns of the snapshots")
    values = sorted(c for c in old.columns if c not in keys)
    rows = multiset_difference(old, new)
    clash = set(keys) & {"change", "n_old", "n_new", "changed_columns"}
    if clash:
        raise ValueError(f"keys named {sorted(clash)}")

    def one(side: str) -> Column:
        """The row of a side, where there is only one."""
        return F.any_value(F.when(F.col(side) > 0, F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])), True)

    aggs = [F.sum("__old").alias("n_old"), F.sum("__new").alias("n_new")]
    if values:
        aggs += [one("__old").alias("__a"), one("__new").alias("__b")]
    got = rows.groupBy(*[F.col(k) for k in keys]).agg(*aggs)
    change = (F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").otherwise("changed"))
    names = F.lit(None).cast("string")
    if values:
        differing = [F.when(~F.col(f"__a.v{i}").eqNullSafe(F.col(f"__b.v{i}")), F.lit(c)) for i, c in enumerate(values)]
        names = F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), F.concat_ws(",", *differing))
    return got.select(*keys, change.alias("change"), "n_old", "n_new", names.alias("changed_columns"))


def cube_report(df: DataFrame, dims: list[str], flag: Column, amount: Column | None = None,
                min_rows: int = 0) -> DataFrame:
    """Rate of ``flag`` on every level of ``dims`` (all subsets of them): dims...,
    level (bit i from the left is 1 where ``dims[i]`` is rolled up), n_rows, n_flagged,
    rate (flagged share of the rows whose flag is known; null without any), and with
    ``amount`` its sum ``amount``.

    Levels of fewer than ``min_rows`` rows are left out (HAVING). A rolled-up
    dimension is null; so is a null value of it, and ``level`` tells them apart.
    Without rows there are no levels.

    Every row is counted once, at the finest level; only those groups, one per
    combination of values, are expanded to the 2^n levels.
    """
    clash = set(dims) & {"level", "n_rows", "n_flagged", "rate", "amount", "n_known"}
    if clash or not dims:
        raise ValueError("dimensions are needed, with names of their own" + (f": {sorted(clash)}" if clash else ""))
    sums = [F.count(F.lit(1)).alias("n_rows"), F.count_if(flag).alias("n_flagged"), F.count(flag).alias("n_known")]
    if amount is not None:
        sums.append(F.sum(amount).alias("amount"))
    finest = df.groupBy(*dims).agg(*sums)
    totals = ["n_rows", "n_flagged", "n_known"] + (["amount"] if amount is not None else [])
    out = finest.cube(*dims).agg(F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in totals])
    out = out.filter(F.col("n_rows") >= min_rows)
    rate = F.try_divide(F.col("n_flagged").cast("double"), F.col("n_known").cast("double"))
    return out.select(*dims, "level", "n_rows", "n_flagged", rate.alias("rate"), *totals[3:])
