"""Derive a larger copy of the driver's tables for local scale checks.

usage: python tools/make_scaled.py SRC_DIR OUT_DIR [copies] [--hot]

Each table is replicated ``copies`` times with its keys shifted per copy (so
keys stay unique and joins keep their shape) and written as several files,
so scans split across tasks as they do on a cluster. ``--hot`` then makes one
customer own a third of all orders and events, and one order own a third of
all line items: the hot-key case the roll-ups and joins must survive.
Everything is a Spark job over the given tables; nothing is invented.
"""
import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from loanlens.session import get_spark  # noqa: E402

# key columns per table and the table whose key range they shift with
SHIFTS = {
    "customer": {"c_custkey": "customer"},
    "orders": {"o_orderkey": "orders", "o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders"},
    "events": {"event_id": "events", "user_id": "customer"},
    "documents": {"doc_id": "documents"},
    "labels": {"doc_id": "documents"},
    "part": {"p_partkey": "part"},
}
KEY_OF = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id",
          "documents": "doc_id", "part": "p_partkey"}


def scale_tables(spark, src: str, out: str, copies: int = 10, hot: bool = False) -> None:
    span = {t: spark.read.parquet(f"{src}/{t}.parquet").agg(F.max(k) + 1).first()[0]
            for t, k in KEY_OF.items()}
    for t, shifts in SHIFTS.items():
        df = spark.read.parquet(f"{src}/{t}.parquet").withColumn(
            "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        df = df.withColumns({c: (F.col(c) + F.col("_copy") * F.lit(span[base])).cast(
            dict(df.dtypes)[c]) for c, base in shifts.items()}).drop("_copy")
        if hot and t == "orders":
            df = df.withColumn("o_custkey", F.when(F.xxhash64("o_orderkey") % 3 == 0, F.lit(0))
                               .otherwise(F.col("o_custkey")).cast("long"))
        if hot and t == "events":
            df = df.withColumn("user_id", F.when(F.xxhash64("event_id") % 3 == 0, F.lit(0))
                               .otherwise(F.col("user_id")).cast("long"))
        if hot and t == "lineitem":
            df = df.withColumn("l_orderkey", F.when(
                F.xxhash64("l_orderkey", "l_linenumber") % 3 == 0, F.lit(0))
                .otherwise(F.col("l_orderkey")).cast("long"))
        df.repartition(8).write.mode("overwrite").parquet(f"{out}/{t}.parquet")


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    spark = get_spark("local[8]", 8)
    scale_tables(spark, args[0], args[1], int(args[2]) if len(args) > 2 else 10,
                 hot="--hot" in sys.argv)
    spark.stop()


if __name__ == "__main__":
    main()
