"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Settings every job here relies on. AQE re-plans joins and coalesces
# partitions at runtime; the skew-join split protects the left-join chain
# when one applicant owns a large share of the child rows.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "loanlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster pass ``master=None`` so spark-submit decides; the shuffle
    partition count should then be sized so one partition holds ~128-256 MB
    of shuffle data at the target scale.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the folder already registered on
    the SparkContext). Only when neither is set and the master is local
    (tests) a fresh local folder is registered on the context; cluster jobs
    always use the folder the cluster names. ``spark.checkpoint.dir`` itself
    is a static setting and is never modified here.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="loanlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, noted for
    :func:`scratch_scope`."""
    path = checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete, at the end, the scratch folders created inside. Use it around
    building and writing a result: frames that read a scratch table are not
    usable after it."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes[:] = [s for s in _scopes if s is not made]
        jvm = spark.sparkContext._jvm
        for path in made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df):
    """Compute ``df`` once and cut its lineage. Use before a frame is read
    twice, e.g. statistics + rows.

    The rows are written as a Parquet table in a fresh sub-folder of the
    shared checkpoint folder and read back: it survives executor loss (unlike
    a cached or local copy), is compressed and columnar, and a later pass
    that needs a few columns (the statistics) reads only those. A frame
    Parquet cannot hold (a NULL-typed column) gets a reliable checkpoint in
    the same folder instead.
    """
    spark = df.sparkSession
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.parquet(path)
