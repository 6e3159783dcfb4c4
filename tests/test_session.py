"""Materialisation into the shared checkpoint folder."""
import pytest
from pyspark.sql import functions as F

from loanlens.session import checkpoint_dir, materialize, scratch_path, scratch_scope


def test_materialize_writes_a_table_in_the_shared_folder(spark):
    df = spark.range(100).select("id", (F.col("id") * 2.5).alias("x"))
    m = materialize(df)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, df.collect()))
    base = spark.conf.get("spark.checkpoint.dir").replace("file:", "")
    files = m.inputFiles()
    assert files and all(base in f for f in files)          # read back from that table


def test_materialize_null_typed_column_falls_back_to_checkpoint(spark):
    df = spark.range(5).select("id", F.lit(None).alias("nothing"))
    m = materialize(df)
    assert m.count() == 5 and m.schema["nothing"].dataType.typeName() == "void"


def test_scratch_paths_differ_and_are_deleted(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    with scratch_scope(spark):
        files = [materialize(spark.range(5)).inputFiles()[0] for _ in range(3)]
        folders = [hadoop(f).getParent() for f in files]
        fs = folders[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert all(fs.exists(p) for p in folders)
    assert not any(fs.exists(p) for p in folders)


class _Ctx:
    def __init__(self, master, registered=None):
        self.master, self.registered, self.calls = master, registered, 0

    def getCheckpointDir(self):
        return self.registered

    def setCheckpointDir(self, d):
        self.calls += 1
        self.registered = "file:" + d + "/uuid"


class _Conf:
    def __init__(self, value=None):
        self.value = value

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.value if self.value is not None else default

    def set(self, key, value):
        raise AssertionError("spark.checkpoint.dir is static; it must not be set")


class _Session:
    def __init__(self, master, conf_value=None, registered=None):
        self.sparkContext, self.conf = _Ctx(master, registered), _Conf(conf_value)


def test_checkpoint_dir_unset_local_registers_once():
    s = _Session("local[4]")
    first = checkpoint_dir(s)
    assert s.sparkContext.calls == 1 and first
    again = checkpoint_dir(s)                  # reuses the registered folder
    assert s.sparkContext.calls == 1 and again.startswith("file:" + first)


def test_checkpoint_dir_cluster_requires_shared_folder():
    with pytest.raises(RuntimeError):
        checkpoint_dir(_Session("yarn"))
    s = _Session("yarn", conf_value="hdfs:///shared/ckpt")
    assert checkpoint_dir(s) == "hdfs:///shared/ckpt" and s.sparkContext.calls == 1
