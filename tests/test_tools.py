"""The scaled-copy helper used for local scale checks."""
import os
import tempfile

import pytest

from tests.conftest import SF0001
from tools.make_scaled import scale_tables

pytestmark = pytest.mark.skipif(not os.path.isdir(SF0001), reason="driver tables not present")


def test_scaled_copy_keeps_keys_unique_and_hot_share(spark):
    out = tempfile.mkdtemp(prefix="loanlens-scaled-")
    scale_tables(spark, SF0001, out, copies=2, hot=True)
    src_o = spark.read.parquet(f"{SF0001}/orders.parquet")
    o = spark.read.parquet(f"{out}/orders.parquet")
    c = spark.read.parquet(f"{out}/customer.parquet")
    assert o.count() == 2 * src_o.count()
    assert o.select("o_orderkey").distinct().count() == o.count()      # keys stay unique
    assert c.select("c_custkey").distinct().count() == c.count()
    hot = o.filter("o_custkey = 0").count() / o.count()
    assert 0.25 < hot < 0.42                                             # about a third
