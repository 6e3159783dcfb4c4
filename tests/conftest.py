import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loanlens.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        # spark.checkpoint.dir is static: register a folder on the context instead
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loanlens-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def credit_pd():
    from tests.credit_fixture import make_tables

    return make_tables()


@pytest.fixture(scope="session")
def credit(spark, credit_pd):
    from tests.credit_fixture import to_spark

    return to_spark(spark, credit_pd)
