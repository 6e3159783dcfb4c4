"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from loanlens.plans import catalog, credit_tables, history, increments
from tests.conftest import SF001, SF0001
from tools.check_oracle import TABLES, digest

pytestmark = pytest.mark.skipif(not os.path.isdir(SF001), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted({**catalog.ORACLE_SQL, **credit_tables.ORACLE_SQL, **history.ORACLE_SQL,
                                         **increments.ORACLE_SQL}))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    res = con.sql(E.oracle_sql()[name])
    orows, ocols = res.fetchall(), res.columns
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(srows, scols) == digest(orows, ocols)


def test_every_query_has_oracle_or_is_training():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"train_score"}
    assert set(history.QUERIES) == set(history.ORACLE_SQL)
    assert set(increments.QUERIES) - set(increments.ORACLE_SQL) == {"stacked_score"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 150 and "c_custkey" in df.columns
