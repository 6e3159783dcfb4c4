"""CSV source and sink against pandas on quoted input."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlens.sources import io as IO

ROWS = pd.DataFrame({"k": [1, 2, 3, 4], "t": ['a "q" b', "x, y", "two\nlines", None],
                     "n": [1.5, None, 3.0, 4.0], "empty": [None] * 4})


def same(got, want):
    assert list(got.columns) == list(want.columns)
    got = got.sort_values("k").reset_index(drop=True)
    for c in want.columns:
        assert [None if pd.isna(v) else v for v in got[c]] == [None if pd.isna(v) else v for v in want[c]]


def test_quotes_and_line_feeds_like_pandas(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    ROWS.to_csv(path, index=False)
    df = IO.read_csv_typed(spark, path, multi_line=True)
    same(df.toPandas(), pd.read_csv(path))
    assert dict(df.dtypes) == {"k": "bigint", "t": "string", "n": "double", "empty": "string"}


def test_sink_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q" b'), (2, "x, y"), (3, '""'), (4, None)], "k long, t string")
    IO.write_csv(df, str(tmp_path / "out"))
    back = IO.read_csv_typed(spark, str(tmp_path / "out")).orderBy("k").collect()
    assert [r.t for r in back] == ['a "q" b', "x, y", '""', None]


@pytest.mark.parametrize("value", [None, "x"])
def test_an_empty_column_stays_text(spark, tmp_path, value):
    pd.DataFrame({"k": [1, 2], "s": [None, value]}).to_csv(tmp_path / "b.csv", index=False)
    df = IO.read_csv_typed(spark, str(tmp_path / "b.csv"))
    assert dict(df.dtypes)["s"] == "string" and df.filter(F.col("s").isNull()).count() == 2 - (value is not None)


def test_every_column_of_the_exclusion_list_has_a_declared_type():
    from loanlens import config as C

    declared = {f.name for s in C.SCHEMAS.values() for f in s.fields}
    assert set(C.SKEW_EXCLUDE) <= declared
    app = C.SCHEMAS["application_train"].names
    assert len(app) == len(set(app))
