"""Sources and sinks: typed CSV scan, table-bundle load, CSV sink, model IO.

CSV is read with every column as text (no Spark inference), the NA tokens are
nulled, declared columns are cast to their schema type with the same
coercion rule as the cleaning step, and undeclared columns are typed by one
bounded one-row aggregate (does every non-NULL value parse as a number?).
Parquet input keeps its own types; declared columns are cast.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import expr as X

_INT_TEXT = r"^\s*[+-]?\d+\s*$"


def null_na_tokens(df: DataFrame, tokens=C.CSV_NA_TOKENS) -> DataFrame:
    """Every string cell equal to an NA token becomes NULL."""
    toks = list(tokens)
    return df.withColumns({f.name: F.when(~F.col(f"`{f.name}`").isin(toks), F.col(f"`{f.name}`"))
                           for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def _cast_text(c: str, dtype: T.DataType):
    s = F.col(f"`{c}`")
    if isinstance(dtype, T.StringType):
        return s
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        as_int = F.when(s.rlike(_INT_TEXT), F.trim(s).try_cast(dtype))
        return F.coalesce(as_int, X.coerce_numeric(s).try_cast(dtype))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return s.try_cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lower(F.trim(s)).try_cast("boolean")
    return X.coerce_numeric(s).cast(dtype)


def infer_text_types(df: DataFrame, cols) -> dict[str, T.DataType]:
    """Type each text column: long if all non-NULL values are integers, double
    if all are numbers, else string (also without any value: a batch in which
    a column happens to be empty must not change its type). One global
    aggregate, one row back."""
    cols = list(cols)
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        s = F.col(f"`{c}`")
        aggs += [
            F.count_if(s.isNotNull() & ~s.rlike(X._NUMERIC_TEXT)).alias(f"bad{i}"),
            F.count_if(s.isNotNull() & ~s.rlike(_INT_TEXT)).alias(f"frac{i}"),
            F.count(s).alias(f"n{i}"),
        ]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        if row[f"bad{i}"] > 0 or row[f"n{i}"] == 0:
            out[c] = T.StringType()
        elif row[f"frac{i}"] > 0:
            out[c] = T.DoubleType()
        else:
            out[c] = T.LongType()
    return out


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   infer_rest: bool = True, na_tokens=C.CSV_NA_TOKENS,
                   multi_line: bool = False) -> DataFrame:
    """A1: header CSV -> typed DataFrame (declared columns cast, others typed by scan).

    Quotes inside quoted fields are doubled. ``multi_line`` allows line feeds
    inside quoted fields; such a file is read by one task, so leave it off for
    large files without them."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
           .option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    raw = null_na_tokens(raw, na_tokens)
    declared = {f.name: f.dataType for f in (schema.fields if schema else [])}
    rest = [c for c in raw.columns if c not in declared]
    types = dict(declared)
    if infer_rest:
        types.update(infer_text_types(raw, rest))
    return raw.select(*[_cast_text(c, types.get(c, T.StringType())).alias(c)
                        for c in raw.columns])


def apply_schema(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    """Cast the declared columns of an already-typed source (Parquet)."""
    if not schema:
        return df
    types = {f.name: f.dataType for f in schema.fields}
    cur = dict((f.name, f.dataType) for f in df.schema.fields)
    change = {}
    for c, t in types.items():
        if c in cur and cur[c] != t:
            if isinstance(cur[c], T.StringType) and not isinstance(t, T.StringType):
                change[c] = _cast_text(c, t)
            else:
                change[c] = F.col(f"`{c}`").cast(t)
    return df.withColumns(change) if change else df


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder on any Hadoop filesystem (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)]


def _stem(name: str) -> str:
    for ext in (".csv", ".parquet", ".pq"):
        if name.lower().endswith(ext):
            return name[: -len(ext)]
    return name


def load_bundle(spark: SparkSession, path: str, tables=C.TABLES,
                schemas=C.SCHEMAS, multi_line: bool = False) -> dict[str, DataFrame]:
    """A2: the tables from one folder (CSV or Parquet, names matched
    case-insensitively); a missing table raises."""
    entries = {}
    for name in list_dir(spark, path):
        if name.startswith((".", "_")):
            continue
        entries.setdefault(_stem(name).lower(), name)
    out = {}
    for t in tables:
        hit = entries.get(t.lower())
        if hit is None:
            raise FileNotFoundError(f"table {t!r} not found in {path}")
        full = path.rstrip("/") + "/" + hit
        if hit.lower().endswith(".csv"):
            out[t] = read_csv_typed(spark, full, schemas.get(t), multi_line=multi_line)
        else:
            out[t] = apply_schema(spark.read.parquet(full), schemas.get(t))
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3: header CSV, one file per partition (no funnel through one task)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_predictions(scored: DataFrame, path: str, key=C.APP_KEY,
                      prediction_col="prediction", out_col=C.LABEL) -> None:
    """A3 + B11: ``key, TARGET`` CSV of hard class labels."""
    write_csv(scored.select(key, F.col(prediction_col).cast("int").alias(out_col)), path)


def save_model(model: PipelineModel, path: str) -> None:
    """A4: persist a fitted pipeline (custom stages are DefaultParams-writable)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
