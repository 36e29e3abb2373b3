"""Reading and writing tables: CSV, TSV, JSON, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.core import c, fold_nan

READABLE = ("csv", "tsv", "json", "parquet")
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",",
             multi_line: bool = False) -> DataFrame:
    """CSV with a header; types are inferred unless a schema spares the extra pass.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"')
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return fold_nan(r.csv(path))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
              array_file: bool = False) -> DataFrame:
    """JSON records, one per line; ``array_file`` for files that hold one JSON array."""
    r = spark.read.option("multiLine", array_file)
    r = r.schema(schema) if schema is not None else r
    return fold_nan(r.json(path))


def read_parquet(spark: SparkSession, path: str, nan_as_null: bool = False) -> DataFrame:
    """Parquet as it is.  Folding NaN costs filter pushdown on floating columns, so it is opt-in."""
    df = spark.read.parquet(path)
    return fold_nan(df) if nan_as_null else df


def read_table(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    """Read by format name, refusing unknown formats and empty tables."""
    fmt = fmt.lower().lstrip(".")
    if fmt not in READABLE:
        raise ValueError(f"unsupported format {fmt!r}; use one of {', '.join(READABLE)}")
    df = _read(spark, path, fmt, schema)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def _read(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    if fmt in ("csv", "tsv"):
        return read_csv(spark, path, schema, sep="\t" if fmt == "tsv" else ",")
    return read_json(spark, path, schema) if fmt == "json" else read_parquet(spark, path)


def check_inputs(spark: SparkSession, inputs: Sequence[tuple[str, str]]) -> DataFrame:
    """(path, format, status, columns, rows) of inputs to be taken in: ok, empty, unsupported or unreadable.

    Rows are counted for readable inputs; nothing raises, so a batch of files can be checked before any is read."""
    rows = []
    for path, fmt in inputs:
        kind = fmt.lower().lstrip(".")
        if kind not in READABLE:
            rows.append((path, kind, "unsupported", None, None))
            continue
        try:
            df = _read(spark, path, kind)
            n = df.count()
        except Exception as e:  # an unreadable file, whatever is wrong with it, is what this report is for
            rows.append((path, kind, f"unreadable: {type(e).__name__}", None, None))
            continue
        rows.append((path, kind, "ok" if n and df.columns else "empty", len(df.columns), n))
    return spark.createDataFrame(rows, "path string, format string, status string, columns int, rows bigint")


def write_csv(df: DataFrame, path: str, sep: str = ",", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV with a header.  NULL and '' both come back as NULL; Parquet and JSON keep them apart."""
    w = (df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampFormat", ISO).option("timestampNTZFormat", ISO))
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_tsv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    write_csv(df, path, "\t", partition_by, mode)


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """JSON lines with ISO timestamps."""
    w = df.write.mode(mode).option("timestampFormat", ISO).option("timestampNTZFormat", ISO) \
        .option("ignoreNullFields", False)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def cast_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring columns read from text back to the types of ``schema``."""
    return df.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in schema])


def batch_score(spark: SparkSession, source: str, model, sink: str, fmt: str = "parquet") -> DataFrame:
    """Read, apply a fitted model, write the scored rows, and return them as written."""
    df = read_table(spark, source, fmt)
    scored = model.transform(df)
    plain = [f.name for f in scored.schema if not isinstance(f.dataType, T.UserDefinedType)]
    scored.select(*[c(n) for n in plain]).write.mode("overwrite").parquet(sink)
    return spark.read.parquet(sink)

