"""CSV scan of the basket tables (S1) and CSV sink of a result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import TABLE_FILES


def by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns of a CSV file or folder, found by their header names.

    Other columns and any order are allowed; a missing column raises
    ValueError.  The header is read once for the order; every file's own
    header is then checked against it (``enforceSchema=false``), and
    ``FAILFAST`` turns a malformed row into an error.
    """
    names = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header ({', '.join(names)})")
    known = {f.name: f.dataType for f in schema}
    full = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    return (spark.read.schema(full).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
            .csv(path).select(*[f"`{f.name}`" for f in schema]))


def with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, bad rows): S1 for files with malformed rows.

    A row with too few or too many fields or with a value that isn't of its
    column's type is set aside as ``file, row, reason``; all others are
    read as by :func:`by_name`.  Both are kept in the shared folder, so each
    file is parsed once.
    """
    names = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header ({', '.join(names)})")
    known = {f.name: f.dataType for f in schema}
    raw = "_raw"
    while raw in names:
        raw += "_"
    full = T.StructType([*[T.StructField(n, known.get(n, T.StringType())) for n in names], T.StructField(raw, T.StringType())])
    rows = (spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw)
            .option("columnPruning", False).option("enforceSchema", True).csv(path)
            .select("*", F.input_file_name().alias(f"{raw}_file")).checkpoint(eager=True))
    good = rows.where(F.col(raw).isNull()).select(*[f"`{f.name}`" for f in schema])
    fields = F.split(F.regexp_replace(F.col(raw), '"[^"]*"', "q"), ",", -1)
    wrong = [F.when(F.expr(f"try_cast(trim(_f[{i}]) AS {known[n].simpleString()})").isNull() & (F.expr(f"trim(_f[{i}])") != ""), F.lit(n))
             for i, n in enumerate(names) if n in known and not isinstance(known[n], T.StringType)]
    bad = rows.where(F.col(raw).isNotNull()).withColumn("_f", fields)
    reason = (F.when(F.size("_f") != len(names), F.concat(F.size("_f").cast("string"), F.lit(f" of {len(names)} fields")))
              .otherwise(F.concat_ws(", ", F.lit("type of"), *wrong) if wrong else F.lit("malformed")))
    return good, bad.select(F.col(f"{raw}_file").alias("file"), F.col(raw).alias("row"), F.regexp_replace(reason, "^type of, ", "type of ").alias("reason"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One basket table from ``folder``, its columns by name."""
    fname, schema = TABLE_FILES[name]
    return by_name(spark, os.path.join(folder, fname), schema)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All six tables, lazily (nothing is read until an action)."""
    return {name: read_table(spark, folder, name) for name in TABLE_FILES}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write ``df`` as CSV part files with a header; returns ``path``.

    No ``coalesce(1)``: at scale one writer task would be the bottleneck.
    Readers take the folder.
    """
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written result, its columns by name; ``schema`` as StructType or DDL."""
    return by_name(spark, path, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
