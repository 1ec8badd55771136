"""Delimited text, Parquet and database tables, and named datasets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .guess import cast_guessed, guess_types
from .records import header_names, read_records

MISSING_TEXT = "NA"


def read_delimited(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None,
                   sep: str = ",", missing: str = MISSING_TEXT, line_breaks: bool = False) -> DataFrame:
    """Delimited text with a header; the text ``NA`` and empty cells are missing, a doubled quote in a quoted cell is a quote.

    Without a schema every column is text and no pass is spent on guessing types. ``line_breaks`` reads files whose quoted cells may
    hold line breaks, still in byte ranges (see ``records``), for one more scan of the text.
    """
    options = {"sep": sep, "nullValue": missing, "quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false"}
    if line_breaks:
        df = _parsed_records(spark, path, schema, sep, options)
    else:
        reader = spark.read.options(**options).option("header", True)
        df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in texts}) if texts else df


def _parsed_records(spark: SparkSession, path: str | list[str], schema: StructType | str | None, sep: str, options: dict[str, str]) -> DataFrame:
    found = read_records(spark, path)
    if schema is None:
        head = found.where("leads").select("record").first()
        names = header_names(head.record, sep) if head is not None else []
        ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    else:
        shape = spark.createDataFrame([], schema).schema
        names, ddl = shape.names, ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(shape.fields))
    if not names:
        return spark.createDataFrame([], "")
    rows = found.where(~F.col("leads")).select(F.from_csv("record", ddl, options | {"multiLine": "true"}).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def read_guessed(spark: SparkSession, path: str | list[str], sep: str = ",", missing: str = MISSING_TEXT, line_breaks: bool = False) -> DataFrame:
    """Delimited text with types guessed from all of its cells by one aggregate; prefer a schema."""
    texts = read_delimited(spark, path, None, sep, missing, line_breaks)
    return cast_guessed(texts, guess_types(texts))


def positional_name(df: DataFrame, name: str, position: int) -> str:
    """Column of a repeated header, by its position counted from 1.

    Spark names repeated headers by the position counted from 0, so the column at position 22
    of a repeated ``ID`` is called ``ID21``.
    """
    found = df.columns[position - 1]
    if not re.fullmatch(re.escape(name) + r"\d*", found):
        raise ValueError(f"column {position} is {found!r}, not {name!r}")
    return found


def repair_headers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Name repeated headers ``name...position`` with positions counted from 1."""
    out = []
    for i, (current, name) in enumerate(zip(df.columns, names), start=1):
        repeated = list(names).count(name) > 1
        out.append(F.col(f"`{current}`").alias(f"{name}...{i}" if repeated else name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, where: Column | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table; the filter and the columns reach the file scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_database(spark: SparkSession, url: str, table: str, where: Column | None = None, **options) -> DataFrame:
    """Database table through JDBC; the filter is sent to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df if where is None else df.where(where)


def write_delimited(df: DataFrame, path: str, sep: str = ",", missing: str = MISSING_TEXT) -> None:
    """Delimited text with a header, one file per task; missing values are written as ``NA``."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", missing).option("escape", '"').csv(path)


def materialise(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> DataFrame:
    """Write a named dataset as Parquet below ``root`` and continue from the written copy."""
    path = f"{root.rstrip('/')}/{name}"
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")
