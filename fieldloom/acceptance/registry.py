"""Registry of acceptance queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.nulls import ColumnLike, as_col


@dataclass(frozen=True)
class Case:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


class Tables:
    """The tables of one scale factor as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def case(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a query name, with the SQL that gives the same result."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in CASES:
            raise ValueError(f"query {name} is registered twice")
        CASES[name] = Case(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn
    return add


def r(c: ColumnLike, digits: int = 6) -> Column:
    """Rounded for comparison, with a plain zero instead of a negative one."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def day_text(c: ColumnLike) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd")


def big(c: ColumnLike) -> Column:
    return as_col(c).cast("bigint")
