"""Small helpers for the operators: clean inputs, Arrow batches, and joins whose broadcast is checked."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 1_000_000

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once; they may not have the driver's path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="fieldloom-code-"), "fieldloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The batch function, giving freed memory back to the system when its task ends.

    Python workers outlive their tasks, and several kinds of task share an executor.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as bigint and the text, empty where missing; every other column is left out."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key is among the unique ``ids``.

    The ids are counted first: up to ``limit`` of them (8 bytes each) are broadcast, so that texts are
    not shuffled; more are joined by a shuffle.
    """
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def join_sized(df: DataFrame, other: DataFrame, key: str | list[str], how: str = "inner", limit: int = BROADCAST_ROWS,
               elements: str | None = None) -> DataFrame:
    """Join with a side that is measured first: broadcast up to ``limit`` rows, shuffled beyond.

    ``elements`` names an array column of that side; its elements count against ten times the limit.
    """
    total = F.coalesce(F.sum(F.size(elements).cast("bigint")), F.lit(0)) if elements else F.lit(0)
    rows, inside = other.agg(F.count("*"), total).first()
    return df.join(F.broadcast(other) if rows <= limit and inside <= 10 * limit else other, key, how)
