"""Files and folders of any store that Spark can reach, through its Hadoop file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or a whole folder; False if there is none."""
    fs, at = _path(spark, path)
    return fs.delete(at, True)


def move(spark: SparkSession, path: str, target: str) -> bool:
    """Rename a folder; False if that is not possible, as when another run was first."""
    fs, at = _path(spark, path)
    return fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(target))


def entries(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """Name, whether it is a folder, and time of change in milliseconds of what lies directly in a folder."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getModificationTime()) for s in fs.listStatus(at))


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of change of every data file below a folder, or of the file itself."""
    fs, at = _path(spark, path)
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        s = found.next()
        if not s.getPath().getName().startswith(("_", ".")):
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)
