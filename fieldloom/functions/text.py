"""Text functions with the substitution rules of the source workloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnLike, as_col


def substr(c: ColumnLike, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop``, both counted from 1 and included."""
    return F.substring(as_col(c), start, stop - start + 1)


def replace_first(c: ColumnLike, pattern: str, replacement: str) -> Column:
    """Replace only the first match of a pattern that has no groups of its own."""
    return F.regexp_replace(as_col(c), f"^([\\s\\S]*?)(?:{pattern})([\\s\\S]*)$",
                            "$1" + replacement + "$2")


def replace_all(c: ColumnLike, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(as_col(c), pattern, replacement)


def strip(c: ColumnLike) -> Column:
    """Remove blanks, tabs and line ends at both sides."""
    return F.regexp_replace(as_col(c), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")


def piece(c: ColumnLike, sep: str, n: int) -> Column:
    """The ``n``-th piece (from 1) of text split on ``sep``; empty when there are fewer."""
    return F.split_part(as_col(c), F.lit(sep), F.lit(n))


def before_first(c: ColumnLike, separators: str) -> Column:
    """Text up to the first of the separator characters, e.g. a site name in a file name."""
    escaped = "".join("\\" + s if s in "-]^\\" else s for s in separators)
    return F.regexp_replace(as_col(c), f"[{escaped}][\\s\\S]*$", "")
