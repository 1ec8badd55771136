"""Row-count audit around steps, without passes over the data of its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from .joins import null_safe_join


class Audit:
    """Counts rows in and out of named steps while the job runs.

    Counts are known after the first action on the result, and cover that action.
    """

    def __init__(self):
        self._seen: dict[tuple[str, str], Observation] = {}

    def _watch(self, df: DataFrame, step: str, what: str, **extra) -> DataFrame:
        seen = Observation(f"{step} {what}")
        self._seen[(step, what)] = seen
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in extra.items()])

    def step(self, df: DataFrame, name: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run ``fn`` and count the rows before and after it."""
        return self._watch(fn(self._watch(df, name, "in")), name, "out")

    def left_join(self, left: DataFrame, right: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        """Left join that also counts matched and unmatched rows."""
        marked = right.withColumn("__hit", F.lit(1))
        joined = null_safe_join(self._watch(left, name, "in"), marked, keys, "left")
        return self._watch(joined, name, "out", matched=F.count("__hit"),
                           unmatched=F.count_if(F.col("__hit").isNull())).drop("__hit")

    def report(self) -> dict[tuple[str, str], dict[str, int]]:
        return {key: dict(o.get) for key, o in self._seen.items()}


def join_audit(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, keys and matches of a join as one row, from counts per key."""
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    both = null_safe_join(l, r, keys, "outer")
    a, b = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    return both.agg(
        F.sum(a).alias("rows_left"), F.sum(b).alias("rows_right"),
        F.sum(F.when(b > 0, a).otherwise(0)).alias("matched_left"),
        F.sum(F.when(b == 0, a).otherwise(0)).alias("unmatched_left"),
        F.sum(F.when(a == 0, b).otherwise(0)).alias("unmatched_right"),
        F.count_if(b > 1).alias("repeated_right_keys"),
        F.sum(a * F.greatest(b, F.lit(1))).alias("rows_left_join"))
