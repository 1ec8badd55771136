"""Individual histories to survival tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import months_from
from ..functions.lookups import SURVIVAL_CODES, lookup
from ..functions.nulls import sum_strict, to_number
from .aggregate import ratio_percent
from .joins import null_safe_join, with_group_stats
from .reshape import to_long

# The last census of the two studies.
LAST_CENSUSES = ("2012-07-01", "2019-08-01")


def censor_class(count: str, date: str, last: Sequence[str] = LAST_CENSUSES) -> Column:
    """``right`` when alive at the last census, else ``interval``."""
    ends = [F.to_date(F.lit(d)) for d in last]
    return F.when((F.col(count) == 1) & F.col(date).isin(ends), "right").otherwise("interval")


def history_long(wide: DataFrame, ids: Sequence[str], censuses: dict[str, tuple[int, str]]) -> DataFrame:
    """Wide histories to rows with year, season, and the first of July or August as date.

    ``censuses`` maps a census column to its year and season (``early`` or ``late``).
    """
    long = to_long(wide.select(*ids, *censuses), list(censuses), "census", "count")
    years = {c: y for c, (y, _) in censuses.items()}
    seasons = {c: s for c, (_, s) in censuses.items()}
    dated = long.withColumns({"year": lookup("census", years), "season": lookup("census", seasons)})
    month = F.when(F.col("season") == "early", 7).otherwise(8)
    return dated.withColumn("date", F.make_date("year", month, F.lit(1))).drop("census", "year")


def survival_rows(history: DataFrame, ids: Sequence[str], climate: DataFrame | None = None,
                  last: Sequence[str] = LAST_CENSUSES) -> DataFrame:
    """Rows per individual and census with censor class, duration and the climate of the month."""
    rows = history.withColumn("censor", censor_class("count", "date", last))
    rows = with_group_stats(rows, ids, {"survival_duration": sum_strict("count")})
    if climate is None:
        return rows
    return null_safe_join(rows, climate, ["siteID", "date"], "left")


def spells(rows: DataFrame, ids: Sequence[str], date: str, count: str,
           last: Sequence[str] = LAST_CENSUSES) -> DataFrame:
    """First and last date alive, and the date of death or of the last census, per individual.

    Death is the first census without the individual after one with it; alive at a last census,
    that census stands in. Of several deaths (with a return in between) the last counts, as an earlier
    one would come before the last date alive. ``rows`` has one row per individual and census, so a window over an
    individual holds as many rows as there are censuses. An individual never seen has no row.
    """
    before = F.lag(count).over(W.partitionBy(*ids).orderBy(date))
    marked = rows.withColumn("__before", before)
    ends = [F.to_date(F.lit(d)) for d in last]
    dead = ((F.col(count) == 0) & (F.col("__before") == 1)) | (
        (F.col(count) == 1) & F.col(date).isin(ends))
    alive = F.col(count) != 0
    return marked.groupBy(*ids).agg(
        F.min(F.when(alive, F.col(date))).alias("date_first"),
        F.max(F.when(alive, F.col(date))).alias("date_last"),
        F.max(F.when(dead, F.col(date))).alias("date_dead"),
        F.sum(count).alias("survival_duration"),
    ).where(F.col("date_first").isNotNull()).withColumns({
        "months_til_alive": months_from("date_first", "date_last"),
        "months_til_dead": months_from("date_first", "date_dead"),
    })


def event_rows(rows: DataFrame, ids: Sequence[str], covariates: Sequence[str], date: str = "date",
               count: str = "count", last: Sequence[str] = LAST_CENSUSES) -> DataFrame:
    """First and last occurrence of each individual as two rows, with the covariates of that row.

    Individuals whose last date alive is after their date of death, or without one, drop out.
    """
    timing = spells(rows, ids, date, count, last)
    alive = rows.where(F.col(count) != 0)
    picked = F.struct(F.col(date), *[F.col(c) for c in covariates])
    edges = alive.groupBy(*ids).agg(F.min_by(picked, F.col(date)).alias("first"),
                                    F.max_by(picked, F.col(date)).alias("last"))
    both = edges.select(*ids, F.explode(F.array(
        F.struct(F.lit("first").alias("occurrence"), F.col("first").alias("at")),
        F.struct(F.lit("last").alias("occurrence"), F.col("last").alias("at")))).alias("e"))
    flat = both.select(*ids, "e.occurrence", *[F.col(f"e.at.{c}").alias(c) for c in [date, *covariates]])
    keep = ["survival_duration", "months_til_alive", "months_til_dead"]
    joined = null_safe_join(flat, timing.select(*ids, *keep), ids, "left")
    return joined.where(F.col("months_til_alive") <= F.col("months_til_dead"))


def survival_percent(rows: DataFrame, frame: DataFrame, keys: Sequence[str], survival: str = "survival") -> DataFrame:
    """Share of survivors per key over a complete frame; keys without seedlings get zeros."""
    coded = rows.withColumn("__s", F.coalesce(lookup(survival, SURVIVAL_CODES), to_number(survival, "int")))
    counted = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("tot"), sum_strict("__s").alias("totS"))
    counted = counted.withColumn("survival", ratio_percent("totS", "tot"))
    out = null_safe_join(counted, frame, keys, "right")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tot", "totS", "survival")})


def interval_survival(df: DataFrame, keys: Sequence[str], alive: str, dead: str, tol: float = 1e-10, max_iter: int = 100_000) -> DataFrame:
    """Survival curve of interval-censored deaths per group: start, end, mass, survival, n.

    A death lies after the last time alive and not after the first time dead; without a time dead it lies after the last time
    alive (right-censored). Only pairs of times are counted, with map-side sums; their number is bounded by the censuses
    whatever the number of individuals, and those counts alone meet in one task per group.

    The estimate puts its mass on the maximal intersections of the intervals (Turnbull), found by the self-consistent EM steps with squared
    extrapolation between them, until no mass moves by ``tol``. ``survival`` is the share alive after ``end``; mass behind the last time has no end. Times are numbers or
    dates (given back as days since 1970); a row without a time alive is left out, an interval that is empty or reversed is an error.
    """
    def number(c: str) -> Column:
        return (F.unix_date(c) if df.schema[c].dataType.typeName() == "date" else F.col(c)).cast("double")

    known = df.where(F.col(alive).isNotNull()).select(*keys, number(alive).alias("__left"), F.coalesce(number(dead), F.lit(float("inf"))).alias("__right"))
    wrong = F.assert_true(F.col("__left") < F.col("__right"), F.lit("a time dead is not after the time alive"))
    counted = known.withColumn("__ok", wrong).where("__ok IS NULL").groupBy(*keys, "__left", "__right").agg(F.count(F.lit(1)).alias("__n"))
    types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]
    schema = ", ".join([*types, "start double", "end double", "mass double", "survival double", "n bigint"])
    names = list(keys)

    def fit(pairs: pd.DataFrame) -> pd.DataFrame:
        left, right, n = pairs["__left"].to_numpy(float), pairs["__right"].to_numpy(float), pairs["__n"].to_numpy(float)
        # In order of time, right ends before left ones as intervals are open to the left: a left end straight before a right one.
        times = np.concatenate([left, right])
        is_left = np.repeat([True, False], len(left))
        order = np.lexsort((is_left, times))
        at = np.flatnonzero(is_left[order][:-1] & ~is_left[order][1:])
        start, end = times[order][at], times[order][at + 1]
        held = (left[:, None] <= start) & (end <= right[:, None])

        def step(p: np.ndarray) -> np.ndarray:
            return p * ((n / (held @ p)) @ held) / n.sum()

        p = np.full(len(start), 1 / len(start))
        for _ in range(max_iter):
            one = step(p)
            two = step(one)
            if np.abs(two - one).max() < tol:
                break
            r, v = one - p, two - one - (one - p)
            jump = -max(1.0, float(np.linalg.norm(r) / max(np.linalg.norm(v), 1e-300)))
            ahead = p - 2 * jump * r + jump * jump * v
            p = step(ahead) if (ahead > 0).all() else two
        p = two
        out = pd.DataFrame({"start": start, "end": np.where(np.isinf(end), np.nan, end), "mass": p, "survival": np.clip(1 - np.cumsum(p), 0, 1), "n": int(n.sum())})
        for c in reversed(names):
            out.insert(0, c, pairs[c].iloc[0])
        return out

    result = counted.groupBy(*keys).applyInPandas(fit, schema)
    return result.withColumn("end", F.when(~F.isnan("end"), F.col("end")))
