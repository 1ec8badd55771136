"""Summary statistics and least-squares trends as single aggregates.

Every fit here is a function of sums, so one pass with map-side partial sums serves any number of
groups of any size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import ColumnLike, as_col
from ..session import cut_lineage
from .joins import null_safe_join, row_stats
from .ordered import exact_quantiles


def _paired(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    """Both values where both are present, else missing."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def origin_slope(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate: slope of a regression through the origin."""
    x, y = _paired(x, y)
    return F.try_divide(F.sum(x * y), F.sum(x * x))


def origin_regression(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Regression through the origin per group: estimate, std_error, t, r_squared, sigma, n.

    R squared is uncentred, as is usual without an intercept.
    """
    px, py = _paired(x, y)
    sums = df.groupBy(*keys).agg(F.sum(px * py).alias("xy"), F.sum(px * px).alias("xx"),
                                 F.sum(py * py).alias("yy"), F.count(px).alias("n"))
    rss = F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0))
    fit = sums.where(F.col("xx") > 0).withColumn("estimate", F.col("xy") / F.col("xx")).withColumn("rss", rss)
    fit = fit.withColumn("sigma", F.when(F.col("n") > 1, F.sqrt(F.col("rss") / (F.col("n") - 1))))
    fit = fit.withColumn("std_error", F.col("sigma") / F.sqrt("xx"))
    return fit.select(*keys, "estimate", "std_error",
                      F.try_divide("estimate", "std_error").alias("statistic"),
                      (1 - F.try_divide("rss", "yy")).alias("r_squared"), "sigma", "n")


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Straight line per group: intercept, slope, r_squared, n."""
    px, py = _paired(x, y)
    return df.groupBy(*keys).agg(
        F.regr_intercept(py, px).alias("intercept"), F.regr_slope(py, px).alias("slope"),
        F.regr_r2(py, px).alias("r_squared"), F.count(px).alias("n"))


def quadratic_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Parabola per group, y = a0 + a1 x + a2 x^2, from power sums of the centred x.

    Centring on the group mean keeps the normal equations well conditioned; they then reduce to a
    two by two system.
    """
    px, py = _paired(x, y)
    work = df.withColumns({"__x": px, "__y": py})
    means = work.groupBy(*keys).agg(F.avg("__x").alias("__m"))
    centred = null_safe_join(work, means, keys, "left") if keys else work.withColumn("__m", means.scalar())
    d, v = F.col("__x") - F.col("__m"), F.col("__y")
    sums = centred.groupBy(*keys).agg(
        F.count("__x").alias("n"), F.max("__m").alias("m"),
        F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4"),
        F.sum(v).alias("t0"), F.sum(d * v).alias("t1"), F.sum(d * d * v).alias("t2"))
    c = F.col
    # With centred x the first power sum is zero, so the constant can be eliminated first.
    q = c("s4") - c("s2") * c("s2") / c("n")
    r = c("t2") - c("s2") * c("t0") / c("n")
    det = c("s2") * q - c("s3") * c("s3")
    solved = sums.withColumn("b2", F.try_divide(c("s2") * r - c("s3") * c("t1"), det)).withColumn(
        "b1", F.try_divide(c("t1") - c("s3") * c("b2"), c("s2"))).withColumn(
        "b0", (c("t0") - c("s2") * c("b2")) / c("n"))
    return solved.select(*keys, (c("b0") - c("b1") * c("m") + c("b2") * c("m") * c("m")).alias("a0"),
                         (c("b1") - 2 * c("b2") * c("m")).alias("a1"), c("b2").alias("a2"), "n")


def orthogonal_quadratic(df: DataFrame, x: str, out: tuple[str, str] = ("poly1", "poly2")) -> DataFrame:
    """Orthonormal linear and quadratic terms of a column over the whole table."""
    value = F.col(x).cast("double")
    mean = df.agg(F.avg(value)).scalar()
    centred = df.withColumn("__m", mean).withColumn("__d", value - F.col("__m"))
    d = F.col("__d")
    s = row_stats(centred, {"n": F.count("__d"), "s2": F.sum(d * d), "s3": F.sum(d * d * d),
                            "s4": F.sum(d * d * d * d)})
    work = centred.withColumn("__s", s)
    n, s2, s3, s4 = (F.col("__s")[k] for k in ("n", "s2", "s3", "s4"))
    raw = d * d - s2 / n - s3 / s2 * d
    norm = s4 - s2 * s2 / n - s3 * s3 / s2
    return work.withColumns({out[0]: d / F.sqrt(s2), out[1]: raw / F.sqrt(norm)}).select(*df.columns, *out)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of each pair of columns over complete rows, long: one aggregate, one row per pair.

    A constant column has no correlation: missing.
    """
    pairs = list(itertools.combinations(columns, 2))
    complete = df.select(*columns).na.drop()
    spread = {c: F.stddev_pop(c) for c in columns}
    wide = complete.agg(*[F.try_divide(F.covar_pop(a, b), spread[a] * spread[b]).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                               F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def collinearity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factor of each column.

    Only the correlations (one number per pair of columns) reach the driver. A column without any
    correlation, as a constant has none, gets a missing factor and is left out of the others'.
    """
    found = {(r.var1, r.var2): r.correlation for r in correlations(df, columns).collect()}
    known = [c for c in columns if any(v is not None for k, v in found.items() if c in k)]
    position = {c: i for i, c in enumerate(known)}
    matrix = np.eye(len(known))
    for (a, b), value in found.items():
        if a in position and b in position:
            matrix[position[a], position[b]] = matrix[position[b], position[a]] = value
    factors = np.diag(np.linalg.pinv(matrix) if np.linalg.matrix_rank(matrix) < len(known) else np.linalg.inv(matrix))
    return df.sparkSession.createDataFrame(
        [(c, float(factors[position[c]]) if c in position else None) for c in columns], "term string, vif double")


def term_collinearity(df: DataFrame, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Generalised variance inflation of model terms that may have several design columns (factors, interactions).

    ``terms`` maps a term to its columns. Gives term, df, gvif = det(R_term) det(R_rest) / det(R) over the correlations R of all design
    columns of complete rows (one aggregate), and gvif^(1 / (2 df)), which compares terms with different numbers of
    columns. A term of one column has its usual factor. Linearly dependent columns are an error.
    """
    columns = [c for own in terms.values() for c in own]
    matrix = np.eye(len(columns))
    found = {(r.var1, r.var2): r.correlation for r in correlations(df, columns).collect()} if len(columns) > 1 else {}
    for (a, b), value in found.items():
        if value is None:
            raise ValueError(f"{a} or {b} is constant")
        i, j = columns.index(a), columns.index(b)
        matrix[i, j] = matrix[j, i] = value
    return _inflation(df, matrix, terms)


def _inflation(df: DataFrame, matrix: np.ndarray, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Generalised inflation from the log-determinants of blocks of a correlation matrix, in the order of the terms' columns."""
    def log_det(picked: list[int]) -> float:
        sign, value = np.linalg.slogdet(matrix[np.ix_(picked, picked)]) if picked else (1.0, 0.0)
        if sign <= 0 or value < -34:
            raise ValueError("design columns depend on each other linearly")
        return float(value)

    every, at, rows = list(range(len(matrix))), 0, []
    for term, own in terms.items():
        inside = every[at:at + len(own)]
        at += len(own)
        gvif = math.exp(log_det(inside) + log_det([i for i in every if i not in inside]) - log_det(every))
        rows.append((term, len(own), gvif, gvif ** (1 / (2 * len(own)))))
    return df.sparkSession.createDataFrame(rows, "term string, df int, gvif double, gvif_per_df double")


def model_collinearity(df: DataFrame, columns: Sequence[str], covariance: Sequence[Sequence[float]], terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """As ``term_collinearity``, from the covariance of a fitted model's coefficients (``columns`` name them, intercept first)."""
    place = [list(columns).index(c) for own in terms.values() for c in own]
    cov = np.asarray(covariance)[np.ix_(place, place)]
    sd = np.sqrt(np.diag(cov))
    return _inflation(df, cov / np.outer(sd, sd), terms)


def smooth_density(df: DataFrame, keys: Sequence[str], value: str, points: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on ``points`` equal steps from min - cut bw to max + cut bw: x, density, bw, n.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5), from exact quartiles; where the quartiles meet, the standard deviation
    stands alone. Values are dealt to their two neighbouring steps (linear binning), so the kernel runs over steps, not
    over rows: ``points`` squared per group. Missing and infinite values are left out; a group with one distinct value has no density.
    """
    c = F.col(value).cast("double")
    known = df.select(*keys, c.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    known = known if keys else known.withColumn("__all", F.lit(0))
    by = list(keys) or ["__all"]
    quartiles = exact_quantiles(known, by, "__v", [0.25, 0.75]).groupBy(*by).agg((F.max("quantile") - F.min("quantile")).alias("__iqr"))
    spread = known.groupBy(*by).agg(F.count("__v").alias("n"), F.stddev_samp("__v").alias("__sd"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    width = F.when(F.col("__iqr") > 0, F.least(F.col("__sd"), F.col("__iqr") / 1.34)).otherwise(F.col("__sd"))
    shape = null_safe_join(spread, quartiles, by, "inner").where("__sd > 0").withColumn("bw", 0.9 * width * F.pow("n", F.lit(-0.2)))
    shape = shape.withColumns({"__from": F.col("__lo") - cut * F.col("bw"), "__to": F.col("__hi") + cut * F.col("bw")})
    shape = cut_lineage(shape.select(*by, "n", "bw", "__from", ((F.col("__to") - F.col("__from")) / (points - 1)).alias("__step")))
    place = (F.col("__v") - F.col("__from")) / F.col("__step")
    dealt = null_safe_join(known, shape, by, "inner").withColumn("__at", place).withColumn("__low", F.floor("__at").cast("int"))
    share = F.col("__at") - F.col("__low")
    # Per step the summed shares for itself and for the next one: no row is doubled.
    steps = dealt.groupBy(*by, "__low").agg(F.sum(1 - share).alias("__own"), F.sum(share).alias("__next"))
    both = steps.select(*by, F.explode(F.array(F.struct(F.col("__low").alias("b"), F.col("__own").alias("w")),
                                               F.struct((F.col("__low") + 1).alias("b"), F.col("__next").alias("w")))).alias("s"))
    weights = both.groupBy(*by, F.col("s.b").alias("__b")).agg(F.sum("s.w").alias("__w"))
    work = null_safe_join(weights, shape, by, "inner").withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("__g") - F.col("__b")) * F.col("__step") / F.col("bw")
    kernel = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    out = work.groupBy(*by, "__g").agg(F.sum(F.col("__w") * kernel).alias("__s"), *[F.first(x).alias(x) for x in ("n", "bw", "__from", "__step")])
    return out.select(*keys, F.col("__g").alias("step"), (F.col("__from") + F.col("__g") * F.col("__step")).alias("x"), (F.col("__s") / (F.col("n") * F.col("bw"))).alias("density"), "bw", "n")


def binned_density(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and density of a value in equal bins from ``lo`` to ``hi``.

    Values below and above have bins of their own, -1 and ``bins``, without a middle and a density;
    all values count for the density.
    """
    width = (hi - lo) / bins
    b = bin_number(F.col(value), lo, hi, bins)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("n_total"))
    joined = null_safe_join(counted, sizes, keys, "left") if keys else counted.withColumn("n_total", sizes.scalar())
    inside = F.col("bin").between(0, bins - 1)
    return joined.select(*keys, "bin", F.when(inside, F.lit(lo) + (F.col("bin") + 0.5) * width).alias("mid"), "n",
                         F.when(inside, F.col("n") / (F.col("n_total") * width)).alias("density"))


def bin_number(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Number of the equal bin from 0; ``hi`` is in the last one, -1 and ``bins`` are outside."""
    inside = F.least(F.lit(bins - 1), F.floor((x - lo) / ((hi - lo) / bins)).cast("int"))
    return F.when(x < lo, -1).when(x > hi, bins).otherwise(inside)


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, variance (n-1), skewness and excess kurtosis (population forms) per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
                                 F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
