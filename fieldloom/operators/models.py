"""Count models, predictions on a grid, diagnostics and summaries of posterior draws.

The design matrix is written out as columns, so terms are explicit and Spark's GLM fits it by
distributed iterations. Only the coefficients and their k by k covariance reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.gamma import poisson_cdf, poisson_mass
from ..functions.nulls import ColumnLike, as_col
from ..session import cut_lineage
from .joins import assert_unique, null_safe_join
from .ordered import ecdf, exact_quantiles
from .reshape import pair_all
from .stats import bin_number

# Probability masses of the intervals drawn around posterior medians.
INTERVAL_MASSES = (0.5, 0.66, 0.8, 0.95, 0.99)
NORMAL_95 = 1.959963984540054


def term(*factors: str) -> Column:
    """Product of design columns, as in an interaction."""
    return reduce(lambda a, b: a * b, [F.col(f"`{f}`") for f in factors])


def design(df: DataFrame, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add one column per model term, each the product of its factors."""
    return df.withColumns({name: term(*factors).cast("double") for name, factors in terms.items()})


@dataclass(frozen=True)
class CountModel:
    """A fitted count model: term names (intercept first), coefficients and covariance."""

    terms: tuple[str, ...]
    coefficients: tuple[float, ...]
    covariance: tuple[tuple[float, ...], ...]

    def linear(self, columns: Mapping[str, Column] | None = None) -> Column:
        """Linear predictor over the term columns."""
        cells = self._cells(columns)
        return reduce(lambda a, b: a + b, [F.lit(b) * c for b, c in zip(self.coefficients, cells)])

    def linear_variance(self, columns: Mapping[str, Column] | None = None) -> Column:
        """Variance of the linear predictor (delta method)."""
        cells = self._cells(columns)
        total = F.lit(0.0)
        for i, a in enumerate(cells):
            for j, b in enumerate(cells):
                total = total + F.lit(self.covariance[i][j]) * a * b
        return F.greatest(total, F.lit(0.0))

    def _cells(self, columns):
        return [F.lit(1.0), *[(columns or {}).get(t, F.col(f"`{t}`")) for t in self.terms[1:]]]


def fit_counts(df: DataFrame, response: str, terms: Sequence[str], max_iter: int = 50,
               tol: float = 1e-10) -> CountModel:
    """Poisson regression with a log link on prepared term columns; incomplete rows are left out."""
    rows = df.select(F.col(response).cast("double").alias("__y"),
                     *[F.col(f"`{t}`").cast("double").alias(f"__t{i}") for i, t in enumerate(terms)]).na.drop()
    rows = cut_lineage(rows)  # read by every iteration of the fit
    assembled = VectorAssembler(inputCols=[f"__t{i}" for i in range(len(terms))], outputCol="__f").transform(rows)
    fitted = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol="__y", featuresCol="__f", maxIter=max_iter, tol=tol,
        predictionCol="__mu").fit(assembled)
    coefficients = [float(fitted.intercept), *[float(b) for b in fitted.coefficients]]
    covariance = _covariance(rows, len(terms), coefficients)
    return CountModel(("(Intercept)", *terms), tuple(coefficients),
                      tuple(tuple(float(v) for v in row) for row in covariance))


def _covariance(rows: DataFrame, k: int, coefficients: Sequence[float]) -> np.ndarray:
    """Inverse of the information matrix, whose k by k cells come from one aggregate."""
    cells = [F.lit(1.0), *[F.col(f"__t{i}") for i in range(k)]]
    mu = F.exp(reduce(lambda a, b: a + b, [F.lit(b) * c for b, c in zip(coefficients, cells)]))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.withColumn("__mu", mu).agg(*[
        F.sum(F.col("__mu") * cells[i] * cells[j]).alias(f"c{n}") for n, (i, j) in enumerate(pairs)]).first()
    information = np.zeros((k + 1, k + 1))
    for n, (i, j) in enumerate(pairs):
        information[i, j] = information[j, i] = sums[n]
    return np.linalg.inv(information)


def coefficient_table(df: DataFrame, model: CountModel, exponentiate: bool = True, digits: int = 3) -> DataFrame:
    """Terms with estimate, standard error, statistic and 95 % interval, rounded half to even."""
    rows = [(t, b, float(np.sqrt(model.covariance[i][i])))
            for i, (t, b) in enumerate(zip(model.terms, model.coefficients))]
    table = df.sparkSession.createDataFrame(rows, "term string, b double, se double")
    shape = F.exp if exponentiate else (lambda c: c)
    scale = shape(F.col("b")) if exponentiate else F.lit(1.0)
    cells = {"estimate": shape(F.col("b")), "std_error": F.col("se") * scale, "statistic": F.col("b") / F.col("se"),
             "conf_low": shape(F.col("b") - NORMAL_95 * F.col("se")),
             "conf_high": shape(F.col("b") + NORMAL_95 * F.col("se"))}
    return table.select("term", *[F.bround(c, digits).alias(n) for n, c in cells.items()])


def predict_counts(df: DataFrame, model: CountModel, out: str = "mu") -> DataFrame:
    return df.withColumn(out, F.exp(model.linear()))


def predict_grid(points: DataFrame, model: CountModel, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Expected count with a 95 % interval on every grid point."""
    rows = design(points, terms)
    eta, half = F.col("__eta"), NORMAL_95 * F.sqrt("__var")
    out = rows.withColumns({"__eta": model.linear(), "__var": model.linear_variance()})
    return out.withColumns({"predicted": F.exp(eta), "conf_low": F.exp(eta - half),
                            "conf_high": F.exp(eta + half)}).select(
        *points.columns, "predicted", "conf_low", "conf_high")


def mean_and_interval(df: DataFrame, keys: Sequence[str], response: str) -> DataFrame:
    """Poisson mean per group with a 95 % interval: the saturated model in closed form."""
    sums = df.groupBy(*keys).agg(F.sum(response).cast("double").alias("s"), F.count(response).alias("n"))
    mean = F.col("s") / F.col("n")
    half = NORMAL_95 / F.sqrt("s")
    return sums.where(F.col("s") > 0).select(
        *keys, mean.alias("predicted"), (mean * F.exp(-half)).alias("conf_low"),
        (mean * F.exp(half)).alias("conf_high"))


def diagnostics(df: DataFrame, response: str, mu: str, n_parameters: int, cutoff: float = 3.0) -> DataFrame:
    """Dispersion, zero inflation and share of outliers of a fitted count model.

    Dispersion is Pearson chi-square by degrees of freedom; zero inflation is observed by expected
    zeros; an outlier has a Pearson residual beyond the cutoff.
    """
    y, m = F.col(response), F.col(mu)
    pearson = (y - m) / F.sqrt(m)
    return df.agg(
        (F.sum(pearson * pearson) / (F.count(y) - n_parameters)).alias("dispersion"),
        (F.count_if(y == 0) / F.sum(F.exp(-m))).alias("zero_ratio"),
        (F.count_if(F.abs(pearson) > cutoff) / F.count(y)).alias("outlier_share"),
        F.count(y).alias("n"))


def residual_quantiles(df: DataFrame, response: str, mu: str, covariate: str, lo: float, hi: float, bins: int,
                       probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of the Pearson residual in equal bins of a covariate; -1 and ``bins`` hold what lies outside."""
    y, m = F.col(response), F.col(mu)
    bin_ = bin_number(F.col(covariate), lo, hi, bins)
    rows = df.where(F.col(covariate).isNotNull()).select(bin_.alias("bin"), ((y - m) / F.sqrt(m)).alias("residual"))
    return exact_quantiles(rows, ["bin"], "residual", probs)


# --- posterior draws ----------------------------------------------------------------------


def gather_draws(draws: DataFrame, terms: Sequence[str] | None = None, prefix: str = "b_") -> DataFrame:
    """Draws of the chosen coefficients with readable names: ``b_a:b`` becomes ``a x b``.

    ``draws`` is long: draw, term, value. The intercept is left out unless it is asked for.
    """
    chosen = (F.col("term").isin(list(terms)) if terms is not None
              else F.col("term").startswith(prefix) & (F.col("term") != f"{prefix}Intercept"))
    name = F.regexp_replace(F.split_part(F.col("term"), F.lit("_"), F.lit(2)), ":", " x ")
    return draws.where(chosen).withColumn("var", name)


def epred_draws(draws: DataFrame, points: DataFrame, terms: Mapping[str, Sequence[str]],
                intercept: str = "b_Intercept", draw: str = "draw") -> DataFrame:
    """Expected count for every draw on every grid point.

    Draws become one row each (terms are a fixed list) and meet the grid in a salted join, so neither
    side is gathered.
    """
    names = [intercept, *terms]
    wide = draws.groupBy(draw).agg(*[F.max(F.when(F.col("term") == t, F.col("value"))).alias(f"__b{i}")
                                     for i, t in enumerate(names)])
    work = design(points, {f"__x{i}": f for i, f in enumerate(terms.values(), start=1)})
    rows = pair_all(wide, work)
    eta = reduce(lambda a, b: a + b, [F.col(f"__b{i}") * F.col(f"__x{i}") for i in range(1, len(names))], F.col("__b0"))
    return rows.select(draw, *points.columns, F.exp(eta).alias("epred"))


def interval_summary(df: DataFrame, keys: Sequence[str], value: str, masses: Sequence[float] = INTERVAL_MASSES) -> DataFrame:
    """Median and central intervals per group: width, median, lower, upper."""
    probs = sorted({0.5, *[round((1 - m) / 2, 6) for m in masses], *[round((1 + m) / 2, 6) for m in masses]})
    long = exact_quantiles(df, keys, value, probs)
    packed = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("prob", "quantile"))).alias("q"))

    def at(p):
        return F.try_element_at("q", F.lit(round(p, 6)))

    rows = F.array(*[F.struct(F.lit(float(m)).alias("width"), at(0.5).alias("median"),
                              at((1 - m) / 2).alias("lower"), at((1 + m) / 2).alias("upper")) for m in masses])
    return packed.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def join_predictions(predictions: DataFrame, covariates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions with the covariates of their level.

    The covariates must have one row per key, else predictions and covariates would be multiplied;
    a repeated key is an error.
    """
    return null_safe_join(predictions, assert_unique(covariates, keys), keys, "left")


def squared(c: ColumnLike) -> Column:
    return as_col(c) * as_col(c)


# --- exact residuals of counts ------------------------------------------------------------


def exact_residuals(df: DataFrame, response: str, mu: str, uniform: Column | None = None) -> DataFrame:
    """Add the exact tails of a count and its quantile residual: ``p_below`` = P(Y < y), ``p_upto`` = P(Y <= y), ``residual``.

    The residual is uniform on (0, 1) where the model is right: the place ``uniform`` of the step from P(Y < y) to P(Y <= y),
    the middle by default. It needs no simulation.
    """
    upto, mass = poisson_cdf(response, mu), poisson_mass(response, mu)
    work = df.withColumn("p_upto", upto).withColumn("p_below", F.greatest(F.lit(0.0), F.col("p_upto") - mass))
    share = F.lit(0.5) if uniform is None else uniform
    return work.withColumn("residual", F.col("p_below") + share * (F.col("p_upto") - F.col("p_below")))


def count_tests(df: DataFrame, keys: Sequence[str], level: float = 0.01) -> DataFrame:
    """Per group of rows from ``exact_residuals``: rows beyond either tail of ``level`` / 2, their expected number, and the
    largest distance of the residuals' distribution from the uniform one with its asymptotic probability."""
    marked = df.groupBy(*keys).agg(
        F.count("residual").alias("n"), F.count_if(F.col("p_upto") < level / 2).alias("n_low"), F.count_if(1 - F.col("p_below") < level / 2).alias("n_high"))
    steps = ecdf(df, keys, "residual")
    sizes = df.groupBy(*keys).agg(F.count("residual").alias("__all"))
    joined = null_safe_join(steps, sizes, list(keys), "left") if keys else steps.withColumn("__all", sizes.scalar())
    r, top = F.col("residual"), F.col("ecdf")
    gap = joined.groupBy(*keys).agg(F.max(F.greatest(top - r, r - (top - F.col("n") / F.col("__all")))).alias("distance"))
    out = null_safe_join(marked, gap, list(keys), "left") if keys else marked.withColumn("distance", gap.scalar())
    x = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("distance")
    series = reduce(lambda a, b: a + b, [(2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x) for k in range(1, 40)])
    return out.withColumns({"expected": F.col("n") * level, "p_uniform": F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))})
