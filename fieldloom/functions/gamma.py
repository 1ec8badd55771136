"""Gamma function and tails of the Poisson distribution as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from .nulls import ColumnLike, as_col

# Coefficients of the Lanczos approximation for g = 7.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
           -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

# Counts below SMALL_COUNT are summed up to a mean of _SUM_LIMIT, where e^mu is finite; beyond, Gauss-Legendre nodes and
# weights on (0, 1), over the part of a tail that is above e^-_DEPTH of its first value.
SMALL_COUNT = 32
_SUM_LIMIT = 700.0
_DEPTH = 40.0
NODES = tuple((float(x + 1) / 2, float(w) / 2) for x, w in zip(*np.polynomial.legendre.leggauss(32)))


def log_gamma(a: ColumnLike) -> Column:
    """Logarithm of the gamma function for a >= 1/2, relative error about 1e-15."""
    z = as_col(a).cast("double") - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        total = total + F.lit(c) / (z + i)
    t = z + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def _tail_by_mass(y: Column, mu: Column, upper: Column) -> Column:
    """Tail of a Poisson count divided by P(Y = y): P(Y <= y) where ``upper``, P(Y > y) elsewhere.

    Both are integrals of (t / mu)^y e^(mu - t), from mu upwards or down to 0, as y is whole. Beyond ``width`` times mu the integrand
    is below e^-40, so the same few nodes give any count with a relative error of about 1e-13.
    """
    near, apart = F.greatest(y, F.lit(1e-9)), F.greatest(F.abs(mu - y), F.lit(1e-9))
    width = F.when(upper, F.least(_DEPTH / apart, (2 * _DEPTH + F.sqrt(4 * _DEPTH ** 2 + 18 * _DEPTH * near)) / (3 * near))).otherwise(
        F.least(F.lit(1.0), _DEPTH / apart, F.sqrt(2 * _DEPTH / near)))
    nodes = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(w).alias("w")) for u, w in NODES])

    def integral(v: Column) -> Column:
        return v["scale"] * F.aggregate(nodes, F.lit(0.0), lambda s, n: s + n["w"] * F.exp(
            v["y"] * F.log1p(v["step"] * n["u"]) - v["mu"] * v["step"] * n["u"]))

    # An array of one struct, so that the width is evaluated once a row and not at every node.
    signed = F.when(upper, width).otherwise(-width)
    one = F.array(F.struct(y.alias("y"), mu.alias("mu"), signed.alias("step"), (mu * width).alias("scale")))
    return F.transform(one, integral)[0]


def poisson_cdf(y: ColumnLike, mu: ColumnLike) -> Column:
    """P(Y <= y) for a Poisson count; 0 below zero.

    Small counts add up their masses in plain arithmetic. The others take an integral over fixed nodes, whose cost does not grow
    with the count either.
    """
    y, mu = as_col(y).cast("double"), as_col(mu).cast("double")
    whole = F.floor(F.greatest(y, F.lit(0.0))).cast("double")
    total = F.lit(1.0)
    for k in range(SMALL_COUNT - 1, 0, -1):
        total = 1 + (whole >= k).cast("double") * mu * (1 / k) * total
    upper = mu >= whole
    tail = F.exp(whole * F.log(mu) - mu - log_gamma(whole + 1)) * _tail_by_mass(whole, mu, upper)
    summed = (whole < SMALL_COUNT) & mu.between(0.0, _SUM_LIMIT)
    return F.when(y < 0, 0.0).when(y.isNull() | mu.isNull(), None).when(mu == 0, 1.0).when(
        summed, F.least(F.lit(1.0), F.exp(-mu) * total)).when(upper, tail).otherwise(1 - tail)


def poisson_mass(y: ColumnLike, mu: ColumnLike) -> Column:
    """P(Y = y) for a Poisson count."""
    y, mu = as_col(y).cast("double"), as_col(mu).cast("double")
    return F.when(y < 0, 0.0).when(mu == 0, (y == 0).cast("double")).otherwise(F.exp(y * F.log(mu) - mu - log_gamma(y + 1)))
