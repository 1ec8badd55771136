"""Count regression with nested random intercepts, fitted by the Laplace approximation.

The model is log E[y] = x'b + u1[g1] + u2[g1, g2] + ..., with normal effects of one variance per level. For given
variances the mode of (b, u) is found by Newton steps on the penalised likelihood. The matrix of a step is an arrow: the effects
of the deepest level meet only their own rows, so each is eliminated inside the aggregate of its group (a Schur complement of
numbers), which leaves a problem of the same shape for the level above, and k by k sums at the driver in the end. Effects stay in
tables, one row per group; neither they nor the rows are gathered.

Variances maximise the Laplace likelihood over their logarithms by Newton steps. The points of the finite differences
are one more column of the tables, so all of them are evaluated by the same jobs.

Rows of one group with equal terms are added up first, which changes nothing for counts. Incomplete rows are left out; a missing group
is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .joins import null_safe_join
from .models import CountModel, fit_counts

STEP = 3e-3
LOG_RANGE = (-9.0, 4.0)


@dataclass(frozen=True)
class MixedModel:
    """Fixed effects with the covariance given the variances, standard deviations by level, and the effects by group."""

    fixed: CountModel
    deviations: tuple[float, ...]
    log_likelihood: float
    effects: DataFrame


def _total(cells: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cells)


class _Modes:
    """Modes of fixed and random effects for several points of log standard deviations at once."""

    def __init__(self, rows: DataFrame, k: int, groups: Sequence[str], start: Sequence[float]):
        self.rows, self.k, self.groups = rows, k, list(groups)
        self.x = [F.lit(1.0), *[F.col(f"__t{i}") for i in range(k)]]
        self.pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        zero = [F.lit(0.0).alias(f"__u{n}") for n in range(len(groups))]
        self.effects = cut_lineage(rows.select(*groups).distinct().select(F.lit(0).alias("__point"), *groups, *zero))
        self.beta = {0: np.array(start, float)}

    def spread(self, points: int) -> None:
        """Start every point from the mode of point 0."""
        base = self.effects.where("__point = 0").drop("__point")
        self.effects = cut_lineage(base.withColumn("__point", F.explode(F.array(*[F.lit(p) for p in range(points)]))))
        self.beta = {p: self.beta[0].copy() for p in range(points)}

    def by_point(self, values: dict[int, float]) -> Column:
        return reduce(lambda c, p: c.when(F.col("__point") == p, F.lit(float(values[p]))), values, F.when(F.lit(False), F.lit(0.0)))

    def step(self, logs: Sequence[Sequence[float]], tol: float) -> tuple[np.ndarray, dict[int, np.ndarray], bool]:
        """One Newton step at all points: Laplace likelihoods and Schur complements before it, and whether all points have settled."""
        k, m = self.k + 1, len(self.groups)
        beta = [self.by_point({p: b[i] for p, b in self.beta.items()}) for i in range(k)]
        joined = null_safe_join(self.rows, self.effects, self.groups, "inner")
        eta = _total([b * x for b, x in zip(beta, self.x)]) + _total([F.col(f"__u{n}") for n in range(m)])
        mu = F.col("__n") * F.exp("__eta")
        left = F.col("__y") - F.col("__mu")
        work = joined.withColumn("__eta", eta).withColumn("__mu", mu)
        sums = {"d": F.sum("__mu"), "g": F.sum(left), "ll": F.sum(F.col("__y") * F.col("__eta") - F.col("__mu")), "det": F.lit(0.0), "pen": F.lit(0.0)}
        sums |= {f"c{i}": F.sum(F.col("__mu") * self.x[i]) for i in range(k)} | {f"r{i}": F.sum(left * self.x[i]) for i in range(k)}
        sums |= {f"a{i}_{j}": F.sum(F.col("__mu") * self.x[i] * self.x[j]) for i, j in self.pairs}
        table = work.groupBy("__point", *self.groups).agg(*[c.alias(n) for n, c in sums.items()], *[F.max(f"__u{n}").alias(f"__u{n}") for n in range(m)])
        kept = []
        for level in range(m, 0, -1):
            v = self.by_point({p: math.exp(2 * logs[p][level - 1]) for p in self.beta})
            u = F.col(f"__u{level - 1}")
            table = cut_lineage(table.withColumn("v", v).withColumn("h", F.col("d") + 1 / F.col("v")).withColumn("own", F.col("g") - u / F.col("v")))
            kept.append(table.select("__point", *self.groups[:level], u, "d", "h", "own", *[f"c{i}" for i in range(k)]))
            d, h, own = F.col("d"), F.col("h"), F.col("own")
            up = {"d": d - d * d / h, "g": F.col("g") - d * own / h, "ll": F.col("ll"), "det": F.col("det") + F.log(h * F.col("v")), "pen": F.col("pen") + u * u / F.col("v")}
            up |= {f"c{i}": F.col(f"c{i}") - F.col(f"c{i}") * d / h for i in range(k)} | {f"r{i}": F.col(f"r{i}") - F.col(f"c{i}") * own / h for i in range(k)}
            up |= {f"a{i}_{j}": F.col(f"a{i}_{j}") - F.col(f"c{i}") * F.col(f"c{j}") / h for i, j in self.pairs}
            table = table.groupBy("__point", *self.groups[:level - 1]).agg(
                *[F.sum(c).alias(n) for n, c in up.items()], *[F.max(f"__u{n}").alias(f"__u{n}") for n in range(level - 1)])
        likelihood, schur, moves = np.zeros(len(self.beta)), {}, {}
        for row in table.collect():  # one row per point
            p, a = row["__point"], np.zeros((k, k))
            for i, j in self.pairs:
                a[i, j] = a[j, i] = row[f"a{i}_{j}"]
            schur[p] = a
            moves[p] = np.linalg.solve(a, np.array([row[f"r{i}"] for i in range(k)]))
            likelihood[p] = row["ll"] - row["pen"] / 2 - row["det"] / 2
        fixed = [self.by_point({p: moves[p][i] for p in moves}) for i in range(k)]
        found, above = None, F.lit(0.0)
        for level, part in enumerate(reversed(kept)):
            cross = _total([F.col(f"c{i}") * fixed[i] for i in range(k)])
            keys = ["__point", *self.groups[:level]]
            base = part if found is None else null_safe_join(part, found, keys, "inner")
            above = F.col("__moved") if found is not None else F.lit(0.0)
            move = (F.col("own") - F.col("d") * above - cross) / F.col("h")
            base = base.withColumn("__move", move)
            earlier = [f"__u{n}" for n in range(level)]
            largest = F.greatest(F.abs("__move"), F.col("__largest") if found is not None else F.lit(0.0))
            found = base.select("__point", *self.groups[:level + 1], *earlier, (F.col(f"__u{level}") + F.col("__move")).alias(f"__u{level}"),
                                (above + F.col("__move")).alias("__moved"), largest.alias("__largest"))
        found = cut_lineage(found)
        largest = found.agg(F.max("__largest")).first()[0] or 0.0
        largest = max([largest, *[float(np.abs(v).max()) for v in moves.values()]])
        self.effects = found.drop("__moved", "__largest")
        self.beta = {p: self.beta[p] + moves[p] for p in self.beta}
        return likelihood, schur, largest < tol

    def settle(self, logs: Sequence[Sequence[float]], tol: float, most: int = 60) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        for _ in range(most):
            likelihood, schur, settled = self.step(logs, tol)
            if settled:
                return likelihood, schur
        raise ArithmeticError("the modes did not converge")


def fit_mixed_counts(df: DataFrame, response: str, terms: Sequence[str], groups: Sequence[str], deviations: Sequence[float] | None = None,
                     tol: float = 1e-6, max_iter: int = 40) -> MixedModel:
    """Poisson regression with a random intercept for ``groups[0]``, for ``groups[:2]``, and so on.

    ``deviations`` fixes the standard deviations of the levels; without it they are estimated.
    """
    cells = [F.col(f"`{t}`").cast("double").alias(f"__t{i}") for i, t in enumerate(terms)]
    names = [f"__t{i}" for i in range(len(terms))]
    work = df.select(*groups, F.col(response).cast("double").alias("__y"), *cells).na.drop(subset=["__y", *names])
    rows = cut_lineage(work.groupBy(*groups, *names).agg(F.sum("__y").alias("__y"), F.count(F.lit(1)).cast("double").alias("__n")))
    plain = fit_counts(df, response, terms)
    modes = _Modes(rows, len(terms), groups, plain.coefficients)
    m = len(groups)
    if deviations is not None:
        logs = np.log(np.array(deviations, float))
    else:
        logs = np.full(m, math.log(0.5))
        ups = [np.eye(m)[i] * STEP for i in range(m)]
        shifts = [np.zeros(m), *[s * e for e in ups for s in (1, -1)], *[ups[i] + ups[j] for i in range(m) for j in range(i + 1, m)]]
        for _ in range(max_iter):
            modes.spread(len(shifts))
            value, _ = modes.settle([logs + s for s in shifts], 1e-6)
            slope = np.array([(value[1 + 2 * i] - value[2 + 2 * i]) / (2 * STEP) for i in range(m)])
            bend = np.diag([(value[1 + 2 * i] + value[2 + 2 * i] - 2 * value[0]) / STEP**2 for i in range(m)])
            at = 1 + 2 * m
            for i in range(m):
                for j in range(i + 1, m):
                    bend[i, j] = bend[j, i] = (value[at] - value[1 + 2 * i] - value[1 + 2 * j] + value[0]) / STEP**2
                    at += 1
            top = np.linalg.eigvalsh(bend).max()
            move = -np.linalg.solve(bend, slope) if top < 0 else slope / max(1.0, np.abs(slope).max())
            move = np.clip(move, -1.0, 1.0)
            new = np.clip(logs + move, *LOG_RANGE)
            moved = float(np.abs(new - logs).max())
            logs = new
            if moved < max(tol, 1e-5):
                break
    modes.spread(1)
    likelihood, schur = modes.settle([logs], 1e-8)
    fixed = CountModel(plain.terms, tuple(map(float, modes.beta[0])), tuple(tuple(map(float, r)) for r in np.linalg.inv(schur[0])))
    effects = modes.effects.select(*groups, *[F.col(f"__u{i}").alias(f"{g}_effect") for i, g in enumerate(groups)])
    return MixedModel(fixed, tuple(float(math.exp(v)) for v in logs), float(likelihood[0]), effects)


def predict_mixed(df: DataFrame, model: MixedModel, groups: Sequence[str], out: str = "mu") -> DataFrame:
    """Expected counts with the effects of the row's groups; a group that the fit did not see has the effect 0."""
    names = [f"{g}_effect" for g in groups]
    joined = null_safe_join(df, model.effects, list(groups), "left")
    shift = _total([F.coalesce(n, F.lit(0.0)) for n in names])
    return joined.withColumn(out, F.exp(model.fixed.linear() + shift)).drop(*names)
