"""Random intercepts, factors' inflation, exact count tests, smooth densities, interval-censored curves."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldloom.operators import mixed


def made_counts(seed=3, sites=9, blocks=4, each=6):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(sites):
        us = rng.normal(0, 0.6)
        for b in range(blocks):
            ub = rng.normal(0, 0.4)
            for _ in range(each):
                x = round(float(rng.normal()), 3)
                out.append((f"s{s}", f"b{b}", x, int(rng.poisson(math.exp(0.7 + 0.3 * x + us + ub)))))
    return out


class Dense:
    """The same Laplace likelihood with whole matrices."""

    def __init__(self, data, levels):
        self.y = np.array([d[3] for d in data], float)
        self.X = np.array([[1, d[2]] for d in data], float)
        names = [sorted({tuple(d[:n]) for d in data}) for n in range(1, levels + 1)]
        self.Z = np.hstack([np.array([[tuple(d[:n]) == g for g in names[n - 1]] for d in data], float) for n in range(1, levels + 1)])
        self.names, self.sizes = names, [len(n) for n in names]

    def mode(self, sd):
        prec = np.repeat([1 / s**2 for s in sd], self.sizes)
        M, p = np.hstack([self.X, self.Z]), self.X.shape[1]
        w = np.zeros(M.shape[1])
        w[0] = math.log(self.y.mean())
        for _ in range(100):
            mu = np.exp(M @ w)
            g = M.T @ (self.y - mu)
            g[p:] -= prec * w[p:]
            H = M.T @ (M * mu[:, None])
            H[np.arange(p, len(w)), np.arange(p, len(w))] += prec
            d = np.linalg.solve(H, g)
            w += d
            if np.abs(d).max() < 1e-12:
                break
        u = w[p:]
        eta = M @ w
        ll = (self.y * eta - np.exp(eta)).sum() - (prec * u * u).sum() / 2 - np.linalg.slogdet(H[p:, p:])[1] / 2 + np.log(prec).sum() / 2
        return w, ll, np.linalg.inv(H)[:p, :p]

    def best(self, levels):
        at, width = np.log([0.5] * levels), 0.5
        value = self.mode(np.exp(at))[1]
        while width > 1e-6:  # pattern search
            for e in [s * width * np.eye(levels)[i] for i in range(levels) for s in (1, -1)]:
                new = self.mode(np.exp(at + e))[1]
                if new > value:
                    at, value = at + e, new
                    break
            else:
                width /= 2
        return np.exp(at)


@pytest.mark.parametrize("levels", [1, 2])
def test_random_intercepts_equal_a_dense_solution(spark, levels):
    data = made_counts(each=5) + [("s0", None, 0.1, 2), ("s0", None, 0.4, 1)] if levels == 1 else made_counts()
    groups = ["site", "block"][:levels]
    df = spark.createDataFrame([*data, ("s1", "b1", None, 3), ("s1", "b1", 0.2, None)], "site string, block string, x double, y int").repartition(3)
    dense = Dense(data, levels)
    fixed = mixed.fit_mixed_counts(df, "y", ["x"], groups, deviations=[0.7, 0.3][:levels])
    w, ll, cov = dense.mode([0.7, 0.3][:levels])
    assert fixed.fixed.coefficients == pytest.approx(w[:2], abs=1e-8)
    assert fixed.log_likelihood == pytest.approx(ll, abs=1e-6)
    assert np.array(fixed.fixed.covariance) == pytest.approx(cov, abs=1e-8)
    got = {tuple(r)[:levels]: tuple(r)[levels:] for r in fixed.effects.collect()}
    offset = 2
    for n, names in enumerate(dense.names):
        for i, g in enumerate(names):
            for key, values in got.items():
                if key[:n + 1] == g:
                    assert values[n] == pytest.approx(w[offset + i], abs=1e-7)
        offset += len(names)
    predicted = mixed.predict_mixed(df.where("y IS NOT NULL AND x IS NOT NULL"), fixed, groups).agg(F.sum("mu")).first()[0]
    assert predicted == pytest.approx(np.exp(np.hstack([dense.X, dense.Z]) @ w).sum())
    if levels == 1:
        assert mixed.fit_mixed_counts(df, "y", ["x"], groups).deviations == pytest.approx(dense.best(levels), rel=2e-3)


# ---------------------------------------------------------------- inflation of terms

def test_term_inflation_equals_determinants(spark):
    from fieldloom.operators import models, stats

    rng = np.random.default_rng(1)
    f = rng.integers(0, 3, 400)
    x = rng.normal(size=400) + f
    data = {"f1": (f == 1) * 1.0, "f2": (f == 2) * 1.0, "x": x, "f1x": (f == 1) * x, "f2x": (f == 2) * x, "z": rng.normal(size=400) + 0.5 * x}
    y = rng.poisson(np.exp(0.2 * x))
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(zip(*data.values()), y)] + [(None,) * 6 + (1,)], ", ".join(f"{c} double" for c in data) + ", y int")
    terms = {"f": ["f1", "f2"], "x": ["x"], "f:x": ["f1x", "f2x"], "z": ["z"]}
    R = np.corrcoef(np.array(list(data.values())))
    names = list(data)

    def gvif(R, order, own):
        i, j = [order.index(c) for c in own], [k for k, c in enumerate(order) if c not in own]
        return np.linalg.det(R[np.ix_(i, i)]) * np.linalg.det(R[np.ix_(j, j)]) / np.linalg.det(R)

    got = {r.term: r for r in stats.term_collinearity(df, terms).collect()}
    for term, own in terms.items():
        want = gvif(R, names, own)
        assert (got[term].df, got[term].gvif, got[term].gvif_per_df) == (len(own), pytest.approx(want), pytest.approx(want ** (0.5 / len(own))))
    single = {r.term: r.vif for r in stats.collinearity(df, ["x", "z"]).collect()}
    assert stats.term_collinearity(df, {"x": ["x"], "z": ["z"]}).where("term = 'x'").first().gvif == pytest.approx(single["x"])
    with pytest.raises(ValueError, match="linearly"):
        stats.term_collinearity(df.withColumn("w", F.col("x") + F.col("z")), {"x": ["x"], "z": ["z"], "w": ["w"]}).collect()
    model = models.fit_counts(df, "y", ["x", "z"])
    V = np.array(model.covariance)[1:, 1:]
    C = V / np.sqrt(np.outer(np.diag(V), np.diag(V)))
    table = stats.model_collinearity(df, model.terms, model.covariance, {"x": ["x"], "z": ["z"]})
    assert table.first().gvif == pytest.approx(1 / np.linalg.det(C))


# ---------------------------------------------------------------- exact count tests

def test_poisson_tails_against_sums(spark):
    from fieldloom.functions import gamma

    cases = [(y, mu) for y in (0, 1, 2, 5, 30, 170, 1000) for mu in (0.0, 1e-8, 0.3, 1.0, 4.9, 31.0, 170.5, 1010.0, 2000.0)]
    df = spark.createDataFrame(cases, "y int, mu double").select("y", "mu", gamma.poisson_cdf("y", "mu").alias("cdf"), gamma.poisson_mass("y", "mu").alias("mass"))
    for r in df.collect():
        mass = [math.exp(k * math.log(r.mu) - r.mu - math.lgamma(k + 1)) if r.mu else float(k == 0) for k in range(r.y + 1)]
        assert r.cdf == pytest.approx(min(1.0, math.fsum(mass)), rel=1e-9, abs=1e-12), (r.y, r.mu)
        assert r.mass == pytest.approx(mass[-1], rel=1e-9, abs=1e-12)
    below = spark.range(1).select(gamma.poisson_cdf(F.lit(-1), F.lit(2.0)), gamma.poisson_cdf(F.lit(None).cast("int"), F.lit(2.0))).first()
    assert below[0] == 0.0 and below[1] is None


def test_exact_residuals_are_uniform_for_the_right_model(spark):
    from fieldloom.operators import models

    rng = np.random.default_rng(2)
    mu = rng.uniform(0.5, 20, 1500)
    data = [("right", float(m), int(rng.poisson(m)), float(rng.random())) for m in mu] + [("wrong", float(m), int(rng.poisson(2 * m)), float(rng.random())) for m in mu]
    df = spark.createDataFrame(data, "g string, mu double, y int, u double")
    found = {r.g: r for r in models.count_tests(models.exact_residuals(df, "y", "mu", F.col("u")), ["g"]).collect()}
    assert found["right"].p_uniform > 0.01 and found["wrong"].p_uniform < 1e-6
    assert found["right"].n_low + found["right"].n_high <= 2 * found["right"].expected and found["wrong"].n_high > 10 * found["wrong"].expected
    one = models.count_tests(models.exact_residuals(df.where("g = 'right'"), "y", "mu", F.col("u")), []).first()
    assert one.distance == pytest.approx(found["right"].distance)


# ---------------------------------------------------------------- smooth density

def test_smooth_density_near_the_direct_kernel_sum(spark):
    from fieldloom.operators import stats

    rng = np.random.default_rng(4)
    values = {"a": rng.normal(3, 2, 400), "b": np.append(rng.exponential(1, 150), [9.0] * 20), "c": np.array([5.0, 5.0])}
    data = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("inf")), ("a", float("nan")), (None, 1.0)]
    got = stats.smooth_density(spark.createDataFrame(data, "g string, v double"), ["g"], "v", points=256).toPandas()
    assert set(got.g) == {"a", "b"}
    for g in ("a", "b"):
        v, own = values[g], got[got.g == g].sort_values("step")
        q = np.quantile(v, [0.25, 0.75])
        bw = 0.9 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * len(v) ** -0.2
        assert own.bw.iloc[0] == pytest.approx(bw) and len(own) == 256 and own.n.iloc[0] == len(v)
        assert own.x.to_numpy() == pytest.approx(np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 256))
        direct = np.exp(-((own.x.to_numpy()[:, None] - v) / bw) ** 2 / 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
        assert np.abs(own.density.to_numpy() - direct).max() < 5e-3 * direct.max()
        assert own.density.sum() * (own.x.iloc[1] - own.x.iloc[0]) == pytest.approx(1, abs=0.01)


# ---------------------------------------------------------------- interval-censored curve

def plain_turnbull(pairs, steps=20_000):
    ends = sorted({(t, k) for l, r in pairs for t, k in ((l, 1), (r, 0))})
    inner = [(a[0], b[0]) for a, b in zip(ends, ends[1:]) if a[1] == 1 and b[1] == 0]
    p = [1 / len(inner)] * len(inner)
    for _ in range(steps):
        new = [0.0] * len(inner)
        for l, r in pairs:
            inside = [j for j, (a, b) in enumerate(inner) if l <= a and b <= r]
            total = sum(p[j] for j in inside)
            for j in inside:
                new[j] += p[j] / total / len(pairs)
        if max(abs(a - b) for a, b in zip(p, new)) < 1e-13:
            break
        p = new
    return inner, p


def test_interval_survival_equals_plain_em(spark):
    from fieldloom.operators import survival

    rng = np.random.default_rng(6)
    data = []
    for g in ("x", None):
        for _ in range(100):
            seen, death = np.sort(rng.choice(12, 4, replace=False)), rng.exponential(6)
            before = [t for t in seen if t < death]
            after = [t for t in seen if t >= death]
            data.append((g, float(before[-1]) if before else 0.0, float(after[0]) if after and after[0] > 0 else None))
    data += [("one", 2.0, 3.0), ("open", 1.0, None), ("x", None, 4.0)]
    got = survival.interval_survival(spark.createDataFrame(data, "g string, a double, d double"), ["g"], "a", "d").toPandas()
    for g in ("x", None):
        pairs = [(a, math.inf if d is None else d) for k, a, d in data if k == g and a is not None]
        inner, p = plain_turnbull(pairs, 4000)
        own = got[got.g.isna() if g is None else got.g == g].sort_values("start")
        assert list(own.start) == [a for a, _ in inner]
        assert own.mass.to_numpy() == pytest.approx(np.array(p), abs=2e-4) and own.n.iloc[0] == len(pairs)
        held = np.array([[l <= a and b <= r for a, b in inner] for l, r in pairs])
        score = (held / (held @ own.mass.to_numpy())[:, None]).mean(0)
        assert score.max() < 1 + 1e-4  # no interval could take more mass: the likelihood is at its top
    assert got[got.g == "one"][["start", "end", "survival"]].to_numpy().tolist() == [[2, 3, 0]]
    assert math.isnan(got[got.g == "open"].end.iloc[0])
    with pytest.raises(Exception, match="not after"):
        survival.interval_survival(spark.createDataFrame([(3.0, 3.0)], "a double, d double"), [], "a", "d").collect()
