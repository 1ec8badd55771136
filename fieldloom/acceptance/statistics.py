"""Scaling, trends, count models, draws, densities and the trait bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import lookup
from ..operators import bootstrap, columns as cols, community, joins, mixed, models, ordered, reshape, stats
from ..session import cut_lineage
from .registry import big, case, r

# --- scaling and least squares ---------------------------------------------------------------


@case("q_zscore", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS p FROM orders),
z AS (SELECT o_orderkey, (p - avg(p) OVER ()) / stddev_samp(p) OVER () AS z FROM o)
SELECT o_orderkey, round(z, 8) + 0.0 AS z, round(z * z, 8) + 0.0 AS z_sq FROM z""")
def zscore(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("p"))
    out = cols.zscore(rows, {"z": "p"})
    return out.select("o_orderkey", r("z", 8).alias("z"), r(models.squared("z"), 8).alias("z_sq"))


@case("q_center", """
SELECT c_custkey, round(c_acctbal / 100 - avg(c_acctbal / 100) OVER (), 6) + 0.0 AS bal FROM customer""")
def center(t):
    return cols.zscore(t.customer, {"bal": "c_acctbal"}, center_only=True, divisors={"c_acctbal": 100}).select(
        "c_custkey", r("bal").alias("bal"))


@case("q_reg_origin", """
WITH a AS (SELECT l_returnflag, CASE WHEN l_discount < 0.01 THEN NULL ELSE l_quantity END AS x, l_extendedprice / 1000 AS y FROM lineitem),
s AS (SELECT l_returnflag, sum(x * y) AS xy, sum(x * x) AS xx, sum(CASE WHEN x IS NOT NULL THEN y * y END) AS yy, count(x) AS n FROM a GROUP BY 1)
SELECT l_returnflag, round(xy / xx, 6) + 0.0 AS estimate, round(sqrt((yy - xy * xy / xx) / (n - 1) / xx), 6) + 0.0 AS std_error,
  round((xy / xx) / sqrt((yy - xy * xy / xx) / (n - 1) / xx), 4) + 0.0 AS statistic, round(1 - (yy - xy * xy / xx) / yy, 6) + 0.0 AS r_squared,
  round(sqrt((yy - xy * xy / xx) / (n - 1)), 6) + 0.0 AS sigma, n::BIGINT AS n FROM s""")
def reg_origin(t):
    rows = t.lineitem.select("l_returnflag", F.when(F.col("l_discount") >= 0.01, F.col("l_quantity")).alias("x"),
                             (F.col("l_extendedprice") / 1000).alias("y"))
    return stats.origin_regression(rows, ["l_returnflag"], "x", "y").select(
        "l_returnflag", *[r(c).alias(c) for c in ("estimate", "std_error")], r("statistic", 4).alias("statistic"),
        r("r_squared").alias("r_squared"), r("sigma").alias("sigma"), "n")


@case("q_slope_impute", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity AS x,
    CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_extendedprice END AS y FROM lineitem),
s AS (SELECT l_returnflag, sum(CASE WHEN y IS NOT NULL THEN x * y END) / sum(CASE WHEN y IS NOT NULL THEN x * x END) AS b FROM a GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(y, x * b), 4) + 0.0 AS y FROM a JOIN s USING (l_returnflag)""")
def slope_impute(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("x"),
                             F.when(F.col("l_linestatus") != "F", F.col("l_extendedprice")).alias("y"))
    out = joins.with_group_stats(rows, ["l_returnflag"], {"b": stats.origin_slope("x", "y")}, written=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.coalesce("y", F.col("x") * F.col("b")), 4).alias("y"))


@case("q_trend_linear", """
SELECT o_orderpriority, round(regr_intercept(o_totalprice, d), 3) + 0.0 AS intercept, round(regr_slope(o_totalprice, d), 6) + 0.0 AS slope,
  round(regr_r2(o_totalprice, d), 9) + 0.0 AS r_squared, count(*)::BIGINT AS n
FROM (SELECT *, dayofyear(o_orderdate)::DOUBLE AS d FROM orders) GROUP BY 1""")
def trend_linear(t):
    rows = t.orders.withColumn("d", F.dayofyear("o_orderdate").cast("double"))
    return stats.linear_trend(rows, ["o_orderpriority"], "d", "o_totalprice").select(
        "o_orderpriority", r("intercept", 3).alias("intercept"), r("slope").alias("slope"), r("r_squared", 9).alias("r_squared"), "n")


@case("q_trend_quadratic", """
WITH a AS (SELECT o_orderpriority AS g, dayofyear(o_orderdate)::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders),
m AS (SELECT *, x - avg(x) OVER (PARTITION BY g) AS d, avg(x) OVER (PARTITION BY g) AS c FROM a),
s AS (SELECT g, count(*) AS n, any_value(c) AS c, sum(d) AS s1, sum(d * d) AS s2, sum(d ** 3) AS s3, sum(d ** 4) AS s4, sum(y) AS t0,
   sum(d * y) AS t1, sum(d * d * y) AS t2 FROM m GROUP BY g),
q AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
b AS (SELECT g, n, c, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det AS b0,
   (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det AS b1,
   (n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det AS b2 FROM q)
SELECT g AS o_orderpriority, round(b0 - b1 * c + b2 * c * c, 5) + 0.0 AS a0, round(b1 - 2 * b2 * c, 7) + 0.0 AS a1, round(b2, 9) + 0.0 AS a2,
  n::BIGINT AS n FROM b""")
def trend_quadratic(t):
    rows = t.orders.select("o_orderpriority", F.dayofyear("o_orderdate").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return stats.quadratic_trend(rows, ["o_orderpriority"], "x", "y").select(
        "o_orderpriority", r("a0", 5).alias("a0"), r("a1", 7).alias("a1"), r("a2", 9).alias("a2"), "n")


@case("q_poly", """
WITH a AS (SELECT o_orderkey, o_totalprice / 100000 - avg(o_totalprice / 100000) OVER () AS d FROM orders),
s AS (SELECT count(*) AS n, sum(d * d) AS s2, sum(d ** 3) AS s3, sum(d ** 4) AS s4 FROM a)
SELECT o_orderkey, round(d / sqrt(s2), 9) + 0.0 AS poly1, round((d * d - s2 / n - s3 / s2 * d) / sqrt(s4 - s2 * s2 / n - s3 * s3 / s2), 9) + 0.0 AS poly2
FROM a, s""")
def poly(t):
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("x"))
    return stats.orthogonal_quadratic(rows, "x").select("o_orderkey", r("poly1", 9).alias("poly1"), r("poly2", 9).alias("poly2"))


CORR = ("l_quantity", "l_extendedprice", "l_discount")


@case("q_corr", """
SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, round(corr(l_quantity, l_extendedprice), 9) + 0.0 AS correlation FROM lineitem WHERE l_tax > 0.01
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 9) + 0.0 FROM lineitem WHERE l_tax > 0.01
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 9) + 0.0 FROM lineitem WHERE l_tax > 0.01""")
def corr(t):
    # A missing value in any column drops the row from every pair.
    rows = t.lineitem.withColumn("l_discount", F.when(F.col("l_tax") > 0.01, F.col("l_discount")))
    return stats.correlations(rows, CORR).select("var1", "var2", r("correlation", 9).alias("correlation"))


@case("q_vif", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'l_quantity' AS term, round((1 - c * c) / det, 6) + 0.0 AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) + 0.0 FROM d
UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) + 0.0 FROM d""")
def vif(t):
    return stats.collinearity(t.lineitem, CORR).select("term", r("vif").alias("vif"))


# --- count models --------------------------------------------------------------------------------

TERMS = {"treatmentGap": ["gap"], "x": ["x"], "treatmentGap:x": ["gap", "x"]}

COUNTS_SQL = """
y AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS gap, o_totalprice / 100000 - 2.5::DOUBLE AS x, coalesce(n, 0)::DOUBLE AS y FROM orders
      LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def _newton_sql(steps: int = 9) -> str:
    """Poisson regression per treatment by unrolled Newton steps: with all interactions the model
    falls apart into one line per treatment."""
    parts = [COUNTS_SQL, "b0 AS (SELECT gap, ln(avg(y)) AS a, 0.0::DOUBLE AS b FROM y GROUP BY 1)"]
    for i in range(steps):
        parts.append(f"""
s{i} AS (SELECT y.gap, a, b, sum(exp(a + b * x)) AS s0, sum(x * exp(a + b * x)) AS s1, sum(x * x * exp(a + b * x)) AS s2,
  sum(y - exp(a + b * x)) AS g0, sum(x * (y - exp(a + b * x))) AS g1 FROM y JOIN b{i} USING (gap) GROUP BY ALL),
b{i + 1} AS (SELECT gap, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) AS a, b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) AS b FROM s{i})""")
    parts.append(f"""
fit AS (SELECT gap, a, b, s2 / (s0 * s2 - s1 * s1) AS va, s0 / (s0 * s2 - s1 * s1) AS vb, -s1 / (s0 * s2 - s1 * s1) AS vab FROM s{steps - 1})""")
    return "WITH" + ",".join(parts)


def _counts(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("gap"), (F.col("o_totalprice") / 100000 - 2.5).alias("x"),
        F.coalesce("n", F.lit(0)).cast("double").alias("y"))
    return models.design(rows, {k: v for k, v in TERMS.items() if k != "x"})


def _fit(t):
    rows = _counts(t)
    return rows, models.fit_counts(rows, "y", list(TERMS))


@case("q_poisson_coef", _newton_sql() + """,
w AS (SELECT max(a) FILTER (WHERE gap = 0) AS a0, max(a) FILTER (WHERE gap = 1) AS a1, max(b) FILTER (WHERE gap = 0) AS b0, max(b) FILTER (WHERE gap = 1) AS b1,
  max(va) FILTER (WHERE gap = 0) AS va0, max(va) FILTER (WHERE gap = 1) AS va1, max(vb) FILTER (WHERE gap = 0) AS vb0, max(vb) FILTER (WHERE gap = 1) AS vb1 FROM fit),
c AS (SELECT '(Intercept)' AS term, a0 AS e, sqrt(va0) AS se FROM w UNION ALL SELECT 'treatmentGap', a1 - a0, sqrt(va0 + va1) FROM w
  UNION ALL SELECT 'x', b0, sqrt(vb0) FROM w UNION ALL SELECT 'treatmentGap:x', b1 - b0, sqrt(vb0 + vb1) FROM w)
SELECT term, round(exp(e), 3) + 0.0 AS estimate, round(se * exp(e), 3) + 0.0 AS std_error, round(e / se, 3) + 0.0 AS statistic,
  round(exp(e - 1.959963984540054 * se), 3) + 0.0 AS conf_low, round(exp(e + 1.959963984540054 * se), 3) + 0.0 AS conf_high FROM c""")
def poisson_coef(t):
    rows, model = _fit(t)
    table = models.coefficient_table(rows, model)
    return table.select("term", *[(F.col(c) + F.lit(0.0)).alias(c) for c in table.columns[1:]])


@case("q_grid_predict", _newton_sql() + """,
g AS (SELECT gap, lo + (hi - lo) * i / 19.0 AS x FROM (SELECT DISTINCT gap FROM y), (SELECT min(x) AS lo, max(x) AS hi FROM y), generate_series(0, 19) AS s(i)),
e AS (SELECT gap, x, a + b * x AS eta, 1.959963984540054 * sqrt(va + 2 * x * vab + x * x * vb) AS h FROM g JOIN fit USING (gap))
SELECT gap, round(x, 6) + 0.0 AS x, round(exp(eta), 5) + 0.0 AS predicted, round(exp(eta - h), 5) + 0.0 AS conf_low, round(exp(eta + h), 5) + 0.0 AS conf_high FROM e""")
def grid_predict(t):
    rows, model = _fit(t)
    points = reshape.grid(rows, ["gap"], {"x": 20})
    out = models.predict_grid(points, model, {k: v for k, v in TERMS.items() if k != "x"})
    return out.select("gap", r("x").alias("x"), *[r(c, 5).alias(c) for c in ("predicted", "conf_low", "conf_high")])


@case("q_diagnostics", _newton_sql() + """,
m AS (SELECT y, exp(a + b * x) AS mu FROM y JOIN fit USING (gap))
SELECT round(sum((y - mu) ** 2 / mu) / (count(*) - 4), 6) + 0.0 AS dispersion, round(count(*) FILTER (WHERE y = 0) / sum(exp(-mu)), 6) + 0.0 AS zero_ratio,
  round(count(*) FILTER (WHERE abs((y - mu) / sqrt(mu)) > 2) / count(*), 6) + 0.0 AS outlier_share, count(*)::BIGINT AS n FROM m""")
def diagnostics(t):
    rows, model = _fit(t)
    out = models.diagnostics(models.predict_counts(rows, model), "y", "mu", 4, cutoff=2.0)
    return out.select(r("dispersion").alias("dispersion"), r("zero_ratio").alias("zero_ratio"), r("outlier_share").alias("outlier_share"), "n")


@case("q_residual_quantiles", _newton_sql() + """,
m AS (SELECT greatest(0, least(9, floor((x + 2.5) / 0.5)::INT)) AS bin, (y - exp(a + b * x)) / sqrt(exp(a + b * x)) AS res FROM y JOIN fit USING (gap)),
q AS (SELECT bin, quantile_cont(res, [0.25, 0.5, 0.75]) AS qs FROM m GROUP BY 1)
SELECT bin, 0.25::DOUBLE AS prob, round(qs[1], 5) + 0.0 AS quantile FROM q UNION ALL SELECT bin, 0.5, round(qs[2], 5) + 0.0 FROM q
UNION ALL SELECT bin, 0.75, round(qs[3], 5) + 0.0 FROM q""")
def residual_quantiles(t):
    rows, model = _fit(t)
    out = models.residual_quantiles(models.predict_counts(rows, model), "y", "mu", "x", -2.5, 2.5, 10)
    return out.select("bin", "prob", r("quantile", 5).alias("quantile"))


@case("q_saturated_mean", """
WITH s AS (SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS y, sum(l_linenumber)::DOUBLE AS s, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, y, round(s / n, 7) + 0.0 AS predicted, round(s / n * exp(-1.959963984540054 / sqrt(s)), 7) + 0.0 AS conf_low,
  round(s / n * exp(1.959963984540054 / sqrt(s)), 7) + 0.0 AS conf_high FROM s WHERE s > 0""")
def saturated_mean(t):
    rows = t.lineitem.withColumn("y", F.year("l_shipdate"))
    out = models.mean_and_interval(rows, ["l_returnflag", "l_linestatus", "y"], "l_linenumber")
    return out.select("l_returnflag", "l_linestatus", "y", *[r(c, 7).alias(c) for c in ("predicted", "conf_low", "conf_high")])


@case("q_predictions_joined", """
WITH s AS (SELECT o_orderpriority, count(*)::DOUBLE / count(DISTINCT o_custkey) AS p FROM orders GROUP BY 1)
SELECT s.o_orderpriority, round(p, 6) + 0.0 AS predicted, d.lo, d.hi FROM s
LEFT JOIN (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) d ON s.o_orderpriority = d.o_orderpriority""")
def predictions_joined(t):
    per = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    predictions = models.mean_and_interval(per, ["o_orderpriority"], "n")
    covariates = t.orders.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return models.join_predictions(predictions, covariates, ["o_orderpriority"]).select(
        "o_orderpriority", r("predicted").alias("predicted"), "lo", "hi")


def _intercepts_sql(steps: int = 10) -> str:
    """Random intercepts of 25 nations with deviation 0.3: unrolled Newton steps on the whole arrow system."""
    parts = [COUNTS_SQL, "z AS (SELECT c_nationkey AS g, x, y FROM y JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey)",
             "b0 AS (SELECT g, 0.0::DOUBLE AS u, (SELECT ln(avg(y)) FROM z) AS a, 0.0::DOUBLE AS b FROM z GROUP BY 1)"]
    for i in range(steps):
        parts.append(f"""
s{i} AS (SELECT g, u, a, b, sum(exp(a + b * x + u)) AS s0, sum(x * exp(a + b * x + u)) AS s1, sum(x * x * exp(a + b * x + u)) AS s2,
  sum(y - exp(a + b * x + u)) AS r0, sum(x * (y - exp(a + b * x + u))) AS r1 FROM z JOIN b{i} USING (g) GROUP BY ALL),
h{i} AS (SELECT *, s0 + 1 / 0.09::DOUBLE AS h, r0 - u / 0.09::DOUBLE AS own FROM s{i}),
k{i} AS (SELECT sum(s0 - s0 * s0 / h) AS a00, sum(s1 - s0 * s1 / h) AS a01, sum(s2 - s1 * s1 / h) AS a11, sum(r0 - s0 * own / h) AS g0, sum(r1 - s1 * own / h) AS g1 FROM h{i}),
m{i} AS (SELECT (a11 * g0 - a01 * g1) / (a00 * a11 - a01 * a01) AS da, (a00 * g1 - a01 * g0) / (a00 * a11 - a01 * a01) AS db,
  sqrt(a11 / (a00 * a11 - a01 * a01)) AS se_a, sqrt(a00 / (a00 * a11 - a01 * a01)) AS se_b FROM k{i}),
b{i + 1} AS (SELECT g, u + (own - s0 * da - s1 * db) / h AS u, a + da AS a, b + db AS b FROM h{i}, m{i})""")
    return "WITH" + ",".join(parts)


@case("q_random_intercepts", _intercepts_sql() + """
SELECT g AS c_nationkey, round(u, 7) + 0.0 AS effect, round(a, 7) + 0.0 AS intercept, round(b, 7) + 0.0 AS slope, round(se_a, 7) + 0.0 AS se_intercept, round(se_b, 7) + 0.0 AS se_slope
FROM b10, m9""")
def random_intercepts(t):
    nations = t.customer.select("c_custkey", "c_nationkey")
    keys = t.orders.select("o_orderkey", "o_custkey").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    model = mixed.fit_mixed_counts(_counts(t).join(keys, "o_orderkey"), "y", ["x"], ["c_nationkey"], deviations=[0.3])
    numbers = dict(zip(("intercept", "slope"), model.fixed.coefficients)) | {f"se_{n}": model.fixed.covariance[i][i] ** 0.5 for i, n in enumerate(("intercept", "slope"))}
    return model.effects.select("c_nationkey", r("c_nationkey_effect", 7).alias("effect"), *[r(F.lit(v), 7).alias(n) for n, v in numbers.items()])


@case("q_term_inflation", """
WITH a AS (SELECT o_orderpriority AS g, o_totalprice AS x, o_custkey::DOUBLE + o_totalprice / 200 AS z FROM orders),
w AS (SELECT x - avg(x) OVER (PARTITION BY g) AS wx, z - avg(z) OVER (PARTITION BY g) AS wz, x, z FROM a),
s AS (SELECT avg(wx * wx) AS xx, avg(wz * wz) AS zz, avg(wx * wz) AS xz, var_pop(x) AS vx, var_pop(z) AS vz, corr(x, z) AS r FROM w),
t AS (SELECT 'priority' AS term, 4 AS df, (1 - r * r) * vx * vz / (xx * zz - xz * xz) AS gvif FROM s
  UNION ALL SELECT 'price', 1, vx * zz / (xx * zz - xz * xz) FROM s UNION ALL SELECT 'customer', 1, vz * xx / (xx * zz - xz * xz) FROM s)
SELECT term, df, round(gvif, 6) + 0.0 AS gvif, round(gvif ** (1 / (2.0 * df)), 6) + 0.0 AS gvif_per_df FROM t""")
def term_inflation(t):
    # Within groups of a factor the closed form needs pooled variances only.
    levels = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = t.orders.select(*[(F.col("o_orderpriority") == v).cast("double").alias(f"p{i}") for i, v in enumerate(levels)], F.col("o_totalprice").alias("x"),
                           (F.col("o_custkey") + F.col("o_totalprice") / 200).alias("z"))
    out = stats.term_collinearity(rows, {"priority": [f"p{i}" for i in range(4)], "price": ["x"], "customer": ["z"]})
    return out.select("term", "df", r("gvif").alias("gvif"), r("gvif_per_df").alias("gvif_per_df"))


@case("q_exact_residuals", _newton_sql() + """,
m AS (SELECT o_orderkey, y, exp(a + b * x) AS mu FROM y JOIN fit USING (gap)),
p AS (SELECT o_orderkey, list_sum(list_transform(range(0, y::BIGINT + 1), lambda k: exp(k * ln(mu) - mu - lgamma(k + 1.0)))) AS upto, exp(y * ln(mu) - mu - lgamma(y + 1.0)) AS mass FROM m)
SELECT o_orderkey, round(greatest(upto - mass, 0), 7) + 0.0 AS p_below, round(upto, 7) + 0.0 AS p_upto, round(greatest(upto - mass, 0) + 0.5 * (upto - greatest(upto - mass, 0)), 7) + 0.0 AS residual,
  upto < 0.005 OR 1 - greatest(upto - mass, 0) < 0.005 AS outlier FROM p""")
def exact_residuals(t):
    rows, model = _fit(t)
    out = models.exact_residuals(models.predict_counts(rows, model), "y", "mu")
    outlier = (F.col("p_upto") < 0.005) | (1 - F.col("p_below") < 0.005)
    return out.select("o_orderkey", *[r(c, 7).alias(c) for c in ("p_below", "p_upto", "residual")], outlier.alias("outlier"))


# --- draws ----------------------------------------------------------------------------------------

DRAW_TERMS = {"b_treatmentGap": ["gap"], "b_spei": ["spei"], "b_IspeiE2": ["spei", "spei"], "b_treatmentGap:spei": ["gap", "spei"]}
DRAW_NAMES = {"1-URGENT": "b_Intercept", "2-HIGH": "b_treatmentGap", "3-MEDIUM": "b_spei", "4-NOT SPECIFIED": "b_IspeiE2",
              "5-LOW": "b_treatmentGap:spei"}

DRAWS_SQL = """
k AS (SELECT * FROM (VALUES ('1-URGENT', 'b_Intercept'), ('2-HIGH', 'b_treatmentGap'), ('3-MEDIUM', 'b_spei'), ('4-NOT SPECIFIED', 'b_IspeiE2'),
  ('5-LOW', 'b_treatmentGap:spei')) AS v(o_orderpriority, term)),
draws AS (SELECT d.draw, k.term, coalesce(o.value, 0) AS value FROM (SELECT DISTINCT o_custkey AS draw FROM orders) d CROSS JOIN k
  LEFT JOIN (SELECT o_custkey AS draw, o_orderpriority, min(o_totalprice) / 400000 AS value FROM orders GROUP BY ALL) o
  ON d.draw = o.draw AND k.o_orderpriority = o.o_orderpriority)"""

EPRED_SQL = DRAWS_SQL + """,
w AS (SELECT draw, max(value) FILTER (WHERE term = 'b_Intercept') AS b0, max(value) FILTER (WHERE term = 'b_treatmentGap') AS b1,
  max(value) FILTER (WHERE term = 'b_spei') AS b2, max(value) FILTER (WHERE term = 'b_IspeiE2') AS b3, max(value) FILTER (WHERE term = 'b_treatmentGap:spei') AS b4
  FROM draws GROUP BY 1),
ep AS (SELECT draw, gap, spei, exp(b0 + b1 * gap + b2 * spei + b3 * spei * spei + b4 * gap * spei) AS epred
  FROM w CROSS JOIN (VALUES (0), (1)) AS g(gap) CROSS JOIN (VALUES (-1.2::DOUBLE), (0.0), (1.2)) AS s(spei))"""


def _draws(t):
    named = t.orders.withColumn("term", lookup("o_orderpriority", DRAW_NAMES))
    values = named.groupBy(F.col("o_custkey").alias("draw"), "term").agg((F.min("o_totalprice") / 400000).alias("value"))
    return reshape.complete(cut_lineage(values), ["draw", "term"], fill={"value": 0.0})


def _epred(t):
    gaps = t.orders.select((F.col("o_orderstatus") == "F").cast("int").alias("gap"))
    points = reshape.grid(gaps, ["gap"], values={"spei": [-1.2, 0.0, 1.2]})
    return models.epred_draws(_draws(t), points, DRAW_TERMS)


@case("q_gather_draws", "WITH" + DRAWS_SQL + """
SELECT draw, replace(split_part(term, '_', 2), ':', ' x ') AS var, value FROM draws WHERE term LIKE 'b%' AND term <> 'b_Intercept'""")
def gather_draws(t):
    return models.gather_draws(_draws(t)).select("draw", "var", "value")


@case("q_draw_epred", "WITH" + EPRED_SQL + " SELECT draw, gap, spei, round(epred, 8) + 0.0 AS epred FROM ep")
def draw_epred(t):
    return _epred(t).select("draw", "gap", "spei", r("epred", 8).alias("epred"))


@case("q_draw_intervals", "WITH" + EPRED_SQL + """,
q AS (SELECT gap, spei, m.width AS width, quantile_cont(epred, 0.5) AS median, CASE m.width WHEN 0.5 THEN quantile_cont(epred, 0.25) WHEN 0.66 THEN quantile_cont(epred, 0.17)
   WHEN 0.8 THEN quantile_cont(epred, 0.1) WHEN 0.95 THEN quantile_cont(epred, 0.025) ELSE quantile_cont(epred, 0.005) END AS lower,
   CASE m.width WHEN 0.5 THEN quantile_cont(epred, 0.75) WHEN 0.66 THEN quantile_cont(epred, 0.83) WHEN 0.8 THEN quantile_cont(epred, 0.9)
   WHEN 0.95 THEN quantile_cont(epred, 0.975) ELSE quantile_cont(epred, 0.995) END AS upper
  FROM ep CROSS JOIN (VALUES (0.5::DOUBLE), (0.66), (0.8), (0.95), (0.99)) AS m(width) GROUP BY gap, spei, m.width)
SELECT gap, spei, width, round(median, 7) + 0.0 AS median, round(lower, 7) + 0.0 AS lower, round(upper, 7) + 0.0 AS upper FROM q""")
def draw_intervals(t):
    out = models.interval_summary(_epred(t), ["gap", "spei"], "epred")
    return out.select("gap", "spei", "width", *[r(c, 7).alias(c) for c in ("median", "lower", "upper")])


# --- distributions ----------------------------------------------------------------------------------


@case("q_quantiles", """
WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.9, 1.0]) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, unnest([0.0, 0.1, 0.5, 0.9, 1.0])::DOUBLE AS prob, round(unnest(q), 4) + 0.0 AS quantile FROM q""")
def quantiles(t):
    out = ordered.exact_quantiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.1, 0.5, 0.9, 1.0])
    return out.select("l_returnflag", "l_linestatus", "prob", r("quantile", 4).alias("quantile"))


@case("q_ecdf", """
SELECT DISTINCT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_returnflag, l_quantity)::BIGINT AS n,
  round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) + 0.0 AS ecdf FROM lineitem""")
def ecdf(t):
    return ordered.ecdf(t.lineitem, ["l_returnflag"], "l_quantity").select("l_returnflag", "l_quantity", "n", r("ecdf", 9).alias("ecdf"))


@case("q_ecdf_all", """
SELECT DISTINCT o_totalprice, round(cume_dist() OVER (ORDER BY o_totalprice), 9) + 0.0 AS ecdf FROM orders""")
def ecdf_all(t):
    return ordered.ecdf(t.orders, [], "o_totalprice").select("o_totalprice", r("ecdf", 9).alias("ecdf"))


@case("q_ecdf_text", """
SELECT DISTINCT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'open ' || l_shipdate::DATE::VARCHAR ELSE 'F' END AS value, count(*) OVER (PARTITION BY l_returnflag, value)::BIGINT AS n,
  round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY value), 9) + 0.0 AS ecdf FROM lineitem""")
def ecdf_text(t):
    value = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("open "), F.date_format("l_shipdate", "yyyy-MM-dd"))).otherwise("F")
    out = ordered.ecdf(t.lineitem.withColumn("value", value), ["l_returnflag"], "value")
    return out.select("l_returnflag", "value", "n", r("ecdf", 9).alias("ecdf"))


@case("q_sorted_text", """
SELECT page_id, url, row_number() OVER (ORDER BY url NULLS FIRST, page_id)::BIGINT AS row_index,
  row_number() OVER (PARTITION BY page_id % 3 ORDER BY split_part(url, '/', 3) NULLS FIRST, page_id)::BIGINT AS in_group,
  lag(url) OVER (ORDER BY url NULLS FIRST, page_id) AS before FROM (SELECT page_id, CASE WHEN url NOT LIKE '%.org%' THEN url END AS url FROM pages)""")
def sorted_text(t):
    pages = t.pages.select("page_id", F.when(~F.col("url").contains(".org"), F.col("url")).alias("url"))
    rows = pages.withColumns({"third": F.col("page_id") % 3, "host": F.split_part("url", F.lit("/"), F.lit(3)), "one": F.lit(0)})
    grouped = ordered.row_index(ordered.row_index(rows, ["url", "page_id"]), ["host", "page_id"], ["third"], out="in_group")
    return ordered.lag_in_group(grouped, ["one"], ["url", "page_id"], {"before": "url"}).select("page_id", "url", "row_index", "in_group", "before")


@case("q_density", """
WITH b AS (SELECT o_orderstatus, CASE WHEN o_totalprice < 100000 THEN -1 WHEN o_totalprice > 400000 THEN 40 ELSE least(39, floor((o_totalprice - 100000) / 7500.0)::INT) END AS bin, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, bin, CASE WHEN bin BETWEEN 0 AND 39 THEN 100000 + (bin + 0.5) * 7500.0::DOUBLE END AS mid, n::BIGINT AS n,
  CASE WHEN bin BETWEEN 0 AND 39 THEN round(n / (sum(n) OVER (PARTITION BY o_orderstatus) * 7500.0::DOUBLE), 12) + 0.0 END AS density FROM b""")
def density(t):
    out = stats.binned_density(t.orders, ["o_orderstatus"], "o_totalprice", 100000.0, 400000.0, 40)
    return out.select("o_orderstatus", "bin", "mid", "n", r("density", 12).alias("density"))


@case("q_smooth_density", """
WITH q AS (SELECT o_orderpriority AS g, count(*) AS n, stddev_samp(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr,
   min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
s AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * n ** -0.2 AS bw FROM q),
f AS (SELECT *, lo - 3 * bw AS a, (hi - lo + 6 * bw) / 127 AS step FROM s),
v AS (SELECT g, (o_totalprice - a) / step AS pos FROM orders JOIN f ON g = o_orderpriority),
w AS (SELECT g, floor(pos)::INT AS b, 1 - (pos - floor(pos)) AS w FROM v UNION ALL SELECT g, floor(pos)::INT + 1, pos - floor(pos) FROM v),
k AS (SELECT g, b, sum(w) AS w FROM w GROUP BY 1, 2)
SELECT f.g AS o_orderpriority, i::INT AS step, round(any_value(a + i * step), 3) + 0.0 AS x, round(sum(w * exp(-0.5 * ((i - b) * step / bw) ** 2)) / sqrt(2 * pi()) / any_value(n * bw) * 1e6, 7) + 0.0 AS density
FROM f JOIN k ON f.g = k.g CROSS JOIN generate_series(0, 127) AS t(i) GROUP BY ALL""")
def smooth_density(t):
    out = stats.smooth_density(t.orders, ["o_orderpriority"], "o_totalprice", points=128)
    return out.select("o_orderpriority", "step", r("x", 3).alias("x"), r(F.col("density") * 1e6, 7).alias("density"))


# --- traits --------------------------------------------------------------------------------------------

TRAIT_SQL = """
cover AS (SELECT l_returnflag AS site, l_partkey AS species, sum(l_quantity) AS cover FROM lineitem GROUP BY 1, 2),
traits AS (SELECT l_returnflag AS site, l_partkey AS species, l_linestatus AS trait, l_extendedprice / 9973 AS value, l_orderkey, l_linenumber, l_suppkey
  FROM lineitem),
n1 AS (SELECT site, species, trait, count(*) AS n1, avg(value) AS m1 FROM traits GROUP BY ALL),
n0 AS (SELECT species, trait, count(*) AS n0, avg(value) AS m0 FROM traits GROUP BY ALL),
fill AS (SELECT c.site, c.species, c.cover, n0.trait, CASE WHEN n1 >= 2 OR n1 = n0 THEN 1 ELSE 0 END AS level, CASE WHEN n1 >= 2 OR n1 = n0 THEN n1 ELSE n0 END AS n_sample,
    CASE WHEN n1 >= 2 OR n1 = n0 THEN m1 ELSE m0 END AS mean_value
  FROM cover c JOIN n0 ON c.species = n0.species LEFT JOIN n1 ON c.site = n1.site AND c.species = n1.species AND n0.trait = n1.trait)"""


def _hash_sql(expression: str, digits: int = 8) -> str:
    return f"('0x' || substr(md5({expression}), 1, {digits}))::BIGINT"


BOOT_SQL = TRAIT_SQL + f""",
ln AS (SELECT *, (cover / max(cover) OVER (PARTITION BY site, trait))::DECIMAL(38, 20) AS w, {_hash_sql("site || '|' || species || '|' || trait")} % 16 AS h FROM fill),
cu AS (SELECT *, sum(w) OVER (PARTITION BY site, trait ORDER BY h, species ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER (PARTITION BY site, trait) AS total FROM ln),
line AS (SELECT *, (hi - w)::DOUBLE / total::DOUBLE AS a FROM cu),
pt AS (SELECT site, trait, replicate, draw, {_hash_sql("'1525|' || site || '|' || trait || '|' || replicate || '|' || draw", 13)} / 4503599627370496.0::DOUBLE AS u,
    {_hash_sql("'1526|' || site || '|' || trait || '|' || replicate || '|' || draw", 13)} / 4503599627370496.0::DOUBLE AS u2
  FROM (SELECT DISTINCT site, trait FROM fill) CROSS JOIN generate_series(1, 100) AS r(replicate) CROSS JOIN generate_series(1, 200) AS d(draw)),
pk AS (SELECT pt.site, pt.trait, replicate, draw, species, level, floor(u2 * n_sample)::BIGINT + 1 AS nr
  FROM pt ASOF JOIN line ON pt.site = line.site AND pt.trait = line.trait AND pt.u >= line.a),
hv AS (SELECT *, {_hash_sql("l_orderkey || '|' || l_linenumber || '|' || species || '|' || l_suppkey")} % 16 AS h FROM traits),
v1 AS (SELECT *, row_number() OVER (PARTITION BY site, species, trait ORDER BY h, l_orderkey, l_linenumber, species, l_suppkey) AS nr FROM hv),
v0 AS (SELECT *, row_number() OVER (PARTITION BY species, trait ORDER BY h, l_orderkey, l_linenumber, species, l_suppkey) AS nr FROM hv),
dr AS (SELECT pk.site, pk.trait, replicate, draw, v1.value FROM pk JOIN v1 ON level = 1 AND pk.site = v1.site AND pk.species = v1.species AND pk.trait = v1.trait AND pk.nr = v1.nr
  UNION ALL SELECT pk.site, pk.trait, replicate, draw, v0.value FROM pk JOIN v0 ON level = 0 AND pk.species = v0.species AND pk.trait = v0.trait AND pk.nr = v0.nr),
ce AS (SELECT *, value - avg(value) OVER (PARTITION BY site, trait, replicate) AS c FROM dr),
mo AS (SELECT site, trait, replicate, avg(value) AS mean, var_samp(value) AS var, avg(c ** 3) / avg(c * c) ** 1.5 AS skew, avg(c ** 4) / avg(c * c) ** 2 - 3 AS kurt,
  count(*) AS n FROM ce GROUP BY 1, 2, 3)"""


def _filled(t):
    cover = t.lineitem.groupBy(F.col("l_returnflag").alias("site"), F.col("l_partkey").alias("species")).agg(F.sum("l_quantity").alias("cover"))
    traits = t.lineitem.select(
        F.col("l_returnflag").alias("site"), F.col("l_partkey").alias("species"), F.col("l_linestatus").alias("trait"),
        (F.col("l_extendedprice") / 9973).alias("value"), "l_orderkey", "l_linenumber", "l_suppkey")
    return bootstrap.trait_fill(cover, traits, ["site"]), traits


def _replicates(t):
    filled, traits = _filled(t)
    draws = bootstrap.bootstrap_draws(filled, traits, ["site", "trait"], ["site"], ["site", "species", "trait"],
                                      ["l_orderkey", "l_linenumber", "species", "l_suppkey"])
    return bootstrap.bootstrap_moments(draws, ["site", "trait"])


@case("q_trait_fill", "WITH" + TRAIT_SQL + """
SELECT site, species, trait, level, n_sample::BIGINT AS n_sample, round(mean_value, 7) + 0.0 AS mean_value, cover FROM fill""")
def trait_fill(t):
    filled, _ = _filled(t)
    return filled.select("site", "species", "trait", "level", big("n_sample").alias("n_sample"), r("mean_value", 7).alias("mean_value"), "cover")


@case("q_bootstrap", "WITH" + BOOT_SQL + """
SELECT site, trait, replicate::INT AS replicate, round(mean, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS var, round(skew, 7) + 0.0 AS skew, round(kurt, 7) + 0.0 AS kurt FROM mo""")
def boot(t):
    return _replicates(t).select("site", "trait", "replicate", r("mean").alias("mean"), r("var", 6).alias("var"), r("skew", 7).alias("skew"), r("kurt", 7).alias("kurt"))


@case("q_boot_moments", "WITH" + BOOT_SQL + """
SELECT site, trait, round(avg(mean), 5) + 0.0 AS mean, round(avg(mean) - stddev_samp(mean), 5) + 0.0 AS ci_low_mean,
  round(avg(mean) + stddev_samp(mean), 5) + 0.0 AS ci_high_mean, round(avg(var), 5) + 0.0 AS var, round(avg(skew), 6) + 0.0 AS skew, round(avg(kurt), 6) + 0.0 AS kurt
FROM mo GROUP BY 1, 2""")
def boot_moments(t):
    out = bootstrap.summarise_moments(_replicates(t), ["site", "trait"])
    return out.select("site", "trait", *[r(c, 5).alias(c) for c in ("mean", "ci_low_mean", "ci_high_mean")], r("var", 5).alias("var"),
                      r("skew").alias("skew"), r("kurt").alias("kurt"))


@case("q_moments", """
WITH c AS (SELECT l_suppkey, l_quantity AS v, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS c FROM lineitem)
SELECT l_suppkey, round(avg(v), 6) + 0.0 AS mean, round(var_samp(v), 6) + 0.0 AS var, round(avg(c ** 3) / avg(c * c) ** 1.5, 8) + 0.0 AS skew,
  round(kurtosis_pop(v), 8) + 0.0 AS kurt FROM c GROUP BY 1""")
def moments(t):
    return stats.moments(t.lineitem, ["l_suppkey"], "l_quantity").select(
        "l_suppkey", r("mean").alias("mean"), r("var").alias("var"), r("skew", 8).alias("skew"), r("kurt", 8).alias("kurt"))


@case("q_trait_names", """
WITH p AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'SLA' WHEN 'LARGE' THEN 'd13C' WHEN 'SMALL' THEN 'height_log' WHEN 'MEDIUM' THEN 'fresh_mass_log'
  ELSE p_name END AS trait_trans FROM part)
SELECT p_partkey, CASE trait_trans WHEN 'SLA' THEN 'SLA cm2/g' WHEN 'd13C' THEN 'δC13 ‰' WHEN 'height_log' THEN 'Height cm' WHEN 'fresh_mass_log' THEN 'Wet mass g'
    ELSE trait_trans END AS trait_fancy,
  CASE trait_trans WHEN 'SLA' THEN 'SLA~(cm^2*g^{-1})' WHEN 'd13C' THEN 'δ^{13}~C~''(‰)''' WHEN 'height_log' THEN 'Plant~height~(cm)' END AS figure_names,
  CASE trait_trans WHEN 'SLA' THEN 7 WHEN 'd13C' THEN 11 WHEN 'height_log' THEN 1 WHEN 'fresh_mass_log' THEN 2 END AS trait_order,
  CASE WHEN trait_trans IN ('height_log', 'fresh_mass_log') THEN 'Size' WHEN trait_trans = 'd13C' THEN 'Isotopes' ELSE 'Leaf economics' END AS class FROM p""")
def trait_names(t):
    code = F.when(F.col("p_type") == "PROMO", "SLA").when(F.col("p_type") == "LARGE", "d13C").when(F.col("p_type") == "SMALL", "height_log").when(
        F.col("p_type") == "MEDIUM", "fresh_mass_log").otherwise(F.col("p_name"))
    return community.describe_traits(t.part.select("p_partkey", code.alias("trait_trans"))).select(
        "p_partkey", "trait_fancy", "figure_names", "trait_order", "class")


# --- values beyond every bound ----------------------------------------------------------------------

BEYOND_SQL = """
v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN 'infinity'::DOUBLE WHEN l_linenumber = 6 THEN '-infinity'::DOUBLE
  WHEN l_linenumber < 5 THEN l_extendedprice END AS v FROM lineitem)"""


def _beyond(t):
    v = F.when(F.col("l_linenumber") == 7, float("inf")).when(F.col("l_linenumber") == 6, float("-inf")).when(F.col("l_linenumber") < 5, F.col("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v"))


@case("q_zscore_infinite", "WITH" + BEYOND_SQL + """,
s AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM v WHERE isfinite(v))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN isfinite(v) THEN round((v - m) / s, 7) + 0.0 ELSE v END AS z FROM v, s""")
def zscore_infinite(t):
    out = cols.zscore(_beyond(t), {"z": "v"})
    z = F.when(F.abs("z") < float("inf"), r("z", 7)).otherwise(F.col("z"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", z.alias("z"))


@case("q_quantiles_infinite", "WITH" + BEYOND_SQL + """,
p AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS prob),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v WHERE v IS NOT NULL)
SELECT prob::DOUBLE AS prob, CASE WHEN max(a.v) = max(b.v) THEN max(a.v) ELSE round(max(a.v) + max((n - 1) * prob - floor((n - 1) * prob)) * (max(b.v) - max(a.v)), 6) + 0.0 END AS quantile
FROM p JOIN k a ON a.i = floor((a.n - 1) * prob) JOIN (SELECT i, v FROM k) b ON b.i = ceil((a.n - 1) * prob) GROUP BY 1""")
def quantiles_infinite(t):
    out = ordered.exact_quantiles(_beyond(t), [], "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    q = F.when(F.abs("quantile") < float("inf"), r("quantile")).otherwise(F.col("quantile"))
    return out.select("prob", q.alias("quantile"))
