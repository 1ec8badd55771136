"""Climate, statistics, count models and the bootstrap against plain numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from pyspark.errors import PySparkException

from fieldloom.operators import bootstrap, climate, models, reshape, stats


def test_monthly_extremes_weight_each_reading(spark):
    day1, day2 = dt.datetime(2018, 7, 1), dt.datetime(2018, 7, 2)
    data = [("s", day1, 1.0), ("s", day1, 5.0), ("s", day1, 3.0), ("s", day2, 10.0), ("s", day2, None)]
    out = climate.monthly_extremes(spark.createDataFrame(data, "site string, ts timestamp, value double"), ["site"], "ts", "value").first()
    assert (out.temp_max, out.temp_min, out.temp_mean) == ((5 * 3 + 10) / 4, (1 * 3 + 10) / 4, 19 / 4)


@pytest.fixture(scope="module")
def zones(spark):
    sites = spark.createDataFrame([("a", "z1", 60.0), ("b", "z1", 61.0), ("c", "z2", 62.0)], "siteID string, Biogeographic_zone string, Latitude double")
    monthly = spark.createDataFrame([("a", 2018, 7, 10.0), ("b", 2018, 8, 4.0), ("a", 2018, 8, 6.0), ("c", 2018, 7, 1.0)],
                                    "siteID string, year int, month int, v double")
    return sites, monthly


def test_zone_fill(zones):
    sites, monthly = zones
    out = climate.fill_from_zone(monthly, sites, "siteID", "Biogeographic_zone", "v")
    assert rows(out) == [("a", 2018, 7, 10.0), ("a", 2018, 8, 6.0), ("b", 2018, 7, 10.0), ("b", 2018, 8, 4.0), ("c", 2018, 7, 1.0), ("c", 2018, 8, None)]
    strict = climate.fill_from_zone(monthly, sites, "siteID", "Biogeographic_zone", "v", strict=True)
    assert (("b", 2018, 7, None)) in rows(strict)


def test_preferred_sensor(spark):
    df = spark.createDataFrame([("a", "temp200cm", None), ("a", "temp30cm", 2.0), ("b", "temp200cm", 3.0), ("b", "temp30cm", 4.0)], "s string, logger string, v double")
    assert rows(climate.prefer_sensor(df, ["s"], "logger", "temp200cm", "temp30cm", ["v"])) == [("a", 2.0), ("b", 3.0)]


def test_evapotranspiration(spark):
    df = spark.createDataFrame([(5.0, 15.0, 60.0, 2018, 7), (5.0, 15.0, 60.0, 2018, 1), (15.0, 5.0, 60.0, 2018, 7), (None, 5.0, 60.0, 2018, 7)],
                               "lo double, hi double, lat double, year int, month int")
    july, january, swapped, missing = [r[0] for r in df.select(climate.hargreaves("lo", "hi", "lat", "year", "month")).collect()]
    # By hand: FAO-56 radiation at 60 degrees north on day 196 is 40.2 MJ.
    day, phi = 196, math.radians(60)
    dec = 0.409 * math.sin(2 * math.pi * day / 365 - 1.39)
    sunset = math.acos(-math.tan(phi) * math.tan(dec))
    ra = 37.6 * (1 + 0.033 * math.cos(2 * math.pi * day / 365)) * (sunset * math.sin(phi) * math.sin(dec) + math.cos(phi) * math.cos(dec) * math.sin(sunset))
    assert july == pytest.approx(0.0023 * 0.408 * ra * 27.8 * math.sqrt(10) * 31) and 39 < ra < 41
    assert january < july / 10 and swapped == 0 and missing is None


def balance(spark, years=11):
    rng = np.random.default_rng(4)
    data = [(s, y, m, float(rng.normal(m * 3, 20))) for s in "ab" for y in range(2009, 2009 + years) for m in range(1, 13)]
    data = [(s, y, m, None if (s, y, m) == ("a", 2012, 5) else (7.0 if m == 12 else v)) for s, y, m, v in data]
    return spark.createDataFrame(data, "siteID string, year int, month int, balance double")


def test_drought_index(spark):
    out = climate.drought_index(balance(spark)).toPandas()
    assert out[(out.siteID == "a") & (out.year == 2012) & (out.month == 5)].spei.isna().all()
    assert out[out.month == 12].spei.isna().all()  # a constant month has no distribution
    known = out[(out.month != 12) & out.spei.notna()].replace([np.inf, -np.inf], np.nan).dropna()
    assert abs(known.spei.mean()) < 0.05 and abs(known.spei.std() - 1) < 0.1
    for _, g in known.groupby(["siteID", "month"]):
        assert g.sort_values("balance").spei.is_monotonic_increasing


def test_drought_index_over_three_months(spark):
    out = climate.drought_index(balance(spark), scale=3, out="x").toPandas().sort_values(["siteID", "year", "month"])
    first = out[out.siteID == "b"].x.isna().to_numpy()
    assert first[:2].all() and not first[2:11].any()
    gap = out[(out.siteID == "a") & (out.year == 2012) & out.month.isin([5, 6, 7])]
    assert gap.x.isna().all()


def test_drought_index_needs_four_years(spark):
    assert climate.drought_index(balance(spark, 3)).where("spei is not null").count() == 0


def test_nested_means(spark):
    days = [("a", dt.date(2018, 1, 1), 1.0), ("a", dt.date(2018, 1, 2), 3.0), ("a", dt.date(2018, 2, 1), 8.0), ("a", dt.date(2019, 1, 1), 4.0)]
    out = climate.nested_means(spark.createDataFrame(days, "siteID string, date date, value double"))
    assert rows(out, "year", "month", "sm_annual_mean", "sm_total_mean", "soil_moisture_month_mean") == [
        (2018, 1, 4.0, 4.0, 2.0), (2018, 2, 4.0, 4.0, 8.0), (2019, 1, 4.0, 4.0, 4.0)]


def test_site_normals(spark):
    data = [("s", dt.date(y, m, 1), v, float(x)) for y in (2010, 2011) for m in range(1, 13) for v, x in (("precipitation", y - 2000), ("temperature", m))]
    data.append(("s", dt.date(2010, 3, 2), "precipitation", 100.0))
    out = climate.site_normals(spark.createDataFrame(data, "siteID string, date date, variable string, value double"))
    assert rows(out) == [("s", (12 * 10 + 100 + 12 * 11) / 2, 7.0)]


def test_site_names_from_files(spark):
    df = spark.createDataFrame([(None, "ITAS_2010.csv"), (None, "Skjeldingahaugen 3"), ("Fauske", "x"), (None, "Veskre-a")], "siteID string, file string")
    assert sorted(r[0] for r in climate.recover_site(df).select("siteID").collect()) == ["Fauske", "Skjelingahaugen", "Ulvehaugen", "Veskre"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "x": rng.normal(3, 1, n)})
    pdf["z"] = pdf.x * 0.5 + rng.normal(0, 1, n)
    pdf["y"] = 2 * pdf.x - 0.3 * pdf.x ** 2 + rng.normal(0, 1, n)
    pdf["n"] = rng.poisson(np.exp(0.2 + 0.3 * pdf.g + 0.25 * pdf.x - 0.1 * pdf.g * pdf.x))
    return spark.createDataFrame(pdf).cache(), pdf


def test_origin_regression(spark, points):
    df, pdf = points
    got = {r.g: r for r in stats.origin_regression(df, ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        b = (part.x * part.y).sum() / (part.x ** 2).sum()
        sigma = math.sqrt(((part.y - b * part.x) ** 2).sum() / (len(part) - 1))
        assert got[g].estimate == pytest.approx(b) and got[g].sigma == pytest.approx(sigma)
        assert got[g].std_error == pytest.approx(sigma / math.sqrt((part.x ** 2).sum()))
    exact = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 9.0), (5.0, None)], "x double, y double")
    line = stats.origin_regression(exact, [], "x", "y").first()
    assert line.estimate == 2.0 and line.n == 2 and line.sigma == 0.0 and line.r_squared == 1.0
    alone = stats.origin_regression(exact.limit(1), [], "x", "y").first()
    assert alone.estimate == 2.0 and alone.std_error is None


def test_trends(points):
    df, pdf = points
    for r in stats.quadratic_trend(df, ["g"], "x", "y").collect():
        part = pdf[pdf.g == r.g]
        assert [r.a2, r.a1, r.a0] == pytest.approx(np.polyfit(part.x, part.y, 2).tolist())
    for r in stats.linear_trend(df, ["g"], "x", "y").collect():
        part = pdf[pdf.g == r.g]
        assert [r.slope, r.intercept] == pytest.approx(np.polyfit(part.x, part.y, 1).tolist())
    poly = stats.orthogonal_quadratic(df, "x").toPandas()
    basis = poly[["poly1", "poly2"]].to_numpy()
    assert np.allclose(basis.T @ basis, np.eye(2)) and np.allclose(basis.sum(axis=0), 0)


def test_correlation_and_collinearity(points):
    df, pdf = points
    want = np.corrcoef(pdf[["x", "z", "y"]].T)
    got = {(r.var1, r.var2): r.correlation for r in stats.correlations(df, ["x", "z", "y"]).collect()}
    assert got[("x", "y")] == pytest.approx(want[0, 2])
    vif = {r.term: r.vif for r in stats.collinearity(df, ["x", "z", "y"]).collect()}
    assert vif["z"] == pytest.approx(np.linalg.inv(want)[1, 1])


def newton(x, y):
    b = np.zeros(x.shape[1])
    b[0] = math.log(y.mean())
    for _ in range(50):
        mu = np.exp(x @ b)
        b = b + np.linalg.solve((x.T * mu) @ x, x.T @ (y - mu))
    return b, np.linalg.inv((x.T * np.exp(x @ b)) @ x)


def test_count_model(points):
    df, pdf = points
    terms = {"g:x": ["g", "x"], "x2": ["x", "x"]}
    model = models.fit_counts(models.design(df, terms), "n", ["g", "x", "g:x", "x2"])
    x = np.column_stack([np.ones(len(pdf)), pdf.g, pdf.x, pdf.g * pdf.x, pdf.x ** 2])
    b, cov = newton(x, pdf.n.to_numpy())
    assert list(model.coefficients) == pytest.approx(b.tolist(), abs=1e-6)
    assert np.allclose(model.covariance, cov, atol=1e-6)
    grid = models.predict_grid(reshape.grid(df, ["g"], {"x": 4}), model, terms).toPandas()
    at = np.column_stack([np.ones(len(grid)), grid.g, grid.x, grid.g * grid.x, grid.x ** 2])
    half = 1.959963984540054 * np.sqrt(np.einsum("ij,jk,ik->i", at, cov, at))
    assert np.allclose(grid.conf_high, np.exp(at @ b + half), rtol=1e-5) and len(grid) == 8
    table = models.coefficient_table(df, model).toPandas().set_index("term")
    assert table.loc["x", "estimate"] == round(math.exp(b[2]), 3)
    fitted = models.predict_counts(models.design(df, terms), model)
    d = models.diagnostics(fitted, "n", "mu", 5).first()
    mu = np.exp(x @ b)
    assert d.dispersion == pytest.approx((((pdf.n - mu) ** 2 / mu).sum()) / (len(pdf) - 5), rel=1e-5)
    assert d.zero_ratio == pytest.approx((pdf.n == 0).sum() / np.exp(-mu).sum(), rel=1e-5)


def test_draws(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(0, 0.3, (50, 3))
    names = ["b_Intercept", "b_spei", "b_treatmentGap:spei"]
    draws = spark.createDataFrame([(i, n, float(values[i, j])) for i in range(50) for j, n in enumerate(names)], "draw int, term string, value double")
    assert {r.var for r in models.gather_draws(draws).select("var").collect()} == {"spei", "treatmentGap x spei"}
    at = spark.createDataFrame([(0.0, -1.2), (1.0, 1.2)], "gap double, spei double")
    out = models.epred_draws(draws, at, {"b_spei": ["spei"], "b_treatmentGap:spei": ["gap", "spei"]})
    pdf = out.toPandas().sort_values(["gap", "draw"])
    want = np.exp(values[:, 0] + 1.2 * values[:, 1] + 1.2 * values[:, 2])
    assert np.allclose(pdf[pdf.gap == 1.0].epred, want) and len(pdf) == 100
    summary = models.interval_summary(out, ["gap"], "epred").where("gap = 1").toPandas().set_index("width")
    assert summary.loc[0.95, "lower"] == pytest.approx(np.quantile(want, 0.025)) and summary.loc[0.5, "upper"] == pytest.approx(np.quantile(want, 0.75))
    assert set(summary.index) == set(models.INTERVAL_MASSES)


def test_trait_fill_takes_the_finest_scale(spark):
    cover = spark.createDataFrame([("s", "p", "a", 2.0), ("s", "p", "b", 1.0), ("t", "q", "a", 1.0), ("t", "q", "c", 1.0)], "site string, plot string, species string, cover double")
    traits = spark.createDataFrame([("s", "a", "H", 1.0), ("s", "a", "H", 3.0), ("t", "a", "H", 10.0), ("t", "b", "H", 5.0), ("u", "b", "H", 7.0)],
                                   "site string, species string, trait string, value double")
    out = bootstrap.trait_fill(cover, traits, ["site"])
    assert rows(out, "site", "species", "level", "n_sample", "mean_value") == [("s", "a", 1, 2, 2.0), ("s", "b", 0, 2, 6.0), ("t", "a", 0, 3, 14 / 3)]


def test_weighted_pick_follows_the_weights(spark):
    data = [("g", i, float(w)) for i, w in enumerate([1, 1, 2, 6, 0])] + [("h", 0, 5.0)]
    df = spark.createDataFrame(data, "grp string, i int, w double")
    out = bootstrap.weighted_pick(df, ["grp"], ["i"], "w", ["i"], 20, 200, seed=7, chunks=4)
    assert out.count() == 2 * 20 * 200  # every draw hits exactly one row
    share = out.where("grp = 'g'").groupBy("i").count().toPandas().set_index("i")["count"] / 4000
    assert share.to_dict() == pytest.approx({0: 0.1, 1: 0.1, 2: 0.2, 3: 0.6}, abs=0.03)
    again = bootstrap.weighted_pick(df.repartition(5), ["grp"], ["i"], "w", ["i"], 20, 200, seed=7, chunks=4)
    assert rows(out.groupBy("grp", "i").count()) == rows(again.groupBy("grp", "i").count())


def test_bootstrap_moments(spark):
    cover = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 3.0)], "plot string, species string, cover double")
    traits = spark.createDataFrame([(i, "a" if i < 2 else "b", "H", float(i)) for i in range(5)], "i int, species string, trait string, value double")
    filled = bootstrap.trait_fill(cover, traits, [])
    draws = bootstrap.bootstrap_draws(filled, traits, ["plot", "trait"], [], ["species", "trait"], ["i"], n_rep=30, sample_size=100)
    assert draws.count() == 3000
    reps = bootstrap.bootstrap_moments(draws, ["plot", "trait"])
    one = bootstrap.summarise_moments(reps, ["plot", "trait"]).first()
    assert one.mean == pytest.approx(0.25 * 0.5 + 0.75 * 3, abs=0.1) and one.ci_low_mean < one["mean"] < one.ci_high_mean
    pdf = draws.where("replicate = 1").toPandas()
    first = reps.where("replicate = 1").first()
    assert first["var"] == pytest.approx(pdf.value.var()) and first["skew"] == pytest.approx(pdf.value.skew(), abs=0.1)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_draws_do_not_depend_on_the_number_of_chunks(spark, monkeypatch, kind):
    cover = spark.createDataFrame([("p", f"s{i % 40}", 1.0 + i) for i in range(40)], "plot string, species string, cover double")
    traits = spark.createDataFrame([(i, f"s{i % 40}", "H", float(i)) for i in range(400)], "i int, species string, trait string, value double")
    traits = traits.withColumns({"j": traits.i % 7, "i": traits.i.cast(kind)})

    def draws():
        out = bootstrap.bootstrap_draws(bootstrap.trait_fill(cover, traits, []), traits, ["plot", "trait"], [], ["species", "trait"], ["i", "j"], n_rep=4, sample_size=50)
        return rows(out)

    whole = draws()
    assert len(whole) == 200
    monkeypatch.setattr("fieldloom.operators.ordered.ROWS_PER_CHUNK", 2)  # the table takes many more chunks now
    assert draws() == whole


def test_predictions_need_unique_covariates(spark):
    predictions = spark.createDataFrame([("Gap", 1.0), ("Gap", 2.0)], "treatment string, predicted double")
    once = spark.createDataFrame([("Gap", 0.5)], "treatment string, spei double")
    assert models.join_predictions(predictions, once, ["treatment"]).count() == 2
    with pytest.raises(PySparkException, match="duplicate key"):
        models.join_predictions(predictions, once.union(once), ["treatment"]).collect()
