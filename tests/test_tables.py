"""Joins, reshaping, aggregates, ordered operators, sources and audit."""

import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom.operators import aggregate as agg, audit, columns, joins, ordered, reshape, stats
from fieldloom.sources import tables


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([("a", 10), (None, 20), ("d", 40)], "k string, w int")


def test_missing_keys_match(left, right):
    assert rows(joins.null_safe_join(left, right, ["k"], "left")) == [(None, 2, 20), ("a", 1, 10), ("c", 3, None)]
    assert rows(joins.natural_join(left, right, "outer")) == [
        (None, 2, 20), ("a", 1, 10), ("c", 3, None), ("d", None, 40)]
    assert rows(joins.null_safe_join(left, right, ["k"], "left_anti")) == [("c", 3)]
    assert rows(joins.null_safe_join(left, right, ["k"], "right")) == [(None, 2, 20), ("a", 1, 10), ("d", None, 40)]


def test_suffix_and_renamed_keys(left):
    out = joins.null_safe_join(left, left.select(F.col("k").alias("j"), "v"), {"k": "j"}, "left", ("_a", "_b"))
    assert out.columns == ["k", "v_a", "v_b"]


def test_assert_unique(spark, left):
    assert joins.assert_unique(left, ["k"]).count() == 3
    with pytest.raises(PySparkException, match="duplicate key"):
        joins.assert_unique(left.union(left), ["k"]).collect()


def test_fill_from_group_counts_plots_once(spark):
    df = spark.createDataFrame([("p", "q", 1.0), ("p", "q", 1.0), ("p", "r", 4.0), ("p", "s", None), ("z", "t", None)],
                               "site string, plot string, h double")
    out = joins.fill_from_group(df, "h", ["site"], ["site", "plot"])
    assert rows(out.where("plot in ('s', 't')")) == [("p", "s", 2.5), ("z", "t", None)]


def test_map_keys(spark, left):
    mapping = spark.createDataFrame([("a", "A")], "from_key string, to_key string")
    assert rows(joins.map_keys(left, mapping, ["k"])) == [(None, 2), ("A", 1), ("c", 3)]


def test_long_and_wide_are_inverse(spark):
    wide = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "id int, a double, b double")
    long = reshape.to_long(wide, ["a", "b"])
    assert long.count() == 4 and reshape.to_long(wide, ["a", "b"], drop_missing=True).count() == 3
    assert rows(reshape.to_wide(long, ["id"], "name", "value", ["a", "b"])) == rows(wide)


def test_wide_reports_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "id int, n string, v double")
    with pytest.raises(PySparkException, match="several values"):
        reshape.to_wide(df, ["id"], "n", "v", ["a"]).collect()


def test_long_by_pattern(spark):
    df = spark.createDataFrame([(1, "x", "d1", "y", "d2")], "id int, presence1 string, date1 string, presence2 string, date2 string")
    out = reshape.to_long_by_pattern(df, df.columns[1:], [".value", "round"], r"(.*)(\d$)")
    assert out.columns == ["id", "round", "presence", "date"]
    assert rows(out) == [(1, "1", "x", "d1"), (1, "2", "y", "d2")]


def test_repeat_cross_complete_grid(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 0, 3.0), ("c", None, 5.0)], "k string, n int, x double")
    assert rows(reshape.repeat_rows(df, "n", "i"), "k", "i") == [("a", 1), ("a", 2)]
    assert reshape.cross_with(df, r=[2, 1, 2]).count() == 6
    full = reshape.complete(df.select("k", "n", "x"), ["k", "n"], fill={"x": 0.0})
    assert full.count() == 9  # the missing n is a level, as any other key
    holes = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", 2)], "k string, n int")
    assert rows(reshape.complete(holes, ["k", "n"])) == sorted(
        [(k, n) for k in (None, "a", "b") for n in (None, 1, 2)], key=lambda t: tuple((v is not None, v) for v in t))
    many = spark.range(100_001).select(F.lit("a").alias("k"), F.col("id").alias("n"))
    assert reshape.key_frame(many, ["k", "n"]).count() == 100_001
    points = reshape.grid(df, ["k"], {"x": 3}, {"s": [0.0, 1.0]})
    assert points.count() == 18 and {r.x for r in points.collect()} == {1.0, 3.0, 5.0}
    assert "CartesianProduct" not in points._jdf.queryExecution().executedPlan().toString()


def test_fill_ids_do_not_depend_on_order(spark):
    data = [(i, None if i % 2 else f"id{i}") for i in range(20)]
    a = reshape.fill_ids(spark.createDataFrame(data, "i int, seed string"), "seed", ["i"])
    b = reshape.fill_ids(spark.createDataFrame(data[::-1], "i int, seed string").repartition(7), "seed", ["i"])
    assert rows(a) == rows(b) and len({r.seed for r in a.collect()}) == 20
    alike = spark.createDataFrame([(1, None)] * 3 + [(2, None), (2, "x"), (None, None)], "i int, seed string")
    ids = reshape.fill_ids(alike, "seed", ["i"])
    assert ids.count() == 6 and len({r.seed for r in ids.collect()}) == 6
    other = spark.createDataFrame([(1, "p", None), (1, "q", None)], "i int, w string, seed string")
    assert len({r.seed for r in reshape.fill_ids(other, "seed", ["i"]).collect()}) == 2


def test_repeated_keys_are_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    twice = spark.createDataFrame([("a", 5), ("a", 6)], "k string, v int")
    with pytest.raises(Exception, match="duplicate key"):
        columns.patch_cells(df, twice, ["k"], ["v"]).collect()
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "from_key string, to_key string")
    with pytest.raises(Exception, match="duplicate key"):
        joins.map_keys(df, pairs, ["k"]).collect()


def test_infinite_and_constant_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(float(i), 3.0) for i in range(50)] + [(inf, 3.0), (-inf, 3.0), (None, 3.0)], "v double, c double")
    z = columns.zscore(df, {"z": "v"}).collect()
    assert sum(r.z is not None and abs(r.z) < 3 for r in z) == 50 and {r.z for r in z if r.v in (inf, -inf)} == {inf, -inf}
    assert ordered.ecdf(df, [], "v").count() == 52
    q = {r.prob: r.quantile for r in ordered.exact_quantiles(df, [], "v", [0.0, 0.5, 1.0]).collect()}
    assert q[0.5] == 24.5 and q[1.0] == inf
    assert stats.correlations(df.where("v < 100 AND v > -1"), ["v", "c"]).first().correlation is None
    assert {r.term: r.vif for r in stats.collinearity(df.where("v < 100 AND v > -1").withColumn("w", F.col("v") * F.col("v")), ["v", "c", "w"]).collect()}["c"] is None
    bins = {r.bin: r.n for r in stats.binned_density(df, [], "v", 0.0, 10.0, 2).collect()}
    assert bins == {-1: 1, 0: 5, 1: 6, 2: 40}


def hot_events(n=3000):
    """A third of the rows in one group, one very frequent order value, some missing values."""
    rng = random.Random(3)
    return [(i, "hot" if i % 3 == 0 else f"g{i % 40}", float(5 if i % 4 == 0 else rng.randrange(200)),
             None if i % 9 == 0 else rng.randrange(1000) / 10) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark):
    data = hot_events()
    pdf = pd.DataFrame(data, columns=["id", "g", "t", "v"])
    return spark.createDataFrame(data, "id int, g string, t double, v double").repartition(6), pdf


def test_lag_matches_a_plain_sort(hot):
    df, pdf = hot
    want = pdf.sort_values(["t", "id"])
    want["prev"] = want.groupby("g")["id"].shift(1)
    got = ordered.lag_in_group(df, ["g"], ["t", "id"], {"prev": "id"}).toPandas().set_index("id")["prev"].sort_index()
    assert got.fillna(-1).tolist() == want.set_index("id")["prev"].sort_index().fillna(-1).tolist()


def test_running_sum_and_row_index(hot):
    df, pdf = hot
    want = pdf.sort_values(["t", "id"])
    want["s"] = want.groupby("g")["id"].cumsum()
    want["i"] = range(1, len(want) + 1)
    got = ordered.running_sum(df, ["g"], ["t", "id"], {"s": "id"}).toPandas().set_index("id")["s"].sort_index()
    assert got.tolist() == want.set_index("id")["s"].sort_index().tolist()
    got = ordered.row_index(df, ["t", "id"]).toPandas().set_index("id")["row_index"].sort_index()
    assert got.tolist() == want.set_index("id")["i"].sort_index().tolist()


def test_chunks_split_the_hot_value(hot):
    df, _ = hot
    sizes = ordered.add_chunks(df, ["t", "id"]).groupBy("__chunk").count().agg(F.max("count")).first()[0]
    assert sizes < 100  # the frequent value alone has 750 rows


def test_sort_position_puts_missing_last(hot):
    df, pdf = hot
    want = pdf.sort_values(["v", "id"], na_position="last")["id"].tolist()
    got = ordered.sort_position(df, "v", "id").orderBy("position").select("id").toPandas()["id"].tolist()
    assert got == want


def test_exact_quantiles_and_ecdf(hot):
    df, pdf = hot
    got = ordered.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).toPandas().set_index(["g", "prob"])["quantile"].sort_index()
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.9]).sort_index()
    assert got.tolist() == pytest.approx(want.tolist())
    curve = ordered.ecdf(df, [], "v").toPandas().sort_values("v")
    assert curve["ecdf"].is_monotonic_increasing and curve["ecdf"].iloc[-1] == 1 and curve["n"].sum() == pdf["v"].notna().sum()


def test_first_and_last_rows(hot):
    df, pdf = hot
    want = pdf.sort_values(["t", "id"]).groupby("g")["id"]
    assert dict(rows(ordered.first_row(df, ["g"], ["t", "id"]), "g", "id")) == want.first().to_dict()
    assert dict(rows(ordered.last_row(df, ["g"], ["t", "id"]), "g", "id")) == want.last().to_dict()


def test_group_operators(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, None), ("b", 2, None), ("c", 3, 7.0)], "k string, y int, x double")
    assert rows(agg.duplicate_keys(df, ["k"])) == [("a", 2)]
    assert rows(agg.drop_duplicates_missing(df, ["k"], "x")) == [("a", 1, 5.0), ("b", 2, None), ("c", 3, 7.0)]
    assert rows(agg.keep_groups(df, ["k"], F.count("x") > 0)) == [("a", 1, None), ("a", 1, 5.0), ("c", 3, 7.0)]
    assert rows(agg.first_within(df, F.col("y") == 1, ["k"], ["x"])) == [("a", 1, None), ("b", 2, None), ("c", 3, 7.0)]
    assert rows(agg.group_distinct(df, ["k"], "x", "n"), "k", "n") == [("a", 1), ("a", 1), ("b", 0), ("c", 1)]
    assert agg.bind_rows(df, df.drop("x")).where("x is null").count() == 6


def test_group_statistics_do_not_use_a_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0)], "k string, x double")
    out = joins.with_group_stats(df, ["k"], {"s": F.sum("x")})
    assert rows(out, "k", "s") == [(None, 3.0), ("a", 3.0), ("a", 3.0)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_text_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("ID,x,ID\nNA,1,k\nb,NA,m\n")
    df = tables.read_delimited(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["ID0", "x", "ID2"] and rows(df) == [(None, "1", "k"), ("b", None, "m")]
    assert tables.positional_name(df, "ID", 3) == "ID2"
    assert tables.repair_headers(df, ["ID", "x", "ID"]).columns == ["ID...1", "x", "ID...3"]
    typed = tables.read_delimited(spark, str(tmp_path / "in.csv"), "a string, x double, b string")
    assert rows(typed, "x") == [(None,), (1.0,)]
    tables.write_delimited(df, str(tmp_path / "out"), sep=";")
    assert rows(tables.read_delimited(spark, str(tmp_path / "out"), sep=";")) == rows(df)
    assert dict(tables.read_guessed(spark, str(tmp_path / "in.csv")).dtypes)["x"] == "int"


def test_stored_tables_push_filters(spark, tmp_path, left):
    stored = tables.materialise(left, str(tmp_path), "left_table")
    assert rows(stored) == rows(left)
    picked = tables.read_table(spark, f"{tmp_path}/left_table", F.col("v") > 1, ["k"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,1)" in plan and rows(picked) == [(None,), ("c",)]
    assert rows(tables.load(spark, str(tmp_path), "left_table")) == rows(left)


def test_audit_counts_rows(left, right):
    seen = audit.Audit()
    kept = seen.step(left, "filter", lambda d: d.where("v > 1"))
    joined = seen.left_join(kept, right, ["k"], "join")
    assert joined.count() == 2
    report = seen.report()
    assert report[("filter", "in")]["rows"] == 3 and report[("filter", "out")]["rows"] == 2
    assert report[("join", "out")] == {"rows": 2, "matched": 1, "unmatched": 1}
    assert tuple(audit.join_audit(left, right, ["k"]).first()) == (3, 3, 2, 1, 1, 0, 3)


def test_zscore_does_not_lose_digits_in_long_sums(spark):
    # A running sum of doubles has steps of 0.5 behind the first row: 0.3 would count as 0.5.
    df = spark.range(0, 1002, 1, 1).selectExpr("CASE id WHEN 0 THEN 3e15D WHEN 1001 THEN -3e15D ELSE 0.3D END AS v")
    out = columns.zscore(df, {"d": "v"}, center_only=True).where("v = 0.3").select("d").distinct().collect()
    assert len(out) == 1 and abs(out[0].d - (0.3 - 300 / 1002)) < 5e-3
    alike = columns.zscore(spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double"), {"z": "v"}).collect()
    assert [r.z for r in alike] == [None, None, None]
