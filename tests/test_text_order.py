"""Ordered operators over text columns."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import ordered


@pytest.fixture
def tiny(monkeypatch):
    """Chunks of a few rows, so that every rule of the cutting is used."""
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 9)


def odd_texts(rng, n):
    values = ["", " ", "a", "ab", "abc", "é", "éa", "日本", "日本語", "𝄞", "z", "Z", "shared beginning " * 40, "shared beginning " * 40 + "x", "shared beginning " * 40 + "y"]
    return [rng.choice([None, *values, "".join(rng.choices("abé", k=rng.randrange(6)))]) for _ in range(n)]


def test_chunks_follow_the_order_and_stay_small(spark, tiny):
    rng = random.Random(2)
    values = odd_texts(rng, 150) + ["hot"] * 40 + [f"page{i:04d}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(3)
    got = [(r.v, r.c) for r in ordered.text_chunks(df, "v", "c").collect()]
    assert sorted(v or "" for v, _ in got) == sorted(v or "" for v in values)
    known = sorted(((v.encode(), c) for v, c in got if v is not None))
    assert [c for _, c in known] == sorted(c for _, c in known)
    assert {c for v, c in got if v is None} == {-1}
    size = {}
    for v, c in got:
        size.setdefault(c, []).append(v)
    assert all(len(vs) <= 18 or len(set(vs)) == 1 for vs in size.values())
    assert len(size) > 15


@pytest.mark.parametrize("order", [["v", "i"], ["v", "w", "i"], ["n", "v", "i"]])
def test_row_numbers_and_lag_by_text(spark, tiny, order):
    rng = random.Random(len(order))
    values = odd_texts(rng, 80)
    data = [(i, v, rng.choice(["x", "y", None]), rng.choice([1.5, None, 2.0, float("inf")])) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "i int, v string, w string, n double").withColumn("one", F.lit(1)).repartition(2)
    if order == ["v", "w", "i"]:
        df = df.withColumn("v", F.lit("one hot value"))
        data = [(i, "one hot value", w, n) for i, _, w, n in data]

    def key(row):
        named = dict(zip("ivwn", row))
        return [(named[c] is not None, (named[c].encode() if isinstance(named[c], str) else named[c]) if named[c] is not None else 0) for c in order]

    want = [r[0] for r in sorted(data, key=key)]
    numbered = ordered.row_index(df, order)
    assert [r.i for r in sorted(numbered.collect(), key=lambda r: r.row_index)] == want
    after = {r.i: r.before for r in ordered.lag_in_group(df, ["one"], order, {"before": "i"}).collect()}
    assert after == dict(zip(want, [None, *want[:-1]]))


def test_ecdf_of_text(spark, tiny):
    rng = random.Random(9)
    data = [(rng.choice("ab"), v) for v in odd_texts(rng, 200)]
    got = {(r.g, r.v): (r.n, r.ecdf) for r in ordered.ecdf(spark.createDataFrame(data, "g string, v string"), ["g"], "v").collect()}
    for g in "ab":
        own = [v for k, v in data if k == g and v is not None]
        for v in set(own):
            assert got[g, v] == (own.count(v), pytest.approx(sum(u.encode() <= v.encode() for u in own) / len(own)))
    assert len(got) == len({k for k in data if k[1] is not None})


def test_empty_and_binary(spark, tiny):
    assert ordered.row_index(spark.createDataFrame([], "v string"), ["v"]).count() == 0
    df = spark.createDataFrame([(bytes([i * 7 % 256]),) for i in range(30)], "v binary")
    assert [bytes(r.v) for r in sorted(ordered.row_index(df, ["v"]).collect(), key=lambda r: r.row_index)] == sorted(bytes([i * 7 % 256]) for i in range(30))
