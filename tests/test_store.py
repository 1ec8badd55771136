"""Datasets that are stored by the fingerprint of what they are made from."""

import os
import types

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldloom import session
from fieldloom.plans import store as stores
from fieldloom.plans.store import Store

FACTOR = 2


def times(c):
    return F.col(c) * FACTOR


def numbers(spark, source):
    return spark.read.parquet(source).select(times("id").alias("n"))


def total(spark, table, add=0):
    return table.agg((F.sum("n") + add).alias("total"))


def other(spark, source):
    return spark.read.parquet(source).select(F.col("id").alias("o"))


def snapshot(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(root) for f in files}


@pytest.fixture
def run(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(4).write.parquet(str(tmp_path / name))

    def once(**params):
        store = Store(spark, str(tmp_path / "root"))
        store.target("numbers", numbers, {"source": str(tmp_path / "a")})
        store.target("other", other, {"source": str(tmp_path / "b")})
        found = rows(store.target("total", total, uses=["numbers"], **params))
        return found, dict(store.log), store

    return once


def test_second_run_writes_nothing(run, tmp_path):
    assert run()[:2] == ([(12,)], {"numbers": "built", "other": "built", "total": "built"})
    before = snapshot(tmp_path)
    assert run()[:2] == ([(12,)], {"numbers": "reused", "other": "reused", "total": "reused"})
    assert snapshot(tmp_path) == before


def test_changed_input_rebuilds_what_depends_on_it(run, spark, tmp_path):
    run()
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert run()[:2] == ([(20,)], {"numbers": "built", "other": "reused", "total": "built"})


def test_changed_parameter_and_code(run, monkeypatch):
    run()
    assert run(add=5)[:2] == ([(17,)], {"numbers": "reused", "other": "reused", "total": "built"})
    monkeypatch.setitem(globals(), "FACTOR", 3)  # a constant of a function that the target's function calls
    assert run()[:2] == ([(18,)], {"numbers": "built", "other": "reused", "total": "built"})


def test_prune_removes_unreferenced_versions(run, spark, tmp_path):
    run()
    store = run(add=5)[2]
    draft = tmp_path / "root" / "total" / ".draft-x"
    draft.mkdir()
    gone = store.prune()
    assert len(gone) == 1 and gone[0].startswith("total/") and draft.exists()
    assert rows(store.read("total")) == [(17,)] and rows(store.read("numbers")) == [(0,), (2,), (4,), (6,)]
    only = Store(spark, str(tmp_path / "root"))
    only.target("other", other, {"source": str(tmp_path / "b")})
    only.prune()
    assert sorted(os.listdir(tmp_path / "root")) == ["other", "total"]  # the draft of another run is kept for a day


def test_failed_build_publishes_nothing(spark, tmp_path):
    def broken(spark):
        return spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))

    store = Store(spark, str(tmp_path))
    with pytest.raises(Exception, match="no"):
        store.target("broken", broken)
    assert not [v for v in os.listdir(tmp_path / "broken") if not v.startswith(".draft-")] and store.log == []


def test_code_text_reaches_own_functions_only():
    text = stores.code_text(numbers)
    assert "def times" in text and "test_store.times:FACTOR" in text and "class SparkSession" not in text
    module = types.ModuleType("made")
    exec("def f(x):\n    return g(x)\ndef g(x):\n    return x + 1\n", module.__dict__)
    one = stores.code_text(module.f)
    exec("def g(x):\n    return x + 2\n", module.__dict__)
    assert stores.code_text(module.f) != one


def test_names_and_order(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError, match="plain name"):
        store.target("a/b", other)
    with pytest.raises(ValueError, match="not made yet"):
        store.target("t", total, uses=["numbers"])


def test_intermediates_are_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", {})  # leave those of other tests alone
    df = session.cut_lineage(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert os.path.exists(path)
    assert session.drop_intermediates(spark) == 1
    assert not os.path.exists(path) and session.drop_intermediates(spark) == 0
