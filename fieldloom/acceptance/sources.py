"""Sources and sinks: tables written to the shared folder of the cluster and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.store import Store
from ..session import shared_folder
from ..sources import tables
from .registry import big, case, r

ORDERS_SCHEMA = "o_orderkey bigint, status string, price double, day date, note string"


def _written(t) -> str:
    """The orders as delimited text, ``NA`` where a value is missing."""
    path = f"{shared_folder(t.spark)}/orders-{uuid.uuid4().hex}"
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    tables.write_delimited(t.orders.select(
        "o_orderkey", F.when(status != "P", status).alias("status"), F.when(price < 300000, price).alias("price"),
        F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit('a "b", '), F.col("o_orderpriority")).alias("note")), path)
    return path


TEXT_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CASE WHEN o_totalprice < 300000 THEN round(o_totalprice, 6) + 0.0 END AS price,
  strftime(o_orderdate, '%Y-%m-%d') AS day, 'a "b", ' || o_orderpriority AS note FROM orders"""


@case("q_delimited_schema", TEXT_SQL)
def delimited_schema(t):
    df = tables.read_delimited(t.spark, _written(t), ORDERS_SCHEMA)
    return df.select("o_orderkey", "status", r("price").alias("price"), F.date_format("day", "yyyy-MM-dd").alias("day"), "note")


@case("q_delimited_text", TEXT_SQL)
def delimited_text(t):
    df = tables.read_delimited(t.spark, _written(t))
    return df.select(big("o_orderkey").alias("o_orderkey"), "status", r(F.col("price").cast("double")).alias("price"), "day", "note")


@case("q_repeated_headers", """
SELECT o_orderkey AS "ID...1", o_orderkey + o_custkey AS "ID...2", o_orderstatus AS status FROM orders""")
def repeated_headers(t):
    path = f"{shared_folder(t.spark)}/headers-{uuid.uuid4().hex}"
    tables.write_delimited(t.orders.select("o_orderkey", (F.col("o_orderkey") + F.col("o_custkey")).alias("second"), "o_orderstatus"), path)
    return tables.repair_headers(tables.read_delimited(t.spark, path, "a bigint, b bigint, c string"), ["ID", "ID", "status"])


@case("q_named_dataset", """
SELECT o_orderstatus AS status, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) + 0.0 AS price FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def named_dataset(t):
    root, name = shared_folder(t.spark), f"orders-by-status-{uuid.uuid4().hex}"
    tables.materialise(t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status")), root, name, ["status"])
    df = tables.load(t.spark, root, name).where("status <> 'P'")  # whole folders are skipped
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("price"))


@case("q_read_pushed", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 25")
def read_pushed(t):
    return tables.read_table(t.spark, f"{t.folder}/lineitem.parquet", F.col("l_quantity") >= 25, ["l_orderkey", "l_linenumber", "l_quantity"])


@case("q_quoted_breaks", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'he said "' || o_orderstatus || '",' || chr(10) || chr(10) || o_orderpriority || chr(13) || chr(10) || '"end"' END AS note,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def quoted_breaks(t):
    path = f"{shared_folder(t.spark)}/quoted-{uuid.uuid4().hex}"
    status = F.col("o_orderstatus")
    said = F.concat(F.lit('he said "'), status, F.lit('",\n\n'), F.col("o_orderpriority"), F.lit('\r\n"end"'))
    tables.write_delimited(t.orders.select("o_orderkey", F.when(status != "P", said).alias("note"), F.col("o_orderdate").cast("date").alias("day")), path)
    return tables.read_delimited(t.spark, path, "o_orderkey bigint, note string, day string", line_breaks=True)


@case("q_guessed_types", """
SELECT o_orderkey AS key, round(o_totalprice, 6) + 0.0 AS price, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer, o_orderdate::DATE::VARCHAR AS day,
  strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS stamp, lpad(o_custkey::VARCHAR, 12, '0') AS code, o_orderstatus = 'F' AS finished,
  'key int, price double, customer int, day date, stamp timestamp, code string, finished boolean, nothing string, mixed double' AS types,
  CASE WHEN o_orderstatus = 'F' THEN 7.0::DOUBLE ELSE 0.5 END AS mixed, NULL::VARCHAR AS nothing FROM orders""")
def guessed_types(t):
    path = f"{shared_folder(t.spark)}/guessed-{uuid.uuid4().hex}"
    finished = F.col("o_orderstatus") == "F"
    tables.write_delimited(t.orders.select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("code"), F.when(finished, "TRUE").otherwise("False").alias("finished"),
        F.lit(None).cast("string").alias("nothing"), F.when(finished, "7").otherwise(".5").alias("mixed")), path)
    df = tables.read_guessed(t.spark, path)
    types = ", ".join(f"{n} {k}" for n, k in df.dtypes)
    return df.select(big("key").alias("key"), r("price").alias("price"), big("customer").alias("customer"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
                     "code", "finished", F.lit(types).alias("types"), "mixed", "nothing")


def _per_day(spark, orders):
    day = F.col("o_orderdate").cast("date")
    return spark.read.parquet(orders).groupBy(day.alias("day"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price"))


def _per_month(spark, days, least):
    month = F.date_format("day", "yyyy-MM")
    return days.groupBy(month.alias("month"), "o_orderstatus").agg(F.sum("n").alias("n"), F.sum("price").alias("price")).where(F.col("n") >= least)


@case("q_reused_datasets", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) + 0.0 AS price,
  'days built, months built, days reused, months reused, days reused, months built' AS states, 1::BIGINT AS removed
FROM orders GROUP BY 1, 2 HAVING count(*) >= 3""")
def reused_datasets(t):
    root, states = f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}", []
    for least in (1, 1, 3):  # a changed parameter rebuilds what depends on it only
        store = Store(t.spark, root)
        store.target("days", _per_day, {"orders": f"{t.folder}/orders.parquet"})
        df = store.target("months", _per_month, uses=["days"], least=least)
        states += [f"{name} {state}" for name, state in store.log]
    removed = len(store.prune())
    return df.select("month", "o_orderstatus", "n", r("price", 2).alias("price"), F.lit(", ".join(states)).alias("states"), big(F.lit(removed)).alias("removed"))
