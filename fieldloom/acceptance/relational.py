"""Selection, derivation, reshaping, joins, aggregates, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, nulls, text
from ..functions.lookups import lookup, recode
from ..operators import aggregate as agg, audit, columns as cols, joins, ordered, reshape
from ..session import cut_lineage
from .registry import big, case, day_text, r

PRIORITY_CODES = {"1-URGENT": "U", "2-HIGH": "H", "3-MEDIUM": "M"}
SEGMENT_LEVELS = ("HOUSEHOLD", "BUILDING", "MACHINERY")


# --- predicates and derivation -------------------------------------------------------------


@case("q_filter_null_safe", """
SELECT o_orderkey, s AS status, regexp_matches(s, '^O')::INT AS strict_match,
       coalesce(regexp_matches(s, '^O'), false) AS safe_match
FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders)
WHERE (s IS NULL OR s NOT IN ('F')) AND regexp_matches(o_orderpriority, '^[12]')
  AND o_totalprice BETWEEN 50000 AND 300000""")
def filter_null_safe(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    rows = t.orders.withColumn("status", status).where(
        nulls.not_in("status", ["F"]) & nulls.matches("o_orderpriority", "^[12]")
        & F.col("o_totalprice").between(50000, 300000))
    return rows.select("o_orderkey", "status", F.col("status").rlike("^O").cast("int").alias("strict_match"),
                       nulls.matches("status", "^O").alias("safe_match"))


@case("q_case_sequential", """
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders),
b AS (SELECT *, CASE WHEN price > 300000 THEN 'high' WHEN price > 100000 THEN 'mid' ELSE 'low' END AS band,
      CASE WHEN price IS NULL THEN NULL WHEN price > 200000 THEN 'big' ELSE 'small' END AS size_class FROM a)
SELECT o_orderkey, band, size_class, band || '_' || coalesce(size_class, 'NA') AS label FROM b""")
def case_sequential(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    price = F.col("price")
    return cols.derive(
        rows,
        band=F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low"),
        size_class=nulls.if_else(price > 200000, F.lit("big"), F.lit("small")),
        label=nulls.paste(F.col("band"), F.col("size_class"), sep="_"),
    ).drop("price")


@case("q_recode_map", """
SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' WHEN '3-MEDIUM' THEN 'M' END AS code,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' WHEN '3-MEDIUM' THEN 'M'
       ELSE o_orderpriority END AS recoded
FROM orders""")
def recode_map(t):
    return t.orders.select("o_orderkey", lookup("o_orderpriority", PRIORITY_CODES).alias("code"),
                           recode("o_orderpriority", PRIORITY_CODES).alias("recoded"))


@case("q_corrections_patch", """
WITH fix AS (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS bal FROM customer GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN f.bal > 9900 THEN f.bal ELSE c.c_acctbal END AS c_acctbal
FROM customer c LEFT JOIN fix f ON c.c_nationkey = f.c_nationkey AND c.c_mktsegment = f.c_mktsegment""")
def corrections_patch(t):
    best = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("best"))
    fixes = best.select("c_nationkey", "c_mktsegment", F.when(F.col("best") > 9900, F.col("best")).alias("c_acctbal"))
    return cols.patch_cells(t.customer, fixes, ["c_nationkey", "c_mktsegment"], ["c_acctbal"]).select(
        "c_custkey", "c_acctbal")


@case("q_levels", """
WITH lv AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY m, c_mktsegment) AS level_order FROM lv)
SELECT c_custkey,
  CASE WHEN c.c_mktsegment IN ('HOUSEHOLD', 'BUILDING', 'MACHINERY') THEN c.c_mktsegment END AS segment,
  CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 END AS ord,
  (c.c_mktsegment = 'BUILDING')::DOUBLE AS is_building, (c.c_mktsegment = 'MACHINERY')::DOUBLE AS is_machinery,
  r.level_order::BIGINT AS level_order
FROM customer c JOIN ranked r USING (c_mktsegment)""")
def levels(t):
    value, position = cols.as_levels("c_mktsegment", SEGMENT_LEVELS)
    rows, _ = cols.dummies(t.customer, "c_mktsegment", SEGMENT_LEVELS, "HOUSEHOLD")
    ranked = cols.order_levels_by(t.customer, "c_mktsegment", "c_acctbal").select("c_mktsegment", "level_order")
    return joins.null_safe_join(rows, ranked, ["c_mktsegment"], "left").select(
        "c_custkey", value.alias("segment"), position.alias("ord"),
        F.col("c_mktsegmentBUILDING").alias("is_building"), F.col("c_mktsegmentMACHINERY").alias("is_machinery"),
        big("level_order").alias("level_order"))


@case("q_cols_range_across", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / 10, 3) + 0.0 AS l_quantity,
  round(l_extendedprice / 10, 3) + 0.0 AS l_extendedprice, round(l_discount / 10, 3) + 0.0 AS l_discount,
  round(l_tax / 10, 3) + 0.0 AS l_tax
FROM lineitem""")
def cols_range_across(t):
    kept = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             *cols.cols_between(t.lineitem, "l_quantity", "l_tax"))
    return cols.across(kept, cols.cols_matching(kept, "quantity|price|discount|tax"), lambda c: r(c / 10, 3))


# --- reshape ---------------------------------------------------------------------------------


@case("q_unpivot", """
SELECT o_orderkey, name, value FROM (
  SELECT o_orderkey, 'o_totalprice' AS name, o_totalprice AS value FROM orders
  UNION ALL SELECT o_orderkey, 'clean', CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END FROM orders)""")
def unpivot(t):
    wide = t.orders.select("o_orderkey", "o_totalprice",
                           F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("clean"))
    return reshape.to_long(wide, ["o_totalprice", "clean"])


@case("q_unpivot_regex", """
WITH w AS (SELECT l_returnflag AS flag, l_linestatus AS st, count(*)::BIGINT AS n1,
  count(*) FILTER (WHERE l_discount > 0.05)::BIGINT AS n2, count(*) FILTER (WHERE l_tax > 0.04)::BIGINT AS n3
  FROM lineitem GROUP BY 1, 2)
SELECT flag, st, 'count' AS category, '1' AS round, n1 AS value FROM w
UNION ALL SELECT flag, st, 'count', '2', n2 FROM w UNION ALL SELECT flag, st, 'count', '3', n3 FROM w""")
def unpivot_regex(t):
    wide = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st")).agg(
        F.count(F.lit(1)).alias("count1"), F.count_if(F.col("l_discount") > 0.05).alias("count2"),
        F.count_if(F.col("l_tax") > 0.04).alias("count3"))
    return reshape.to_long_by_pattern(wide, ["count1", "count2", "count3"], ["category", "round"], r"(^.{0,5})([1-3])")


@case("q_unpivot_multi", """
WITH w AS (SELECT l_returnflag AS flag, min(l_quantity) AS qty_lo, max(l_quantity) AS qty_hi,
  min(l_extendedprice) AS price_lo, max(l_extendedprice) AS price_hi FROM lineitem GROUP BY 1)
SELECT flag, 'lo' AS edge, qty_lo AS qty, price_lo AS price FROM w
UNION ALL SELECT flag, 'hi', qty_hi, price_hi FROM w""")
def unpivot_multi(t):
    wide = t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.min("l_quantity").alias("qty_lo"), F.max("l_quantity").alias("qty_hi"),
        F.min("l_extendedprice").alias("price_lo"), F.max("l_extendedprice").alias("price_hi"))
    return reshape.to_long_by_pattern(wide, wide.columns[1:], [".value", "edge"], r"(.*)_(.*)")


@case("q_pivot", """
SELECT year(l_shipdate) AS year, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS qty_A,
  sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS qty_N,
  sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS qty_R
FROM lineitem GROUP BY 1""")
def pivot(t):
    long = t.lineitem.groupBy(F.year("l_shipdate").alias("year"), "l_returnflag").agg(F.sum("l_quantity").alias("qty"))
    return reshape.to_wide(long, ["year"], "l_returnflag", "qty", ["A", "N", "R"], prefix="qty_")


@case("q_split_name", """
SELECT p_partkey, split_part(p_brand, '#', 1) AS maker, split_part(p_brand, '#', 2) AS number,
  split_part(p_name, ' ', 2) AS thing FROM part""")
def split_name(t):
    rows = reshape.split_column(t.part, "p_brand", "#", ["maker", "number"])
    return rows.select("p_partkey", "maker", "number", text.piece("p_name", " ", 2).alias("thing"))


@case("q_uncount", """
SELECT l_returnflag, copy, count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS lines
FROM (SELECT *, unnest(generate_series(1, l_quantity::INT)) AS copy FROM lineitem) GROUP BY 1, 2""")
def uncount(t):
    rows = reshape.repeat_rows(t.lineitem.select("l_returnflag", "l_linenumber", "l_quantity"), "l_quantity", "copy")
    return rows.groupBy("l_returnflag", "copy").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@case("q_cross_complete", """
WITH c AS (SELECT user_id, event_type, ts::DATE AS d, count(*)::BIGINT AS n FROM events GROUP BY ALL),
frame AS (SELECT * FROM (SELECT DISTINCT user_id FROM c) CROSS JOIN (SELECT DISTINCT event_type FROM c)
  CROSS JOIN (SELECT DISTINCT d FROM c) CROSS JOIN (VALUES ('early'), ('late')) AS p(part))
SELECT f.user_id, f.event_type, strftime(f.d, '%Y-%m-%d') AS day, part, coalesce(n, 0)::BIGINT AS n
FROM frame f LEFT JOIN c USING (user_id, event_type, d)""")
def cross_complete(t):
    counts = t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"))
    full = reshape.complete(cut_lineage(counts), ["user_id", "event_type", "d"], fill={"n": 0})
    return reshape.cross_with(full, part=["early", "late"]).select(
        "user_id", "event_type", day_text("d").alias("day"), "part", "n")


@case("q_date_frame", """
WITH e AS (SELECT user_id, ts::DATE AS d, count(*)::BIGINT AS n FROM events GROUP BY ALL),
span AS (SELECT min(d) AS lo, max(d) AS hi FROM e),
frame AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d
          FROM (SELECT DISTINCT user_id FROM e), span)
SELECT f.user_id, strftime(f.d, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS n FROM frame f LEFT JOIN e USING (user_id, d)""")
def date_frame(t):
    counts = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    frame = reshape.date_frame(counts, ["user_id"], "d")
    return joins.null_safe_join(frame, counts, ["user_id", "d"], "left").select(
        "user_id", day_text("d").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@case("q_grid", """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT p.o_orderpriority, q.o_orderstatus, round(lo + (hi - lo) * i / 49.0, 4) + 0.0 AS price, spei
FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) q
CROSS JOIN s CROSS JOIN generate_series(0, 49) AS g(i) CROSS JOIN (VALUES (-1.2::DOUBLE), (0.0), (1.2)) AS v(spei)""")
def grid(t):
    points = reshape.grid(t.orders, ["o_orderpriority", "o_orderstatus"], {"o_totalprice": 50},
                          {"spei": [-1.2, 0.0, 1.2]})
    return points.select("o_orderpriority", "o_orderstatus", r("o_totalprice", 4).alias("price"), "spei")


@case("q_fill_ids", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ran' || md5(o_orderkey || '|' || o_custkey) || '_1'
  ELSE 'o' || o_orderkey END AS id,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::BIGINT AS nr,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS nr_all
FROM orders""")
def fill_ids(t):
    rows = t.orders.withColumn("id", F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("o"), F.col("o_orderkey"))))
    rows = reshape.fill_ids(rows, "id", ["o_orderkey", "o_custkey"])
    order = ["o_orderdate", "o_orderkey"]
    rows = ordered.row_index(rows, order, ["o_orderpriority"], "nr")
    return ordered.row_index(rows, order, out="nr_all").select("o_orderkey", "id", "nr", "nr_all")


# --- joins -------------------------------------------------------------------------------------


@case("q_join_left", """
SELECT o_orderkey, c.c_mktsegment, c.c_nationkey FROM orders o
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey""")
def join_left(t):
    known = t.customer.where("c_acctbal > 0")
    return joins.null_safe_join(t.orders, known, {"o_custkey": "c_custkey"}, "left").select(
        "o_orderkey", "c_mktsegment", "c_nationkey")


@case("q_join_several_keys", """
WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority, max(o_totalprice) AS top
           FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_orderkey, m.top FROM orders o LEFT JOIN m
  ON year(o.o_orderdate) = m.y AND month(o.o_orderdate) = m.m AND o.o_orderpriority = m.o_orderpriority""")
def join_several_keys(t):
    dated = t.orders.withColumns({"y": F.year("o_orderdate"), "m": F.month("o_orderdate")})
    keys = ["y", "m", "o_orderpriority"]
    tops = dated.where("o_orderstatus = 'F'").groupBy(*keys).agg(F.max("o_totalprice").alias("top"))
    return joins.null_safe_join(dated, tops, keys, "left").select("o_orderkey", "top")


@case("q_join_natural_full", """
WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*)::BIGINT AS customers FROM customer
           WHERE c_acctbal > 9000 GROUP BY ALL),
b AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*)::BIGINT AS debtors FROM customer
      WHERE c_acctbal < -800 GROUP BY ALL)
SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.segment, b.segment) AS segment, customers, debtors
FROM a FULL JOIN b ON a.nation = b.nation AND a.segment = b.segment""")
def join_natural_full(t):
    def counted(where, name):
        return t.customer.where(where).groupBy(F.col("c_nationkey").alias("nation"),
                                               F.col("c_mktsegment").alias("segment")).agg(
            F.count(F.lit(1)).alias(name))
    return joins.natural_join(counted("c_acctbal > 9000", "customers"), counted("c_acctbal < -800", "debtors"), "outer")


@case("q_join_right", """
WITH n AS (SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
SELECT c_custkey AS custkey, n FROM n RIGHT JOIN customer c ON n.o_custkey = c.c_custkey""")
def join_right(t):
    counts = t.orders.where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("n"))
    return joins.null_safe_join(counts, t.customer.select(F.col("c_custkey").alias("custkey")), ["custkey"], "right")


@case("q_join_anti", """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)""")
def join_anti(t):
    large = t.orders.where("o_totalprice > 450000").select("o_custkey")
    return joins.null_safe_join(t.customer, large, {"c_custkey": "o_custkey"}, "left_anti").select("c_custkey", "c_name")


@case("q_join_suffix", """
WITH f AS (SELECT o_custkey AS cust, min(o_orderdate) AS d, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus='F' GROUP BY 1),
p AS (SELECT o_custkey AS cust, min(o_orderdate) AS d, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus='P' GROUP BY 1)
SELECT f.cust, strftime(f.d, '%Y-%m-%d') AS d_last, strftime(p.d, '%Y-%m-%d') AS d_first, f.n AS n_last, p.n AS n_first
FROM f LEFT JOIN p ON f.cust = p.cust""")
def join_suffix(t):
    def summary(status):
        return t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("cust")).agg(
            day_text(F.min("o_orderdate")).alias("d"), F.count(F.lit(1)).alias("n"))
    return joins.null_safe_join(summary("F"), summary("P"), ["cust"], "left", ("_last", "_first"))


@case("q_join_null_keys", """
WITH c AS (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer),
s AS (SELECT seg, count(*)::BIGINT AS n, max(c_acctbal) AS top FROM c GROUP BY 1)
SELECT c_custkey, c.seg, n, top FROM c LEFT JOIN s ON c.seg IS NOT DISTINCT FROM s.seg""")
def join_null_keys(t):
    rows = t.customer.withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return joins.with_group_stats(rows, ["seg"], {"n": F.count(F.lit(1)), "top": F.max("c_acctbal")}).select(
        "c_custkey", "seg", "n", "top")


@case("q_join_many", """
SELECT n.n_name, c.c_mktsegment, count(*)::BIGINT AS pairs FROM nation n
LEFT JOIN (SELECT DISTINCT c_nationkey, c_mktsegment, c_acctbal FROM customer) c ON n.n_nationkey = c.c_nationkey
GROUP BY ALL""")
def join_many(t):
    covariates = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment", "c_acctbal").distinct()
    return joins.null_safe_join(t.nation, covariates, ["n_nationkey"], "left").groupBy("n_name", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("pairs"))


@case("q_site_enrich", """
SELECT o_orderkey, n.n_name, CASE WHEN r.r_name IN ('ASIA', 'EUROPE') THEN 'alpine'
  WHEN r.r_name = 'AFRICA' THEN 'sub-alpine' ELSE 'boreal' END AS level, top.top
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS top FROM customer GROUP BY 1) top ON top.c_nationkey = n.n_nationkey""")
def site_enrich(t):
    tops = t.customer.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("top"))
    sites = joins.null_safe_join(t.nation, t.region, {"n_regionkey": "r_regionkey"}, "left")
    sites = joins.null_safe_join(sites, tops, {"n_nationkey": "c_nationkey"}, "left")
    rows = joins.null_safe_join(t.orders, t.customer, {"o_custkey": "c_custkey"}, "left")
    rows = joins.null_safe_join(rows, sites, {"c_nationkey": "n_nationkey"}, "left")
    level = F.when(F.col("r_name").isin("ASIA", "EUROPE"), "alpine").when(
        F.col("r_name") == "AFRICA", "sub-alpine").otherwise("boreal")
    return rows.select("o_orderkey", "n_name", level.alias("level"), "top")


@case("q_key_map", """
WITH m AS (SELECT n_name AS a, upper(r_name) || '_' || n_nationkey AS b FROM nation JOIN region ON n_regionkey = r_regionkey
           WHERE r_name <> 'ASIA')
SELECT n_nationkey, coalesce(m.b, n_name) AS n_name FROM nation LEFT JOIN m ON n_name = m.a""")
def key_map(t):
    pairs = joins.null_safe_join(t.nation, t.region, {"n_regionkey": "r_regionkey"}, "inner").where("r_name <> 'ASIA'")
    mapping = pairs.select(F.col("n_name").alias("from_key"), F.concat_ws("_", F.upper("r_name"), "n_nationkey").alias("to_key"))
    return joins.map_keys(t.nation, mapping, ["n_name"]).select("n_nationkey", "n_name")


@case("q_impute_self", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
    CASE WHEN l_linestatus = 'F' OR l_discount < 0.02 THEN NULL ELSE l_quantity END AS q FROM lineitem),
m1 AS (SELECT l_partkey, avg(q) AS m FROM (SELECT DISTINCT l_partkey, l_suppkey, q FROM a WHERE l_returnflag = 'N') GROUP BY 1),
b AS (SELECT a.*, CASE WHEN q IS NULL AND l_returnflag = 'N' THEN m ELSE q END AS q1 FROM a LEFT JOIN m1 USING (l_partkey)),
m2 AS (SELECT l_suppkey, avg(q1) AS m FROM (SELECT DISTINCT l_partkey, l_suppkey, q1 FROM b) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(q1, m), 6) + 0.0 AS q, q1 IS NULL AS filled
FROM b LEFT JOIN m2 USING (l_suppkey)""")
def impute_self(t):
    missing = (F.col("l_linestatus") == "F") | (F.col("l_discount") < 0.02)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                             F.when(~missing, F.col("l_quantity")).alias("q"))
    control = F.col("l_returnflag") == "N"
    once = joins.fill_from_group(rows, "q", ["l_partkey"], ["l_partkey", "l_suppkey"], where=control, apply_to=control)
    flagged = once.withColumn("filled", F.col("q").isNull())
    return joins.fill_from_group(flagged, "q", ["l_suppkey"], ["l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("q").alias("q"), "filled")


# --- aggregates ---------------------------------------------------------------------------------


@case("q_agg_na", """
WITH a AS (SELECT l_suppkey, CASE WHEN l_quantity > 49 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS p FROM lineitem)
SELECT l_suppkey, CASE WHEN count(q) < count(*) THEN NULL ELSE sum(q) END AS sum_strict, coalesce(sum(q), 0) AS sum_skip,
  round(CASE WHEN count(q) < count(*) THEN NULL ELSE avg(q) END, 6) + 0.0 AS mean_strict, round(avg(q), 6) + 0.0 AS mean_skip,
  min(q) AS lo, max(q) AS hi, count(*)::BIGINT AS n FROM a GROUP BY 1""")
def agg_na(t):
    rows = t.lineitem.select("l_suppkey", F.when(F.col("l_quantity") <= 49, F.col("l_quantity")).alias("q"))
    return rows.groupBy("l_suppkey").agg(
        nulls.sum_strict("q").alias("sum_strict"), nulls.sum_skip("q").alias("sum_skip"),
        r(nulls.mean_strict("q")).alias("mean_strict"), r(nulls.mean_skip("q")).alias("mean_skip"),
        F.min("q").alias("lo"), F.max("q").alias("hi"), F.count(F.lit(1)).alias("n"))


@case("q_agg_na_small_groups", """
WITH a AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_returnflag, CASE WHEN count(q) < count(*) THEN NULL ELSE sum(q) END AS sum_strict,
  coalesce(sum(q), 0) AS sum_skip FROM a GROUP BY 1, 2""")
def agg_na_small_groups(t):
    rows = t.lineitem.select("l_orderkey", "l_returnflag", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("q"))
    return rows.groupBy("l_orderkey", "l_returnflag").agg(nulls.sum_strict("q").alias("sum_strict"),
                                                          nulls.sum_skip("q").alias("sum_skip"))


@case("q_ndistinct", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_supp::BIGINT AS n_supp FROM lineitem
JOIN (SELECT l_returnflag, l_linestatus, year(l_shipdate) AS y, count(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY ALL) d
ON lineitem.l_returnflag = d.l_returnflag AND lineitem.l_linestatus = d.l_linestatus AND year(l_shipdate) = d.y""")
def ndistinct(t):
    rows = t.lineitem.withColumn("y", F.year("l_shipdate"))
    return agg.group_distinct(rows, ["l_returnflag", "l_linestatus", "y"], "l_suppkey", "n_supp").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_supp")


@case("q_weighted_mean", """
SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice / 9973 * l_quantity) / sum(l_quantity), 6) + 0.0 AS wmean
FROM lineitem GROUP BY 1, 2""")
def weighted_mean(t):
    return t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(
        r(nulls.weighted_mean(F.col("l_extendedprice") / 9973, "l_quantity")).alias("wmean"))


@case("q_ratio", """
SELECT o_custkey, count(*)::BIGINT AS tot, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS done,
  round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 6) + 0.0 AS pct FROM orders GROUP BY 1""")
def ratio(t):
    sums = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("tot"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return sums.withColumn("pct", r(agg.ratio_percent("done", "tot")))


@case("q_dup_keys", """
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_keys(t):
    return agg.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@case("q_group_diff", """
WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2)
SELECT * FROM (SELECT *, n - lag(n) OVER (PARTITION BY o_orderpriority ORDER BY year) AS diff FROM y) WHERE diff IS NOT NULL""")
def group_diff(t):
    yearly = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return agg.group_difference(yearly, ["o_orderpriority"], "year", "n")


@case("q_two_stage_mean", """
WITH y AS (SELECT n_name, r_name, year(o_orderdate) AS y, sum(l_extendedprice) AS price, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3)
SELECT n_name, r_name, round(avg(price), 4) + 0.0 AS mean_yearly, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_years
FROM y GROUP BY 1, 2""")
def two_stage_mean(t):
    sites = joins.null_safe_join(t.nation, t.region, {"n_regionkey": "r_regionkey"}, "inner")
    dated = t.orders.where(dates.within_years("o_orderdate", 1996, 2000))
    # Lines are summed per order before any join, so only one row per order is shuffled onwards.
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))
    rows = per_order.join(dated.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")),
                          F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    yearly = rows.groupBy("c_nationkey", "year").agg(F.sum("price").alias("price"), F.sum("n").alias("n"))
    means = yearly.groupBy("c_nationkey").agg(r(F.avg("price"), 4).alias("mean_yearly"), F.sum("n").alias("n_lines"),
                                              F.count(F.lit(1)).alias("n_years"))
    return joins.null_safe_join(means, sites, {"c_nationkey": "n_nationkey"}, "inner").select(
        "n_name", "r_name", "mean_yearly", "n_lines", "n_years")


@case("q_distinct_rows", """
SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_discount FROM lineitem""")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey", "l_discount").distinct()


# --- group values on rows, order within groups ----------------------------------------------------


@case("q_window_group", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER w AS sum_q, min(l_quantity) OVER w AS min_q,
  max(l_quantity) OVER w AS max_q, round(avg(l_quantity) OVER w, 6) + 0.0 AS mean_q
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_returnflag)""")
def window_group(t):
    return joins.with_group_stats(t.lineitem, ["l_suppkey", "l_returnflag"], {
        "sum_q": F.sum("l_quantity"), "min_q": F.min("l_quantity"), "max_q": F.max("l_quantity"),
        "mean_q": r(F.avg("l_quantity"))}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sum_q", "min_q", "max_q", "mean_q")


@case("q_group_size_filter", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n::BIGINT AS n FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n,
    CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS q FROM lineitem) WHERE NOT (n = 2 AND q IS NULL)""")
def group_size_filter(t):
    sized = agg.group_size(t.lineitem, ["l_orderkey", "l_linenumber"])
    return agg.drop_known_bad(sized, (F.col("n") == 2) & F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).isNull()).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n")


@case("q_keep_groups", """
SELECT o_orderkey, o_custkey FROM orders o WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
  HAVING NOT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) < 3)""")
def keep_groups(t):
    found = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return agg.keep_groups(t.orders, ["o_custkey"], ~(found < 3)).select("o_orderkey", "o_custkey")


@case("q_lag_transition", """
SELECT event_id, user_id, prev_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type FROM events)
WHERE event_type = 'error' AND prev_type = 'click'""")
def lag_transition(t):
    rows = ordered.lag_in_group(t.events, ["user_id"], ["ts", "event_id"], {"prev_type": "event_type"})
    return rows.where("event_type = 'error' and prev_type = 'click'").select("event_id", "user_id", "prev_type")


@case("q_lag_all", """
SELECT event_id, lag(value) OVER w AS prev_value, lag(event_id) OVER w AS prev_id FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def lag_all(t):
    return ordered.lag_in_group(t.events, ["event_type"], ["ts", "event_id"],
                                {"prev_value": "value", "prev_id": "event_id"}).select(
        "event_id", "prev_value", "prev_id")


@case("q_first_last_row", """
SELECT f.user_id, f.event_id AS first_id, f.value AS first_value, l.event_id AS last_id, l.event_type AS last_type FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i = 1) f
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
      WHERE i = 1) l ON f.user_id = l.user_id""")
def first_last_row(t):
    rows = t.events.select("user_id", "ts", "event_id", "value", "event_type")
    first = ordered.first_row(rows, ["user_id"], ["ts", "event_id"]).select(
        "user_id", F.col("event_id").alias("first_id"), F.col("value").alias("first_value"))
    last = ordered.last_row(rows, ["user_id"], ["ts", "event_id"]).select(
        "user_id", F.col("event_id").alias("last_id"), F.col("event_type").alias("last_type"))
    return joins.null_safe_join(first, last, ["user_id"], "inner")


@case("q_fill_first_last", """
WITH e AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE value END AS v FROM events),
f AS (SELECT user_id, arg_min(v, (ts, event_id)) AS fv FROM e WHERE v IS NOT NULL GROUP BY 1),
l AS (SELECT user_id, arg_max(v, (ts, event_id)) AS lv, FROM e WHERE v IS NOT NULL GROUP BY 1)
SELECT event_id, coalesce(v, fv, lv) AS filled, lv AS last_known FROM e LEFT JOIN f USING (user_id) LEFT JOIN l USING (user_id)""")
def fill_first_last(t):
    rows = t.events.withColumn("v", F.when(~F.col("event_type").isin("click", "view"), F.col("value")))
    order = ["ts", "event_id"]
    known = joins.with_group_stats(rows, ["user_id"], {"fv": ordered.first_value("v", order, skip_missing=True),
                                                       "lv": ordered.last_value("v", order, skip_missing=True)})
    return known.select("event_id", F.coalesce("v", "fv", "lv").alias("filled"), F.col("lv").alias("last_known"))


@case("q_last_equal", """
SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, event_type, max(ts::DATE) AS d FROM events GROUP BY 1, 2) m
ON e.user_id = m.user_id AND e.event_type = m.event_type AND e.ts::DATE = m.d""")
def last_equal(t):
    rows = joins.with_group_stats(t.events, ["user_id", "event_type"], {"last_day": F.max(F.to_date("ts"))})
    return rows.where(F.to_date("ts") == F.col("last_day")).select("event_id", "user_id")


@case("q_dedupe_slice", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT (year(o_orderdate) = 1998 AND o_orderstatus = 'F')
UNION ALL
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i
  FROM orders WHERE year(o_orderdate) = 1998 AND o_orderstatus = 'F') WHERE i = 1""")
def dedupe_slice(t):
    scope = (F.year("o_orderdate") == 1998) & (F.col("o_orderstatus") == "F")
    return agg.first_within(t.orders, scope, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "o_custkey")


@case("q_running_sum", """
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS so_far
FROM events""")
def running_sum(t):
    return ordered.running_sum(t.events, ["event_type"], ["ts", "event_id"], {"total": "value"}).select(
        "event_id", r("total", 2).alias("so_far"))


@case("q_union_by_name", """
SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment, NULL::VARCHAR AS label FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL, s_name FROM supplier""")
def union_by_name(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"),
                          F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"),
                          F.col("s_name").alias("label"))
    return agg.bind_rows(a, b)


# --- scalar functions -------------------------------------------------------------------------------


@case("q_string_fns", """
SELECT p_partkey, p_type || '_' || coalesce(nullif(p_brand, 'Brand#4'), 'NA') AS pasted, substr(p_name, 2, 3) AS mid,
  replace(p_name, 'e', '3') AS all_e, regexp_replace(p_name, 'e', '3') AS first_e, trim('  ' || p_name || ' ') AS trimmed,
  split_part(p_name, ' ', 1) AS head, try_cast(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_no,
  try_cast(p_brand AS DOUBLE) AS not_a_number,
  coalesce(CASE WHEN p_size > 30 THEN p_size END, CASE WHEN p_size > 20 THEN -p_size END, 0) AS first_known,
  p_size + CASE WHEN p_size > 10 THEN p_size END AS strict_sum, p_size + coalesce(CASE WHEN p_size > 10 THEN p_size END, 0) AS skip_sum,
  round_even(p_retailprice / 4, 1) + 0.0 AS half_even, floor(p_retailprice)::BIGINT AS whole, p_retailprice * p_retailprice AS squared
FROM part""")
def string_fns(t):
    large = F.when(F.col("p_size") > 10, F.col("p_size"))
    return t.part.select(
        "p_partkey", nulls.paste(F.col("p_type"), F.nullif(F.col("p_brand"), F.lit("Brand#4")), sep="_").alias("pasted"),
        text.substr("p_name", 2, 4).alias("mid"), text.replace_all("p_name", "e", "3").alias("all_e"),
        text.replace_first("p_name", "e", "3").alias("first_e"),
        text.strip(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("trimmed"),
        text.before_first("p_name", " ").alias("head"), nulls.to_number(text.piece("p_brand", "#", 2)).alias("brand_no"),
        nulls.to_number("p_brand").alias("not_a_number"),
        nulls.first_present([F.when(F.col("p_size") > 30, F.col("p_size")), F.when(F.col("p_size") > 20, -F.col("p_size")),
                             F.lit(0)]).alias("first_known"),
        nulls.row_sum(["p_size", large]).alias("strict_sum"),
        nulls.row_sum(["p_size", large], skip_missing=True).alias("skip_sum"),
        (F.bround(F.col("p_retailprice") / 4, 1) + F.lit(0.0)).alias("half_even"),
        F.floor("p_retailprice").alias("whole"), (F.col("p_retailprice") * F.col("p_retailprice")).alias("squared"))


@case("q_date_fns", """
SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d,
  dayofyear(o_orderdate)::INT AS doy, hour(o_orderdate)::INT AS h, strftime(o_orderdate, '%Y-%m') AS ym,
  strftime(DATE '2018-01-01' + (dayofyear(o_orderdate) - 1)::INT, '%Y-%m-%d') AS norm_day,
  strftime(o_orderdate::DATE + 29, '%Y-%m-%d') AS plus29,
  CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN '2' WHEN month(o_orderdate) BETWEEN 6 AND 7 THEN 'early'
       WHEN month(o_orderdate) BETWEEN 8 AND 11 THEN 'late' ELSE '1' END AS season,
  CASE WHEN month(o_orderdate) IN (6, 7) THEN 'spr' WHEN month(o_orderdate) IN (8, 9) THEN 'aut' END AS phase,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start FROM orders""")
def date_fns(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.dayofyear(d).alias("doy"),
        F.hour(d).alias("h"), dates.month_key(d).alias("ym"),
        day_text(dates.day_number_to_date(F.dayofyear(d) - 1, "2018-01-01")).alias("norm_day"),
        day_text(F.date_add(F.to_date(d), 29)).alias("plus29"), dates.season_of_month(F.month(d)).alias("season"),
        dates.phase_of_month(F.month(d), "spr", "aut").alias("phase"),
        day_text(dates.month_start(F.year(d), F.month(d))).alias("month_start"))


@case("q_parse_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dmy, strftime(o_orderdate, '%Y-%m-%d') AS ymd,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS my, NULL::VARCHAR AS bad,
  2000 + CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) - 2000 ELSE year(o_orderdate) - 1900 END AS code_year
FROM orders""")
def parse_dates(t):
    d = F.col("o_orderdate")
    code = F.concat(F.lit("aut_"), F.substring(F.date_format(d, "yyyy"), 3, 2))
    return t.orders.select(
        "o_orderkey", day_text(dates.parse_day_month_year(F.date_format(d, "d.M.yyyy"))).alias("dmy"),
        day_text(dates.parse_year_month_day(F.date_format(d, "yyyy/M/d"))).alias("ymd"),
        day_text(dates.parse_month_year(F.date_format(d, "M-yyyy"))).alias("my"),
        day_text(dates.parse_day_month_year(F.date_format(d, "d/Myyyy"))).alias("bad"),
        dates.year_of_code(code).cast("bigint").alias("code_year"))


@case("q_months_between", """
SELECT o_custkey, ((year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)))::DOUBLE
  AS months FROM orders GROUP BY 1""")
def months_between(t):
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return t.orders.groupBy("o_custkey").agg(dates.months_from(F.min(month), F.max(month)).alias("months"))


@case("q_audit", """
WITH l AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN -1 - o_custkey ELSE o_custkey END AS k, count(*) AS nl FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS k, count(*) AS nr FROM customer GROUP BY 1),
j AS (SELECT coalesce(nl, 0) AS a, coalesce(nr, 0) AS b FROM l FULL JOIN r ON l.k = r.k)
SELECT sum(a)::BIGINT AS rows_left, sum(b)::BIGINT AS rows_right, sum(CASE WHEN b > 0 THEN a ELSE 0 END)::BIGINT AS matched_left,
  sum(CASE WHEN b = 0 THEN a ELSE 0 END)::BIGINT AS unmatched_left, sum(CASE WHEN a = 0 THEN b ELSE 0 END)::BIGINT AS unmatched_right,
  count(*) FILTER (WHERE b > 1)::BIGINT AS repeated_right_keys, sum(a * greatest(b, 1))::BIGINT AS rows_left_join FROM j""")
def audit_join(t):
    left = t.orders.select(F.when(F.col("o_orderpriority") == "1-URGENT", -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("k"))
    right = t.customer.select(F.col("c_custkey").alias("k"))
    return audit.join_audit(left, right, ["k"])


@case("q_sorted", """
SELECT event_id, row_number() OVER (ORDER BY v NULLS LAST, event_id)::BIGINT AS position FROM (
  SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS v FROM events)""")
def sorted_rows(t):
    v = F.when(F.col("event_type") != "click", F.col("value"))
    return ordered.sort_position(t.events.select("event_id", v.alias("v")), "v", "event_id").select("event_id", "position")
