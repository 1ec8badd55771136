"""Presence histories and survival. A user stands in for a seedling, five days for a census."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import ROMAN_BLOCKS, lookup
from ..functions.nulls import sum_strict
from ..operators import census, joins, reshape, survival
from ..plans import datasets
from .registry import big, case, day_text, r

SIX = ["c1", "c2", "c3", "c4", "c5", "c6"]
CENSUS_DAYS = 5

PRESENCE_SQL = """
p AS (SELECT user_id, least(6, (day(ts) - 1) // 5 + 1) AS census,
    max(CASE WHEN event_type = 'purchase' AND value > 60 THEN 1 ELSE 0 END)::DOUBLE AS present FROM events GROUP BY ALL),
h AS (SELECT user_id, coalesce(max(present) FILTER (WHERE census = 1), 0) AS c1, coalesce(max(present) FILTER (WHERE census = 2), 0) AS c2,
    coalesce(max(present) FILTER (WHERE census = 3), 0) AS c3, coalesce(max(present) FILTER (WHERE census = 4), 0) AS c4,
    coalesce(max(present) FILTER (WHERE census = 5), 0) AS c5, coalesce(max(present) FILTER (WHERE census = 6), 0) AS c6
  FROM p GROUP BY 1)"""

FILL_SQL = """
f1 AS (SELECT * REPLACE (CASE WHEN c1 = 1 AND c2 = 0 AND c4 = 1 THEN 1 ELSE c2 END AS c2) FROM h),
f2 AS (SELECT * REPLACE (CASE WHEN c2 = 1 AND c3 = 0 AND c5 = 1 THEN 1 ELSE c3 END AS c3) FROM f1),
f3 AS (SELECT * REPLACE (CASE WHEN c3 = 1 AND c4 = 0 AND c6 = 1 THEN 1 ELSE c4 END AS c4) FROM f2),
f4 AS (SELECT * REPLACE (CASE WHEN c1 = 1 AND c2 = 0 AND c3 = 1 THEN 1 ELSE c2 END AS c2) FROM f3),
f5 AS (SELECT * REPLACE (CASE WHEN c2 = 1 AND c3 = 0 AND c4 = 1 THEN 1 ELSE c3 END AS c3) FROM f4),
f6 AS (SELECT * REPLACE (CASE WHEN c3 = 1 AND c4 = 0 AND c5 = 1 THEN 1 ELSE c4 END AS c4) FROM f5),
f AS (SELECT * REPLACE (CASE WHEN c4 = 1 AND c5 = 0 AND c6 = 1 THEN 1 ELSE c5 END AS c5) FROM f6)"""

# Long rows of the filled history, a month per census ending with the last census of the study.
ROWS_SQL = """
w AS (SELECT user_id, unnest([{c: 1, v: c1}, {c: 2, v: c2}, {c: 3, v: c3}, {c: 4, v: c4}, {c: 5, v: c5}, {c: 6, v: c6}]) AS e FROM f),
l AS (SELECT user_id, e.v AS count, make_date(2019, 2 + e.c, 1) AS date FROM w)"""

SPELLS_SQL = """
g AS (SELECT *, lag(count) OVER (PARTITION BY user_id ORDER BY date) AS before FROM l),
s AS (SELECT user_id, min(date) FILTER (WHERE count <> 0) AS a, max(date) FILTER (WHERE count <> 0) AS b,
    max(date) FILTER (WHERE (count = 0 AND before = 1) OR (count = 1 AND date = DATE '2019-08-01')) AS d, sum(count) AS dur
  FROM g GROUP BY 1 HAVING a IS NOT NULL)"""


def census_number():
    return F.least(F.lit(6), F.floor((F.dayofmonth("ts") - 1) / CENSUS_DAYS).cast("int") + 1)


def presence(t):
    seen = (F.col("event_type") == "purchase") & (F.col("value") > 60)
    return t.events.groupBy("user_id", census_number().alias("census")).agg(
        F.max(F.when(seen, 1.0).otherwise(0.0)).alias("present"))


def histories(t):
    wide = census.history(presence(t), ["user_id"], "census", "present", [1, 2, 3, 4, 5, 6])
    return wide.select("user_id", *[F.coalesce(f"`{i}`", F.lit(0.0)).alias(f"c{i}") for i in range(1, 7)])


def history_rows(t):
    filled = census.gap_fill(histories(t), SIX)
    long = reshape.to_long(filled, SIX, "census", "count")
    month = 2 + F.substring("census", 2, 1).cast("int")
    return long.select("user_id", "count", F.make_date(F.lit(2019), month, F.lit(1)).alias("date"))


@case("q_first_occurrence", "WITH" + PRESENCE_SQL + """
SELECT user_id, CASE WHEN c1 > 0 THEN 'c1' WHEN c2 > 0 THEN 'c2' WHEN c3 > 0 THEN 'c3' WHEN c4 > 0 THEN 'c4' WHEN c5 > 0 THEN 'c5'
  WHEN c6 > 0 THEN 'c6' END AS first_occurrence, c1 + c2 + c3 + c4 + c5 + c6 AS survival_duration FROM h""")
def first_occurrence(t):
    return histories(t).select("user_id", census.first_occurrence(SIX).alias("first_occurrence"),
                               (F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4") + F.col("c5") + F.col("c6")).alias("survival_duration"))


@case("q_first_occurrence_long", """
SELECT user_id, event_type, min(day(ts)) FILTER (WHERE value > 100)::INT AS first_census, count(*) FILTER (WHERE value > 100)::BIGINT AS n_seen
FROM events GROUP BY 1, 2""")
def first_occurrence_long(t):
    rows = t.events.select("user_id", "event_type", F.dayofmonth("ts").alias("day"), (F.col("value") > 100).cast("int").alias("present"))
    return census.first_occurrence_long(rows, ["user_id", "event_type"], "day", "present")


@case("q_resurrect", """
WITH p AS (SELECT user_id, least(6, (day(ts) - 1) // 5 + 1) AS census, bool_or(event_type = 'purchase' AND value > 60) AS s,
    bool_or(event_type = 'signup' AND value > 120) AS d, bool_or(event_type = 'error' AND value > 120) AS t FROM events GROUP BY ALL),
k AS (SELECT user_id, census, CASE WHEN s THEN 'S' WHEN d THEN 'D' WHEN t THEN 'T' ELSE '0' END AS code FROM p),
h AS (SELECT user_id, coalesce(max(code) FILTER (WHERE census = 1), '0') AS c1, coalesce(max(code) FILTER (WHERE census = 2), '0') AS c2,
    coalesce(max(code) FILTER (WHERE census = 3), '0') AS c3, coalesce(max(code) FILTER (WHERE census = 4), '0') AS c4,
    coalesce(max(code) FILTER (WHERE census = 5), '0') AS c5, coalesce(max(code) FILTER (WHERE census = 6), '0') AS c6 FROM k GROUP BY 1),
r5 AS (SELECT * REPLACE (CASE WHEN c5 = '0' AND c6 IN ('T', 'D') THEN 'S' ELSE c5 END AS c5) FROM h),
r4 AS (SELECT * REPLACE (CASE WHEN c4 = '0' AND c5 IN ('T', 'D') THEN 'S' ELSE c4 END AS c4) FROM r5),
r3 AS (SELECT * REPLACE (CASE WHEN c3 = '0' AND c4 IN ('T', 'D') THEN 'S' ELSE c3 END AS c3) FROM r4)
SELECT * REPLACE (CASE WHEN c2 = '0' AND c3 IN ('T', 'D') THEN 'S' ELSE c2 END AS c2) FROM r3""")
def resurrect(t):
    def seen(kind, level):
        return F.max((F.col("event_type") == kind) & (F.col("value") > level))
    codes = t.events.groupBy("user_id", census_number().alias("census")).agg(
        F.when(seen("purchase", 60), "S").when(seen("signup", 120), "D").when(seen("error", 120), "T").otherwise("0").alias("code"))
    wide = census.history(codes, ["user_id"], "census", "code", [1, 2, 3, 4, 5, 6])
    wide = wide.select("user_id", *[F.coalesce(f"`{i}`", F.lit("0")).alias(f"c{i}") for i in range(1, 7)])
    return census.resurrect(wide, SIX)


@case("q_gap_fill", "WITH" + PRESENCE_SQL + "," + FILL_SQL + " SELECT * FROM f")
def gap_fill(t):
    return census.gap_fill(histories(t), SIX)


@case("q_gap_fill_one", "WITH" + PRESENCE_SQL + """,
a AS (SELECT user_id, c1, CASE WHEN c1 = 1 AND c2 = 0 AND c3 = 1 THEN 1 ELSE c2 END AS c2, c3, c4 FROM h)
SELECT * REPLACE (CASE WHEN c2 = 1 AND c3 = 0 AND c4 = 1 THEN 1 ELSE c3 END AS c3) FROM a""")
def gap_fill_one(t):
    return census.gap_fill(histories(t).select("user_id", *SIX[:4]), SIX[:4], two_gap=False)


@case("q_presence_recode", """
WITH e AS (SELECT event_id, substr(CASE WHEN value > 50 THEN upper(event_type) ELSE event_type END, 1, 1) AS k FROM events)
SELECT event_id, CASE WHEN k IN ('s', 'H', 'C', 'E', ' ', '1', 'V') THEN 'S' WHEN k = '?' THEN 'T' ELSE k END AS code FROM e""")
def presence_recode(t):
    text = F.when(F.col("value") > 50, F.upper("event_type")).otherwise(F.col("event_type"))
    return t.events.select("event_id", census.presence_code(text).alias("code"))


@case("q_presence_number", """
WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'NF' WHEN 'P' THEN '1?' ELSE
  CASE WHEN o_totalprice > 100000 THEN (o_orderkey % 30)::VARCHAR END END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v = 'NF' OR v IS NULL THEN 0.0 WHEN v = '1?' THEN 1.0 ELSE try_cast(v AS DOUBLE) END AS presence FROM o""")
def presence_number(t):
    note = F.when(F.col("o_orderstatus") == "F", "NF").when(F.col("o_orderstatus") == "P", "1?").when(
        F.col("o_totalprice") > 100000, (F.col("o_orderkey") % 30).cast("string"))
    return t.orders.select("o_orderkey", census.presence_number(note).alias("presence"))


@case("q_species_group", """
WITH p AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Poa.pra' WHEN 'LARGE' THEN 'Luz.mul' WHEN 'SMALL' THEN 'G'
    WHEN 'MEDIUM' THEN NULL ELSE p_name END AS a, CASE WHEN p_size > 25 THEN 'Car.big' END AS b FROM part),
q AS (SELECT p_partkey, coalesce(a, b) AS species FROM p)
SELECT p_partkey, species, CASE WHEN species IN ('G', 'Ant.odo', 'Ave.fle') OR regexp_matches(species, 'Agr|Car|Des|Fes|Poa|Luz')
  THEN 'graminoid' ELSE 'forb' END AS functional_group FROM q""")
def species_group(t):
    code = F.when(F.col("p_type") == "PROMO", "Poa.pra").when(F.col("p_type") == "LARGE", "Luz.mul").when(
        F.col("p_type") == "SMALL", "G").when(F.col("p_type") == "MEDIUM", None).otherwise(F.col("p_name"))
    rows = t.part.select("p_partkey", code.alias("species"), F.when(F.col("p_size") > 25, "Car.big").alias("other"))
    rows = census.impute_species(rows, "species", ["other"])
    return rows.select("p_partkey", "species", census.functional_group("species").alias("functional_group"))


@case("q_complete_counts", """
WITH frame AS (SELECT * FROM (SELECT user_id FROM events UNION SELECT -1 - user_id FROM events) CROSS JOIN generate_series(1, 6) AS g(census)),
c AS (SELECT user_id, least(6, (day(ts) - 1) // 5 + 1) AS census, sum(CASE WHEN event_type = 'click' THEN 1 END)::BIGINT AS n
      FROM events GROUP BY ALL)
SELECT user_id, census::INT AS census, coalesce(n, 0)::BIGINT AS sumcount FROM frame LEFT JOIN c USING (user_id, census)""")
def complete_counts(t):
    counts = t.events.select("user_id", census_number().alias("census"), F.when(F.col("event_type") == "click", 1).alias("count"))
    frame = reshape.cross_with(_with_strangers(t.events.select("user_id").distinct()), census=[1, 2, 3, 4, 5, 6])
    return census.complete_counts(counts, frame, ["user_id", "census"], "count").withColumn("sumcount", big("sumcount"))


@case("q_census_dates", """
WITH o AS (SELECT o_orderpriority, o_orderdate, CASE WHEN o_totalprice > 450000 THEN 1 WHEN o_totalprice > 300000 THEN 2
  WHEN o_totalprice > 200000 THEN 3 ELSE 4 END AS i FROM orders)
SELECT o_orderpriority AS site, CASE i WHEN 1 THEN 'spr_18' WHEN 2 THEN 'aut_18' WHEN 3 THEN 'spr_19' ELSE 'aut_19' END AS season,
  strftime(max(o_orderdate), '%Y-%m-%d') AS date FROM o GROUP BY 1, 2""")
def census_dates(t):
    price, text = F.col("o_totalprice"), F.date_format("o_orderdate", "d.M.yyyy")
    raw = t.orders.select(
        F.col("o_orderpriority").alias("siteID"), F.when(price > 450000, text).alias("date1"),
        F.when((price > 300000) & (price <= 450000), text).alias("date2"),
        F.when((price > 200000) & (price <= 300000), text).alias("date3"),
        F.when(price <= 200000, text).otherwise("8/82x019").alias("date4"))
    return census.census_dates(raw).select(F.col("siteID").alias("site"), "season", day_text("date").alias("date"))


@case("q_coded_frame", """
SELECT p.o_orderpriority AS plot, s.season, y.year FROM (SELECT DISTINCT o_orderpriority FROM orders) p
CROSS JOIN (VALUES (2009), (2010), (2011), (2012)) y(year) CROSS JOIN (VALUES ('early'), ('late')) s(season)
WHERE NOT (year = 2009 AND season = 'early') AND NOT (year = 2012 AND season = 'late')""")
def coded_frame(t):
    return census.coded_frame(t.orders.select(F.col("o_orderpriority").alias("plot")), ["plot"])


@case("q_treatment_class", """
SELECT p_partkey, CASE WHEN plot LIKE '%C%' THEN 'Intact' ELSE 'Gap' END AS treatment
FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type || 'FGB' ELSE p_type END AS plot FROM part)
WHERE plot LIKE '%C%' OR plot LIKE '%FGB%'""")
def treatment_class(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.concat("p_type", F.lit("FGB"))).otherwise(F.col("p_type")).alias("plot"))
    return census.with_treatment_class(rows, "plot").select("p_partkey", "treatment")


@case("q_roman_blocks", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 4 END AS block FROM customer""")
def roman_blocks(t):
    numeral = F.when(F.col("c_mktsegment") == "BUILDING", "I").when(F.col("c_mktsegment") == "MACHINERY", "IV").otherwise("XX")
    return t.customer.select("c_custkey", lookup(numeral, ROMAN_BLOCKS).alias("block"))


# --- survival -------------------------------------------------------------------------------------


@case("q_survival_table", "WITH" + PRESENCE_SQL + "," + FILL_SQL + "," + ROWS_SQL + """
SELECT user_id, strftime(date, '%Y-%m-%d') AS date, count, CASE WHEN count = 1 AND date = DATE '2019-08-01' THEN 'right' ELSE 'interval' END
  AS censor, sum(count) OVER (PARTITION BY user_id) AS survival_duration FROM l""")
def survival_table(t):
    rows = survival.survival_rows(history_rows(t), ["user_id"])
    return rows.select("user_id", day_text("date").alias("date"), "count", "censor", "survival_duration")


@case("q_time_to_event", "WITH" + PRESENCE_SQL + "," + FILL_SQL + "," + ROWS_SQL + "," + SPELLS_SQL + """
SELECT user_id, strftime(a, '%Y-%m-%d') AS date_first, strftime(b, '%Y-%m-%d') AS date_last, strftime(d, '%Y-%m-%d') AS date_dead,
  dur AS survival_duration, (month(b) - month(a))::DOUBLE AS months_til_alive, (month(d) - month(a))::DOUBLE AS months_til_dead FROM s""")
def time_to_event(t):
    out = survival.spells(history_rows(t), ["user_id"], "date", "count")
    return out.select("user_id", *[day_text(c).alias(c) for c in ("date_first", "date_last", "date_dead")],
                      "survival_duration", "months_til_alive", "months_til_dead")


@case("q_event_long", "WITH" + PRESENCE_SQL + "," + FILL_SQL + "," + ROWS_SQL + "," + SPELLS_SQL + """,
v AS (SELECT user_id, make_date(2019, 2 + least(6, (day(ts) - 1) // 5 + 1)::INT, 1) AS date, max(value) AS top FROM events GROUP BY ALL),
o AS (SELECT user_id, 'first' AS occurrence, a AS date, month(b) - month(a) AS alive, month(d) - month(a) AS dead FROM s
  UNION ALL SELECT user_id, 'last', b, month(b) - month(a), month(d) - month(a) FROM s)
SELECT o.user_id, occurrence, strftime(o.date, '%Y-%m-%d') AS date, top, alive::DOUBLE AS months_til_alive, dead::DOUBLE AS months_til_dead
FROM o LEFT JOIN v ON o.user_id = v.user_id AND o.date = v.date WHERE alive <= dead""")
def event_long(t):
    month = F.make_date(F.lit(2019), 2 + census_number(), F.lit(1))
    tops = t.events.groupBy("user_id", month.alias("date")).agg(F.max("value").alias("top"))
    rows = joins.null_safe_join(history_rows(t), tops, ["user_id", "date"], "left")
    return survival.event_rows(rows, ["user_id"], ["top"]).select(
        "user_id", "occurrence", day_text("date").alias("date"), "top", "months_til_alive", "months_til_dead")


# Both studies: the histories as they are, and again under other ids, 85 months earlier, ending with the other last census.
STUDIES_SQL = "WITH" + PRESENCE_SQL + "," + FILL_SQL + "," + ROWS_SQL + """,
cl AS (SELECT o_custkey % 12 AS "siteID", month(o_orderdate) AS m, max(o_totalprice) AS spei FROM orders GROUP BY ALL),
st AS (SELECT user_id AS id, date, count, 'numbered' AS study FROM l UNION ALL SELECT -1 - user_id, (date - INTERVAL 85 MONTH)::DATE, count, 'coded' FROM l),
sr AS (SELECT id, study, st.date, count, CASE WHEN count = 1 AND date IN (DATE '2012-07-01', DATE '2019-08-01') THEN 'right' ELSE 'interval' END AS censor,
    sum(count) OVER (PARTITION BY id) AS survival_duration, spei FROM st LEFT JOIN cl ON cl."siteID" = abs(id) % 12 AND cl.m = month(date))"""


def _studies(t):
    site = (F.abs("user_id") % 12).alias("siteID")
    numbered = history_rows(t)
    coded = numbered.select((-1 - F.col("user_id")).alias("user_id"), F.add_months("date", -85).alias("date"), "count")
    climate = t.orders.groupBy((F.col("o_custkey") % 12).alias("siteID"), F.month("o_orderdate").alias("m")).agg(F.max("o_totalprice").alias("spei"))
    climate = reshape.cross_with(climate, year=[2012, 2019]).select("siteID", F.make_date("year", "m", F.lit(1)).alias("date"), "spei")
    parts = {name: rows.select("*", site) for name, rows in (("numbered", numbered), ("coded", coded))}
    return datasets.survival_dataset(parts, ["user_id"], climate)


@case("q_survival_dataset", STUDIES_SQL + """
SELECT id, study, strftime(date, '%Y-%m-%d') AS date, count, censor, survival_duration, round(spei, 4) + 0.0 AS spei FROM sr""")
def survival_dataset(t):
    return _studies(t).select(F.col("user_id").alias("id"), "study", day_text("date").alias("date"), "count", "censor", "survival_duration", r("spei", 4).alias("spei"))


@case("q_survival_events", STUDIES_SQL + """,
g AS (SELECT *, lag(count) OVER (PARTITION BY id ORDER BY date) AS before FROM sr),
s AS (SELECT id, min(date) FILTER (WHERE count <> 0) AS a, max(date) FILTER (WHERE count <> 0) AS b,
    max(date) FILTER (WHERE (count = 0 AND before = 1) OR (count = 1 AND date IN (DATE '2012-07-01', DATE '2019-08-01'))) AS d FROM g GROUP BY 1 HAVING a IS NOT NULL),
o AS (SELECT id, 'first' AS occurrence, a AS date, a, b, d FROM s UNION ALL SELECT id, 'last', b, a, b, d FROM s)
SELECT o.id, occurrence, strftime(o.date, '%Y-%m-%d') AS date, study, round(spei, 4) + 0.0 AS spei, ((year(b) - year(a)) * 12 + month(b) - month(a))::DOUBLE AS months_til_alive,
  ((year(d) - year(a)) * 12 + month(d) - month(a))::DOUBLE AS months_til_dead FROM o JOIN sr ON o.id = sr.id AND o.date = sr.date WHERE b <= d""")
def survival_events(t):
    out = datasets.survival_events(_studies(t), ["user_id"], ["study", "spei"])
    return out.select(F.col("user_id").alias("id"), "occurrence", day_text("date").alias("date"), "study", r("spei", 4).alias("spei"), "months_til_alive", "months_til_dead")


def _with_strangers(frame):
    """The keys and as many that no record has."""
    return frame.unionByName(frame.withColumn("user_id", -1 - F.col("user_id")))


@case("q_survival_pct", """
WITH e AS (SELECT user_id, event_type, CASE WHEN value > 40 THEN 1 ELSE 0 END AS s FROM events),
c AS (SELECT user_id, event_type, count(*) AS tot, sum(s) AS tots, sum(s)::DOUBLE / count(*) * 100 AS survival FROM e GROUP BY 1, 2)
SELECT f.user_id, f.event_type, coalesce(tot, 0)::BIGINT AS tot, coalesce(tots, 0)::BIGINT AS "totS", round(coalesce(survival, 0), 6) + 0.0 AS survival
FROM (SELECT user_id, event_type FROM events UNION SELECT -1 - user_id, event_type FROM events) f LEFT JOIN c ON f.user_id = c.user_id AND f.event_type = c.event_type""")
def survival_pct(t):
    state = F.when(F.col("value") > 200, "1").when(F.col("value") > 40, "alive").when(F.col("value") > 20, "dezd").otherwise("not found")
    rows = t.events.select("user_id", "event_type", state.alias("survival"))
    frame = _with_strangers(t.events.select("user_id", "event_type").distinct())
    out = survival.survival_percent(rows, frame, ["user_id", "event_type"])
    return out.select("user_id", "event_type", big("tot").alias("tot"), big("totS").alias("totS"), r("survival").alias("survival"))


@case("q_interval_curve", """
WITH y AS (SELECT c_mktsegment AS g, c_custkey, max(year(o_orderdate)) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT g, last, count(*) AS n FROM y GROUP BY ALL),
top AS (SELECT max(last) AS top FROM y),
s AS (SELECT g, last, n, sum(n) OVER (PARTITION BY g ORDER BY last DESC) AS at_risk, sum(n) OVER (PARTITION BY g) AS total FROM k, top)
SELECT g AS segment, last::DOUBLE AS "start", CASE WHEN last < top THEN last + 1.0::DOUBLE END AS "end", round(n / total, 7) + 0.0 AS mass, round((at_risk - n) / total, 7) + 0.0 AS survival,
  total::BIGINT AS n FROM s, top""")
def interval_curve(t):
    # A customer is alive in the last year with an order and dead in the one after, unless the table ends there.
    top = t.orders.agg(F.max(F.year("o_orderdate"))).scalar()
    last = t.orders.groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("alive")).withColumn("top", top)
    rows = last.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("segment"), "alive", F.when(F.col("alive") < F.col("top"), F.col("alive") + 1).alias("dead"))
    out = survival.interval_survival(rows, ["segment"], "alive", "dead")
    return out.select("segment", "start", "end", r("mass", 7).alias("mass"), r("survival", 7).alias("survival"), "n")


# --- analysis tables -----------------------------------------------------------------------------


@case("q_key_frame", """
WITH k AS (SELECT DISTINCT user_id, event_type, least(6, (day(ts) - 1) // 5 + 1)::INT AS census FROM events),
f AS (SELECT user_id, g.census::INT AS census FROM (SELECT user_id FROM events UNION SELECT -1 - user_id FROM events) CROSS JOIN generate_series(1, 6) AS g(census))
SELECT coalesce(k.user_id, f.user_id) AS user_id, event_type, coalesce(k.census, f.census) AS census
FROM k FULL JOIN f ON k.user_id = f.user_id AND k.census = f.census""")
def key_frame(t):
    records = t.events.withColumn("census", census_number())
    frame = reshape.cross_with(_with_strangers(t.events.select("user_id").distinct()), census=[1, 2, 3, 4, 5, 6])
    return datasets.plot_frame(records, frame, ["user_id", "event_type", "census"]).select("user_id", "event_type", "census")


@case("q_abundance", """
WITH k AS (SELECT DISTINCT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type)::BIGINT AS n FROM events)
SELECT f.user_id, f.event_type, n FROM (SELECT user_id, event_type FROM events UNION SELECT -1 - user_id, event_type FROM events) f
LEFT JOIN k ON f.user_id = k.user_id AND f.event_type = k.event_type""")
def abundance(t):
    records = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    frame = _with_strangers(t.events.select("user_id", "event_type").distinct())
    return datasets.abundance(records, frame, ["user_id", "event_type", "n"])


@case("q_group_subset", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q AS annual_count, round(q / 0.25, 6) + 0.0 AS annual_count_scaled
FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey, year(l_shipdate)) AS q FROM lineitem)
WHERE l_returnflag = 'R' AND year(l_shipdate) >= 1997""")
def group_subset(t):
    rows = t.lineitem.withColumn("year", F.year("l_shipdate"))
    keep = (F.col("l_returnflag") == "R") & (F.col("year") >= 1997)
    return datasets.group_subset(rows, ["l_orderkey", "year"], "l_quantity", 0.25, keep).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "annual_count", r("annual_count_scaled").alias("annual_count_scaled"))


@case("q_analysis_table", """
WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS month,
    count(*) OVER (PARTITION BY o_custkey, o_orderpriority, year(o_orderdate), month(o_orderdate)) AS sumcount FROM orders),
m AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY ALL),
j AS (SELECT d.*, price, c_acctbal FROM d LEFT JOIN m USING (year, month) LEFT JOIN customer ON d.o_custkey = c_custkey WHERE sumcount < 3)
SELECT o_custkey, o_orderpriority, year, month, sumcount::BIGINT AS sumcount, round(price / 100 - avg(price / 100) OVER (), 4) + 0.0 AS sprice,
  round(c_acctbal - avg(c_acctbal) OVER (), 4) + 0.0 AS sbal, year - 1994 AS year1 FROM j""")
def analysis_table(t):
    dated = t.orders.select("o_custkey", "o_orderpriority", F.year("o_orderdate").cast("bigint").alias("year"),
                            F.month("o_orderdate").cast("bigint").alias("month"), "o_totalprice")
    counts = dated.groupBy("o_custkey", "o_orderpriority", "year", "month").agg(F.count(F.lit(1)).alias("sumcount"))
    drought = dated.groupBy("year", "month").agg(F.round(F.avg("o_totalprice"), 2).alias("price")).withColumn("season", F.lit("x"))
    weather = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    out = datasets.analysis_table(counts, drought, weather, {"sprice": "price", "sbal": "c_acctbal"}, {"price": 100}, 3, 1994)
    return out.select("o_custkey", "o_orderpriority", "year", "month", "sumcount", r("sprice", 4).alias("sprice"),
                      r("sbal", 4).alias("sbal"), "year1")


@case("q_fill_month", """
WITH e AS (SELECT event_id, event_type, user_id, CASE WHEN event_type IN ('click', 'view') THEN 'early' ELSE 'late' END AS season,
    CASE WHEN value > 30 THEN day(ts)::INT END AS month FROM events),
a AS (SELECT *, CASE WHEN season = 'early' THEN 7 ELSE month END AS m FROM e),
k AS (SELECT user_id, event_type, arg_min(m, event_id) AS f FROM a WHERE m IS NOT NULL GROUP BY ALL)
SELECT event_id, coalesce(m, f) AS month FROM a LEFT JOIN k ON a.user_id = k.user_id AND a.event_type = k.event_type""")
def fill_month(t):
    season = F.when(F.col("event_type").isin("click", "view"), "early").otherwise("late")
    rows = t.events.select("event_id", "event_type", "user_id", season.alias("season"), F.when(F.col("value") > 30, F.dayofmonth("ts")).alias("month"))
    return datasets.fill_month(rows, ["user_id", "event_type"], ["event_id"]).select("event_id", "month")


@case("q_plot_totals", """
SELECT DISTINCT o_custkey, year(o_orderdate) AS year, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey,
  year(o_orderdate))::BIGINT AS total, sum(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate))::BIGINT AS keysum FROM orders""")
def plot_totals(t):
    rows = t.orders.withColumn("year", F.year("o_orderdate").cast("bigint"))
    out = joins.with_group_stats(rows, ["o_custkey", "year"], {
        "total": sum_strict(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), "keysum": F.sum("o_orderkey")})
    return out.select("o_custkey", "year", "total", "keysum").distinct()


@case("q_row_coalesce", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'size' WHEN p_retailprice > 1000 THEN 'price' WHEN p_type = 'PROMO' THEN 'promo' END AS species FROM part""")
def row_coalesce(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 40, 1).alias("size"), F.when(F.col("p_retailprice") > 1000, 1).alias("price"),
                         F.when(F.col("p_type") == "PROMO", 1).alias("promo"))
    return rows.select("p_partkey", census.species_of_indicators(rows, ["size", "price", "promo"]).alias("species"))


@case("q_plots_with_records", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
  HAVING sum(CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END) >= 1)""")
def plots_with_records(t):
    rows = t.orders.withColumn("found", F.when(F.col("o_totalprice") > 480000, 1).otherwise(0))
    return datasets.plots_with_records(rows, ["o_custkey"], "found").select("o_orderkey", "o_custkey")
