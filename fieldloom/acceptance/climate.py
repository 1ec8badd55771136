"""Climate operators. A nation or an order priority stands in for a site, prices for readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import phase_of_month, season_of_month
from ..operators import climate, joins
from .registry import big, case, day_text, r

# --- SQL building blocks ----------------------------------------------------------------------

NATION_ORDERS = """
no AS (SELECT n_name AS "siteID", n_nationkey, r_name AS zone, o_orderdate::DATE AS date, o_orderkey, o_orderstatus,
         o_orderpriority, o_totalprice / 9973 AS value
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""

PET_SQL = """0.0023 * 0.408 * (37.6 * (1 + 0.033 * cos(turn)) * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)))
  * ((tmin + tmax) / 2 + 17.8) * sqrt(greatest(tmax - tmin, 0)) * day(last_day(make_date(year::INT, month::INT, 1)))"""


def pet_ctes(source: str, name: str) -> str:
    """CTEs that add ``pet`` to ``source`` (siteID, year, month, tmin, tmax, lat)."""
    return f"""
{name}_1 AS (SELECT *, radians(lat) AS phi,
    2 * pi() / 365 * [15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349][month] AS turn FROM {source}),
{name}_2 AS (SELECT *, 0.409 * sin(turn - 1.39) AS dec FROM {name}_1),
{name}_3 AS (SELECT *, acos(greatest(-1, least(1, -tan(phi) * tan(dec)))) AS ws FROM {name}_2),
{name} AS (SELECT "siteID", year, month, {PET_SQL} AS pet FROM {name}_3)"""


def spei_ctes(source: str, name: str, scale: int) -> str:
    """CTEs that add ``{name}`` (siteID, year, month, spei) to a balance series."""
    return f"""
{name}_0 AS (SELECT "siteID", year, month, CASE WHEN count(balance) OVER w = {scale}
    AND year * 12 + month - min(year * 12 + month) OVER w = {scale - 1} THEN sum(balance) OVER w END AS x
  FROM {source} WINDOW w AS (PARTITION BY "siteID" ORDER BY year * 12 + month ROWS {scale - 1} PRECEDING)),
{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY "siteID", month ORDER BY x NULLS LAST, year) - 1 AS i,
    count(x) OVER (PARTITION BY "siteID", month) AS n FROM {name}_0),
{name}_2 AS (SELECT *, avg(x) OVER g AS b0, avg(CASE WHEN n > 1 THEN i::DOUBLE / (n - 1) * x END) OVER g AS b1,
    avg(CASE WHEN n > 2 THEN (i * (i - 1))::DOUBLE / ((n - 1) * (n - 2)) * x END) OVER g AS b2
  FROM {name}_1 WINDOW g AS (PARTITION BY "siteID", month)),
{name}_3 AS (SELECT *, CASE WHEN n >= 4 AND 2 * b1 - b0 > 1e-12 THEN -(6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) END AS k FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN abs(k) < 1e-6 THEN 2 * b1 - b0 ELSE (2 * b1 - b0) * sin(k * pi()) / (k * pi()) END AS a FROM {name}_3),
{name}_5 AS (SELECT *, CASE WHEN abs(k) < 1e-6 THEN b0 ELSE b0 - a * (1 / k - pi() / sin(k * pi())) END AS c FROM {name}_4),
{name}_6 AS (SELECT *, 1 - k * (x - c) / a AS u FROM {name}_5),
{name}_7 AS (SELECT *, CASE WHEN k IS NULL OR x IS NULL THEN NULL
    WHEN abs(k) >= 1e-6 AND u <= 0 THEN CASE WHEN k < 0 THEN 0 ELSE 1 END
    ELSE 1 / (1 + exp(-(CASE WHEN abs(k) < 1e-6 THEN (x - c) / a ELSE -ln(CASE WHEN u > 0 THEN u END) / k END))) END AS f FROM {name}_6),
{name}_8 AS (SELECT *, sqrt(-2 * ln(CASE WHEN f > 0 AND f < 1 THEN least(f, 1 - f) END)) AS w FROM {name}_7),
{name}_9 AS (SELECT *, w - (2.515517 + 0.802853 * w + 0.010328 * w * w)
    / (1 + 1.432788 * w + 0.189269 * w * w + 0.001308 * w * w * w) AS z FROM {name}_8),
{name} AS (SELECT "siteID", year, month, CASE WHEN f <= 0 THEN '-inf'::DOUBLE WHEN f >= 1 THEN 'inf'::DOUBLE
    WHEN f < 0.5 THEN -z ELSE z END AS spei FROM {name}_9)"""


TEMPERATURE_SQL = """
rd AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM no WHERE o_orderpriority IN ('2-HIGH', '5-LOW')
       WINDOW w AS (PARTITION BY "siteID", o_orderpriority, date)),
lg AS (SELECT "siteID", o_orderpriority, year(date) AS year, month(date) AS month, avg(hi) AS hi, avg(lo) AS lo, avg(value) AS me
       FROM rd GROUP BY ALL),
pf AS (SELECT "siteID", year, month,
    coalesce(max(lo) FILTER (WHERE o_orderpriority = '2-HIGH'), max(lo) FILTER (WHERE o_orderpriority = '5-LOW')) AS lo,
    coalesce(max(me) FILTER (WHERE o_orderpriority = '2-HIGH'), max(me) FILTER (WHERE o_orderpriority = '5-LOW')) AS me,
    coalesce(max(hi) FILTER (WHERE o_orderpriority = '2-HIGH'), max(hi) FILTER (WHERE o_orderpriority = '5-LOW')) AS hi
  FROM lg GROUP BY ALL),
cal AS (SELECT * FROM (SELECT DISTINCT "siteID" FROM pf) CROSS JOIN (SELECT DISTINCT year FROM pf) CROSS JOIN (SELECT DISTINCT month FROM pf)),
tmp AS (SELECT "siteID", year, month, coalesce(lo, avg(lo) OVER z) AS temp_min, coalesce(me, avg(me) OVER z) AS temp_mean,
    coalesce(hi, avg(hi) OVER z) AS temp_max
  FROM cal LEFT JOIN pf USING ("siteID", year, month)
  JOIN (SELECT n_name AS "siteID", r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey) USING ("siteID")
  WINDOW z AS (PARTITION BY zone, year, month))"""


# Prices become readings by a prime unit, so that no mean lies halfway between two rounded values.
READING = 9973

# --- stand-in sources -----------------------------------------------------------------------------


def nation_orders(t):
    sites = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("siteID"), F.col("r_name").alias("zone"))
    return (t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(sites, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("siteID", "n_nationkey", "zone", F.to_date("o_orderdate").alias("date"), "o_orderkey",
                    "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / READING).alias("value")))


def site_info(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("siteID"), F.col("r_name").alias("Biogeographic_zone"),
        (58 + F.col("n_nationkey") * F.lit(0.2)).alias("Latitude"))


def readings(t):
    return nation_orders(t).select("siteID", "date", F.col("o_orderpriority").alias("logger"), "value")


def balance_series(t):
    return nation_orders(t).groupBy("siteID", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        (F.sum("value") / 10).alias("balance"))


BALANCE_SQL = NATION_ORDERS + """,
bal AS (SELECT "siteID", year(date) AS year, month(date) AS month, sum(value) / 10 AS balance FROM no GROUP BY ALL)"""


# --- queries -------------------------------------------------------------------------------------


@case("q_monthly_total", """
SELECT o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS month,
  round(CASE WHEN count(p) < count(*) THEN NULL ELSE sum(p) END, 2) + 0.0 AS total
FROM (SELECT *, CASE WHEN o_totalprice < 497000 THEN o_totalprice END AS p FROM orders) GROUP BY 1, 2, 3""")
def monthly_total(t):
    rows = t.orders.withColumn("p", F.when(F.col("o_totalprice") < 497000, F.col("o_totalprice")))
    out = climate.monthly_total(rows, "o_orderpriority", "o_orderdate", "p")
    return out.select("o_orderpriority", big("year").alias("year"), big("month").alias("month"), r("total", 2).alias("total"))


@case("q_monthly_extremes", """
WITH d AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM events
           WINDOW w AS (PARTITION BY user_id, event_type, ts::DATE)),
m AS (SELECT user_id, event_type, year(ts) AS year, month(ts) AS month, avg(hi) AS hi, avg(lo) AS lo, avg(value) AS me FROM d GROUP BY ALL),
p AS (SELECT user_id, year, month,
  coalesce(max(hi) FILTER (WHERE event_type = 'click'), max(hi) FILTER (WHERE event_type = 'view')) AS temp_max,
  coalesce(max(lo) FILTER (WHERE event_type = 'click'), max(lo) FILTER (WHERE event_type = 'view')) AS temp_min,
  coalesce(max(me) FILTER (WHERE event_type = 'click'), max(me) FILTER (WHERE event_type = 'view')) AS temp_mean
  FROM m WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT user_id, year, month, round(temp_max, 7) + 0.0 AS temp_max, round(temp_min, 7) + 0.0 AS temp_min, round(temp_mean, 7) + 0.0 AS temp_mean
FROM p""")
def monthly_extremes(t):
    monthly = climate.monthly_extremes(t.events, ["user_id", "event_type"], "ts", "value")
    out = climate.prefer_sensor(monthly, ["user_id", "year", "month"], "event_type", "click", "view",
                                ["temp_max", "temp_min", "temp_mean"])
    return out.select("user_id", big("year").alias("year"), big("month").alias("month"),
                      *[r(c, 7).alias(c) for c in ("temp_max", "temp_min", "temp_mean")])


def _zone_sql(mean: str) -> str:
    return "WITH" + NATION_ORDERS + f""",
m0 AS (SELECT "siteID", year(date) AS year, month(date) AS month, max(value) AS v FROM no GROUP BY ALL),
m AS (SELECT * REPLACE (CASE WHEN (length("siteID") + year * 12 + month) % 5 = 0 THEN year + 100 ELSE year END AS year) FROM m0),
cal AS (SELECT * FROM (SELECT DISTINCT "siteID" FROM m) CROSS JOIN (SELECT DISTINCT year FROM m) CROSS JOIN (SELECT DISTINCT month FROM m)),
z AS (SELECT "siteID", zone, year, month, v FROM cal LEFT JOIN m USING ("siteID", year, month)
      JOIN (SELECT n_name AS "siteID", r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey) USING ("siteID"))
SELECT "siteID" AS site, year, month, round(coalesce(v, {mean}), 6) + 0.0 AS v FROM z WINDOW w AS (PARTITION BY zone, year, month)"""


def _zone_fill(t, strict):
    monthly = nation_orders(t).groupBy("siteID", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.max("value").alias("v"))
    # Months that move by a century leave gaps to fill where they were, and where the others did not go.
    moved = F.expr("(length(siteID) + year * 12 + month) % 5 = 0")
    monthly = monthly.withColumn("year", F.when(moved, F.col("year") + 100).otherwise(F.col("year")))
    out = climate.fill_from_zone(monthly, site_info(t), "siteID", "Biogeographic_zone", "v", strict)
    return out.select(F.col("siteID").alias("site"), big("year").alias("year"), big("month").alias("month"), r("v").alias("v"))


@case("q_zone_fill", _zone_sql("avg(v) OVER w"))
def zone_fill(t):
    return _zone_fill(t, strict=False)


@case("q_zone_fill_strict", _zone_sql("CASE WHEN count(v) OVER w = count(*) OVER w THEN avg(v) OVER w END"))
def zone_fill_strict(t):
    return _zone_fill(t, strict=True)


@case("q_pet", "WITH" + NATION_ORDERS + """,
s AS (SELECT "siteID", n_nationkey, year(date) AS year, month(date) AS month, min(value) / 5 AS tmin, max(value) / 2 AS tmax,
      58 + n_nationkey * 0.2::DOUBLE AS lat, sum(value) AS precip_sum FROM no GROUP BY ALL),""" + pet_ctes("s", "pet") + """
SELECT "siteID" AS site, year, month, round(pet, 6) + 0.0 AS pet, round(precip_sum - pet, 6) + 0.0 AS balance
FROM s JOIN pet USING ("siteID", year, month)""")
def pet(t):
    monthly = nation_orders(t).groupBy("siteID", "n_nationkey", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        (F.min("value") / 5).alias("tmin"), (F.max("value") / 2).alias("tmax"), F.sum("value").alias("precip_sum"))
    located = monthly.withColumn("lat", 58 + F.col("n_nationkey") * F.lit(0.2))
    evap = located.withColumn("pet", climate.hargreaves("tmin", "tmax", "lat", "year", "month"))
    both = climate.water_balance(monthly.select("siteID", "year", "month", "precip_sum"), evap.select("siteID", "year", "month", "pet"))
    out = joins.null_safe_join(evap.select("siteID", "year", "month", "pet"), both, ["siteID", "year", "month"], "left")
    return out.select(F.col("siteID").alias("site"), big("year").alias("year"), big("month").alias("month"),
                      r("pet").alias("pet"), r("balance").alias("balance"))


@case("q_rolling_sum", """
WITH d AS (SELECT event_type, dayofyear(ts) AS day, sum(value) AS v FROM events GROUP BY ALL)
SELECT event_type, day, round(CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END, 2) + 0.0 AS v3
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS 2 PRECEDING)""")
def rolling_sum(t):
    daily = t.events.groupBy("event_type", F.lit(0).alias("year"), F.dayofyear("ts").alias("month")).agg(F.sum("value").alias("v"))
    return climate.rolling_sum(daily, "event_type", "v", 3, "v3").select(
        "event_type", big("month").alias("day"), r("v3", 2).alias("v3"))


def _spei_sql(scale: int) -> str:
    return "WITH" + BALANCE_SQL + "," + spei_ctes("bal", "sp", scale) + """
SELECT "siteID" AS site, year, month, round(spei, 4) + 0.0 AS spei FROM sp"""


def _spei(t, scale):
    return climate.drought_index(balance_series(t), scale=scale).select(
        F.col("siteID").alias("site"), big("year").alias("year"), big("month").alias("month"), r("spei", 4).alias("spei"))


@case("q_spei1", _spei_sql(1))
def spei1(t):
    return _spei(t, 1)


@case("q_spei3", _spei_sql(3))
def spei3(t):
    return _spei(t, 3)


CLIMATOLOGY_SQL = """
normal AS (SELECT dayofyear(o_orderdate) - 1 AS day, o_orderpriority AS "siteID", avg(o_totalprice / 9973) AS value FROM orders GROUP BY ALL)"""


def priority_readings(t):
    return t.orders.select(F.col("o_orderpriority").alias("siteID"), F.col("o_orderdate").alias("date"),
                           (F.col("o_totalprice") / READING).alias("value"), "o_orderstatus")


def _normal(t):
    return climate.climatology(priority_readings(t), "siteID", "date", "value")


@case("q_climatology_anomaly", "WITH" + CLIMATOLOGY_SQL + """,
daily AS (SELECT o_orderpriority AS "siteID", o_orderdate::DATE AS date, avg(o_totalprice / 9973) AS value FROM orders GROUP BY ALL)
SELECT d."siteID" AS site, strftime(d.date, '%Y-%m-%d') AS date, round(d.value - n.value, 5) + 0.0 AS anomaly,
  CASE WHEN d.value - n.value > 1e-9 THEN 'red' ELSE 'blue' END AS sign
FROM daily d LEFT JOIN normal n ON d."siteID" = n."siteID" AND dayofyear(d.date) - 1 = n.day""")
def climatology_anomaly(t):
    daily = climate.daily_means(priority_readings(t), ["siteID"], "date", "value")
    out = climate.anomalies(daily, _normal(t))
    return out.select(F.col("siteID").alias("site"), day_text("date").alias("date"), r("tAnom", 5).alias("anomaly"), "sign")


@case("q_phase_means", "WITH" + CLIMATOLOGY_SQL + """,
p AS (SELECT "siteID", value, month(DATE '2018-01-01' + day::INT) AS m FROM normal)
SELECT "siteID" AS site, CASE WHEN m IN (6, 7) THEN 'summer' ELSE 'autumn' END AS phase, round(avg(value), 4) + 0.0 AS "LTtval"
FROM p WHERE m IN (6, 7, 8, 9) GROUP BY ALL""")
def phase_means(t):
    return climate.phase_means(_normal(t), "siteID", phase_of_month(F.month("date"), "summer", "autumn"), "LTtval").select(
        F.col("siteID").alias("site"), F.col("monthN").alias("phase"), r("LTtval", 4).alias("LTtval"))


@case("q_drought_anomalies", """
WITH d AS (SELECT o_orderpriority AS "siteID", o_orderdate::DATE AS date, avg(o_totalprice / 9973) AS t,
    avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 9973 END) AS m FROM orders GROUP BY ALL),
p AS (SELECT *, year(date) AS year, CASE WHEN month(date) IN (6, 7) THEN 'spr' ELSE 'aut' END AS phase FROM d WHERE month(date) IN (6, 7, 8, 9)),
lt AS (SELECT "siteID", phase, avg(t) AS v FROM p GROUP BY ALL), lm AS (SELECT "siteID", phase, avg(m) AS v FROM p GROUP BY ALL),
y AS (SELECT "siteID", phase, year, avg(t) AS t, avg(CASE WHEN year <> 2000 THEN m END) AS m FROM p GROUP BY ALL),
x AS (SELECT "siteID", phase, year, avg(m) AS nm FROM p WHERE year = 2000 GROUP BY ALL)
SELECT y."siteID" AS site, y.phase, y.year, round(t - lt.v, 4) + 0.0 AS "tAnom", round(coalesce(m, nm) - lm.v, 4) + 0.0 AS "pAnom"
FROM y LEFT JOIN lt ON y."siteID" = lt."siteID" AND y.phase = lt.phase LEFT JOIN lm ON y."siteID" = lm."siteID" AND y.phase = lm.phase
LEFT JOIN x ON y."siteID" = x."siteID" AND y.phase = x.phase AND y.year = x.year""")
def drought_anomalies(t):
    daily = priority_readings(t).groupBy("siteID", F.to_date("date").alias("date")).agg(
        F.avg("value").alias("soilT"), F.avg(F.when(F.col("o_orderstatus") == "F", F.col("value"))).alias("soilM"))
    phase = phase_of_month(F.month("date"), "spr", "aut")
    rows = daily.withColumn("monthN", phase).where(F.col("monthN").isNotNull())
    warm = rows.groupBy("siteID", "monthN").agg(F.avg("soilT").alias("LTtval"))
    wet = rows.groupBy("siteID", "monthN").agg(F.avg("soilM").alias("LTPval"))
    extra = rows.where(F.year("date") == 2000).groupBy("siteID", "monthN", F.year("date").alias("year")).agg(F.avg("soilM").alias("soilM"))
    gappy = daily.withColumn("soilM", F.when(F.year("date") != 2000, F.col("soilM")))
    out = climate.drought_anomalies(gappy, warm, wet, extra, ["monthN", "year", "siteID"], phase)
    return out.select(F.col("siteID").alias("site"), F.col("monthN").alias("phase"), big("year").alias("year"),
                      r("tAnom", 4).alias("tAnom"), r("pAnom", 4).alias("pAnom"))


@case("q_soil_means", """
WITH d AS (SELECT o_orderpriority AS "siteID", o_orderdate::DATE AS date,
    CASE WHEN count(v) < count(*) THEN NULL ELSE avg(v) END AS v
  FROM (SELECT *, CASE WHEN o_totalprice < 490000 OR year(o_orderdate) < 1998 THEN o_totalprice / 9973 END AS v FROM orders) GROUP BY ALL),
n AS (SELECT *, CASE WHEN count(v) OVER s = count(*) OVER s THEN avg(v) OVER s END AS total,
    CASE WHEN count(v) OVER y = count(*) OVER y THEN avg(v) OVER y END AS annual
  FROM d WINDOW s AS (PARTITION BY "siteID"), y AS (PARTITION BY "siteID", year(date)))
SELECT "siteID" AS site, month(date) AS month, year(date) AS year, round(any_value(annual), 4) + 0.0 AS sm_annual_mean,
  round(any_value(total), 4) + 0.0 AS sm_total_mean, round(avg(v), 4) + 0.0 AS soil_moisture_month_mean
FROM n GROUP BY 1, 2, 3""")
def soil_means(t):
    v = F.when((F.col("o_totalprice") < 490000) | (F.year("o_orderdate") < 1998), F.col("o_totalprice") / READING)
    rows = t.orders.select(F.col("o_orderpriority").alias("siteID"), F.col("o_orderdate").alias("date"), v.alias("value"))
    out = climate.nested_means(rows)
    return out.select(F.col("siteID").alias("site"), big("month").alias("month"), big("year").alias("year"),
                      *[r(c, 4).alias(c) for c in ("sm_annual_mean", "sm_total_mean", "soil_moisture_month_mean")])


@case("q_daily_means", """
SELECT o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS date, dayofyear(o_orderdate)::INT AS day,
  year(o_orderdate)::INT AS year, round(avg(o_totalprice), 7) + 0.0 AS value FROM orders GROUP BY ALL""")
def daily_means(t):
    return climate.daily_means(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderdate", "o_totalprice").select(
        "o_orderpriority", "o_orderstatus", day_text("date").alias("date"), "day", "year", r("value", 7).alias("value"))


@case("q_season_span", """
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS date, year(o_orderdate) AS year,
  CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN '2' WHEN month(o_orderdate) BETWEEN 6 AND 7 THEN 'early'
       WHEN month(o_orderdate) BETWEEN 8 AND 11 THEN 'late' ELSE '1' END AS season FROM orders)
SELECT o_orderkey, season, strftime(min(date) OVER w, '%Y-%m-%d') AS xmin, strftime(max(date + 29) OVER w, '%Y-%m-%d') AS xmax
FROM o WINDOW w AS (PARTITION BY season, year)""")
def season_span(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"),
                           season_of_month(F.month("o_orderdate")).alias("season"))
    return climate.season_spans(rows).select("o_orderkey", "season", day_text("xmin").alias("xmin"), day_text("xmax").alias("xmax"))


@case("q_name_recover", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type END, CASE head WHEN 'ITAS' THEN 'Ulvehaugen' ELSE head END) AS site
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(p_name || '_' || p_brand, '_.*', ''), ' .*', ''), '-.*', '') AS head FROM part)""")
def name_recover(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("siteID"),
                         F.concat_ws("_", "p_name", "p_brand").alias("file"))
    return climate.recover_site(rows).select("p_partkey", F.col("siteID").alias("site"))


@case("q_site_normals", "WITH" + NATION_ORDERS + """,
d AS (SELECT "siteID", date, max(value) FILTER (WHERE o_orderstatus = 'F') AS p, max(value) FILTER (WHERE o_orderstatus = 'O') AS t
  FROM no WHERE o_orderstatus IN ('F', 'O') AND year(date) BETWEEN 1996 AND 2000 GROUP BY ALL),
y AS (SELECT "siteID", year(date) AS y, sum(p) AS p FROM d GROUP BY ALL),
m AS (SELECT "siteID", year(date) AS y, month(date) AS m, avg(t) AS t, count(t) < count(*) AS gap FROM d GROUP BY ALL),
s AS (SELECT "siteID", CASE WHEN bool_or(gap) THEN NULL ELSE avg(t) END AS temperature FROM m WHERE m IN (6, 7, 8) GROUP BY 1)
SELECT a."siteID" AS site, round(a.p, 3) + 0.0 AS precipitation, round(temperature, 3) + 0.0 AS temperature
FROM (SELECT "siteID", avg(coalesce(p, 0)) AS p FROM y GROUP BY 1) a LEFT JOIN s USING ("siteID")""")
def site_normals(t):
    variable = F.when(F.col("o_orderstatus") == "F", "precipitation").when(F.col("o_orderstatus") == "O", "temperature")
    # One value per site, day and variable, as in a gridded product.
    grid = nation_orders(t).withColumn("variable", variable).where(F.col("variable").isNotNull()).groupBy(
        "siteID", "date", "variable").agg(F.max("value").alias("value"))
    out = climate.site_normals(grid, 1996, 2000)
    return out.select(F.col("siteID").alias("site"), r("precipitation", 3).alias("precipitation"), r("temperature", 3).alias("temperature"))


@case("q_monthly_temperature", "WITH" + NATION_ORDERS + "," + TEMPERATURE_SQL + """
SELECT "siteID" AS site, year, month, round(temp_min, 5) + 0.0 AS temp_min, round(temp_mean, 5) + 0.0 AS temp_mean,
  round(temp_max, 5) + 0.0 AS temp_max FROM tmp""")
def monthly_temperature(t):
    out = climate.monthly_temperature(readings(t), site_info(t), "2-HIGH", "5-LOW")
    return out.select(F.col("siteID").alias("site"), big("year").alias("year"), big("month").alias("month"),
                      *[r(c, 5).alias(c) for c in ("temp_min", "temp_mean", "temp_max")])


def drought_ctes(first: int, last: int) -> str:
    """CTEs of the monthly climate table ``dt`` over ``no``, ``nation`` and ``region``."""
    return TEMPERATURE_SQL + f""",
rain AS (SELECT "siteID", year(date) AS year, month(date) AS month, sum(value) AS precip_sum FROM no GROUP BY ALL),
loc AS (SELECT "siteID", year, month, temp_min AS tmin, temp_max AS tmax, 58 + n_nationkey * 0.2::DOUBLE AS lat
  FROM tmp JOIN (SELECT n_name AS "siteID", n_nationkey FROM nation) USING ("siteID") WHERE year BETWEEN {first} AND {last}),""" + pet_ctes("loc", "pet") + f""",
bal AS (SELECT r."siteID", r.year, r.month, precip_sum - pet AS balance FROM rain r LEFT JOIN pet p
  ON r."siteID" = p."siteID" AND r.year = p.year AND r.month = p.month WHERE r.year BETWEEN {first} AND {last}),""" + (
        spei_ctes("bal", "s1", 1) + "," + spei_ctes("bal", "s3", 3)) + """,
days AS (SELECT "siteID", date, avg(value) AS v FROM no WHERE o_orderstatus = 'F' GROUP BY ALL),
soil AS (SELECT "siteID", date, v, avg(v) OVER (PARTITION BY "siteID") AS total, avg(v) OVER (PARTITION BY "siteID", year(date)) AS annual FROM days),
sm AS (SELECT "siteID", year(date) AS year, month(date) AS month, any_value(annual) AS annual, any_value(total) AS total, avg(v) AS v FROM soil GROUP BY 1, 2, 3),
dt AS (SELECT b."siteID", b.year, b.month, s1.spei, s3.spei AS spei_seasonal, temp_min, temp_mean, temp_max, annual, total, v
FROM bal b LEFT JOIN s1 ON b."siteID" = s1."siteID" AND b.year = s1.year AND b.month = s1.month
LEFT JOIN s3 ON b."siteID" = s3."siteID" AND b.year = s3.year AND b.month = s3.month
LEFT JOIN tmp ON b."siteID" = tmp."siteID" AND b.year = tmp.year AND b.month = tmp.month
LEFT JOIN sm ON b."siteID" = sm."siteID" AND b.year = sm.year AND b.month = sm.month)"""


def drought_sources(base):
    """Rain, readings and moisture from rows (siteID, date, value, o_orderkey, o_orderpriority, o_orderstatus)."""
    logger = F.when(F.col("o_orderpriority") == "2-HIGH", "temp200cm").when(F.col("o_orderpriority") == "5-LOW", "temp30cm")
    # Half of the moisture rows carry the site only in the file name.
    known = F.when(F.col("o_orderkey") % 2 == 0, F.col("siteID"))
    moisture = base.select(known.alias("siteID"), "date", "value", F.when(F.col("o_orderstatus") != "F", "bad").alias("flag"),
                           F.concat(F.col("siteID"), F.lit(" 2009-x.csv")).alias("file"))
    return base.select("siteID", "date", "value"), base.select("siteID", "date", logger.alias("logger"), "value"), moisture


@case("q_drought_table", "WITH" + NATION_ORDERS + "," + drought_ctes(1995, 2000) + """
SELECT "siteID" AS site, year, month, round(spei, 4) + 0.0 AS spei, round(spei_seasonal, 4) + 0.0 AS spei_seasonal,
  strftime(make_date(year::INT, month::INT, 1), '%Y-%m-%d') AS date,
  CASE WHEN month BETWEEN 3 AND 5 THEN '2' WHEN month BETWEEN 6 AND 7 THEN 'early' WHEN month BETWEEN 8 AND 11 THEN 'late' ELSE '1' END AS season,
  round(temp_min, 5) + 0.0 AS temp_min, round(temp_mean, 5) + 0.0 AS temp_mean, round(temp_max, 5) + 0.0 AS temp_max,
  round(annual, 5) + 0.0 AS sm_annual_mean, round(total, 5) + 0.0 AS sm_total_mean, round(v, 5) + 0.0 AS soil_moisture_month_mean FROM dt""")
def drought_table(t):
    rain, temps, moisture = drought_sources(nation_orders(t))
    sites = site_info(t)
    # An underscore ends the site name in a file name, so site names here do without.
    coded = {"siteID": F.regexp_replace("siteID", "_", "")}
    out = climate.drought_table(rain.withColumns(coded), temps.withColumns(coded), sites.withColumns(coded),
                                moisture.withColumns({**coded, "file": F.regexp_replace("file", "NATION_", "NATION")}), 1995, 2000)
    return out.select(
        F.regexp_replace("siteID", "NATION", "NATION_").alias("site"), big("year").alias("year"), big("month").alias("month"),
        r("spei", 4).alias("spei"), r("spei_seasonal", 4).alias("spei_seasonal"), day_text("date").alias("date"), "season",
        *[r(c, 5).alias(c) for c in ("temp_min", "temp_mean", "temp_max", "sm_annual_mean", "sm_total_mean", "soil_moisture_month_mean")])
