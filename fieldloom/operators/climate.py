"""Sensor readings to monthly climate, evapotranspiration, drought index and anomalies.

Everything stays long (site, year, month, value). Raw readings are only ever touched by
aggregates with a partial step; windows run on monthly rows, of which a site has a bounded number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import mid_month_day_of_year, month_start, season_of_month, within_years
from ..functions.lookups import SITE_SPELLINGS_OF_FILES, recode
from ..functions.nulls import (ColumnLike, as_col, if_else, mean_skip, mean_strict, sum_skip,
                               sum_strict)
from ..functions.text import before_first
from ..session import cut_lineage
from .joins import natural_join, null_safe_join
from .reshape import complete

MONTH = ["year", "month"]


def monthly_total(df: DataFrame, site: str, date: str, value: str, out: str = "total") -> DataFrame:
    """Monthly sum per site; a missing day makes the month missing."""
    return (df.groupBy(F.year(date).alias("year"), F.month(date).alias("month"), site)
            .agg(sum_strict(value).alias(out)))


def monthly_extremes(df: DataFrame, keys: Sequence[str], time: str, value: str,
                     names: tuple[str, str, str] = ("temp_max", "temp_min", "temp_mean")) -> DataFrame:
    """Monthly mean of daily extremes and of all readings, each day weighted by its readings.

    A day is reduced to its extremes, sum and count first; the weights make the result equal to
    repeating the extremes on every reading.
    """
    hi, lo, mean = names
    days = df.where(F.col(value).isNotNull()).groupBy(*keys, F.to_date(time).alias("__day")).agg(
        F.max(value).alias("hi"), F.min(value).alias("lo"),
        F.sum(value).alias("s"), F.count(value).alias("n"))
    month = [F.year("__day").alias("year"), F.month("__day").alias("month")]
    return days.groupBy(*keys, *month).agg(
        (F.sum(F.col("hi") * F.col("n")) / F.sum("n")).alias(hi),
        (F.sum(F.col("lo") * F.col("n")) / F.sum("n")).alias(lo),
        (F.sum("s") / F.sum("n")).alias(mean))


def prefer_sensor(df: DataFrame, keys: Sequence[str], sensor: str, preferred: str, fallback: str,
                  values: Sequence[str]) -> DataFrame:
    """One row per key: values of the preferred sensor, else of the fallback sensor."""
    def from_sensor(name, v):
        return F.max(F.when(F.col(sensor) == name, F.col(v)))

    return df.where(F.col(sensor).isin(preferred, fallback)).groupBy(*keys).agg(
        *[F.coalesce(from_sensor(preferred, v), from_sensor(fallback, v)).alias(v) for v in values])


def fill_from_zone(df: DataFrame, sites: DataFrame, site: str, zone: str, value: str,
                   strict: bool = False) -> DataFrame:
    """Complete the calendar and fill a missing month by the mean of the sites of its zone.

    ``strict`` makes the zone mean missing as soon as one site misses it, so nothing is filled.
    """
    full = complete(cut_lineage(df), [site, *MONTH])
    zoned = null_safe_join(full, sites.select(site, zone), [site], "left")
    mean = mean_strict(value) if strict else mean_skip(value)
    means = zoned.groupBy(zone, *MONTH).agg(mean.alias("__zone_mean"))
    out = null_safe_join(zoned, means, [zone, *MONTH], "left")
    return out.withColumn(value, F.coalesce(value, "__zone_mean")).select(*full.columns)


def monthly_temperature(readings: DataFrame, sites: DataFrame, preferred: str = "temp200cm",
                        fallback: str = "temp30cm", strict: bool = False) -> DataFrame:
    """Filled monthly minimum, mean and maximum temperature per site.

    ``readings``: date, siteID, logger, value; ``sites``: siteID, Biogeographic_zone.
    """
    used = readings.where(F.col("logger").isin(preferred, fallback) & F.col("value").isNotNull())
    monthly = monthly_extremes(used, ["siteID", "logger"], "date", "value")
    one = prefer_sensor(monthly, ["siteID", *MONTH], "logger", preferred, fallback,
                        ["temp_max", "temp_min", "temp_mean"])
    full = complete(cut_lineage(one), ["siteID", *MONTH])
    zoned = null_safe_join(full, sites.select("siteID", "Biogeographic_zone"), ["siteID"], "left")
    mean = mean_strict if strict else mean_skip
    values = ["temp_min", "temp_mean", "temp_max"]
    means = zoned.groupBy("Biogeographic_zone", *MONTH).agg(*[mean(v).alias(f"__{v}") for v in values])
    out = null_safe_join(zoned, means, ["Biogeographic_zone", *MONTH], "left")
    return out.withColumns({v: F.coalesce(v, f"__{v}") for v in values}).select("siteID", *MONTH, *values)


def hargreaves(tmin: ColumnLike, tmax: ColumnLike, latitude: ColumnLike, year: ColumnLike,
               month: ColumnLike) -> Column:
    """Monthly potential evapotranspiration in mm (Hargreaves and Samani, FAO-56 radiation).

    FAO-56 eq. 21 to 25 with the solar constant folded into 37.6; 0.408 turns MJ into mm.
    """
    lo, hi = as_col(tmin), as_col(tmax)
    day = mid_month_day_of_year(month)
    turn = F.lit(2 * math.pi / 365) * day
    distance = 1 + 0.033 * F.cos(turn)
    declination = 0.409 * F.sin(turn - 1.39)
    phi = F.radians(as_col(latitude))
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(declination))))
    radiation = 37.6 * distance * (sunset * F.sin(phi) * F.sin(declination)
                                   + F.cos(phi) * F.cos(declination) * F.sin(sunset))
    days = F.dayofmonth(F.last_day(month_start(year, month)))
    return (0.0023 * 0.408 * radiation * ((lo + hi) / 2 + 17.8)
            * F.sqrt(F.when((lo + hi).isNotNull(), F.greatest(hi - lo, F.lit(0.0)))) * days)


def water_balance(precipitation: DataFrame, pet: DataFrame, site: str = "siteID") -> DataFrame:
    """Precipitation minus evapotranspiration, matched by site and month."""
    joined = null_safe_join(precipitation, pet, [site, *MONTH], "left")
    return joined.withColumn("balance", F.col("precip_sum") - F.col("pet")).select(site, *MONTH, "balance")


def rolling_sum(df: DataFrame, site: str, value: str, k: int, out: str) -> DataFrame:
    """Sum of the last ``k`` months of one site; missing when fewer, not consecutive, or any missing."""
    t = F.col("year") * 12 + F.col("month")
    w = W.partitionBy(site).orderBy(t).rowsBetween(-(k - 1), 0)
    whole = (F.count(value).over(w) == k) & (t - F.min(t).over(w) == k - 1)
    return df.withColumn(out, F.when(whole, F.sum(value).over(w)))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution (Abramowitz and Stegun 26.2.23; error below 4.5e-4)."""
    tail = F.least(p, 1 - p)
    w = F.sqrt(-2 * F.ln(tail))
    z = w - (2.515517 + 0.802853 * w + 0.010328 * w * w) / (
        1 + 1.432788 * w + 0.189269 * w * w + 0.001308 * w * w * w)
    return F.when(p < 0.5, -z).otherwise(z)


def drought_index(df: DataFrame, site: str = "siteID", value: str = "balance", scale: int = 1,
                  out: str = "spei") -> DataFrame:
    """Standardised precipitation-evapotranspiration index of a monthly balance series.

    Rolling sum over ``scale`` months; per site and calendar month a log-logistic distribution is
    fitted by L-moments and the probability is turned into a normal quantile. Needs four years and
    some spread, else missing. A value beyond the fitted support has probability 0 or 1 and gets
    an infinite index. A (site, calendar month) group has one row per year.
    """
    x = F.col("__x")
    rolled = rolling_sum(df, site, value, scale, "__x")
    group = W.partitionBy(site, "month")
    ordered = group.orderBy(x.asc_nulls_last(), "year")
    i = F.row_number().over(ordered) - 1
    n = F.count(x).over(group)
    first = rolled.withColumns({"__i": i, "__n": n})
    i, n = F.col("__i"), F.col("__n")
    moments = first.withColumns({
        "__b0": F.avg(x).over(group),
        "__b1": F.avg(F.when(n > 1, i / (n - 1) * x)).over(group),
        "__b2": F.avg(F.when(n > 2, i * (i - 1) / ((n - 1) * (n - 2)) * x)).over(group),
    })
    b0, b1, b2 = F.col("__b0"), F.col("__b1"), F.col("__b2")
    shaped = moments.withColumn("__l2", 2 * b1 - b0)
    l2 = F.col("__l2")
    shaped = shaped.withColumn("__k", F.when((n >= 4) & (l2 > 1e-12), -(6 * b2 - 6 * b1 + b0) / l2))
    k = F.col("__k")
    flat = F.abs(k) < 1e-6
    angle = k * math.pi
    shaped = shaped.withColumn("__a", F.when(flat, l2).otherwise(l2 * F.sin(angle) / angle))
    a = F.col("__a")
    shaped = shaped.withColumn(
        "__c", F.when(flat, b0).otherwise(b0 - a * (1 / k - math.pi / F.sin(angle))))
    shaped = shaped.withColumn("__u", 1 - k * (x - F.col("__c")) / a)
    u = F.col("__u")
    y = F.when(flat, (x - F.col("__c")) / a).otherwise(-F.ln(F.when(u > 0, u)) / k)
    shaped = shaped.withColumn(
        "__f", F.when(k.isNull() | x.isNull(), None)
        .when(~flat & (u <= 0), F.when(k < 0, 0.0).otherwise(1.0))
        .otherwise(1 / (1 + F.exp(-y))))
    f = F.col("__f")
    index = (F.when(f <= 0, F.lit(float("-inf"))).when(f >= 1, F.lit(float("inf")))
             .otherwise(normal_quantile(f)))
    return shaped.withColumn(out, index).select(*df.columns, out)


def season_spans(df: DataFrame, date: str = "date", year: str = "year", season: str = "season",
                 tail_days: int = 29) -> DataFrame:
    """First day and last day (plus a tail) of each season of a year, on every row."""
    spans = df.groupBy(season, year).agg(F.min(date).alias("xmin"),
                                         F.max(F.date_add(date, tail_days)).alias("xmax"))
    return null_safe_join(df, spans, [season, year], "left")


def recover_site(df: DataFrame, site: str = "siteID", file: str = "file") -> DataFrame:
    """Take a missing site from the start of the file name; one spelling per site, recorded ones too."""
    return df.withColumn(site, recode(F.coalesce(site, before_first(file, "_ -")), SITE_SPELLINGS_OF_FILES))


def nested_means(df: DataFrame, site: str = "siteID", date: str = "date", value: str = "value") -> DataFrame:
    """Monthly mean with the annual and the overall mean of the site on the same row.

    Days first (strict mean per day), then sums and counts per month; the annual and overall means
    are put together from the monthly sums, so windows see one row per site and month only.
    """
    days = df.groupBy(site, F.to_date(date).alias("__day")).agg(mean_strict(value).alias("__v"))
    months = days.groupBy(site, F.year("__day").alias("year"), F.month("__day").alias("month")).agg(
        F.sum("__v").alias("s"), F.count("__v").alias("n"), F.count(F.lit(1)).alias("n_all"))

    def rolled(*keys):
        w = W.partitionBy(*keys)
        return F.when(F.sum("n").over(w) == F.sum("n_all").over(w), F.sum("s").over(w) / F.sum("n").over(w))

    return months.select(
        site, "month", "year", rolled(site, "year").alias("sm_annual_mean"),
        rolled(site).alias("sm_total_mean"),
        F.try_divide("s", "n").alias("soil_moisture_month_mean"))


def daily_means(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Mean per day and key, missing readings skipped, with the day of the year."""
    day = F.to_date(date)
    return df.groupBy(*keys, day.alias("date")).agg(mean_skip(value).alias("value")).withColumns(
        {"day": F.dayofyear("date"), "year": F.year("date")})


def climatology(df: DataFrame, site: str, date: str, value: str, out: str = "value",
                origin: str = "2018-01-01") -> DataFrame:
    """Long-term mean per day of the year (counted from 0), with that day in a given year."""
    return (df.groupBy(F.dayofyear(date).alias("__d"), site).agg(mean_skip(value).alias(out))
            .withColumn("day", F.col("__d") - 1).drop("__d")
            .withColumn("date", F.date_add(F.to_date(F.lit(origin)), F.col("day"))))


#: Deviations up to this are rounding noise of equal means.
EQUAL_MEANS = 1e-9


def anomalies(daily: DataFrame, normal: DataFrame, site: str = "siteID", tolerance: float = EQUAL_MEANS) -> DataFrame:
    """Deviation of daily values from the long-term value of the same day, with its sign class.

    A deviation up to ``tolerance`` is no warm one, so the class does not depend on the order of sums.
    """
    shifted = daily.withColumn("day", F.col("day") - 1)
    joined = null_safe_join(shifted, normal.select(site, "day", F.col("value").alias("LTval")),
                            [site, "day"], "left")
    return joined.withColumn("tAnom", F.col("value") - F.col("LTval")).withColumn(
        "sign", if_else(F.col("tAnom") > tolerance, F.lit("red"), F.lit("blue")))


def phase_means(normal: DataFrame, site: str, phase: Column, out: str) -> DataFrame:
    """Mean of a long-term daily series per site and phase of the season."""
    return (normal.withColumn("monthN", phase).where(F.col("monthN").isNotNull())
            .groupBy("monthN", site).agg(mean_strict("value").alias(out)))


def drought_anomalies(daily: DataFrame, temperature_normal: DataFrame, moisture_normal: DataFrame,
                      extra_moisture: DataFrame | None, keys: Sequence[str], phase: Column | None,
                      months: Sequence[int] = (6, 7, 8, 9), site: str = "siteID") -> DataFrame:
    """Temperature and moisture anomalies per site, year and (optionally) phase.

    ``daily`` has one row per site and date with ``soilT`` and ``soilM``; the normals hold
    ``LTtval`` and ``LTPval``; ``extra_moisture`` fills a missing ``soilM``.
    """
    rows = daily.where(F.month("date").isin(list(months))).withColumn("year", F.year("date"))
    if phase is not None:
        rows = rows.withColumn("monthN", phase).where(F.col("monthN").isNotNull())
    means = rows.groupBy(*keys).agg(mean_skip("soilT").alias("soilT"), mean_skip("soilM").alias("soilM"))
    out = natural_join(natural_join(means, temperature_normal), moisture_normal)
    if extra_moisture is not None:
        shared = [c for c in keys if c in extra_moisture.columns]
        out = null_safe_join(out, extra_moisture, shared, "left", ("", "_new"))
        out = out.withColumn("soilM", F.coalesce("soilM", "soilM_new"))
    return out.withColumns({"tAnom": F.col("soilT") - F.col("LTtval"),
                            "pAnom": F.col("soilM") - F.col("LTPval")}).select(
        *keys, "tAnom", "pAnom", "soilT", "soilM")


def site_normals(daily: DataFrame, first_year: int = 2008, last_year: int = 2019) -> DataFrame:
    """Mean annual precipitation and mean summer temperature of each site.

    ``daily``: date, siteID, variable, value. Precipitation: yearly sums (missing skipped), then
    their mean. Temperature: June to August monthly means (a day without one makes the month
    missing), then their mean.
    """
    used = daily.where(F.col("variable").isin("temperature", "precipitation")
                       & within_years("date", first_year, last_year))
    days = used.groupBy("siteID", "date").agg(
        F.max(F.when(F.col("variable") == "precipitation", F.col("value"))).alias("p"),
        F.max(F.when(F.col("variable") == "temperature", F.col("value"))).alias("t"))
    monthly = days.groupBy("siteID", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("p").alias("p"), mean_strict("t").alias("t"))
    yearly = monthly.groupBy("siteID", "year").agg(sum_skip("p").alias("p"))
    rain = yearly.groupBy("siteID").agg(F.avg("p").alias("precipitation"))
    summer = monthly.where(F.col("month").isin(6, 7, 8))
    warmth = summer.groupBy("siteID").agg(mean_strict("t").alias("temperature"))
    return null_safe_join(rain, warmth, ["siteID"], "left")


def monthly_climate(index: DataFrame, temperature: DataFrame, moisture: DataFrame) -> DataFrame:
    """Drought index with temperatures and soil moisture of the same site and month."""
    return natural_join(natural_join(index, temperature), moisture)


def drought_table(precipitation: DataFrame, readings: DataFrame, sites: DataFrame, moisture: DataFrame,
                  first_year: int = 2009, last_year: int = 2019) -> DataFrame:
    """The whole monthly climate table from raw sources.

    ``precipitation``: date, siteID, value (daily); ``readings``: date, siteID, logger, value;
    ``sites``: siteID, Biogeographic_zone, Latitude; ``moisture``: date, siteID, value, flag, file.
    """
    # Before the readings are summed, so that the years reach the scan.
    temperature = monthly_temperature(readings.where(within_years("date", first_year, last_year)), sites)
    rain = monthly_total(precipitation.where(within_years("date", first_year, last_year)),
                         "siteID", "date", "value", "precip_sum")
    located = null_safe_join(temperature, sites.select("siteID", "Latitude"), ["siteID"], "left")
    in_span = F.col("year").between(first_year, last_year)
    pet = located.where(in_span).withColumn(
        "pet", hargreaves("temp_min", "temp_max", "Latitude", "year", "month")).select("siteID", *MONTH, "pet")
    balance = water_balance(rain, pet)
    both = drought_index(drought_index(balance, scale=1), scale=3, out="spei_seasonal")
    dated = both.drop("balance").withColumn("date", month_start("year", "month")).withColumn(
        "season", season_of_month("month"))
    clean = recover_site(moisture.where(F.col("flag").isNull() & F.col("value").isNotNull()))
    return monthly_climate(dated, temperature, nested_means(clean))
