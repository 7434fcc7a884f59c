"""Exchange rates: tables, nearest dates, period averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_rates(entities: DataFrame, rates: DataFrame) -> DataFrame:
    """``entities`` (code, cy, py, ...) with avg_rate and cy_rate of year cy, and py_rate of year py.

    A year that isn't set falls back to the newest year with spot rates of any code, py to the one before; a year that is set
    but has no rate gives NULL.
    """
    spot = rates.where("kind = 'spot' AND rate IS NOT NULL").select("year")
    newest = spot.agg(F.max("year"))
    prior = spot.where(F.col("year") < newest.scalar()).agg(F.max("year"))
    out = entities.withColumns({"__code": F.upper(F.trim("code")), "__cy": F.coalesce("cy", newest.scalar()), "__py": F.coalesce("py", prior.scalar())})
    for name, kind, year in (("avg_rate", "avg", "__cy"), ("cy_rate", "spot", "__cy"), ("py_rate", "spot", "__py")):
        own = rates.where(F.col("kind") == kind).select(F.upper(F.trim("code")).alias("__code"), F.col("year").alias(year), F.col("rate").alias(name))
        out = out.join(own, ["__code", year], "left")
    return out.select(*entities.columns, "avg_rate", "cy_rate", "py_rate")


def nearest_rate(requests: DataFrame, daily: DataFrame, tolerance: int = 7) -> DataFrame:
    """(code, d, rate, as_of, diff_days): the point nearest to each requested day within the tolerance, ties to the earlier.

    Days are dealt into spans of the tolerance's length, so the range becomes an equi-join with the span and its neighbours.
    """
    span = lambda c: F.floor(F.unix_date(c) / (tolerance + 1))
    asked = requests.select("code", "d").distinct().withColumn("span", F.explode(F.array(span(F.col("d")) - 1, span(F.col("d")), span(F.col("d")) + 1)))
    points = daily.select(F.col("code").alias("c"), F.col("d").alias("at"), "rate", span(F.col("d")).alias("s"))
    diff = F.abs(F.datediff("at", "d"))
    hits = asked.join(points, (F.col("code") == F.col("c")) & (F.col("span") == F.col("s"))).where(diff <= tolerance)
    best = hits.groupBy("code", "d").agg(F.min_by(F.struct("rate", "at"), F.struct(diff, F.col("at"))).alias("b"))
    return best.select("code", "d", F.col("b.rate").alias("rate"), F.col("b.at").alias("as_of"), F.datediff("b.at", "d").alias("diff_days"))


def period_average(requests: DataFrame, daily: DataFrame, least: int = 60) -> DataFrame:
    """Mean rate within [start, end] of each request (code, start, end), six places; NULL under ``least`` points.

    Months that lie within a request come from sums a code and month; only the months at its ends meet single days. So a
    request makes a row a month, whatever its length in days.
    """
    keys = ["code", "start", "end"]
    month = lambda c: F.trunc(c, "MM")
    asked = requests.select(*keys).distinct()
    months = asked.where("start <= end").withColumn("m", F.explode(F.sequence(month("start"), month("end"), F.expr("interval 1 month"))))
    months = months.withColumn("inside", (F.col("m") >= F.col("start")) & (F.last_day("m") <= F.col("end")))
    days = daily.where("rate is not null").select("code", month("d").alias("m"), "d", "rate")
    sums = days.groupBy("code", "m").agg(F.count("*").alias("n"), F.sum("rate").alias("s"))
    within = months.where("inside").join(sums, ["code", "m"]).select(*keys, "n", "s")
    ends = months.where("not inside").join(days, ["code", "m"]).where(F.col("d").between(F.col("start"), F.col("end"))).select(*keys, F.lit(1).cast("bigint").alias("n"), F.col("rate").alias("s"))
    found = within.unionByName(ends).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    points = F.coalesce("n", F.lit(0)).cast("bigint")
    return asked.join(found, keys, "left").select(*keys, points.alias("points"), F.when(points >= least, F.round(F.col("s") / F.col("n"), 6)).alias("rate"))


def pivot_rate_book(rates: DataFrame, kind: str, years: list[int]) -> DataFrame:
    """One row a code, one column y<year> a year; of several rates of a year the largest."""
    wide = rates.where(F.col("kind") == kind).groupBy("code").pivot("year", years).agg(F.max("rate"))
    return wide.select("code", *(F.col(str(y)).alias(f"y{y}") for y in years))


def undeclared_codes(rates: DataFrame, codes: DataFrame) -> DataFrame:
    return rates.select("code").distinct().join(codes.select("code"), "code", "left_anti")
