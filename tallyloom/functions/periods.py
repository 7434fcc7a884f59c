"""Period ends as they are typed on forms: month, day and year with slashes or hyphens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A period's end with a year of two to four digits, and of four; the longest period in days.
SHORT, FULL = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
MOST_DAYS = 400


def _part(period: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(F.trim(period), pattern, i)


def month_from_period(period: Column) -> Column:
    """The month that a period's text begins with, or null."""
    n = F.regexp_extract(F.trim(period), r"^(\d{1,2})[-/]", 1).try_cast("int")
    return F.when(n.between(1, 12), n)


def is_fiscal(period: Column) -> Column:
    """Whether a period ends in another month than December; false where it has none."""
    return F.coalesce(month_from_period(period) != 12, F.lit(False))


def short_period(period: Column) -> Column:
    """MM/DD/YY; what isn't a period's end stays as it is."""
    two = lambda i: F.lpad(_part(period, SHORT, i), 2, "0")
    year = _part(period, SHORT, 3)
    yy = F.when(F.length(year) == 4, F.substring(year, 3, 2)).otherwise(year)
    return F.when(F.trim(period).rlike(SHORT), F.concat(two(1), F.lit("/"), two(2), F.lit("/"), yy)).otherwise(period)


def period_plus_one_year(period: Column) -> Column:
    """The end a year later, without zeros in front being added or lost; null where the year hasn't four digits."""
    year = _part(period, FULL, 3).try_cast("int") + 1
    return F.when(F.trim(period).rlike(FULL), F.concat_ws("/", _part(period, FULL, 1), _part(period, FULL, 2), year.cast("string")))


def period_date(period: Column) -> Column:
    """A period's end as DATE; a year of two digits is of this century. Days and months beyond their range count on."""
    year = F.when(F.length(_part(period, SHORT, 3)) == 2, _part(period, SHORT, 3).try_cast("int") + 2000).otherwise(_part(period, SHORT, 3).try_cast("int"))
    first = F.add_months(F.make_date(F.when(year >= 1, year), F.lit(1), F.lit(1)), _part(period, SHORT, 1).try_cast("int") - 1)
    return F.when(F.trim(period).rlike(SHORT), F.date_add(first, _part(period, SHORT, 2).try_cast("int") - 1))


def days_between_periods(start: Column, end: Column) -> Column:
    """Days from one period's end to the next, if more than none and fewer than MOST_DAYS; else null."""
    n = F.date_diff(period_date(end), period_date(start))
    return F.when((n > 0) & (n < MOST_DAYS), n)
