"""Dates of sitemaps and of HTTP headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsight.functions.text import stripped

#: The forms that the sitemap protocol allows. Fixed value of the format.
W3C = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?)?)?$"


#: Years from 69 on of RFC 850 dates are of the 20th century, as in C's strptime.
SHORT_YEAR = r"^([A-Za-z]+, \d{2}-[A-Za-z]{3})-(69|[7-9]\d) "


def w3c(v: Column) -> Column:
    """A timestamp; null if v isn't a W3C datetime or not a date of the calendar."""
    full = F.regexp_replace(v, r"(T\d\d:\d\d)(Z|[+-])", "$1:00$2")
    short = F.regexp_replace(full, r"(\.\d{6})\d+", "$1")
    return F.when(v.rlike(W3C), short).try_cast("timestamp")


def http_date(v: Column) -> Column:
    """RFC 1123, RFC 850 or asctime; null for anything else."""
    forms = (
        (r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", "dd MMM yyyy HH:mm:ss"),
        (r"^[A-Za-z]+, (\d{2}-[A-Za-z]{3}-\d{2} \d{2}:\d{2}:\d{2}) GMT$", "dd-MMM-yy HH:mm:ss"),
        (r"^[A-Za-z]+, (\d{2}-[A-Za-z]{3}-19\d{2} \d{2}:\d{2}:\d{2}) GMT$", "dd-MMM-yyyy HH:mm:ss"),
        (r"^[A-Za-z]{3} ([A-Za-z]{3} +\d{1,2} \d{2}:\d{2}:\d{2} \d{4})$", "MMM d HH:mm:ss yyyy"),
    )
    v = F.regexp_replace(stripped(v), SHORT_YEAR, "$1-19$2 ")
    found = [F.try_to_timestamp(F.nullif(F.regexp_replace(F.regexp_extract(v, regex, 1), " +", " "), F.lit("")), F.lit(form)) for regex, form in forms]
    return F.coalesce(*found)


def retry_after(v: Column, now: Column) -> Column:
    """Seconds to wait: a number, or what is left until an HTTP date, 0 at least; null if neither."""
    v = stripped(v)
    number = F.when(v.rlike(r"^\+?\d+$"), v).try_cast("bigint")
    left = F.greatest(F.lit(0.0), (F.unix_micros(http_date(v)) - F.unix_micros(now)) / 1e6)
    return F.coalesce(number.cast("double"), F.when(http_date(v).isNotNull(), left))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


def rounded(v: Column) -> Column:
    """To three decimals, halves up."""
    return F.floor(v * 1000 + 0.5) / F.lit(1000.0)


def number_in(v: Column, low: float, high: float) -> Column:
    """Whether v is written as a number from low to high; NaN is no number outside."""
    written = v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(written, v).try_cast("double")
    return F.coalesce((value >= low) & (value <= high), F.lower(v) == "nan", F.lit(False))
