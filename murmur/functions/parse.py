"""Tolerant conversions: bad input gives a default, never a failed query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"
_HAS_ZONE = r"([Zz]|[+-]\d{1,2}(:?\d{2})?)$"
_HAS_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d"
_NO_SECONDS = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}(:?\d{2})?)?$"
_SHORT_ZONE = r"([+-]\d{2})(\d{2})$"
_INTEGER = r"^\s*[+-]?\d{1,19}\s*$"
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Month names of the web API's own time format.
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_API_TIME = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) (\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{2})(\d{2}) (\d{4})$"


def parse_instant(col: Column, api_format: bool = False) -> Column:
    """ISO-8601 text as an instant; no zone means UTC; anything else is NULL.

    The zone is made explicit before the conversion, so the result does not
    depend on the session time zone.  ``api_format`` also accepts times such as
    ``Sat Apr 18 08:00:00 +0000 2026``.
    """
    text = F.trim(col.cast("string"))
    # Most times are complete and end in Z; only the others need rewriting.
    full = F.regexp_replace(text, _NO_SECONDS, "$1:00$2")
    zoned = (
        F.when(text.endswith("Z") & (F.length(text) > 19), text)
        .when(~text.rlike(_HAS_TIME), F.concat(text, F.lit("T00:00:00Z")))
        .when(
            F.substring(text, 11, 100).rlike(_HAS_ZONE),
            F.regexp_replace(full, _SHORT_ZONE, "$1:$2"),
        )
        .otherwise(F.concat(full, F.lit("Z")))
    )
    iso = F.when(text.rlike(_ISO_DATE), F.try_to_timestamp(zoned))
    if not api_format:
        return iso
    part = lambda n: F.regexp_extract(text, _API_TIME, n)
    month = F.lpad(
        F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), part(1)).cast("string"), 2, "0"
    )
    rebuilt = F.concat(
        part(6), F.lit("-"), month, F.lit("-"), part(2), F.lit("T"), part(3),
        part(4), F.lit(":"), part(5),
    )
    return F.coalesce(iso, F.when(text.rlike(_API_TIME), F.try_to_timestamp(rebuilt)))


#: Counts and weights beyond these are not believed: sums of them could leave their types.
MOST_COUNT, MOST_WEIGHT = 10**12, 1e6


def parse_int(col: Column, default: int = 0) -> Column:
    """Text as a whole number of at most ``MOST_COUNT`` either way, else ``default``.

    The pattern keeps unreadable text away from the cast, which would raise and
    catch an exception for each such row.
    """
    text = col.cast("string")
    number = F.when(text.rlike(_INTEGER), text.try_cast("bigint"))
    believed = F.when(number.between(-MOST_COUNT, MOST_COUNT), number)
    return F.coalesce(believed, F.lit(default).cast("bigint"))


def parse_float(col: Column, default: Column | float | None = 1.0) -> Column:
    """Text as a finite number, else ``default``."""
    text = col.cast("string")
    number = F.when(text.rlike(_DECIMAL), text.try_cast("double"))
    finite = F.when(F.abs(number) != float("inf"), number)
    if default is None:
        return finite
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(finite, fallback)


def parse_weight(col: Column) -> Column:
    """Text as a weight of at most ``MOST_WEIGHT`` either way, else NULL."""
    number = parse_float(col, None)
    return F.when(number.between(-MOST_WEIGHT, MOST_WEIGHT), number)


def utc(col: Column) -> Column:
    """An instant's wall clock in UTC, whatever the session's zone."""
    return F.to_utc_timestamp(col, F.current_timezone())


def partition_date(col: Column) -> Column:
    return F.to_date(utc(col))


def partition_hour(col: Column) -> Column:
    """Two-digit hour text in UTC, as used in directory names."""
    return F.date_format(utc(col), "HH")


def iso_text(col: Column) -> Column:
    """An instant as ISO text, for presentation only."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssXXX")
