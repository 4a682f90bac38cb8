"""ISO-8601 parsing and formatting; the session zone is UTC (see ``session.pin_utc``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwatch.functions.text import strip

_DATE = r"\d{4}-\d{2}-\d{2}"
_SECONDS = r"\d{2}:\d{2}:\d{2}(?:\.\d+)?"
_ZONE = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::\d{2})?)?)"


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to a timestamp; no zone means UTC; unreadable text becomes null.

    Compact dates and times, hours alone and offsets of hours or with seconds are read, too.
    Missing parts are filled in one after the other, so the argument is used only once.
    """
    text = F.translate(strip(c), ",", ".")
    dated = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    for digits, marks in ((3, "$1$2:$3:$4"), (2, "$1$2:$3")):
        compact = r"^(.{10}[T ])" + r"(\d{2})" * digits + r"(?=$|[.Z+-])"
        dated = F.regexp_replace(dated, compact, marks)
    clocked = F.regexp_replace(dated, f"^({_DATE})$", "$1T00:00:00")
    hours = F.regexp_replace(clocked, rf"^(.{{10}}[T ]\d{{2}})({_ZONE}?)$", "$1:00$2")
    exact = F.regexp_replace(hours, rf"([T ]\d{{2}}:\d{{2}})({_ZONE}?)$", "$1:00$2")
    offset = F.regexp_replace(exact, rf"([T ]{_SECONDS}[+-]\d{{2}})$", "$1:00")
    zoned = F.regexp_replace(offset, f"([T ]{_SECONDS})$", "$1Z")
    readable = F.regexp_extract(zoned, f"^{_DATE}[T ]{_SECONDS}{_ZONE}$", 0)
    return readable.try_cast("timestamp")


def parse_iso_or_epoch(c: Column) -> Column:
    """Unreadable or missing text falls back to 1970-01-01."""
    return F.coalesce(parse_iso(c), F.timestamp_seconds(F.lit(0)))


def parse_iso_strict(c: Column, what: str = "timestamp") -> Column:
    """Unreadable or missing text stops the job."""
    return F.coalesce(
        parse_iso(c),
        F.raise_error(
            F.concat(F.lit(f"Invalid {what}: "), F.coalesce(c, F.lit("null")))
        ).cast("timestamp"),
    )


def iso_text(ts: Column) -> Column:
    """``2024-01-01T00:00:07.179575+00:00``; the fraction only when it is not zero."""
    micros = F.unix_micros(ts) % 1_000_000
    return F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )
