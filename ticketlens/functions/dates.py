"""Date cleaning, parsing and calendar features."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text a date column may hold that means "no date".
MISSING_DATE_TEXT = ("missing", "")

# Formats tried in order by to_utc_timestamp (ISO first, then the tracker export format).
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSZ",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """end - start in seconds (double); works for timestamp and timestamp_ntz."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1e6)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def clean_date_string(col: str | Column) -> Column:
    """null, blank or 'missing' (any case) -> null; other text unchanged."""
    c = _c(col)
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(*MISSING_DATE_TEXT), F.lit(None)).otherwise(c)


def parse_utc_timestamp(col: str | Column) -> Column:
    """F3 for one column: cleaned text -> UTC timestamp; unparsable text -> null."""
    c = clean_date_string(col)
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS]
    return F.coalesce(*tries)


def to_utc_timestamp(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """coerce the named columns that exist to UTC timestamps (errors -> null)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    return df.withColumns({c: parse_utc_timestamp(F.col(f"`{c}`")) for c in present})


def to_utc_ntz(col: str | Column) -> Column:
    """A timestamp as its UTC wall-clock ``timestamp_ntz`` (independent of the session time zone)."""
    c = _c(col)
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def drop_invalid_dates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """drop a row when ANY of the (present) date columns is null."""
    present = [c for c in cols if c in df.columns]
    return df.na.drop("any", subset=present) if present else df


def resolution_time_hours(created: str | Column, resolved: str | Column) -> Column:
    """(resolved - created) in hours for resolved issues; negatives kept."""
    r = _c(resolved)
    return F.when(r.isNotNull(), hours_between(created, r))


def resolution_time_days(created: str | Column, resolved: str | Column) -> Column:
    """(resolved - created) in days for resolved issues; negative -> null."""
    d = seconds_between(created, resolved) / F.lit(86400.0)
    return F.when(_c(resolved).isNotNull() & (d >= 0), d)


def is_resolved(resolved: str | Column) -> Column:
    """F12."""
    return _c(resolved).isNotNull().cast("int")


def age_days(created: str | Column, as_of: _dt.datetime | str) -> Column:
    """days from created to ``as_of`` (a parameter, never the wall clock)."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    # a wall-clock literal built from text: independent of the session time zone
    stamp = F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return seconds_between(created, stamp) / F.lit(86400.0)


def calendar_parts(df: DataFrame, created: str = "created", resolved: str = "resolutiondate") -> DataFrame:
    """Monday=0 weekday, hour, month, year of created; weekday and hour of resolved."""
    out = {}
    if created in df.columns:
        out.update({
            "created_day_of_week": F.weekday(created),
            "created_hour": F.hour(created),
            "created_month": F.month(created),
            "created_year": F.year(created),
            "created_on_weekend": (F.weekday(created) >= 5).cast("int"),
        })
    if resolved in df.columns:
        out.update({
            "resolved_day_of_week": F.weekday(resolved),
            "resolved_hour": F.hour(resolved),
        })
    return df.withColumns(out)


def issue_time_features(df: DataFrame, created: str = "created", resolved: str = "resolutiondate",
                        as_of: _dt.datetime | str | None = None) -> DataFrame:
    """F10-F13 + F15 in one projection."""
    cols = {
        "resolution_time_hours": resolution_time_hours(created, resolved),
        "resolution_time_days": resolution_time_days(created, resolved),
        "is_resolved": is_resolved(resolved),
    }
    if as_of is not None:
        cols["age_days"] = age_days(created, as_of)
    return calendar_parts(df.withColumns(cols), created, resolved)
