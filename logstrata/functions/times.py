"""Time arguments and timestamps: everything compares as UTC without a zone."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(r"(\d+(?:\.\d+)?)\s*([a-z]*)\Z", re.IGNORECASE)
_SECONDS = {"": 1, "s": 1, "sec": 1, "secs": 1, "m": 60, "min": 60, "mins": 60, "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600}
#: Years that stand in for a missing one in records and in events.
RECORD_YEAR, EVENT_YEAR = 1900, 2000


class TimeError(ValueError):
    """A time or duration that can't be read."""


def duration(raw: str) -> timedelta:
    """60, 60s, 5m, 1.5h."""
    match = _DURATION.match((raw or "").strip())
    if not match or match[2].lower() not in _SECONDS:
        raise TimeError(f"not a duration: {raw!r}")
    return timedelta(seconds=float(match[1]) * _SECONDS[match[2].lower()])


def naive(moment: datetime) -> datetime:
    return moment.astimezone(UTC).replace(tzinfo=None) if moment.tzinfo else moment


def moment(raw: str, reference: datetime) -> datetime:
    """An ISO time (with or without a zone), or a time of day on the reference's date."""
    text = (raw or "").strip()
    if not text:
        raise TimeError("an empty time")
    if re.match(r"\d{4}-\d{2}-\d{2}[T ]", text):
        try:
            return naive(datetime.fromisoformat(text))
        except ValueError:
            pass
    if found := re.fullmatch(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", text):
        hour, minute, second = (int(x or 0) for x in found.groups())
        try:
            return naive(reference).replace(hour=hour, minute=minute, second=second, microsecond=0)
        except ValueError:
            pass
    raise TimeError(f"not a time: {raw!r}")


# Strptime directives and their datetime-pattern letters.
_DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%a": "EEE", "%z": "XX", "%p": "a", "%I": "hh"}


def java_pattern(layout: str) -> str:
    """A strptime layout as a datetime pattern; letters between directives are quoted."""
    out = []
    for part in re.findall(r"%.|[A-Za-z]+|[^A-Za-z%]+", layout):
        if part.startswith("%"):
            if part not in _DIRECTIVES:
                raise TimeError(f"no pattern for {part}")
            # Beside a month's name days have one digit or two.
            out.append("d" if part == "%d" and "%b" in layout else _DIRECTIVES[part])
        else:
            out.append(f"'{part}'" if part[0].isalpha() else part)
    return "".join(out).replace(".SSSSSS", "[.SSSSSS]").replace(",SSSSSS", "[,SSSSSS]")


def parse(raw: Column, layouts: tuple[str, ...], year: int = RECORD_YEAR) -> Column:
    """The first layout that fits; a layout without a year means ``year``."""
    text = F.regexp_replace(F.trim(raw), r"\s+", " ")
    tries = []
    for layout in layouts:
        pattern = java_pattern(layout)
        if any(y in layout for y in ("%Y", "%y")):
            tries.append(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))
        else:
            tries.append(F.try_to_timestamp(F.concat(F.lit(f"{year} "), text), F.lit(f"yyyy {pattern}")).cast("timestamp_ntz"))
    return F.coalesce(*tries)


def iso(raw: Column) -> Column:
    """ISO-8601 text, any zone taken to UTC; null if it is none."""
    looks = F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([Zz]|[+-]\d{2}:?\d{2})?)?$")
    return F.when(looks, F.try_to_timestamp(F.regexp_replace(F.trim(raw), r"([+-]\d{2})(\d{2})$", "$1:$2")).cast("timestamp_ntz"))


# Layouts of event times beside ISO, tried in this order.
EVENT_LAYOUTS = ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%m-%d %H:%M:%S.%f", "%m-%d %H:%M:%S", "%b %d %H:%M:%S")


def event_time(raw: Column) -> Column:
    """The time that an event states as text, UTC without a zone; one without a year means EVENT_YEAR."""
    return F.coalesce(iso(raw), parse(raw, EVENT_LAYOUTS, EVENT_YEAR))


def epoch(number: Column) -> Column:
    """Seconds, or milliseconds beyond 1e11 in size."""
    value = number.cast("double")
    seconds = F.when(F.abs(value) > 1e11, value / 1000).otherwise(value)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.timestamp_micros((seconds * 1_000_000).cast("long")).cast("timestamp_ntz"))
