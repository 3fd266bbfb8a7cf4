"""Column functions over log text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, tags and word lists that define the results.
TIMESTAMP = r"(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?|\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
HEX = r"0x[0-9a-fA-F]+|[0-9a-fA-F]{8,}"
NUMBER = r"\d+(?:\.\d+)?"
TOKEN = r"[A-Za-z0-9_]{4,}|[\x{4e00}-\x{9fff}]{2,}"
LEVEL = r"(?i)\b(TRACE|VERBOSE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERR(?:OR)?|FATAL|CRIT(?:ICAL)?|PANIC)\b"
LEVEL_ALIASES = {"WARNING": "WARN", "ERR": "ERROR", "CRIT": "CRITICAL"}
TEMPLATE_ORDER = ((TIMESTAMP, "<TS>"), (IPV4, "<IP>"), (HEX, "<HEX>"), (NUMBER, "<NUM>"))
VALUE_ORDER = ((IPV4, "<IP>"), (HEX, "<HEX>"), (TIMESTAMP, "<TS>"), (NUMBER, "<NUM>"))
SAMPLE_CHARS = 300
LINE_BREAK = r"\r\n|\n|\r"


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def template(text: Column, normalizers: tuple[tuple[str, str], ...] = ()) -> Column:
    """A record's shape: format rules first, then times, addresses, hex and numbers as tags."""
    for pattern, tag in (*normalizers, *TEMPLATE_ORDER):
        text = F.regexp_replace(text, pattern, tag)
    return squeeze(text)


def values(text: Column) -> Column:
    """The raw values behind the tags: array of (tag, value), each kind found in what the kinds before it left."""

    def tagged(tag: str) -> Callable[[Column], Column]:
        return lambda value: F.struct(F.lit(tag).alias("tag"), value.alias("value"))

    parts = []
    for pattern, tag in VALUE_ORDER:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), tagged(tag)))
        text = F.regexp_replace(text, pattern, tag)
    return F.concat(*parts)


def tokens(text: Column, header: str | None = None, token: str = TOKEN) -> Column:
    """The distinct tokens of a record, first seen first; ``header`` is cut from the start of each line."""
    body = F.regexp_replace(text, f"(?m)^(?:{header})", "") if header else text
    return F.array_distinct(F.regexp_extract_all(body, F.lit(f"({token})"), 1))


def level(text: Column, *fields: Column) -> Column:
    """Severity: the first field that says one, else the first level word of the text."""
    found = F.coalesce(*[F.when(F.trim(f.cast("string")) != "", F.trim(f.cast("string"))) for f in fields], F.nullif(F.regexp_extract(text, LEVEL, 1), F.lit("")))
    upper = F.upper(found)
    for alias, name in LEVEL_ALIASES.items():
        upper = F.when(upper == alias, name).otherwise(upper)
    return F.substring(upper, 1, 32)


def hit_lines(text: Column, start_line: Column, term: Column) -> Column:
    """Line numbers of the record's lines that contain the term."""
    lines = F.split(text, LINE_BREAK, -1)
    places = F.transform(lines, lambda line, i: F.when(F.contains(line, term), start_line + i))
    return F.array_compact(places)


def clip(text: Column, chars: int) -> Column:
    """The first ``chars`` characters, with a note of how many were cut."""
    cut = F.concat(F.substring(text, 1, chars), F.lit(" …[+"), (F.length(text) - chars).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > chars, cut).otherwise(text)


def bounded(text: Column, chars: int = 256) -> Column:
    """struct(value, truncated): at most ``chars`` characters."""
    return F.struct(F.substring(text, 1, chars).alias("value"), F.coalesce(F.length(text) > chars, F.lit(False)).alias("truncated"))


def one_line(text: Column) -> Column:
    """Tabs and line breaks as spaces, null as empty: a cell of a tab-separated table."""
    return F.translate(F.coalesce(text, F.lit("")), "\t\r\n", "   ")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("long")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def evidence_uri(digest: Column, first: Column, last: Column) -> Column:
    """evidence://sha256/<digest>#L<a>[-L<b>]"""
    end = F.when(last > first, F.concat(F.lit("-L"), last.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("evidence://sha256/"), digest, F.lit("#L"), first.cast("string"), end)


def event_id(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-1 over the parts joined by bars; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def search_text(category: Column, name: Column, label: Column, text: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (category, name, label, text)])


def label(text: Column, chars: int = 240) -> Column:
    """The first line that is not blank, shortened."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK, -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.get(lines, 0), 1, chars)


def safe_tag(name: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; anything else is an underscore."""
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, 64)
