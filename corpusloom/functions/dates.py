"""Dates and times as column expressions, in UTC."""

from __future__ import annotations

from datetime import date, datetime, timezone
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import attribute, tags

#: What pages call their date of publication, in the order in which it is believed.
LINKED_DATA = "datePublished"
META_NAMES = ("article:published_time", "datePublished")
#: Fixed value: the class of a header that shows readers a date.
SHOWN_CLASS = "storyDate"


def mail_time(text: str | None) -> datetime | None:
    """An RFC 2822 date; without a zone in UTC; None if it is none."""
    try:
        d = parsedate_to_datetime(text) if text else None
    except (TypeError, ValueError, IndexError):
        return None
    return d and (d.replace(tzinfo=timezone.utc) if d.tzinfo is None else d.astimezone(timezone.utc))


@F.arrow_udf(T.TimestampType())
def mail_date(a: pa.Array) -> pa.Array:
    """RFC 2822 dates; without a zone in UTC; null if it is none."""
    return pa.array([mail_time(x) for x in a.to_pylist()], pa.timestamp("us", "UTC"))


def iso(text: Column) -> Column:
    """ISO 8601 dates and times; without a zone in UTC; null if it is none. A time alone is none: Spark would put it on the
    day of the run."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]{4}"), F.try_to_timestamp(t))


def zoned(text: Column) -> Column:
    """As iso(), but null without a zone."""
    t = F.trim(text)
    return F.when(t.rlike(r"[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"), iso(t))


def meta(page: Column) -> Column:
    """array<struct<name, content>> of a page's meta elements, whatever the order of their attributes."""
    return F.transform(tags(page, "meta"), lambda x: F.struct(attribute(x, "property|itemprop|name").alias("name"), attribute(x, "content").alias("content")))


def _first(values: Column) -> Column:
    """The first of the values that is a time with a zone."""
    return F.get(F.filter(F.transform(values, zoned), lambda x: x.isNotNull()), F.lit(0))


def page_date(page: Column, zone: str | None = None, most: int | None = None) -> Column:
    """The first date with a zone: of linked data, else of the meta elements named META_NAMES; with ``zone`` else the time
    there that the element of SHOWN_CLASS shows. ``most`` characters of a page are searched, all by default."""
    head = page if most is None else F.left(page, F.lit(most))
    said = F.regexp_extract_all(head, F.lit(rf'"{LINKED_DATA}"\s*:\s*"([^"]*)"'), F.lit(1))
    named = meta(head)
    called = lambda name: F.transform(F.filter(named, lambda m: m["name"] == name), lambda m: m["content"])
    tries = [_first(said), *[_first(called(n)) for n in META_NAMES]]
    if zone:
        shown = F.get(F.split(F.get(F.split(head, rf'class="{SHOWN_CLASS}"[^>]*>', 2), F.lit(1)), r"</p\b", 2), F.lit(0))
        tries.append(local(shown, r"(\d+)\.(\d+)\.(\d{4})(?:\D|&#160;)*?(\d+):(\d+)", zone))
    return F.coalesce(*tries)


def local(text: Column, pattern: str, zone: str) -> Column:
    """Day, month, year, hour and minute by the pattern's groups, as the clock shows them in the zone."""
    d, m, y, h, n = (F.try_to_number(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("9999")).cast("int") for i in range(1, 6))
    return F.to_utc_timestamp(F.try_make_timestamp(y, m, d, h, n, F.lit(0)), zone)


def within(ts: Column, first: date, last: date) -> Column:
    """Days first to last, both included, as a range that Parquet readers can skip by."""
    end = F.date_add(F.lit(last), 1)
    return (ts >= F.lit(first).cast("timestamp")) & (ts < end.cast("timestamp"))


def days(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 1 day"))


def round_of(ts: Column, genesis: int, period: int = 30) -> Column:
    """Number of a randomness beacon's round at a time: rounds are ``period`` seconds long, the first is 1."""
    return F.floor((F.unix_seconds(ts) - genesis) / period) + 1


def time_of(number: Column, genesis: int, period: int = 30) -> Column:
    return F.timestamp_seconds((number - 1) * period + genesis)


def beacon_holds(signature: Column, randomness: Column) -> Column:
    """The randomness is the signature's SHA-256, both in hexadecimal digits."""
    return F.sha2(F.unhex(signature), 256) == F.lower(randomness)


def seed_of(randomness: Column, tag: str) -> Column:
    """64 bits of SHA-256 of the randomness (hexadecimal digits of its bytes) and a tag, as a decimal string."""
    return F.conv(F.left(F.sha2(F.concat(F.unhex(randomness), F.encode(F.lit(tag), "UTF-8")), 256), F.lit(16)), 16, 10)
