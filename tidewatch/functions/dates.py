"""Column expressions over dates, durations and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone names that stand for no offset, the years that count, and the widest offset in hours (fixed values).
NO_OFFSET, YEARS, WIDEST_H = ("UT", "UTC", "GMT", "Z"), (1990, 2200), 14
#: Spark's formats of an instant with its zone: an ISO one, and that of mail.
ISO, MAIL = "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX][XX]", "d MMM yyyy HH:mm:ss [XXX][XX]"


def _zoned(text: Column, pattern: str) -> Column:
    """The instant of a text in a format with a zone; null where the zone is missing or lies over 14 hours from UTC."""
    at = lambda t: F.unix_millis(F.try_to_timestamp(t, F.lit(pattern)))
    zone = F.regexp_extract(text, r"(Z|[+-]\d\d:?\d\d)$", 0)
    wall = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(zone)), F.lit("Z"))
    both = F.array(F.struct(at(text).alias("instant"), at(wall).alias("wall")))  # an array holds what is used more than once
    near = F.filter(both, lambda x: F.abs(x["wall"] - x["instant"]) <= WIDEST_H * 3_600_000)
    return F.when(zone != "", F.timestamp_millis(F.get(near, F.lit(0))["instant"]))


def _from_iso(text: Column) -> Column:
    # capitals alone: Spark's formats would take a small t or z too; digits beyond milliseconds go
    return F.when(text.like("____-__-__T%") & (text == F.upper(text)), _zoned(F.regexp_replace(text, r"(\.\d{3})\d+", "$1"), ISO))


def _from_day(text: Column) -> Column:
    return F.when((F.length(text) == 10) & text.like("____-__-__"), _zoned(F.concat(text, F.lit("T00:00:00Z")), ISO))


def _from_mail(text: Column) -> Column:
    """Words: perhaps a weekday and a comma, then day, month, year, time and zone."""
    comma = F.substring(text, 4, 1) == ","
    words = F.split(F.when(comma & F.substring(text, 1, 3).rlike("^[A-Za-z]+$"), F.ltrim(F.substring(text, 5, 99))).otherwise(text), r"\s+")
    day, month, year, time, zone = (F.get(words, F.lit(i)) for i in range(5))
    century = F.when(F.length(year) == 2, F.when(year <= "49", "20").otherwise("19")).otherwise("")
    sizes = (F.size(words) == 5) & (F.length(day) <= 2) & F.length(year).isin(2, 4)
    plain = F.when(F.upper(zone).isin(*NO_OFFSET), "Z").otherwise(zone)
    return F.when(sizes & ~zone.contains(":"), _zoned(F.concat_ws(" ", day, month, F.concat(century, year), time, plain), MAIL))


def _from_epoch(text: Column) -> Column:
    digits = (F.translate(text, "0123456789", "") == "") & F.length(text).between(1, 11)
    return F.when(digits, F.timestamp_seconds(text.try_cast("bigint")))


def publication_date(text: Column) -> Column:
    """Instant of a publication date, first form that fits: ISO 8601 with a zone (milliseconds cut),
    date only (midnight UTC), the form of mail (two-digit years up to 49 are 20xx; numeric and UTC
    zones), epoch seconds. No such calendar time, an offset over 14:00 or a year outside 1990 to 2200: null."""
    s = F.trim(text)
    found = F.array(F.coalesce(_from_iso(s), _from_day(s), _from_mail(s), _from_epoch(s)))
    return F.get(F.filter(found, lambda at: F.year(at).between(*YEARS)), F.lit(0))


def duration_ms(text: Column) -> Column:
    """Milliseconds of ``<number>m``, ``h`` or ``d``; null for others and for none."""
    n, unit = F.regexp_extract(text, r"^(\d+)([mhd])$", 1).try_cast("bigint"), F.regexp_extract(text, r"^(\d+)([mhd])$", 2)
    size = F.when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return F.when(n > 0, n * size)


def elapsed(since: Column, until: Column) -> Column:
    """Minutes below an hour, hours below 48, then days, as text."""
    ms = F.unix_millis(until) - F.unix_millis(since)
    count = lambda unit: F.floor(ms / unit).cast("bigint").cast("string")
    return F.when(ms < 3_600_000, F.concat(count(60_000), F.lit("m"))).when(ms < 48 * 3_600_000, F.concat(count(3_600_000), F.lit("h"))).otherwise(F.concat(count(86_400_000), F.lit("d")))


def age_clause(published: Column, first_seen: Column, now: Column) -> Column:
    """How old an item is at ``now``, in words."""
    undated = F.concat(F.lit("undated, first seen "), elapsed(first_seen, now), F.lit(" ago"))
    return F.when(published.isNull(), undated).when(published > now, "dated after this note").otherwise(F.concat(elapsed(published, now), F.lit(" old")))


def within_days(published: Column, now: Column, days) -> Column:
    """Dated, and at most ``days`` old; the future passes."""
    return F.coalesce(F.unix_millis(now) - F.unix_millis(published) <= F.lit(days) * F.lit(86_400_000).cast("long"), F.lit(False))
