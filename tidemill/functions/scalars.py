"""Scalar expressions on URLs, ages and numbers. Every one that needs a clock takes it as ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def safe_https(url: Column, most: int = 2048) -> Column:
    """The URL without its fragment; null unless it is https, names no user, isn't too long and has a path below the root."""
    fine = url.rlike(r"^https://[^/?#@\s]+/[^?#\s]") & (F.length(url) <= most)
    return F.when(fine, F.regexp_replace(url, "#.*$", ""))


def under(name: Column, suffix: str) -> Column:
    """Whether a host is the suffix or below it."""
    return (name == suffix) | F.endswith(name, F.lit("." + suffix))


def first_host_rule(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule (suffix, label) the host falls under."""
    return F.coalesce(*[F.when(under(name, s), F.lit(label)) for s, label in rules])


def stable_id(url: Column, prefix: str = "apply-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(url, 256), 1, 24))


def query_value(url: Column, name: str) -> Column:
    """A query parameter's decoded value."""
    return F.try_url_decode(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))


def viewed_id(url: Column, host_suffix: str, name: str = "jk") -> Column:
    """The id in a detail page's URL; null unless scheme, host, path and id are right."""
    value = query_value(url, name)
    return F.when(F.startswith(url, F.lit("https://")) & under(host(url), host_suffix) & path(url).rlike("^/viewjob/?$") & value.rlike("^[A-Za-z0-9_-]{6,128}$"), value)


# Units of relative ages and their length in minutes, in the order in which they are tried, and whole values that mean now.
_UNITS = (("分|minutes?", 1), ("時間|hours?|hrs?", 60), ("日|days?", 1440), ("週|weeks?", 10080), ("か月|ヶ月|ヵ月|months?", 43200))
_NOW = ("新着", "たった今", "just posted", "today")
_MANY_DAYS = 31


def relative_minutes(text: Column) -> Column:
    """The age that a relative date names, in minutes; ``5+ days ago`` and ``5日以上前`` are at least 31 days; null when it names none."""
    plain = F.trim(F.lower(F.translate(text, "０１２３４５６７８９＋", "0123456789+")))
    open_ended = F.contains(plain, F.lit("+")) | F.contains(plain, F.lit("以上"))
    days = lambda n: F.when(open_ended & (n < _MANY_DAYS), _MANY_DAYS).otherwise(n) * 1440
    cases = [F.when(plain.isin(*_NOW), F.lit(0))]
    for unit, minutes in _UNITS:
        number = F.regexp_extract(plain, rf"(\d+)\s*(?:{unit})", 1).try_cast("int")
        cases.append(days(number) if minutes == 1440 else number * minutes)
    cases.append(days(F.regexp_extract(plain, r"(\d+)\+?\s*days?\s*ago", 1).try_cast("int")))
    return F.coalesce(*cases)


# Confidence by age in days (each bound inside its step), beyond the last step, and of an unknown age.
FRESHNESS_STEPS, FRESHNESS_REST, FRESHNESS_UNKNOWN = ((1, 98), (3, 92), (7, 84), (14, 70), (30, 52), (60, 34)), 18, 40


def freshness(age_days: Column, seen_count: Column | None = None, seen_days_ago: Column | None = None) -> Column:
    """A confidence by age. A row seen before gains twice its count (1 where that is null or 0), 10 at most, and 5 more if last seen within three days."""
    out = F.lit(FRESHNESS_REST)
    for bound, value in reversed(FRESHNESS_STEPS):
        out = F.when(F.greatest(F.lit(0.0), age_days) <= bound, value).otherwise(out)
    out = F.when(age_days.isNull(), FRESHNESS_UNKNOWN).otherwise(out)
    if seen_count is None:
        return out
    again = F.least(F.lit(10), 2 * F.when(seen_count != 0, seen_count).otherwise(1))
    recent = F.when(seen_days_ago <= 3, 5).otherwise(0) if seen_days_ago is not None else F.lit(0)
    return clamp(out + again + recent)


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    """Rounded half to even and held inside the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(x).cast("int")))


def non_negative(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(x.cast("string").try_cast("double"), F.lit(0.0)))


def days_left(day: Column) -> Column:
    """Days left in the month, this one included."""
    return F.greatest(F.lit(1), F.datediff(F.add_months(F.trunc(day, "MM"), 1), day))


def paced(used: Column, cap: int, day: Column) -> Column:
    """What may be spent today so that the month's rest lasts: at least 1 until the cap is reached, then 0."""
    rest = F.lit(cap) - used
    return F.when(rest <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(rest / days_left(day)).cast("int")))


def ladder(x: Column, steps: Sequence[tuple[int, int]], rest: int) -> Column:
    """The value of the first step (below, value) that x lies below."""
    out = F.lit(rest)
    for below, value in reversed(steps):
        out = F.when(x < below, value).otherwise(out)
    return out


def headroom(used: Column, hourly: int, reserve: int, left: Column) -> Column:
    """The smaller of what an hour and what the whole plan still allow; an unknown bound doesn't count."""
    return F.greatest(F.lit(0), F.least(F.lit(hourly) - used - F.lit(reserve), left))
