"""Points in time in uneven notations, brought to microseconds since the epoch in UTC.

A value is read in three parts (date, time of day, zone). The date part may have more than one valid reading (day
before month, month before day). :func:`normalise` learns, for each source, the mixture of those formats by
expectation-maximisation and lets the posterior choose; a choice it can't make with enough confidence is marked
``ambiguous`` instead of being hidden.

The readings come from one Arrow-batched function: as built-in expressions (nine notations, three parts, each used
several times) the plan's projections collapse into generated code beyond the JVM's 64 KB limit for a method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets from UTC in minutes.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NPT": 345, "ICT": 420, "HKT": 480, "SGT": 480, "AWST": 480,
    "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180,
    "BRST": -120, "ART": -180, "NST": -210, "NDT": -150, "ADT": -180, "EST": -300, "EDT": -240,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Abbreviations that stand for more than one zone (India or Israel, British or Bangladesh, US Central or China, Atlantic or Arabia).
ZONE_READINGS = {"IST": (330, 120), "BST": (60, 360), "CST": (-360, 480), "AST": (-240, 180)}
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH_OF = {name: i for i, m in enumerate(_MONTHS, 1) for name in (m, m[:3])} | {"sept": 9}

#: What is left without blanks and invisible characters names no instant when it is longer (the longest notation has fewer than 80 characters).
MAX_CHARS = 200
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0x2212: 0x2D}
_BLANKS = re.compile("[\\s­᠎​-‏⁠-⁤﻿]+")
_PLAIN = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,12}))?(Z|z|[+-]\d\d:?\d\d)?")
_EPOCH = re.compile(r"(-?)(\d{13}|\d{10})(?:\.(\d+))?")
_DATE = (
    r"(?:(?P<y1>\d{4})(?P<s>[-/.])(?P<m1>\d{1,2})(?P=s)(?P<d1>\d{1,2})"
    r"|(?P<y2>\d{4}) ?年 ?(?P<m2>\d{1,2}) ?月 ?(?P<d2>\d{1,2}) ?日"
    r"|(?P<y3>\d{4})(?P<m3>\d\d)(?P<d3>\d\d)"
    r"|(?P<a>\d{1,2})(?P<r>[-/.])(?P<b>\d{1,2})(?P=r)(?P<y4>\d{4})"
    r"|(?P<d5>\d{1,2})(?:st|nd|rd|th)?[ -](?P<m5>[A-Za-z]{3,9})\.?,?[ -](?P<y5>\d{4})"
    r"|(?P<m6>[A-Za-z]{3,9})\.? (?P<d6>\d{1,2})(?:st|nd|rd|th)?,? (?P<y6>\d{4}))"
)
_TIME = (
    r"(?:(?P<half>午前|午後)?(?P<H>\d{1,2}):(?P<M>\d\d)(?::(?P<S>\d\d)(?:[.,](?P<f>\d{1,12}))?)?(?: ?(?P<ap>[AaPp])\.?[Mm]\.?)?"
    r"|(?P<jhalf>午前|午後)?(?P<jH>\d{1,2}) ?時(?: ?(?P<jM>\d{1,2}) ?分(?: ?(?P<jS>\d{1,2}) ?秒)?)?"
    r"|(?P<cH>\d\d)(?P<cM>\d\d)(?P<cS>\d\d)?(?:[.,](?P<cf>\d{1,12}))?)"
)
_ZONE = r"(?:(?P<word>[A-Za-z]{1,5})?(?P<off>[+-]\d{1,2}(?::?\d\d)?)?)? ?(?:\[(?P<region>[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\])?"
_WHOLE = re.compile(
    rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? )?{_DATE}(?:(?: ?[Tt,] ?| (?:at )?|(?<=日)|(?<=\d{{8}})){_TIME})?(?: ?{_ZONE})?", re.IGNORECASE
)
_EPOCH_DAY = date(1970, 1, 1).toordinal()


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _micros(digits: str | None) -> int:
    return int((digits + "000000")[:6]) if digits else 0


def _to_utc(days: int, day_us: int, zone: str | None, offset_us: int | None) -> int | None:
    """A local reading as UTC. A local time that occurs twice is the earlier instant; one that never occurs is read with the offset before the change (Python's fold=0 is just that)."""
    local = days * 86_400_000_000 + day_us
    if offset_us is not None:
        return local - offset_us
    tz = _zone(zone) if zone else None
    if tz is None:
        return local
    try:
        at = datetime.fromordinal(days + _EPOCH_DAY) + timedelta(microseconds=day_us)
        return local - round(at.replace(tzinfo=tz).utcoffset() / timedelta(microseconds=1))
    except OverflowError:
        return None


def _days(y: str, m: str | int, d: str) -> int | None:
    try:
        return date(int(y), int(m), int(d)).toordinal() - _EPOCH_DAY
    except ValueError:
        return None


def read_instant(value: str | None, zone: str | None = None) -> tuple[int | None, int | None]:
    """(main, alternative) readings of one value in UTC microseconds.

    The alternative is month before day, or the second zone of an abbreviation that has two; where the name in ``zone``
    has the offset of one of these at that time, only that reading is valid.
    """
    if value is None:
        return None, None
    if (m := _PLAIN.fullmatch(value)) is None:
        value = _BLANKS.sub(" ", value.translate(_WIDE)).strip()
        if len(value) > MAX_CHARS:
            return None, None
        if m := _EPOCH.fullmatch(value):
            scale = 1_000_000 if len(m[2]) == 10 else 1_000
            us = int(m[2]) * scale + (_micros(m[3]) if scale == 1_000_000 else 0)
            return (-us if m[1] else us), None
        m = _PLAIN.fullmatch(value)
    if m is not None:
        y, mo, d, hh, mm, ss, frac, off = m.groups()
        days = _days(y, mo, d)
        if days is None or hh > "23" or mm > "59" or ss > "59":
            return None, None
        day_us = (int(hh) * 3600 + int(mm) * 60 + int(ss)) * 1_000_000 + _micros(frac)
        return _to_utc(days, day_us, zone, _offset(off)), None
    m = _WHOLE.fullmatch(value)
    if m is None:
        return None, None
    g = m.groupdict()
    main = other = None
    if g["y1"] or g["y2"] or g["y3"]:
        k = "1" if g["y1"] else "2" if g["y2"] else "3"
        main = _days(g["y" + k], g["m" + k], g["d" + k])
    elif g["y4"]:
        main, other = _days(g["y4"], g["b"], g["a"]), _days(g["y4"], g["a"], g["b"])
    else:
        k = "5" if g["y5"] else "6"
        main = _days(g["y" + k], _MONTH_OF.get(g["m" + k].lower(), 0), g["d" + k])
    if main is None and other is None:
        return None, None
    hour, minute, second = (int(g[x] or g["j" + x] or g["c" + x] or 0) for x in "HMS")
    half = {"A": 0, "P": 1}.get((g["ap"] or "").upper(), {"午前": 0, "午後": 1}.get(g["half"] or g["jhalf"] or "", None))
    if half is not None:
        if hour > 12 or (hour == 0 and g["ap"]):
            return None, None
        hour = hour % 12 + 12 * half
    if hour > 23 or minute > 59 or second > 59:
        return None, None
    day_us = (hour * 3600 + minute * 60 + second) * 1_000_000 + _micros(g["f"] or g["cf"])
    offset = None
    if g["off"]:
        offset = _offset(g["off"])
        if offset is None or (g["word"] and g["word"].upper() not in ("UTC", "GMT")):
            return None, None
    elif g["word"] and g["word"].upper() in ZONE_READINGS:
        day = other if main is None else main
        one, two = (_to_utc(day, day_us, None, x * 60_000_000) for x in ZONE_READINGS[g["word"].upper()])
        if main is None or other is None or main == other:
            named = _to_utc(day, day_us, zone, None) if zone and _zone(zone) else None
            return (one, None) if named == one else (None, two) if named == two else (one, two)
        offset = ZONE_READINGS[g["word"].upper()][0] * 60_000_000
    elif g["word"]:
        minutes = ZONE_MINUTES.get(g["word"].upper())
        if minutes is None:
            return None, None
        offset = minutes * 60_000_000
    elif g["region"]:
        zone = g["region"]
        if _zone(zone) is None:
            return None, None
    a = None if main is None else _to_utc(main, day_us, zone, offset)
    b = None if other is None else _to_utc(other, day_us, zone, offset)
    return a, b


def _offset(text: str | None) -> int | None:
    if not text:
        return None
    if text in ("Z", "z"):
        return 0
    digits = text[1:].replace(":", "")
    hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    if hours > 18 or minutes > 59:
        return None
    return (hours * 60 + minutes) * (-60_000_000 if text[0] == "-" else 60_000_000)


def _readings(values: pd.Series, zones: pd.Series) -> pd.DataFrame:
    found = [read_instant(v, z) for v, z in zip(values, zones)]
    return pd.DataFrame({"main": pd.array([x[0] for x in found], "Int64"), "alt": pd.array([x[1] for x in found], "Int64")})


@dataclass(frozen=True)
class MixtureParams:
    """Parameters of the per-source format mixture."""

    rounds: int = 30
    #: weight, in values, of even shares against one source's own values
    prior_values: float = 2.0
    #: likelihood of a reading before 2000 or after 2100, relative to one between
    off_range: float = 0.01
    #: a posterior below this leaves the value marked ambiguous (its likelier reading is still given)
    sure: float = 0.8


_RANGE_US = (946_684_800_000_000, 4_102_444_800_000_000)


def _em(rounds: int, start: Column, known_a: Column, known_b: Column, open_ab: Column, weight: float) -> Column:
    """The share of format A after some rounds of expectation-maximisation over one source's counts."""

    def step(share: Column, _: Column) -> Column:
        return (known_a + open_ab * share + start * weight) / (known_a + known_b + open_ab + weight)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def normalise(
    df: DataFrame, value: str, zone: str | None = None, source: str | None = None, params: MixtureParams = MixtureParams()
) -> DataFrame:
    """Adds ``utc_us`` (bigint) and ``time_status`` to ``df``.

    ``time_status`` is ``read`` (one valid reading), ``inferred`` (two; the source's format mixture decided with
    a posterior of at least ``params.sure``), ``ambiguous`` (two, and the mixture doesn't tell: the likelier reading is
    given), ``invalid`` (no reading) or null (the value is null). Empty, blank and very long values are ``invalid``;
    repeated rows are kept; an empty table gives an empty table. A zone in the value counts, else the name in ``zone``,
    else UTC; unknown names count as UTC. Columns of ``df`` named like the two added ones are replaced; all others are
    kept as they are.

    Only values of the shape ``a/b/yyyy`` and those with one of a few zone abbreviations can have two readings; each of
    these has its own mixture. Their statistics are three counts per source,
    aggregated map-side; the mixture of each source is fitted inside the JVM on those counts and joined back to the
    open values only, so no other row is shuffled, whatever the size of a source.
    """
    keep = [c for c in df.columns if c not in ("utc_us", "time_status")]
    df = df.select(*keep)
    zones = F.col(zone).cast("string") if zone else F.lit(None).cast("string")
    # non-deterministic for the optimizer only: filters on the result then don't call it a second time
    read = F.pandas_udf(_readings, "main bigint, alt bigint").asNondeterministic()(F.col(value).cast("string"), zones)
    main, alt = F.col("__tm_r.main"), F.col("__tm_r.alt")
    two = main.isNotNull() & alt.isNotNull() & (main != alt)
    known = df.withColumn("__tm_r", read)
    settled = known.where(~two).select(
        *keep,
        F.coalesce(main, alt).alias("utc_us"),
        F.when(F.col(value).isNull(), None).when(F.coalesce(main, alt).isNull(), "invalid").otherwise("read").alias("time_status"),
    )
    # a superset of the values with two readings, told apart before any Python is called; full-width digits and letters count
    slashed = F.col(value).cast("string").rlike(r"(?U)\d{1,2}\s*[-/.／．－−]\s*\d{1,2}\s*[-/.／．－−]\s*\d{4}")
    shortened = F.upper(F.regexp_extract(F.translate(F.col(value).cast("string"), "ＩＢＣＡＳＴｉｂｃａｓｔ", "IBCASTibcast"), r"(?i)(?<![a-z])([IBCA]ST)(?![a-z])", 1))
    origin = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    maybe = df.where(slashed | (shortened != "")).withColumn("__tm_src", F.struct(origin.alias("s"), shortened.alias("z"))).withColumn("__tm_r", read)
    stats = maybe.groupBy("__tm_src").agg(
        F.count_if(main.isNotNull() & (alt.isNull() | (main == alt))).cast("double").alias("na"),
        F.count_if(main.isNull() & alt.isNotNull()).cast("double").alias("nb"),
        F.count_if(two).cast("double").alias("no"),
    )
    mixed = stats.where("no > 0").select(
        "__tm_src", _em(params.rounds, F.lit(0.5), F.col("na"), F.col("nb"), F.col("no"), params.prior_values).alias("__tm_share")
    )
    likely = lambda c: F.when(c.between(*_RANGE_US), 1.0).otherwise(params.off_range)
    a, b = F.col("__tm_share") * likely(main), (1 - F.col("__tm_share")) * likely(alt)
    opened = (
        maybe.where(two)
        .join(mixed, "__tm_src")
        .withColumn("__tm_post", a / (a + b))
        .select(
            *keep,
            F.when(F.col("__tm_post") >= 0.5, main).otherwise(alt).alias("utc_us"),
            F.when(F.greatest("__tm_post", 1 - F.col("__tm_post")) >= params.sure, "inferred").otherwise("ambiguous").alias("time_status"),
        )
    )
    return settled.unionByName(opened)
