from datetime import datetime, timezone

import pytest

from tidemill.functions.timestamps import normalise, read_instant


def us(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [
        ("2026-04-30T08:43:42.124997+00:00", None, us(2026, 4, 30, 8, 43, 42) + 124997),
        ("2025-07-10T14:12:44+0100", "Asia/Tokyo", us(2025, 7, 10, 13, 12, 44)),
        ("20260310T045826", "Europe/Berlin", us(2026, 3, 10, 3, 58, 26)),
        ("2026-02-04T04:11:13.005091414Z", None, us(2026, 2, 4, 4, 11, 13) + 5091),
        ("1761710463.0", "Asia/Tokyo", us(2025, 10, 29, 4, 1, 3)),
        ("1762056359731", None, us(2025, 11, 2, 4, 5, 59) + 731000),
        ("２０２５年８月３０日 ２１時２９分 JST", None, us(2025, 8, 30, 12, 29)),
        ("Feb 2, 2026 5:02:24 AM JST", None, us(2026, 2, 1, 20, 2, 24)),
        ("Oct 14, 2025 12:05 AM", "UTC", us(2025, 10, 14, 0, 5)),
        ("Mon, 15 Sep 2025 09:50:34 -0400", None, us(2025, 9, 15, 13, 50, 34)),
        ("2025-06-30T14:46:27+02:00[Europe/Berlin]", "Asia/Tokyo", us(2025, 6, 30, 12, 46, 27)),
        ("22/08/2025 06:26", None, us(2025, 8, 22, 6, 26)),
        ("10/17/2025 03:05", None, us(2025, 10, 17, 3, 5)),
        ("16.03.2026 00:01", "Europe/Berlin", us(2026, 3, 15, 23, 1)),
        ("2 Apr 2026", "Asia/Tokyo", us(2026, 4, 1, 15)),
        (" 2025-12-23T04:40:50+05:45\n", None, us(2025, 12, 22, 22, 55, 50)),
        ("2025-10-26T02:30:00", "Europe/Berlin", us(2025, 10, 26, 0, 30)),  # twice: the earlier
        ("2025-03-30T02:30:00", "Europe/Berlin", us(2025, 3, 30, 1, 30)),  # never: the offset before
        ("2025-11-02T01:50:18.000", "America/New_York", us(2025, 11, 2, 5, 50, 18)),
    ],
)
def test_read(value, zone, want):
    assert read_instant(value, zone)[0] == want or read_instant(value, zone) == (None, want)


@pytest.mark.parametrize("value", ["", "   ", "soon", "N/A", "0000-00-00T00:00:00Z", "2026-02-30 10:00:00", "2026-13-01T00:00:00Z", "2026-01-15T25:61:00Z", "2025-11-31", "9" * 5000, "12345", "2025-01-01 10:00 XYZ"])
def test_invalid(value):
    assert read_instant(value, "Asia/Tokyo") == (None, None)


def test_mixture(spark):
    rows = [(i, "us", f"03/{d}/2026 10:00", "keep") for i, d in enumerate(range(13, 25))] + [(100, "us", "03/04/2026 10:00", "x"), (101, "eu", "25/04/2026", "x"), (102, "new", "05/06/2026", "x")]
    rows += [(103, "us", None, "x"), (104, None, "junk", "x"), (105, "us", "07/07/2026", "x"), (105, "us", "07/07/2026", "x")]
    df = spark.createDataFrame(rows, "k int, source string, value string, utc_us string")
    got = {r["k"]: (r["utc_us"], r["time_status"]) for r in normalise(df, "value", None, "source").collect()}
    assert got[100] == (us(2026, 3, 4, 10), "inferred")
    assert got[101] == (us(2026, 4, 25), "read")
    assert got[102][1] == "ambiguous"
    assert got[103] == (None, None) and got[104] == (None, "invalid") and got[105] == (us(2026, 7, 7), "read")
    assert normalise(df, "value", None, "source").count() == len(rows)
    assert normalise(df.limit(0), "value").count() == 0


def test_nothing_is_lost_by_length():
    from tidemill.functions.timestamps import read_instant

    plain = read_instant("2024-03-01T10:00:00Z")
    assert plain[0] and read_instant("2024-03-01T10:00:00Z" + "​" * 300) == plain == read_instant(" " * 5000 + "2024-03-01 10:00:00 UTC　" * 1)
    assert read_instant("2024-03-01T10:00:00Z" + "x" * 300) == (None, None) and read_instant("mon" * 100_000) == (None, None)


def test_zone_abbreviations_are_readings_of_the_mixture(spark):
    from tidemill.functions.timestamps import normalise

    value = "2024-03-01 10:00:00 IST"
    rows = [("a", value, "Asia/Kolkata")] * 6 + [("a", value, None), ("b", value, None), ("c", value, "Asia/Jerusalem")] + [("c", value, None)] + [("c", value, "Asia/Jerusalem")] * 6 + [("d", "2024-03-01 10:00:00 EST", None), ("d", "03/04/2024 10:00 CST", "Asia/Shanghai")]
    df = spark.createDataFrame(rows, "src string, v string, tz string")
    got = {(r["src"], r["tz"]): (r["hour"], r["time_status"]) for r in normalise(df, "v", "tz", "src").selectExpr("src", "tz", "hour(timestamp_micros(utc_us)) AS hour", "time_status").collect()}
    assert got["a", "Asia/Kolkata"] == (4, "read") and got["a", None] == (4, "inferred") and got["b", None][1] == "ambiguous"
    assert got["c", "Asia/Jerusalem"] == (8, "read") and got["c", None] == (8, "inferred") and got["d", None] == (15, "read") and got["d", "Asia/Shanghai"][1] == "ambiguous"
    assert normalise(df, "v", "tz", "src").count() == len(rows)
