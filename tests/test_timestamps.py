from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswerk.functions.instants import parse_instant
from presswerk.operators.timestamps import normalise_instants


def utc(*parts) -> int:
    return int(datetime(*parts, tzinfo=UTC).timestamp())


@pytest.mark.parametrize(
    ("raw", "zone", "order", "want"),
    [
        ("2024-01-22T10:17:54-08:00", "UTC", "dmy", utc(2024, 1, 22, 18, 17, 54)),
        ("2024-01-22t10:17:54.999z", "Asia/Tokyo", "dmy", utc(2024, 1, 22, 10, 17, 54)),
        ("  2024-01-22T10:17:54Z\n", "UTC", "dmy", utc(2024, 1, 22, 10, 17, 54)),
        ("Fri, 19 Jan 2024 23:32:38 EST", "UTC", "dmy", utc(2024, 1, 20, 4, 32, 38)),
        ("Sun, 21 Jan 2024 07:43:12 UT", "Asia/Tokyo", "dmy", utc(2024, 1, 21, 7, 43, 12)),
        ("1705884276", "Asia/Tokyo", "dmy", 1705884276),
        ("1705986753552", "UTC", "dmy", 1705986753),
        ("1705733514.0", "UTC", "dmy", 1705733514),
        ("20240124T064715Z", "UTC", "dmy", utc(2024, 1, 24, 6, 47, 15)),
        ("2/3/2024 2:56 PM", "UTC", "mdy", utc(2024, 2, 3, 14, 56)),
        ("2/3/2024 12:05 AM", "UTC", "dmy", utc(2024, 3, 2, 0, 5)),
        ("06.02.2024, 09:10", "Europe/Berlin", "mdy", utc(2024, 2, 6, 8, 10)),
        ("18. Januar 2024, 21:18 Uhr", "Europe/Berlin", "dmy", utc(2024, 1, 18, 20, 18)),
        ("1er août 2024 à 9h05", "Europe/Paris", "dmy", utc(2024, 8, 1, 7, 5)),
        ("3 de febrero de 2024, 14:13", "Europe/Madrid", "dmy", utc(2024, 2, 3, 13, 13)),
        ("Feb. 25, 2024 at 6:05 p.m. PT", "UTC", "dmy", utc(2024, 2, 26, 2, 5)),
        ("May 5, 2024, 7:45 AM CT", "UTC", "dmy", utc(2024, 5, 5, 12, 45)),
        ("2024-02-21 07:37:03[Europe/London]", "UTC", "dmy", utc(2024, 2, 21, 7, 37, 3)),
        ("2023-11-26 22:35:07 America/New_York", "UTC", "dmy", utc(2023, 11, 27, 3, 35, 7)),
        ("Tue Mar 05 2024 10:00:00 GMT-0500 (EST)", "UTC", "dmy", utc(2024, 3, 5, 15)),
        ("Tue Mar  5 10:00:00 2024", "Europe/Berlin", "dmy", utc(2024, 3, 5, 9)),
        ("14:30, 5 March 2024", "Europe/London", "dmy", utc(2024, 3, 5, 14, 30)),
        ("2:05 PM ET on March 5, 2024", "UTC", "dmy", utc(2024, 3, 5, 19, 5)),
        ("2024-01-23", "Australia/Sydney", "dmy", utc(2024, 1, 22, 13)),
        ("2024-03-10 02:30:00", "America/New_York", "dmy", utc(2024, 3, 10, 7, 30)),  # skipped: forward by the gap
        ("2024-11-03 01:30:00", "America/New_York", "dmy", utc(2024, 11, 3, 5, 30)),  # doubled: first pass
        *[(x, "UTC", "dmy", None) for x in (None, "", "  ", "-", "TBD", "just now", "32.13.2025 25:61", "0000-00-00 00:00:00", "2024-02-30", "12:30", "null")],
    ],
)
def test_forms(raw, zone, order, want):
    assert parse_instant(raw, zone, order) == want


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2060, 1, 1)), st.sampled_from(["UTC", "America/New_York", "Asia/Kolkata", "Australia/Sydney"]))
def test_round_trip_of_written_instants(moment, zone):
    moment = moment.replace(microsecond=0)
    epoch = int(moment.replace(tzinfo=UTC).timestamp())
    assert parse_instant(moment.isoformat() + "Z", zone) == epoch
    assert parse_instant(moment.strftime("%a, %d %b %Y %H:%M:%S GMT"), zone) == epoch
    local = datetime.fromtimestamp(epoch, ZoneInfo(zone))
    assert parse_instant(local.isoformat(), "Asia/Tokyo") == epoch
    if local.fold == 0:
        assert parse_instant(local.replace(tzinfo=None).isoformat(sep=" "), zone) == epoch
    else:
        assert parse_instant(local.replace(tzinfo=None).isoformat(sep=" "), zone) in (epoch, epoch - 3600, epoch - 1800)


ROWS = "row_id bigint, source string, published_at string, fetched_at string, utc string"
ZONES = "name string, tz_name string, date_order string"


def test_operator(spark, tmp_path):
    zones = spark.createDataFrame([("a", "America/New_York", "mdy"), ("b", None, None), ("a", "America/New_York", "mdy")], ZONES)
    rows = spark.createDataFrame(
        [
            (1, "a", "2/3/2024 2:56 PM", "2024-02-03 20:00:00", "x"),
            (1, "a", "2/3/2024 2:56 PM", "2024-02-03 20:00:00", "x"),
            (2, "b", "2024-01-01 00:00:00", None, "x"),
            (3, None, "2024-01-01", "2024-01-01T00:00:00Z", "x"),
            (4, "a", "n/a", "soon", "x"),
        ],
        ROWS,
    )
    path = f"file://{tmp_path}/dictionary"
    got = sorted(map(tuple, normalise_instants(rows, zones, path).select("row_id", "field", "utc").collect()))
    want = [(1, "fetched_at", "2024-02-03T20:00:00Z"), (1, "published_at", "2024-02-03T19:56:00Z")]
    assert got == sorted([*want, *want, (2, "published_at", "2024-01-01T00:00:00Z"), (3, "published_at", "2024-01-01T00:00:00Z")])
    before = spark.read.parquet(path).count()
    more = rows.unionByName(spark.createDataFrame([(9, "a", "1705884276", None, "x")], ROWS))
    again = normalise_instants(more, zones, path, canonical_too=True)
    assert again.where("row_id = 9").first()["utc"] == "2024-01-22T00:44:36Z"
    assert again.where("row_id = 3").count() == 2
    assert spark.read.parquet(path).count() == before + 1  # known values are not parsed again
    assert normalise_instants(rows.limit(0), zones).count() == 0
    assert timedelta(0) == timedelta()
