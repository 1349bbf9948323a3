from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.mini import TABLES, edit, feed as make, queries, rows
from tramline.functions import times
from tramline.operators import calendar as cal

ZONE = "Atlantic/Azores"


def test_gtfs_seconds(spark):
    cases = [("08:40:00", 31200), ("24:35:00", 88500), ("7:05:09", 25509), (" 07:05:09", 25509), ("125:00:01", 450001),
             ("07:05", None), ("", None), (None, None), ("x:y:z", None), ("7:5:", None), ("1:2:3:4", None), ("-7:00:00", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.s for r in df.select("i", times.gtfs_seconds(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [s for _, s in cases]


def test_format_pads_and_does_not_wrap(spark):
    df = spark.createDataFrame([(88500,), (61,), (450001,), (None,)], "s int")
    assert [r[0] for r in df.select(times.gtfs_time(F.col("s"))).collect()] == ["24:35:00", "00:01:01", "125:00:01", None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dates(date(2021, 1, 1), date(2031, 12, 31)), min_size=20, max_size=60))
def test_day_start_is_noon_minus_twelve_hours(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(times.day_start(F.col("d"), F.lit(ZONE))).collect()]
    assert got == [int((datetime(d.year, d.month, d.day, 12, tzinfo=ZoneInfo(ZONE)).astimezone(timezone.utc)
                        - timedelta(hours=12)).timestamp()) for d in days]


def test_day_start_on_clock_changes(spark):
    """Clocks go forward on 2027-03-28 and back on 2027-10-31."""
    df = spark.createDataFrame([(date(2027, 3, 28),), (date(2027, 10, 31),)], "d date")
    got = [r[0] for r in df.select(times.local_iso(times.day_start(F.col("d"), F.lit(ZONE)), F.lit(ZONE))).collect()]
    assert got == ["2027-03-27T23:00:00-01:00", "2027-10-31T00:00:00-01:00"]


def services_on(feed, day):
    out = cal.service_calendar(feed.calendar(), feed.calendar_dates())
    return {(r.service_id, r.origin) for r in out.filter(F.col("service_date") == day).collect()}


def test_week_holiday_and_feast(feed):
    assert services_on(feed, "2027-05-12") == {("work", "weekly")}
    assert services_on(feed, "2027-06-10") == {("rest", "exception")}
    assert services_on(feed, "2027-07-10") == {("rest", "weekly"), ("feast", "exception")}
    assert services_on(feed, "2027-11-03") == set()


def test_a_removal_wins_and_unknown_types_remove(spark):
    f = make(spark, calendar_dates="service_id,date,exception_type\nwork,20270512,1 \nwork,20270512,2\n"
                                   "feast,20270512,7\nrest,20270512, 1")
    assert services_on(f, "2027-05-12") == {("rest", "exception")}


def test_one_of_the_two_files_is_enough(spark):
    assert services_on(make(spark, drop=("calendar",)), "2027-06-10") == {("rest", "exception")}
    assert services_on(make(spark, drop=("calendar_dates",)), "2027-06-10") == {("work", "weekly")}


def test_candidate_days_reach_two_days_back(spark, feed):
    q = queries(spark, ("q", "410", "2027-05-12T23:15:00+00:00", 60))
    assert rows(cal.candidate_dates(q, feed.zones()), "service_date") == [(date(2027, 5, d),) for d in (10, 11, 12, 13)]


def test_service_day_candidates_after_midnight(spark, feed):
    q = queries(spark, ("q", "410", "2027-05-13T00:35:00+00:00", 60))
    assert rows(cal.service_day_candidates(q, feed.zones()), "service_date", "gtfs_time", "plausible", "after_midnight") == [
        (date(2027, 5, 12), "24:35:00", True, True), (date(2027, 5, 13), "00:35:00", True, False)]


def test_coverage(spark, feed):
    def days(*texts):
        return feed.zones().select("feed_id", "snapshot_id", F.explode(F.array(*[
            F.lit(t).cast("date") for t in texts])).alias("today"))

    out = cal.feed_coverage(feed.calendar(), feed.calendar_dates(), days("2027-10-21", "2027-10-25", "2027-11-02"), feed.feed_info())
    assert rows(out, "days_remaining", "expired", "warn") == [(-2, True, True), (6, False, True), (10, False, False)]
    f = make(spark, drop=("calendar", "calendar_dates"))
    assert rows(cal.feed_coverage(f.calendar(), f.calendar_dates(), days("2027-05-12")), "days_remaining", "expired") == [(None, False)]


def test_late_night_lists_every_call_and_ranks_on_request(spark):
    f = make(spark, **edit("stop_times", "c1,08:52:00,08:52:00", "c1,9:52:00,9:52:00"))
    totals, calls = cal.late_night(f.stop_times(), f.trips())
    assert rows(totals, "total_calls", "max_time", "distinct_trips") == [(2, "24:50:00", 1)]
    assert rows(calls, "departure_time") == [("24:35:00",), ("24:50:00",)]
    many = make(spark, stop_times=TABLES["stop_times"] + "".join(f"\nc9,25:{i:02}:00,25:{i:02}:00,hall,{i + 30},0,0" for i in range(60)))
    totals, calls = cal.late_night(many.stop_times(), many.trips())
    assert calls.count() == totals.first().total_calls == 62
    assert rows(cal.late_night(many.stop_times(), many.trips(), limit=2)[1], "rank", "departure_time") == [(1, "25:59:00"), (2, "25:58:00")]
