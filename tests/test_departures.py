"""Boards of the mini feed; its island is at UTC in summer and an hour behind in winter."""

from datetime import date

from pyspark.sql import functions as F

from tests.mini import TABLES, edit, feed as make, queries, rows
from tramline.operators import departures as dep
from tramline.operators import stops as st
from tramline.sources.feeds import Feed

MORNING = "2027-05-12T08:30:00+00:00"  # a Wednesday


def board(spark, feed, *qs, limit=None):
    return dep.departures(queries(spark, *qs), feed, limit)


def test_morning_board(spark, feed):
    out = board(spark, feed, ("q", "410", MORNING, 60))
    assert rows(out, "rank", "trip_id", "minutes_away", "departure_local", "total") == [
        (1, "c1", 10, "2027-05-12T08:40:00+00:00", 2), (2, "h1", 14, "2027-05-12T08:44:00+00:00", 2)]


def test_nothing_is_cut_unless_asked(spark):
    extra = "\n".join(f"x{i},09:{i // 60:02}:{i % 60:02},09:{i // 60:02}:{i % 60:02},gate,1,0,0" for i in range(130))
    f = make(spark, stop_times=TABLES["stop_times"] + "\n" + extra,
             trips=TABLES["trips"] + "\n" + "\n".join(f"coast,work,x{i},Hall,0" for i in range(130)))
    q = ("q", "410", MORNING, 60)
    assert board(spark, f, q).agg(F.count("*"), F.max("rank"), F.min("total")).first()[:] == (132, 132, 132)
    assert rows(board(spark, f, q, limit=3), "rank", "total") == [(1, 132), (2, 132), (3, 132)]


def test_night_bus_belongs_to_the_day_before(spark, feed):
    out = board(spark, feed, ("q", "420", "2027-05-13T00:20:00+00:00", 45))
    assert rows(out, "trip_id", "service_date", "gtfs_time", "after_midnight", "minutes_away") == [
        ("c9", date(2027, 5, 12), "24:50:00", True, 30)]


def test_both_ends_of_the_window_count(spark, feed):
    at = "2027-05-12T08:40:00+00:00"
    assert rows(board(spark, feed, ("q", "410", at, 4)), "trip_id") == [("c1",), ("h1",)]
    assert rows(board(spark, feed, ("q", "410", at, 3)), "trip_id") == [("c1",)]


def test_last_stop_without_pickup(spark, feed):
    q = ("q", "430", MORNING, 60)
    assert board(spark, feed, q).count() == 0
    short = "\n".join(",".join(line.split(",")[:5]) for line in TABLES["stop_times"].split("\n"))
    assert rows(board(spark, make(spark, stop_times=short), q), "trip_id") == [("c1",)]


def test_a_station_stands_for_its_sides(spark, feed):
    out = board(spark, feed, ("q", "500", MORNING, 60))
    assert rows(out, "stop_id", "trip_id") == [("top-n", "h1"), ("top-s", "h2")]


def test_holiday_and_feast_services(spark, feed):
    out = board(spark, feed, ("holiday", "410", "2027-06-10T08:30:00+00:00", 120),
                ("feast", "440", "2027-07-10T10:45:00+00:00", 30), ("any", "440", MORNING, 300))
    assert rows(out, "query_id", "trip_id") == [("feast", "s1"), ("holiday", "r1")]


def test_route_filter_takes_ids_and_badges(spark, feed):
    out = board(spark, feed, *((n, "410", MORNING, 60, n) for n in ("hill", "T", "7", "sail")))
    assert rows(out, "query_id", "trip_id") == [("7", "c1"), ("T", "h1"), ("hill", "h1")]


def test_headsign_of_the_call_wins(spark):
    header, *lines = TABLES["stop_times"].split("\n")
    text = "\n".join([header + ",stop_headsign", *(x + ("," if "gate" not in x else ",via Quay") for x in lines)])
    out = board(spark, make(spark, stop_times=text), ("a", "410", MORNING, 60), ("b", "420", MORNING, 60))
    assert rows(out, "query_id", "trip_id", "headsign") == [
        ("a", "c1", "via Quay"), ("a", "h1", "via Quay"), ("b", "c1", "Lighthouse"), ("b", "h2", "Hilltop")]


def test_repeated_hour_measures_elapsed_time(spark):
    """On 2027-10-31 at 01:00 the clock goes back to 00:00. Saturday's service counts from
    its noon less twelve hours, so 24:40 is the first 00:40 and 25:40 the second."""
    f = make(spark, stop_times=TABLES["stop_times"] + "\nr1,24:40:00,24:40:00,quay,30,0,0\nr1,25:40:00,25:40:00,quay,40,0,0")
    out = board(spark, f, ("first", "440", "2027-10-31T00:10:00+00:00", 120),
                ("second", "440", "2027-10-31T00:10:00-01:00", 45))
    assert rows(out, "query_id", "gtfs_time", "minutes_away", "departure_local") == [
        ("first", "24:40:00", 30, "2027-10-31T00:40:00+00:00"),
        ("first", "25:40:00", 90, "2027-10-31T00:40:00-01:00"),
        ("second", "25:40:00", 30, "2027-10-31T00:40:00-01:00")]


def test_needles(spark):
    f = make(spark, **edit("stops", "hall,420", "hall,410"))
    out = st.resolve_stops(queries(spark, ("a", " 410", MORNING, 5), ("b", "light", MORNING, 5),
                                   ("c", "atlantis", MORNING, 5)), f.stops())
    assert sorted(map(tuple, out.select("needle", F.coalesce("stop_id", F.lit("-")), "ambiguous", "status")
                      .collect()), key=repr) == [
        ("410", "gate", True, "FOUND"), ("410", "hall", True, "FOUND"),
        ("atlantis", "-", None, "STOP_NOT_FOUND"), ("light", "light", False, "FOUND")]


def test_reasons_for_an_empty_board(spark, feed):
    f = make(spark, stops=TABLES["stops"] + "\nold,460,Old Mill,37.75,-25.65,0,,0",
             calendar_dates="service_id,date,exception_type\nwork,20270610,2")
    out = dep.explain_empty(queries(
        spark, ("unknown", "999", MORNING, 30), ("over", "410", "2027-11-02T08:30:00-01:00", 30),
        ("closed", "410", "2027-06-10T08:30:00+00:00", 30), ("disused", "460", MORNING, 30),
        ("weekday only", "501", "2027-05-15T08:30:00+00:00", 30), ("early", "410", "2027-05-12T05:00:00+00:00", 30)), f)
    assert dict(rows(out, "query_id", "verdict")) == {
        "unknown": "STOP_NOT_FOUND", "over": "FEED_EXPIRED", "closed": "NO_SERVICE_THAT_DAY",
        "disused": "STOP_NEVER_SERVED", "weekday only": "NO_SERVICE_AT_STOP_TODAY", "early": "WINDOW_TOO_NARROW"}


def test_feeds_stay_apart_in_any_row_order(spark, feed):
    header, *lines = TABLES["stop_times"].split("\n")
    other = make(spark, feed_id="N", stop_times="\n".join([header, *reversed(lines)]).replace("08:40:00", "07:40:00"))
    both = Feed(spark, {n: other.tables()[n].unionByName(feed.tables()[n]) for n in feed.tables()})
    q = queries(spark, ("m", "410", MORNING, 60))
    q = q.unionByName(q.withColumns({"feed_id": F.lit("N"), "query_id": F.lit("n")}))
    assert rows(dep.departures(q, both), "query_id", "rank", "trip_id") == [
        ("m", 1, "c1"), ("m", 2, "h1"), ("n", 1, "h1")]


def test_network_departures_of_one_day(spark, feed):
    def day(d):
        return feed.zones().select("feed_id", "snapshot_id", F.lit(d).cast("date").alias("service_date"))

    assert dep.network_departures(feed, day("2027-05-12")).count() == 8
    assert rows(dep.network_departures(feed, day("2027-07-10")), "trip_id", "stop_id") == [
        ("r1", "gate"), ("r1", "hall"), ("s1", "quay")]
