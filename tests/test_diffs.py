import pytest

from tests.mini import TABLES, edit, feed as make, rows
from tramline.operators import diffs
from tramline.operators import stops as st
from tramline.sources import feeds


def test_moves_are_measured_in_metres(spark, feed):
    def moves(old, new):
        return rows(diffs.diff_stops(feed.stops(), make(spark, **edit("stops", old, new)).stops()), "stop_id", "change")

    # A degree of latitude is 111.2 km: 0.00021 is 23 m, 0.00024 is 27 m. A degree of
    # longitude at 37.7 N is 88 km: 0.00027 is 24 m, 0.0003 is 26 m.
    assert moves("37.7400,-25.6700", "37.74021,-25.6700") == []
    assert moves("37.7400,-25.6700", "37.74024,-25.6700") == [("gate", "moved")]
    assert moves("37.7400,-25.6700", "37.7400,-25.67027") == []
    assert moves("37.7400,-25.6700", "37.7400,-25.6703") == [("gate", "moved")]


def test_stop_changes_are_told_apart(spark, feed):
    b = make(spark, **edit("stops", "Town Hall,37.7450", "City Hall,37.7550"))
    out = {r.change: r.moved_m for r in diffs.diff_stops(feed.stops(), b.stops()).collect()}
    assert out["renamed"] is None and out["moved"] == pytest.approx(1111.9, abs=0.3)
    b = make(spark, **edit("stops", "Lighthouse Point,37.7600", "Lighthouse Point,"))
    assert rows(diffs.diff_stops(feed.stops(), b.stops()), "stop_id", "change") == [("light", "coordinates_missing")]


def test_route_changes(spark, feed):
    b = make(spark, routes=TABLES["routes"].replace("hill,T,Hill Tram,0", "cable,K,Cable Car,5")
             .replace("7,Coast Road,3", "7,Shore Road,0"))
    assert rows(diffs.diff_routes(feed.routes(), b.routes()), "route_id", "change", "field", "type_changed") == [
        ("cable", "added", "", False), ("coast", "changed", "route_long_name", True),
        ("coast", "changed", "route_type", True), ("hill", "removed", "", False)]


def test_survival_of_ids_and_codes(spark, feed):
    b = make(spark, **edit("stops", "quay,440", "quay,449"))
    r = diffs.id_survival(feed.stops(), b.stops()).first()
    assert (r.id_rate, r.code_lost, r.code_gained, r.meets_floor) == (1.0, 1, 1, False)
    assert r.code_rate == pytest.approx(6 / 7, abs=1e-4)
    r = diffs.id_survival(feed.stops().drop("stop_code"), feed.stops()).first()
    assert (r.id_rate, r.measured, r.meets_floor) == (1.0, False, False)


def test_calendar_changes(spark, feed):
    b = make(spark, calendar=TABLES["calendar"].replace("20271031", "20271130").replace("rest,0", "idle,0"),
             calendar_dates="service_id,date,exception_type\nwork,20270610,2\nfeast,20270711,1")
    got = rows(diffs.diff_calendar(feed.calendar(), feed.calendar_dates(), b.calendar(), b.calendar_dates()),
               "change", "service_id", "field")
    assert ("window_shift", "", "end") in got and ("field_changed", "work", "end_date") in got
    assert {g for g in got if g[0].startswith("service")} == {("service_added", "idle", ""), ("service_removed", "rest", "")}
    assert {g for g in got if g[0].startswith("exception")} == {
        ("exception_added", "feast", "20270711"), ("exception_removed", "feast", "20270710"),
        ("exception_removed", "rest", "20270610")}


def calls(f):
    return st.calls(f.stop_times(), f.trips(), f.routes(), "left")


def test_schedule_changes(spark, feed):
    def changes(f, *columns):
        return rows(diffs.diff_schedule(calls(feed), calls(f)), *columns)

    b = make(spark, **edit("stop_times", "h2,08:59:00,08:59:00", "h2,09:01:00,09:01:00"))
    assert changes(b, "departure_time", "added", "removed") == [("08:59:00", 0, 1), ("09:01:00", 1, 0)]
    b = make(spark, trips=TABLES["trips"].replace("Lighthouse", "Cape"),
             **edit("stop_times", "quay,1,0,0", "quay,1,1,0"))
    assert changes(b, "stop_id", "departure_time", "changed_fields") == [
        ("gate", "08:40:00", "headsign"), ("hall", "08:52:00", "headsign"),
        ("light", "09:05:00", "headsign"), ("quay", "11:00:00", "pickup_type")]


def test_renumbered_trips_alone_are_no_change(spark, feed):
    def renumber(text):
        for old in ("c1", "c9", "r1", "h1", "h2", "s1"):
            text = text.replace(f"{old},", f"2027-{old},")
        return text

    b = make(spark, trips=renumber(TABLES["trips"]), stop_times=renumber(TABLES["stop_times"]))
    assert diffs.diff_schedule(calls(feed), calls(b)).count() == 0
    assert diffs.diff_route_schedule(calls(feed), calls(b)).count() == 0


def test_files_come_and_go(spark, feed):
    b = make(spark, drop=("feed_info",), frequencies="trip_id,start_time\nh1,07:00:00")
    out = diffs.diff_files(feeds.row_counts(feed.tables()), feeds.row_counts(b.tables()))
    got = {r.table_name: (r.status, r.pct_change) for r in out.collect()}
    assert (got["feed_info"], got["frequencies"], got["trips"]) == (("removed", None), ("added", None), ("unchanged", 0.0))


def test_findings(spark, feed):
    def findings(b):
        a = feed
        return rows(diffs.diff_findings(
            diffs.diff_files(feeds.row_counts(a.tables()), feeds.row_counts(b.tables())),
            diffs.diff_routes(a.routes(), b.routes()), diffs.diff_stops(a.stops(), b.stops()),
            diffs.id_survival(a.stops(), b.stops()),
            diffs.window_shift(a.calendar(), a.calendar_dates(), b.calendar(), b.calendar_dates()),
            diffs.diff_calendar(a.calendar(), a.calendar_dates(), b.calendar(), b.calendar_dates())),
            "severity", "dimension", "detail")

    assert findings(feed) == []
    b = make(spark, frequencies="trip_id,start_time\nh1,07:00:00\nh2,07:00:00", fare_attributes="fare_id\nday",
             routes=TABLES["routes"].replace("\nhill,T,Hill Tram,0,AA0000", ""),
             calendar=TABLES["calendar"].replace("20271031", "20271001"))
    assert findings(b) == [
        ("alarming", "calendar", "service ends 30 day(s) earlier"),
        ("alarming", "files", "frequencies.txt appeared (2 rows)"),
        ("alarming", "routes", "1 rail route(s) removed"),
        ("opportunity", "files", "fare_attributes.txt appeared (1 rows)")]
