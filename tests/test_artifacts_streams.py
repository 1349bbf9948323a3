import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.mini import TABLES, edit, feed as make, queries, rows
from tramline.operators import artifacts, departures as dep, profile, stops as st
from tramline.sources.feeds import Feed
from tramline.streaming import jobs

MORNING = "2027-05-12T08:30:00+00:00"


def index(f):
    return artifacts.stops_index(f.stops(), st.serving(f.stop_times(), f.trips(), f.routes()))


def test_index_keeps_the_lowest_stop_and_sorts_badges(spark):
    f = make(spark, **edit("stops", "hall,420", "hall,410"), routes=TABLES["routes"] + "\nring,12,Ring,3,",
             trips=TABLES["trips"] + "\nring,work,g1,Ring,0",
             stop_times=TABLES["stop_times"] + "\ng1,10:00:00,10:00:00,gate,1,0,0")
    got = {r.code: (r.stop_id, r.routes, r.shadowed) for r in index(f).collect()}
    assert got["410"] == ("gate", "7|12|T", 1) and got["440"] == ("quay", "sail", 0)
    assert rows(artifacts.index_report(f.stops()), "codes", "shared_codes", "without_code") == [(6, 1, 0)]


def test_prune_keeps_parents_of_called_platforms(spark, feed):
    out = artifacts.compact(feed.tables(), "minimal", routes=["hill"])
    assert rows(out["stops"], "stop_id") == [("gate",), ("hall",), ("top",), ("top-n",), ("top-s",)]
    assert rows(out["trips"], "trip_id") == [("h1",), ("h2",)]
    assert "feed_info" not in out and "stop_lat" not in out["stops"].columns


def test_prune_by_days_starts_at_the_feed(spark, feed):
    # 2027-03-01 is a Monday: five days never reach the weekend.
    out = artifacts.compact(feed.tables(), "balanced", days=5)
    assert rows(out["calendar"], "service_id") == [("work",)]
    assert rows(out["trips"], "trip_id") == [("c1",), ("c9",), ("h1",), ("h2",)]


def test_compact_drops_what_the_decisions_call_empty(spark):
    f = make(spark, trips="\n".join(line + ("," if i else ",shape_id") for i, line in enumerate(TABLES["trips"].split("\n"))))
    written = artifacts.compact(f.tables(), "balanced")
    kept = {(r.table_name, r.column_name)
            for r in artifacts.prune_decisions(profile.feed_profile(f.tables()), "balanced").collect() if r.kept}
    assert kept == {(n, c) for n, df in written.items() for c in df.columns if c not in ("feed_id", "snapshot_id")}
    assert "shape_id" not in written["trips"].columns


def test_unknown_routes_are_an_error(spark, feed):
    with pytest.raises(ValueError, match="metro"):
        artifacts.compact(feed.tables(), "minimal", routes=["hill", "metro"])


def test_full_drops_nothing(spark, feed):
    out = artifacts.compact(feed.tables(), "full")
    assert {n: df.columns for n, df in out.items()} == {n: df.columns for n, df in feed.tables().items()}


def test_decisions_measure_empty_columns(spark):
    f = make(spark, trips="\n".join(line + ("," if i else ",shape_id") for i, line in enumerate(TABLES["trips"].split("\n"))))
    out = artifacts.prune_decisions(profile.feed_profile(f.tables()), "balanced")
    got = {(r.table_name, r.column_name): r.reason for r in out.collect()}
    assert got["stop_times", "stop_headsign"] == "empty_on_every_row"
    assert got["stops", "stop_lat"] == "not_in_strategy" and got["stops", "stop_code"] == ""


def test_profile_gives_first_and_last_values(spark, feed):
    got = {(r.table_name, r.column_name): (r.distinct, r.first_value, r.last_value)
           for r in profile.feed_profile(feed.tables()).collect()}
    assert got["trips", "trip_headsign"] == (4, "Hilltop", "Town Hall")
    assert got["routes", "route_short_name"] == (3, "7", "T")


def test_route_summary_counts_headsigns(spark, feed):
    got = {r.route_id: (r.trips, r.headsigns, r.first_headsign, r.last_headsign, r.first_departure, r.last_departure)
           for r in profile.route_summary(feed.trips(), feed.stop_times()).collect()}
    assert got["coast"] == (3, 2, "Lighthouse", "Town Hall", "08:40:00", "24:50:00")
    assert profile.route_headsigns(feed.trips()).count() == 4


def test_pruned_feed_gives_the_same_board(spark, feed):
    q = queries(spark, ("q", "410", MORNING, 90))
    small = Feed(spark, artifacts.compact(feed.tables(), "minimal"))
    cols = ("trip_id", "departure_local", "headsign")
    assert rows(dep.departures(q, small), *cols) == rows(dep.departures(q, feed), *cols)


def test_clustered_sink_and_manifest(spark, feed, tmp_path):
    artifacts.compact_sink(artifacts.compact(feed.tables()), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "stop_times")).count() == 12
    artifacts.json_artifact_sink(index(feed), ["code"], str(tmp_path / "one"))
    artifacts.json_artifact_sink(index(feed), ["code"], str(tmp_path / "two"))
    files = artifacts.artifact_manifest(spark, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")})
    by = {n: [r.sha256 for r in files.filter(F.col("name") == n).orderBy("file").collect()] for n in ("one", "two")}
    assert by["one"] == by["two"] and files.agg(F.sum("rows")).first()[0] == 14


def test_paginate(spark, feed):
    def page(offset, limit):
        out = artifacts.paginate(feed.stops(), ["feed_id"], ["stop_id"], offset, limit)
        return [tuple(r) for r in out.orderBy("row").select("stop_id", "total", "has_more", "next_offset").collect()]

    assert page(0, 2) == [("gate", 7, True, 2), ("hall", 7, True, 2)]
    assert page(6, 3) == [("top-s", 7, False, None)]
    assert page(7, 2) == [] and len(page(0, 5000)) == 7


def test_sql_returns_every_row(spark, feed):
    assert artifacts.feed_sql(spark, feed.tables(), "SELECT a.* FROM stop_times a JOIN stop_times b "
                                                    "ON true JOIN stop_times c ON true").count() == 12 ** 3


def test_golden_names_the_first_difference(spark, feed):
    q = queries(spark, ("same", "410", MORNING, 60), ("gone", "999", MORNING, 60))
    cases = q.select(F.col("query_id").alias("case_id"))
    golden = artifacts.golden_rows(dep.departures(q, feed))
    errors = spark.createDataFrame([("gone", "StopNotFound")], "case_id string, error string")

    def reasons(fresh, fresh_errors=errors):
        out = artifacts.golden_regression(cases, golden, fresh, errors, fresh_errors)
        return {r.case_id: r.reason for r in out.collect()}

    assert reasons(golden) == {"same": None, "gone": None}
    changed = golden.withColumn("headsign", F.when(F.col("position") == 2, "X").otherwise(F.col("headsign")))
    assert reasons(changed)["same"] == "departure 1 differs on: headsign"
    assert reasons(golden.filter("position = 1"))["same"] == "count changed: 2 -> 1"
    assert reasons(golden, errors.filter("false"))["gone"] == "expected StopNotFound but got departures"
    with pytest.raises(ValueError):
        artifacts.golden_regression(cases.filter("false"), golden, golden, errors, errors)


def snapshots(spark, n):
    return spark.createDataFrame(
        [(f"c{i}", "web", "s", "x" if i < 2 else str(i), "x", 10, i, "p" if i == 0 else None) for i in range(n)],
        "capture_ref string, kind string, source string, sha256 string, actual_sha256 string, bytes int, "
        "fetched_epoch bigint, pin string")


def test_snapshot_catalogue(spark):
    s = snapshots(spark, 8)
    assert rows(artifacts.snapshot_latest(s), "capture_ref") == [("c7",)]
    assert rows(artifacts.snapshot_duplicates(s), "copies", "first_ref") == [(2, "c0")]
    assert rows(artifacts.retention(s, 5), "capture_ref") == [("c1",), ("c2",)]
    assert artifacts.integrity(s).filter("intact").count() == 2


def updates(spark, *records):
    rows = spark.createDataFrame([("M", *r) for r in records],
                                 "feed_id string, trip_id string, header_ts bigint, entity_pos bigint, "
                                 "delay int, seen_epoch bigint")
    return rows.withColumn("ts", F.timestamp_seconds("seen_epoch"))


def poured(spark, folder, files, schema=None):
    """Write each file in turn, an hour apart as its name says, and read one per batch."""
    for n, data in enumerate(files):
        data.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 2e9 - 1:
                continue
            if name.endswith(".parquet"):
                os.utime(f"{folder}/{name}", (2e9 + n * 3600, 2e9 + n * 3600))
    return spark.readStream.schema(schema or files[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def newest_of_spell(records, silence=7200, delay=21600):
    """What is left of trips in the end, by a plain loop over all updates in order of time."""
    trips, newest = {}, max(r[4] for r in records)
    for trip, header, pos, late, seen in sorted(records, key=lambda r: r[4]):
        best, last = trips.get(trip, (None, None))
        record = (header, pos, late, seen)
        trips[trip] = (record if last is None or seen - last > silence else max(best, record), seen)
    return sorted((t, *best, last) for t, (best, last) in trips.items()
                  if last >= newest - silence and last + silence > newest - delay)


def test_trip_state_is_the_same_for_every_split_and_order(spark, tmp_path):
    """Seven hours of updates with silences of more than two, late headers and copies; rows come
    up to five hours late."""
    rng = random.Random(5)
    records = []
    for trip in range(6):
        at = rng.randrange(600)
        while at < 25_000:
            records.append((f"t{trip}", at - rng.randrange(4000), len(records), rng.randrange(99), at))
            at += rng.choice([40, 600, 1800, 7200, 7201, 9000])
    want = newest_of_spell(records)
    assert len({t for t, *_ in records}) == 6 and 0 < len(want) <= 6
    by_time = sorted(records, key=lambda r: r[4])
    cuts = {"whole": [by_time + by_time[:9]],
            "by time": [by_time[:10], by_time[10:40], by_time[40:], by_time[-9:]],
            "mixed": [sorted(by_time, key=lambda r: r[2] % 3)[i::3] for i in range(3)]}
    for name, parts in cuts.items():
        stream = poured(spark, str(tmp_path / f"in {name}"), [updates(spark, *p) for p in parts])
        got = jobs.TripState(spark, str(tmp_path / f"state {name}")).run(stream)
        assert rows(got, "trip_id", "header_ts", "entity_pos", "delay", "seen_epoch", "last_seen") == want, name


def test_trip_state_carries_on_after_a_restart(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "state")
    first = updates(spark, ("a", 100, 0, 1, 1000), ("b", 100, 1, 2, 1000))

    def run():
        stream = spark.readStream.schema(first.schema).parquet(source)
        return rows(jobs.TripState(spark, root).run(stream), "trip_id", "header_ts", "last_seen")

    first.filter("false").write.parquet(source)
    assert run() == []
    first.write.mode("append").parquet(source)
    assert run() == [("a", 100, 1000), ("b", 100, 1000)] == run()
    updates(spark, ("a", 90, 2, 3, 1500)).write.mode("append").parquet(source)
    assert run() == [("a", 100, 1500), ("b", 100, 1000)]
    # A silence of three hours: the old header no longer counts, the other trip has left.
    updates(spark, ("a", 80, 3, 4, 12_400)).write.mode("append").parquet(source)
    assert run() == [("a", 80, 12_400)]


def test_silent_trips_leave_the_state(spark, tmp_path):
    root = str(tmp_path / "state")
    stream = poured(spark, str(tmp_path / "in"), [updates(spark, ("a", 1, 0, 1, 1000)), updates(spark, ("b", 1, 1, 1, 60_000))])
    jobs.TripState(spark, root).run(stream)
    changes = spark.read.schema(jobs.CHANGES).parquet(f"{root}/changes")
    assert rows(changes, "trip_id", "version", "expired") == [("a", 1, False), ("a", 2, True), ("b", 1, False)]


def board_inputs(spark):
    """One trip on three days, updates of two captures a few hours apart, one with a start date."""
    day = 86_400
    departures = spark.createDataFrame(
        [("M", "t", f"s{n}", str(n), date(2027, 5, d), (20_584 + d) * day + 36_000 + n * 600, 0) for d in (11, 12, 13) for n in (1, 2)],
        "feed_id string, trip_id string, stop_id string, stop_sequence string, service_date date, departure_epoch bigint, minutes_away int")
    noon = (20_584 + 12) * day + 30_000
    status = spark.createDataFrame([("M", "c1", 0, "", "SCHEDULED", None), ("M", "c2", 0, "", "SCHEDULED", None),
                                    ("M", "c2", 1, "20270513", "SCHEDULED", None)],
                                   "feed_id string, capture_id string, entity_pos bigint, start_date string, trip_relationship string, trip_delay int")
    stops = spark.createDataFrame(
        [("M", "c1", 0, 0, "t", "s1", "", "SCHEDULED", 60, None, noon), ("M", "c1", 0, 1, "t", "", "2", "SCHEDULED", 61, None, noon),
         ("M", "c2", 0, 0, "t", "s1", "1", "SCHEDULED", 120, None, noon + 3000), ("M", "c2", 0, 1, "t", "s1", "", "SCHEDULED", 121, None, noon + 3000),
         ("M", "c2", 1, 0, "t", "s1", "", "SCHEDULED", 999, None, noon + 3000)],
        "feed_id string, capture_id string, entity_pos bigint, stu_pos int, trip_id string, stop_id string, stop_sequence string, "
        "relationship string, event_delay int, event_time bigint, seen_epoch bigint")
    return departures, status, stops


def test_live_board_shows_the_newest_update_of_dates_in_reach(spark, tmp_path):
    departures, status, stops = board_inputs(spark)
    old, new = stops.filter("capture_id = 'c1'"), stops.filter("capture_id = 'c2'")
    for name, files in {"one": [stops], "two": [old, new], "late": [new, old], "again": [old, new, old, stops]}.items():
        stream = poured(spark, str(tmp_path / f"in {name}"), files, stops.schema)
        board = jobs.LiveBoard(spark, str(tmp_path / f"board {name}")).run(jobs.live_board(stream, status, departures))
        assert rows(board, "service_date", "stop_id", "capture_id", "stu_pos", "delay_seconds") == [
            (date(2027, 5, 12), "s1", "c2", 0, 120), (date(2027, 5, 12), "s2", "c1", 1, 61)], name


def polls(spark, *epochs):
    return spark.createDataFrame([("M", "alerts", t) for t in epochs], "feed_id string, entity_kind string, fetched_epoch bigint").withColumn(
        "ts", F.timestamp_seconds("fetched_epoch"))


def test_outages_show_a_silence_inside_an_hour(spark, tmp_path):
    before, after = list(range(0, 181, 30)), list(range(3180, 3700, 30))
    end = polls(spark, 90_000)
    orders = {"in order": [polls(spark, *before), polls(spark, *after), end], "late": [polls(spark, *after), polls(spark, *before), end],
              "mixed": [polls(spark, *(before + after)[::2]), polls(spark, *(before + after)[1::2]), end]}
    for name, files in orders.items():
        spells, late = jobs.run_counted(jobs.poll_spells(poured(spark, str(tmp_path / f"in {name}"), files)), str(tmp_path / f"out {name}"))
        assert rows(spells, "spell_start", "last_fetch", "captures") == [(0, 180, 7), (3180, 3690, 18)] and late == 0
        assert rows(jobs.outages(spells), "silent_from", "silent_until", "seconds", "longest") == [(180, 3180, 3000, 1)]
    files = [polls(spark, *after), end, polls(spark, *before)]
    _, late = jobs.run_counted(jobs.poll_spells(poured(spark, str(tmp_path / "in late"), files)), str(tmp_path / "out very late"))
    assert late > 0
