"""Lookup tables, term search, paging, publishing, life spans, sketches and nested records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.mini import TABLES, feed as make, queries, rows
from tramline.operators import artifacts, calendar as cal, departures as dep, diffs, pages, printed, profile, stops as st

MORNING = "2027-05-12T08:30:00+00:00"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_hold_the_days_of_a_service(spark):
    f = make(spark, calendar=TABLES["calendar"] + "\nwork,0,0,0,0,0,1,0,20270301,20270331\nodd,1,0,0,0,0,0,0,19691228,19700202")
    words = cal.service_words(f.calendar(), f.calendar_dates())
    days = {(r.service_id, str(r.service_date)) for r in cal.active_days(words).collect()}
    assert ("work", "2027-03-06") in days and ("work", "2027-04-03") not in days and ("work", "2027-06-10") not in days
    assert {d for s, d in days if s == "odd"} == {"1969-12-29", "1970-01-05", "1970-01-12", "1970-01-19", "1970-01-26", "1970-02-02"}
    bits = cal.service_bitmaps(words)
    asked = spark.createDataFrame([("2027-03-06",), ("2027-03-07",), ("2027-06-10",), ("2030-01-01",)], "d string").select(F.col("d").cast("date"))
    got = bits.filter("service_id = 'work'").join(asked).filter(cal.runs_on(F.col("service_days"), F.col("d")))
    assert [str(r.d) for r in got.collect()] == ["2027-03-06"]


def test_plans_of_boards_have_no_row_per_service_day(spark, feed):
    q = queries(spark, ("q", "410", MORNING, 60))
    for df in (dep.departures(q, feed), dep.explain_empty(q, feed)):
        assert "explode(sequence(start_date" not in plan_of(df).replace(" ", "").lower()
        assert "service_days" in plan_of(df)


def test_boards_from_the_lookup_table(spark, feed, tmp_path):
    q = queries(spark, ("a", "410", MORNING, 60), ("b", "420", "2027-05-13T00:20:00+00:00", 45), ("c", "500", MORNING, 60, "T"),
                ("d", "440", "2027-07-10T10:45:00+00:00", 30))
    dates = cal.candidate_dates(q, feed.zones()).select("feed_id", "snapshot_id", "service_date").distinct()
    events = dep.write_stop_events(feed, dates, "test_stop_events", str(tmp_path / "events"))
    got = dep.looked_up(q, feed, events)
    want = dep.all_departures(q, feed)
    columns = ["query_id", "stop_id", "trip_id", "service_date", "departure_epoch", "headsign", "route_short_name"]
    assert rows(got, *columns) == rows(want, *columns) and got.count() == 6
    one = dep.looked_up(queries(spark, ("a", "410", MORNING, 60)), feed, events)
    one.collect()
    plan = plan_of(one)
    scan = [line for line in one._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in line and "service_date" in line]
    assert scan and "2027-07-10" not in "".join(scan) and "2027-05-12" in "".join(scan) or "service_date" in plan
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "seconds" in line]
    assert not moved
    spark.sql("DROP TABLE test_stop_events")


@pytest.mark.parametrize("count", [4, 3000])
def test_search_by_a_table_of_terms(spark, count):
    rng = random.Random(1)
    names = ["Harbour Gate", "Town Hall", "été Ünder_100%", "Lighthouse Point", "", None, "a", "Hall"]
    stops = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "stop_id int, stop_name string")
    terms = ["hall", "H", "", "_1", "ÜNDER", "zz", "gate", "town h", "e"]
    terms += ["".join(rng.choice("abhl t") for _ in range(rng.randint(1, 5))) for _ in range(count)]
    found = st.stop_search(stops, spark.createDataFrame([(t,) for t in terms], "term string"))
    want = sorted((t, i) for t in set(terms) for i, n in enumerate(names) if t.lower() in (n or "").lower())
    assert rows(found, "term", "stop_id") == want
    assert len(plan_of(found)) < 60_000


def test_deep_pages_and_ties(spark):
    rng = random.Random(2)
    data = [("a" if i % 3 else "b", rng.choice("xyz"), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, name string, n int").repartition(7)
    want = {g: sorted((name, n) for h, name, n in data if h == g) for g in "ab"}
    for offset, limit in ((0, 5), (120, 20), (260, 50), (999, 5)):
        page = artifacts.paginate(df, ["g"], ["name"], offset, limit)
        for g in "ab":
            got = [(r.name, r.n) for r in page.filter(F.col("g") == g).orderBy("row").collect()]
            assert got == want[g][offset:offset + limit]
    assert "PartitionBy" not in plan_of(page) and {r.total for r in artifacts.paginate(df, ["g"], ["name"], 0, 1).collect()} == {266, 134}


def test_publishing_swaps_only_what_passes(spark, feed, tmp_path, monkeypatch):
    root = str(tmp_path / "published")
    tables = feed.tables()

    def standing(name="stops"):
        return artifacts.published(spark, root, name, tables[name].schema)

    assert rows(artifacts.publish(tables, root), "reason", "accepted") == [("", True)]
    before = rows(standing(), "stop_id", "stop_name")
    refused = artifacts.publish({**tables, "stops": tables["stops"].filter("false")}, root)
    assert rows(refused, "reason", "accepted") == [("NO_STOPS", False)] and rows(standing(), "stop_id", "stop_name") == before

    renamed = {**tables, "stops": tables["stops"].withColumn("stop_name", F.lit("new"))}
    broken = {**renamed, "trips": tables["trips"].withColumn("trip_id", F.raise_error(F.lit("disk full")).cast("string"))}
    with pytest.raises(Exception, match="disk full"):
        artifacts.publish(broken, root)
    assert rows(standing(), "stop_id", "stop_name") == before
    # What is staged is read back: rows lost on the way keep the version from being named.
    version = artifacts._version
    monkeypatch.setattr(artifacts, "_version", lambda *a: version(*a).limit(3))
    assert rows(artifacts.publish(renamed, root), "reason") == [("STAGED_ROWS_DIFFER",)]
    monkeypatch.undo()
    assert rows(standing(), "stop_id", "stop_name") == before
    artifacts.publish(renamed, root)
    assert {r.stop_name for r in standing().collect()} == {"new"} and standing().count() == 7


def test_life_spans_over_four_snapshots(spark):
    seen = {1: {"s1": "10", "s2": "20"}, 2: {"s1": "10"}, 3: {"s1": "10", "s2": "20", "s3": "10"}, 4: {"s2": "10", "s3": "30"}}
    stops = spark.createDataFrame([("M", f"v{9 - n}", s, c) for n, held in seen.items() for s, c in held.items()],
                                  "feed_id string, snapshot_id string, stop_id string, stop_code string")
    order = spark.createDataFrame([("M", f"v{9 - n}", n * 100) for n in seen], "feed_id string, snapshot_id string, fetched_epoch bigint")
    got = rows(diffs.id_life_spans(stops, order), "kind", "value", "first_snapshot", "last_snapshot", "seen", "spells", "longest_gap", "alive", "holders")
    assert got == [("code", "10", "v8", "v5", 4, 1, 0, True, 3), ("code", "20", "v8", "v6", 2, 2, 1, False, 1),
                   ("code", "30", "v5", "v5", 1, 1, 0, True, 1), ("id", "s1", "v8", "v6", 3, 1, 0, False, 1),
                   ("id", "s2", "v8", "v5", 3, 2, 1, True, 2), ("id", "s3", "v6", "v5", 2, 1, 0, True, 2)]


def test_sketches_merge_and_stay_near_the_exact_counts(spark):
    def table(snapshot, low, high):
        return spark.range(low, high).select(F.lit("M").alias("feed_id"), F.lit(snapshot).alias("snapshot_id"),
                                             F.col("id").cast("string").alias("key"), (F.col("id") % 9).cast("string").alias("few"),
                                             F.when(F.col("id") % 4 > 0, "x").alias("holes"))
    sketches = profile.column_sketches({"t": table("A", 0, 60_000)}).unionByName(profile.column_sketches({"t": table("B", 30_000, 90_000)}))
    got = {r.column_name: r for r in profile.sketched_profile(sketches, ["feed_id"]).collect()}
    assert abs(got["key"].distinct_estimate / 90_000 - 1) < 0.03
    assert (got["few"].distinct_estimate, got["holes"].distinct_estimate) == (9, 2)
    assert (got["holes"].rows, got["holes"].non_empty, got["holes"].null_rate, got["key"].first_value) == (120_000, 90_000, 0.25, "0")
    alone = profile.sketched_profile(sketches)
    exact = profile.feed_profile({"t": table("A", 0, 60_000)})
    for r in exact.collect():
        mine = alone.filter((F.col("snapshot_id") == "A") & (F.col("column_name") == r.column_name)).first()
        assert abs(mine.distinct_estimate / r.distinct - 1) < 0.03 and mine.non_empty == r.non_empty
    assert "value" not in [c for line in plan_of(alone).split("\n") if "Exchange" in line for c in line.split("(")[-1].split(",")]


def test_fields_of_nested_records(spark):
    deep = {"a": {"b": [1, {"c": "x", "d": None}, [True, 2.5]]}, "e": "", "f": {}}
    df = spark.createDataFrame([("p", json.dumps(deep)), ("q", "not json"), ("r", None), ("s", "7")], "page_key string, record string")
    assert rows(pages.json_fields(df), "page_key", "path", "value") == [
        ("p", "a.b[0]", "1"), ("p", "a.b[1].c", "x"), ("p", "a.b[2][0]", "true"), ("p", "a.b[2][1]", "2.5"), ("p", "e", ""), ("s", "", "7")]


def test_record_delta_takes_the_two_newest_captures(spark):
    records = [("p", 1, "h1", {"x": 1}), ("p", 5, "h2", {"x": 2, "y": {"z": 1}}), ("p", 9, "h3", {"x": 3}), ("once", 1, "h", {"x": 1}),
               ("tie", 4, "h1", {"x": 1}), ("tie", 4, "h2", {"x": 2})]
    captures = spark.createDataFrame([(k, t, h, json.dumps(r)) for k, t, h, r in records],
                                     "page_key string, fetched_epoch bigint, content_hash string, record string")
    got = pages.record_delta(captures)
    assert sorted(map(tuple, got.select("page_key", "path", "value_a", "value_b", "status").collect())) == [
        ("p", "x", "2", "3", "changed"), ("p", "y.z", "1", None, "removed"), ("tie", "x", "1", "2", "changed")]


def test_queries_keep_the_callers_views(spark, feed):
    spark.range(3).createOrReplaceTempView("stops")
    assert artifacts.feed_sql(spark, feed.tables(), "WITH s AS (SELECT * FROM stops) SELECT count(*) AS n FROM s").first().n == 7
    assert spark.table("stops").count() == 3
    spark.catalog.dropTempView("stops")


def test_fare_rows_keep_what_cannot_be_read_apart(spark):
    table = [({"Fare Type": "Day Pass", "Mode": "Bus", "Price": "$5"}, "bus-day-pass", 500, None),
             ({"PASS": "day-pass", "mode ": "bus", "Cost": "5.50"}, "bus-day-pass-2", 550, None),
             ({"Product": "Child", "Rider Type": "Under 5", "Amount": "Free"}, "under-5-child", 0, None),
             ({"Product": "Mystery"}, None, None, "NO_PRICE"), ({"Product": "Zone", "Price": "$1-$3"}, None, None, "NOT_A_PRICE"),
             ({"Product": "Odd", "Price": "1.234"}, None, None, "TOO_MANY_DECIMALS"),
             ({"Product": "Week", "Price": " ", "Price USD": "$1,027.00", "Notes": "7 days"}, "week", 102_700, None)]
    df = spark.createDataFrame([("p", i, c) for i, (c, *_) in enumerate(table)], "page_key string, row_no int, cells map<string,string>")
    got = {r.row_no: r for r in printed.fare_rows(df).collect()}
    assert [(got[i].fare_id, got[i].price_cents, got[i].reason) for i in range(len(table))] == [t[1:] for t in table]
    assert got[6].price == "$1027.00" and got[6].notes == "7 days" and got[2].price == "$0.00"
    assert printed.fare_rows(df.filter("false")).count() == 0


def test_holiday_rows_never_merge_modes(spark):
    table = [({"Holiday": "Spring Day", "Date": "May 4", "Bus": "Sunday Service", "Light Rail": "Weekend", "Van": "No service"}),
             ({"Event": "Feast", "Observed": "5/9/2027", "BUS": "Regular", "Train": "Normal"}), ({"Day": "Old", "When": "2026-01-01", "Bus": "Sunday"}),
             ({"Day": "Some day", "Date": "the second Tuesday", "Bus": "Sunday"}), ({"Day": "Quiet", "Date": "20270606"}),
             ({"Day": "Snow", "Date": "6/7", "Bus": "Snow plan"})]
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate(table)], "page_key string, row_no int, cells map<string,string>")
    out = printed.holiday_rows(df, 2027)
    got = sorted(map(tuple, out.select("row_no", F.col("date").cast("string"), "mode", "service_type", "modes_differ", "reason").collect()), key=repr)
    assert got == sorted([(0, "2027-05-04", "bus", "sunday", True, None), (0, "2027-05-04", "rail", "weekend", True, None),
                          (0, "2027-05-04", "paratransit", "no_service", True, None), (1, "2027-05-09", "bus", "regular", False, None),
                          (1, "2027-05-09", "rail", "regular", False, None), (2, "2026-01-01", None, None, False, "OTHER_YEAR"),
                          (3, None, None, None, False, "DATE_UNREADABLE"), (4, "2027-06-06", None, None, False, "NO_SERVICE_NAMED"),
                          (5, "2027-06-07", "bus", "unrecognised", False, None)], key=repr)
    assert {r.weekday for r in out.filter("row_no = 0").collect()} == {"Tuesday"}
    assert rows(printed.modes_missing(printed.holiday_rows(df.filter("row_no = 5"), 2027)), "page_key", "missing") == [("p", "rail")]


def test_robots_and_kept_chrome(spark):
    html = ["<main><p>x</p></main><META CONTENT='NoArchive' data-x=1 NAME=\"Robots\">", "<meta name=googlebot content=noindex><nav>only</nav>",
            "<meta name='description' content='noindex'><body><nav>gone</nav><p>kept</p></body>", ""]
    df = spark.createDataFrame([(str(i), 1, h) for i, h in enumerate(html)], "page_key string, fetched_epoch bigint, html string")
    assert rows(pages.normalize_pages(df), "page_key", "strategy", "text", "noarchive", "nosnippet", "noindex") == [
        ("0", "main_element", "x", True, False, False), ("1", "whole_document+chrome_kept", "only", False, False, True),
        ("2", "body", "kept", False, False, False), ("3", "whole_document+chrome_kept", "", False, False, False)]
