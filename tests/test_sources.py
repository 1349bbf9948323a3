import os
import zipfile

from pyspark.sql import functions as F

from tests.mini import TABLES, feed as make, queries, rows
from tramline.operators import departures as dep
from tramline.sources import captures, feeds


def unpack(root, feed_id, **changes):
    folder = os.path.join(root, f"feed_id={feed_id}", "snapshot_id=A")
    os.makedirs(folder)
    for name, text in {**TABLES, **changes}.items():
        with open(os.path.join(folder, f"{name}.txt"), "w", encoding="utf-8", newline="") as f:
            f.write(text)


def test_scan_reads_every_feed_by_its_own_header(spark, tmp_path):
    root = str(tmp_path / "feeds")
    unpack(root, "M")
    unpack(root, "N", stops='﻿"stop_name","stop_id"\r\n"Pier, old",007\r\n"Bare"\r\n\r\n')
    out = feeds.gtfs_scan(spark, root, ["stop_id", "stop_name", "stop_code"], "stops.txt")
    assert rows(out.filter("feed_id = 'N'"), "stop_id", "stop_name", "stop_code") == [("", "Bare", ""), ("007", "Pier, old", "")]
    assert out.filter("feed_id = 'M'").count() == 7


def test_scan_reads_wide_files(spark, tmp_path):
    root = str(tmp_path / "feeds")
    wide = ",".join(f"x{i}" for i in range(90)) + ",stop_id\n" + ",".join(str(i) for i in range(90)) + ",last"
    unpack(root, "W", stops=wide)
    assert rows(feeds.gtfs_scan(spark, root, ["stop_id", "x88"], "stops.txt"), "stop_id", "x88") == [("last", "88")]


def test_scanned_feed_answers_queries(spark, tmp_path):
    root = str(tmp_path / "feeds")
    unpack(root, "M")
    q = queries(spark, ("q", "410", "2027-05-12T08:30:00+00:00", 60))
    assert rows(dep.departures(q, feeds.Feed.scan(spark, root)), "trip_id") == [("c1",), ("h1",)]


def test_zip_landing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("inner/routes.txt", "﻿route_id,route_long_name\r\nsail,Praça\r\n")
        z.writestr("notes.md", "no table")
    out = feeds.land_zips(spark, str(tmp_path / "*.zip"))
    assert rows(out, "table_name", "line_no", "line") == [("routes", 0, "route_id,route_long_name"), ("routes", 1, "sail,Praça")]


def test_gate_refuses_empty_feeds_and_feeds_without_stops(spark, feed):
    counts = feeds.row_counts(feed.tables())
    none = counts.withColumns({"rows": F.lit(0).cast("bigint"), "snapshot_id": F.lit("blank")})
    stopless = counts.filter("table_name <> 'stops'").withColumn("snapshot_id", F.lit("nostops"))
    verdict = feeds.feed_gate(counts.unionByName(none).unionByName(stopless))
    assert rows(verdict, "snapshot_id", "reason", "accepted") == [
        ("A", "", True), ("blank", "EMPTY_FEED", False), ("nostops", "NO_STOPS", False)]
    assert feeds.accepted_only(feed.stops(), verdict).count() == 7


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>maré</p>", encoding="utf-8")
    assert rows(captures.page_scan(spark, str(tmp_path)), "html") == [("<p>maré</p>",)]


def test_captures_of_two_sources_keep_their_pins_apart(spark):
    given = spark.createDataFrame([("web", s, bytearray(b"same"), 1_800_000_000) for s in ("a", "b")],
                                  "kind string, source string, content binary, fetched_epoch bigint")
    refs = captures.snapshot_manifest(given, spark.createDataFrame([], "pin string, capture_ref string"))
    pins = refs.filter("source = 'a'").select(F.lit("kept").alias("pin"), "capture_ref")
    assert sorted(map(tuple, captures.snapshot_manifest(given, pins).select("source", "pin").collect())) == [("a", "kept"), ("b", None)]


def test_absent_columns_read_empty(spark, feed):
    out = feeds.with_optional(feed.stops().drop("stop_code"), ["stop_id", "stop_code"])
    assert {r.stop_code for r in out.collect()} == {""}
    assert make(spark, drop=("calendar",)).calendar().count() == 0
