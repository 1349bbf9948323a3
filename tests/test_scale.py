"""Plans that stay within a small driver, and calls pruned before they are shuffled."""

import re

from pyspark.sql import functions as F

from tests.mini import queries, rows
from tramline.operators import calendar as cal
from tramline.operators import departures as dep
from tramline.operators import stops as st
from tramline.sources import demo

MORNING = "2027-05-12T08:30:00+00:00"  # a Wednesday


def gathered(df):
    """What stands below the broadcasts of the planned query."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    out, depth = [], lambda x: re.search(r"[A-Za-z]", x).start() if re.search(r"[A-Za-z]", x) else 0
    for i, line in enumerate(lines):
        m = re.search(r"(Broadcast\w+Join).*Build(Left|Right)", line)
        if m:
            sides = [j for j in range(i + 1, len(lines)) if lines[j][depth(line):].startswith((":-", "+-"))]
            start = sides[0] if m[2] == "Left" else sides[1]
            end = next((j for j in range(start + 1, len(lines)) if depth(lines[j]) <= depth(lines[start])), len(lines))
            out.append("\n".join(lines[start:end]))
    return out


def test_exploded_tables_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    spark.range(50_000).withColumn("name", F.lit("a")).write.parquet(str(tmp_path / "t"))
    many = spark.read.parquet(str(tmp_path / "t")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500))))
    other = spark.range(50_000).withColumn("m", F.col("id") % 7)
    assert gathered(many.join(other, "id")) == []


def test_searched_texts_are_not_broadcast(spark, tmp_path):
    names = spark.createDataFrame([("M", "A", "a", "Old Mill Road"), ("M", "A", "b", "Mill"), ("M", "A", "c", "Quay")],
                                  "feed_id string, snapshot_id string, stop_id string, stop_name string")
    names.coalesce(1).write.parquet(str(tmp_path / "s"))
    found = st.stop_search(spark.read.parquet(str(tmp_path / "s")), spark.createDataFrame([("mill",), ("QUAY",), ("x",)], "term string"))
    assert not any("Generate" in side for side in gathered(found))
    assert rows(found, "stop_id", "term") == [("a", "mill"), ("b", "mill"), ("c", "QUAY")]


def test_calls_out_of_the_asked_hours_and_days_are_pruned(spark, feed):
    asked = queries(spark, ("q", "410", MORNING, 60))
    zones = feed.zones()
    slots = dep.window_slots(asked.select("feed_id", "snapshot_id", "at_epoch", "window_minutes"), zones, dep.call_span(feed.stop_times()))
    dates = cal.candidate_dates(asked, zones).select("feed_id", "snapshot_id", "service_date").distinct()
    gate = spark.createDataFrame([("M", "A", "gate")], "feed_id string, snapshot_id string, stop_id string")
    out = dep.boardable(feed.stop_times(), dep.running_trips(feed, dates), gate, dep.asked_hours(slots))
    assert rows(out, "trip_id", "stop_id") == [("c1", "gate"), ("h1", "gate")]


def test_hours_of_several_days_share_a_row(spark):
    slots = spark.createDataFrame([("M", "A", d, lo, hi) for d, lo, hi in (("2027-05-12", 3_500, 3_700), ("2027-05-13", 3_000, 3_650))],
                                  "feed_id string, snapshot_id string, service_date string, from_s bigint, to_s bigint")
    out = dep.asked_hours(slots.withColumn("service_date", F.col("service_date").cast("date")))
    day = 20_950  # 2027-05-12
    bits = (1 << day % 64) | (1 << (day + 1) % 64)
    assert rows(out, "bucket", "asked_word", "asked_days", "since", "until") == [
        (b, day // 64, bits - (1 << 64) if bits >> 63 else bits, 3_000, 3_700) for b in (0, 1)]


def test_departures_of_some_trips_on_some_dates(spark, feed):
    days = spark.createDataFrame([("M", t, d) for t, d in (("c1", "2027-05-12"), ("c1", "2027-05-15"), ("r1", "2027-05-15"), ("x", "2027-05-12"))],
                                 "feed_id string, trip_id string, service_date string").withColumn("service_date", F.col("service_date").cast("date"))
    dates = days.select("feed_id", F.lit("A").alias("snapshot_id"), "service_date").distinct()
    whole = dep.network_departures(feed, dates)
    some = dep.network_departures(feed, dates, reached=days)
    want = whole.join(days, ["feed_id", "trip_id", "service_date"], "left_semi")
    assert some.columns == whole.columns
    assert rows(some, *some.columns) == rows(want, *some.columns)
    assert {r[0] for r in some.select("trip_id").collect()} == {"c1", "r1"}


def test_large_tables_stay_as_they_are_read(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("red mill").alias("p_name"), F.lit(3).alias("p_size")).write.parquet(
        str(tmp_path / "part.parquet"))
    stops = demo.Demo(spark, str(tmp_path)).stops()
    monkeypatch.setattr(demo, "SPREAD_BYTES", 0)
    plain = demo.Demo(spark, str(tmp_path)).stops()
    assert rows(plain, *plain.columns) == rows(stops, *stops.columns)
    assert "Exchange" not in plain._jdf.queryExecution().sparkPlan().toString()
    assert "Repartition" not in plain._jdf.queryExecution().optimizedPlan().toString()
