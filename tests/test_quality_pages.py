import re

from pyspark.sql import functions as F

from tests.mini import TABLES, edit, feed as make, rows
from tramline.functions import text as tx
from tramline.operators import pages, quality


CODED = re.sub(r"(?m)^([\w-]+),(\d{3}),", r"\1,7\2,", TABLES["stops"])  # codes of four digits


def suite(spark, today="2027-05-12", zone="Atlantic/Azores", baseline=None, stops=CODED, rt_health=None, **changes):
    f = make(spark, stops=stops, **changes)
    days = f.zones().select("feed_id", "snapshot_id", F.lit(today).cast("date").alias("today"))
    zones = spark.createDataFrame([("M", zone)], "feed_id string, zone string") if zone else None
    out = quality.assumptions(quality.Inputs(tables=f.tables(), feeds=days, zones=zones, rt_health=rt_health,
                                             baseline=baseline and baseline.tables()))
    return {r.id: (r.status, r.observed) for r in out.collect()}


def test_healthy_feed_passes_and_missing_inputs_skip(spark):
    got = suite(spark)
    static = {k for k, _, category, _ in quality.ASSUMPTIONS if category == "static"}
    assert {k for k, v in got.items() if v[0] == "pass"} == static
    assert all(got[k] == ("skip", None) for k in got if k not in static)
    assert suite(spark, zone=None)["timezone_unchanged"] == ("skip", None)


def test_each_assumption_breaks_on_its_own(spark):
    def one(name, **changes):
        return suite(spark, **changes)[name]

    assert one("stop_code_unique", stops=CODED.replace("hall,7420", "hall,7410")) == ("fail", "1")
    assert one("stop_code_present", stops=CODED.replace("hall,7420", "hall,"))[0] == "fail"
    assert one("stop_code_format", stops=CODED.replace("hall,7420", "hall,H-20"))[0] == "fail"
    assert one("max_time_bounded", **edit("stop_times", "24:50:00,24:50:00", "28:10:00,28:10:00")) == ("fail", "28:10:00")
    assert one("max_time_bounded", **edit("stop_times", "08:52:00,08:52:00", "8:52:00,8:52:00"))[0] == "pass"
    assert one("max_time_bounded", **edit("stop_times", "08:52:00,08:52:00", "later,08:52:00"))[0] == "fail"
    assert one("timezone_unchanged", zone="Europe/Lisbon") == ("fail", "Atlantic/Azores")
    assert one("no_fare_files", fare_products="fare_product_id\nday") == ("opportunity", "fare_products")
    assert one("no_frequencies_file", frequencies="trip_id\nh1\nh2") == ("fail", "2")


def test_expiry(spark):
    assert suite(spark, "2027-10-26")["feed_not_expiring"] == ("fail", "5")
    assert suite(spark, "2027-11-02")["feed_not_expiring"] == ("fail", "-2")


def test_baseline_checks(spark):
    got = suite(spark, baseline=make(spark, stops=CODED.replace("quay,7440", "quay,7449")))
    assert got["stop_ids_stable"][0] == "fail" and got["rail_route_ids_stable"] == ("pass", "-0/+0")
    no_rail = make(spark, stops=CODED, routes=TABLES["routes"].replace("\nhill,T,Hill Tram,0,AA0000", ""))
    assert suite(spark, baseline=no_rail)["rail_route_ids_stable"][0] == "skip"


def health(spark, age, ago, kinds=("trip_updates", "vehicle_positions", "alerts")):
    data = [("M", k, k in kinds, age if k in kinds else None, ago if k in kinds else None)
            for k in quality.REQUIRED_RT]
    return spark.createDataFrame(data, "feed_id string, entity_kind string, available boolean, "
                                       "age_at_fetch bigint, fetched_ago bigint")


def test_rt_fresh(spark):
    def status(*a, **k):
        return suite(spark, rt_health=health(spark, *a, **k))["rt_fresh"][0]

    assert [status(60, 10), status(400, 10), status(60, 900),
            status(60, 10, kinds=("alerts",))] == ["pass", "fail", "skip", "fail"]


def test_status_lists_what_nobody_checked(spark, feed):
    out = quality.feed_status(feed.zones()).first()
    assert out.status == "attention" and out.not_checked == "feed,assertions,realtime,drift,snapshots"


HTML = ('<html><head><title>x</title><meta name="robots" content="noarchive"></head><body><nav>Menu</nav>'
        '<article><h1>Fares</h1><p>Adult <b>fare</b>: $2.50&nbsp;now</p><script>n=1</script>{}</article>'
        '<footer>(c)</footer></body></html>')


def capture(spark, *versions, ok=True):
    return spark.createDataFrame([("p", i, HTML.format(v), ok) for i, v in enumerate(versions)],
                                 "page_key string, fetched_epoch bigint, html string, extraction_ok boolean")


def test_text_keeps_content_and_masks_noise(spark):
    noise = ("<p>at 2026-08-05T10:00:00Z 1754236800000 deadbeefdeadbeef a.css?ver=1.2 "
             "123e4567-e89b-12d3-a456-426614174000 GA1abcdefghijklmnopqrstuvwx</p><p>September 7, 2026</p>")
    row = pages.normalize_pages(capture(spark, noise)).first()
    assert row.text == ("Fares\nAdult fare: $2.50 now\nat [timestamp] [timestamp] [nonce] a.css [nonce] "
                        "[nonce]\nSeptember 7, 2026")
    assert (row.strategy, row.noarchive, row.line_count) == ("single_article", True, 4)


def test_noise_is_no_drift_but_words_are(spark):
    expected = spark.createDataFrame([("p", "alarming"), ("q", "routine")], "page_key string, severity string")

    def status(caps):
        out = pages.page_drift(expected, pages.normalize_pages(caps))
        return {r.page_key: (r.status, r.changed) for r in out.collect()}

    stamp = "<p>{}-08-05T10:00:00Z</p>"
    assert status(capture(spark, stamp.format(2025), stamp.format(2026))) == {
        "p": ("unchanged", False), "q": ("never_captured", False)}
    assert status(capture(spark, "<p>Bus</p>", "<p>Train</p>"))["p"] == ("changed", True)
    assert status(capture(spark, "<p>Bus</p>"))["p"] == ("single_capture", False)
    assert status(capture(spark, "a", "a", ok=False))["p"][0] == "extraction_failed"


def test_line_delta_is_a_bag(spark):
    caps = pages.normalize_pages(capture(spark, "<p>a</p><p>a</p><p>b</p>", "<p>b</p><p>a</p><p>c</p>"))
    assert rows(pages.line_delta(caps), "lines_added", "lines_removed") == [(1, 1)]


def test_facts(spark):
    df = spark.createDataFrame([("p", "Pass $2.50 - $1,005\nFree\nSept 7, 2026 no service on light rail\n"
                                      "9/7/26\nSeptember 7")], "page_key string, text string")
    got = [tuple(r) for r in pages.page_facts(df).orderBy("line_no").select(
        "line_no", "cents", "is_range", "date_iso", "service_type", "mode").collect()]
    assert got == [(0, "250|100500", True, None, None, None), (1, "0", False, None, None, None),
                   (2, None, False, "2026-09-07", "no_service", "rail"),
                   (3, None, False, "2026-09-07", None, None)]


def test_price_cells(spark):
    df = spark.createDataFrame([(x,) for x in ("$2.50", "1", "Free", "$1-$3", "2.505", "$1,000")], "c string")
    got = [tuple(r.p) for r in df.select(tx.price_cell(F.col("c")).alias("p")).collect()]
    assert got == [(250, ""), (100, ""), (0, ""), (None, "NOT_A_PRICE"), (None, "TOO_MANY_DECIMALS"),
                   (100000, "")]


def test_holiday_dates(spark):
    texts = ["2026-09-07", "20260907", "9/7", "9/7/26", "Sept. 7", "Monday, September 7, 2026", "2/30", "soon"]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    got = [str(r[0]) for r in df.select(tx.holiday_date(F.col("c"), F.lit(2026))).collect()]
    assert got == ["2026-09-07"] * 6 + ["None"] * 2


def test_schedule_ids_first_pattern_wins(spark):
    html = ('<a href="/x?pickId=P1&d=20260801.pdf"></a><a href="/schedules/S2/r.pdf"></a>'
            '<a href="/map-20260801.pdf"></a><a href="/news/20260801"></a><a href="#pick=no"></a>')
    df = spark.createDataFrame([("p", html)], "page_key string, html string")
    assert rows(pages.schedule_ids(df), "schedule_id", "strategy") == [
        ("20260801", "dated_filename"), ("P1", "pick_query"), ("S2", "schedule_path")]
