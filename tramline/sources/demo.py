"""GTFS-shaped views over the star-schema test tables.

Three feeds (``F0``..``F2``, by trip key modulo 3) in three time zones, two
snapshots (``A``, and ``B`` with deterministic changes), realtime captures from
``events`` and page captures from ``pages``. Everything is a projection of the
given tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import times

# Fixed values of the demo feeds.
FEEDS = 3
ZONES = {"F0": "America/Chicago", "F1": "America/New_York", "F2": "America/Denver"}
INSTANTS = {1: "2026-11-01 05:30:00", 2: "2026-11-01 06:30:00",
            3: "2026-03-08 07:30:00", 4: "2026-09-07 17:00:00"}
CALENDAR_COLUMNS = ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday",
                    "saturday", "sunday", "start_date", "end_date"]
CALENDAR = {
    "A": [("WK", "1", "1", "1", "1", "1", "0", "0", "20260101", "20261231"),
          ("SA", "0", "0", "0", "0", "0", "1", "0", "20260101", "20261231"),
          ("SU", "0", "0", "0", "0", "0", "0", "1", "20260101", "20261231"),
          ("WK2", "1", "1", "1", "1", "1", "0", "0", "20260901", "20261130")],
    "B": [("WK", "1", "1", "1", "1", "1", "0", "0", "20260101", "20270228"),
          ("SA", "0", "0", "0", "0", "0", "1", "0", "20260101", "20270228"),
          ("SU", "0", "0", "0", "0", "0", "0", "1", "20260101", "20270228"),
          ("NW", "1", "1", "1", "1", "1", "0", "0", "20261201", "20270131")],
}
CALENDAR_DATES = {
    "A": [("WK", "20260907", "2"), ("SU", "20260907", "1"), ("XH", "20261101", "1")],
    "B": [("WK", "20260907", "2"), ("SU", "20260907", "1"), ("XH", "20261101", "1"),
          ("WK", "20261126", "2")],
}


def inline(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A literal string table; its size is known to the planner."""
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


# A table read of fewer bytes than this may be one row group.
SPREAD_BYTES = 32 << 20


class Demo:
    """The demo feeds of one data folder and one snapshot."""

    def __init__(self, spark: SparkSession, sf_dir: str, snapshot: str = "A"):
        self.spark, self.dir, self.snapshot = spark, sf_dir.rstrip("/"), snapshot

    def at(self, snapshot: str) -> "Demo":
        return Demo(self.spark, self.dir, snapshot)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _spread(self, df: DataFrame, key: str) -> DataFrame:
        """The raw columns spread by key: a test table is one file, and so one task.

        The key passes a condition that is always true but that the optimizer takes for
        random, so filters are not moved below the exchange, into that one task. Larger
        tables are read by several tasks, and stay as they are read.
        """
        if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= SPREAD_BYTES:
            return df
        return df.repartition(key).withColumn(key, F.when(F.rand(0) <= F.abs(F.col(key)) + 1, F.col(key)))

    def _keyed(self, df: DataFrame, feed) -> DataFrame:
        return df.withColumns({"feed_id": feed, "snapshot_id": F.lit(self.snapshot)})

    def _per_feed(self, df: DataFrame) -> DataFrame:
        """One copy of every row for each feed."""
        feeds = F.explode(F.array(*[F.lit(f"F{i}") for i in range(FEEDS)]))
        return df.withColumns({"feed_id": feeds, "snapshot_id": F.lit(self.snapshot)})

    @staticmethod
    def _feed_of(key: str):
        return F.concat(F.lit("F"), (F.col(key) % FEEDS).cast("string"))

    # ------------------------------------------------------------ schedule --
    def stops(self) -> DataFrame:
        k, b = F.col("p_partkey"), self.snapshot == "B"
        code = F.when(k % 97 == 0, "").otherwise(
            (k + 10_000 - F.when(k % 211 == 1, 1).otherwise(0)).cast("string"))
        lat = 385_000 + k + (F.when(k % 29 == 0, 3).otherwise(0) if b else 0)
        lat_text = F.concat(F.floor(lat / 10_000).cast("string"), F.lit("."),
                            F.lpad((lat % 10_000).cast("string"), 4, "0"))
        lon = 90_400 - F.col("p_size").cast("bigint") * 2
        name = F.col("p_name")
        if b:
            name = F.when(k % 41 == 0, F.concat(name, F.lit(" Plaza"))).otherwise(name)
            lat_text = F.when(k % 89 == 0, "").otherwise(lat_text)
        df = self._spread(self.raw("part").select("p_partkey", "p_name", "p_size"),
                          "p_partkey").select(
            F.concat(F.lit("S"), k.cast("string")).alias("stop_id"),
            code.alias("stop_code"),
            name.alias("stop_name"),
            lat_text.alias("stop_lat"),
            F.concat(F.lit("-"), F.floor(lon / 1000).cast("string"), F.lit("."),
                     F.lpad((lon % 1000).cast("string"), 3, "0")).alias("stop_lon"),
            F.when(k % 50 == 0, "1").otherwise("0").alias("location_type"),
            F.when((k % 50).isin(1, 2), F.concat(F.lit("S"), (k - k % 50).cast("string")))
            .otherwise("").alias("parent_station"),
            F.lit("").alias("wheelchair_boarding"),
            k,
        )
        if b:
            df = df.filter(k % 53 != 0)
        return self._per_feed(df.drop("p_partkey"))

    def stop_history(self) -> DataFrame:
        """Stops in six snapshots: some come late, some go, some are missing for a while, and
        codes of stops that went are given to others."""
        k, n = F.col("p_partkey"), F.col("n")
        rows = self.raw("part").select("p_partkey").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(6))))
        gone = ((k % 7 == 0) & (n > 4)) | ((k % 11 == 0) & n.isin(2, 3)) | ((k % 13 == 0) & (n == 5)) | ((k % 17 == 0) & (n < 3))
        taken = F.when((k % 7 == 1) & (n > 4) & (k > 1), k - 1).otherwise(k)
        feeds = F.explode(F.array(*[F.lit(f"F{i}") for i in range(FEEDS)])).alias("feed_id")
        return rows.filter(~gone).select(
            feeds, F.concat(F.lit("W"), n.cast("string")).alias("snapshot_id"), F.concat(F.lit("S"), k.cast("string")).alias("stop_id"),
            F.when(k % 97 == 0, "").otherwise((taken + 10_000).cast("string")).alias("stop_code"))

    def stop_snapshots(self) -> DataFrame:
        """The six snapshots, a week apart."""
        n = F.col("n")
        rows = self.spark.range(1, 7).select(F.col("id").cast("int").alias("n"))
        feeds = F.explode(F.array(*[F.lit(f"F{i}") for i in range(FEEDS)])).alias("feed_id")
        return rows.select(feeds, F.concat(F.lit("W"), n.cast("string")).alias("snapshot_id"),
                           (F.lit(1_790_000_000) + n * 604_800).cast("bigint").alias("fetched_epoch"))

    def routes(self) -> DataFrame:
        k, r, b = F.col("n_nationkey"), F.col("n_regionkey"), self.snapshot == "B"
        kind = F.when(r == 0, "0").when(r == 4, "3 ").otherwise("3")
        name = F.col("n_name")
        short = F.when(k % 10 == 9, "").when(r == 0, F.concat(F.lit("L"), k.cast("string"))) \
            .otherwise(k.cast("string"))
        raw = self.raw("nation")
        if b:
            raw = raw.filter(k % 53 != 0)
            raw = raw.withColumn("n_nationkey", F.explode(F.when(
                k % 20 == 1, F.array(k, k + 100)).otherwise(F.array(k))))
            name = F.when(k % 7 == 3, F.concat(name, F.lit(" Line"))).otherwise(name)
            kind = F.when(k % 12 == 5, "11").otherwise(kind)
        return self._per_feed(raw.select(
            F.concat(F.lit("R"), k.cast("string")).alias("route_id"),
            short.alias("route_short_name"),
            name.alias("route_long_name"),
            kind.alias("route_type"),
            F.lit("000000").alias("route_color"),
        ))

    def trips(self) -> DataFrame:
        k, c, b = F.col("o_orderkey"), F.col("o_custkey"), self.snapshot == "B"
        p = F.substring("o_orderpriority", 1, 1)
        raw = self._spread(self.raw("orders").select(
            "o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
        if b:
            raw = raw.filter(k % 53 != 0)
        headsign = F.concat(F.lit("Dest "), (c % 7).cast("string"))
        if b:
            headsign = F.when(k % 61 == 0, F.concat(headsign, F.lit(" Express"))).otherwise(headsign)
        return self._keyed(raw, self._feed_of("o_orderkey")).select(
            "feed_id", "snapshot_id",
            F.concat(F.lit("U" if b else "T"), k.cast("string")).alias("trip_id"),
            F.concat(F.lit("R"), (c % 25).cast("string")).alias("route_id"),
            F.when(p == "1", "WK").when(p == "2", "SA").when(p == "3", "SU")
            .when(p == "4", "WK2").otherwise("XH").alias("service_id"),
            headsign.alias("trip_headsign"),
            (k % 2).cast("string").alias("direction_id"),
            F.lit("").alias("shape_id"),
        )

    def stop_times(self) -> DataFrame:
        o, p, n, b = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), \
            self.snapshot == "B"
        raw = self._spread(self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"), "l_orderkey")
        if b:
            raw = raw.filter((o % 53 != 0) & (p % 53 != 0))
        secs = 14_400 + (o * 613 + n * 300) % 79_200
        if b:
            secs = secs + F.when(o % 37 == 0, 300).otherwise(0)
        # Line 7 is written without the leading zero, as some producers do.
        first = F.when((n == 7) & (secs < 36_000), 2).otherwise(1)
        clock = F.when((p % 83 == 0) & (n == 4), "").otherwise(F.substring(times.gtfs_time(secs), first, F.lit(8)))
        return self._keyed(raw, self._feed_of("l_orderkey")).select(
            "feed_id", "snapshot_id",
            F.concat(F.lit("U" if b else "T"), o.cast("string")).alias("trip_id"),
            clock.alias("arrival_time"),
            clock.alias("departure_time"),
            F.concat(F.lit("S"), p.cast("string")).alias("stop_id"),
            n.cast("string").alias("stop_sequence"),
            F.when((F.col("l_returnflag") == "R") & (p % 5 == 0), "1")
            .when(n % 2 == 0, "").otherwise("0").alias("pickup_type"),
            F.lit("0").alias("drop_off_type"),
            F.when(p % 31 == 0, F.concat(F.lit("Via "), (F.col("l_suppkey") % 5).cast("string")))
            .otherwise("").alias("stop_headsign"),
        )

    # ------------------------------------------------------------ calendar --
    def calendar(self) -> DataFrame:
        """The network's own services, and a fortnight's charter service per customer."""
        k, b = F.col("c_custkey"), self.snapshot == "B"
        raw = self.raw("customer").select("c_custkey")
        if b:
            raw = raw.filter(k % 53 != 0)
        start = F.date_add(F.lit("2026-01-01").cast("date"), (k * 7 % 340).cast("int"))
        length = F.when(k % 11 == 0, 20).otherwise(13) if b else F.lit(13)
        days = [(F.floor(k / 2 ** i) % 2).cast("string").alias(c)
                for i, c in enumerate(CALENDAR_COLUMNS[1:8])]
        charter = self._keyed(raw, self._feed_of("c_custkey")).select(
            F.concat(F.lit("H"), k.cast("string")).alias("service_id"), *days,
            F.date_format(start, "yyyyMMdd").alias("start_date"),
            F.date_format(F.date_add(start, length), "yyyyMMdd").alias("end_date"),
            "feed_id", "snapshot_id")
        own = self._per_feed(inline(self.spark, CALENDAR_COLUMNS, CALENDAR[self.snapshot]))
        return own.unionByName(charter)

    def calendar_dates(self) -> DataFrame:
        """The network's own exceptions, and one per user and day with events: charters
        run, or don't on days with errors."""
        u = F.col("user_id")
        raw = self.raw("events").select("user_id", "ts", "event_type")
        if self.snapshot == "B":
            raw = raw.filter(u % 7 != 0)
        day = F.date_add(F.col("ts").cast("date"), 1009)
        charter = self._keyed(raw, self._feed_of("user_id")).groupBy("feed_id", "snapshot_id", "user_id", day.alias("d")).agg(
            F.max(F.when(F.col("event_type") == "error", "2").otherwise("1")).alias("exception_type")).select(
            F.concat(F.lit("H"), u.cast("string")).alias("service_id"),
            F.date_format("d", "yyyyMMdd").alias("date"), "exception_type", "feed_id", "snapshot_id")
        own = self._per_feed(inline(self.spark, ["service_id", "date", "exception_type"],
                                    CALENDAR_DATES[self.snapshot]))
        return own.unionByName(charter)

    def agency(self) -> DataFrame:
        rows = [(f, self.snapshot, "A1", f"Agency {f}", z) for f, z in ZONES.items()]
        return inline(self.spark, ["feed_id", "snapshot_id", "agency_id", "agency_name",
                                   "agency_timezone"], rows)

    def feed_info(self) -> DataFrame:
        end = "20261231" if self.snapshot == "A" else "20270228"
        return self._per_feed(inline(
            self.spark, ["feed_publisher_name", "feed_start_date", "feed_end_date",
                         "feed_version"],
            [("Demo", "20260101", end, f"demo-{self.snapshot}")]))

    def zones(self) -> DataFrame:
        """(feed_id, snapshot_id, zone): every feed has one agency."""
        return self.agency().select("feed_id", "snapshot_id", F.col("agency_timezone").alias("zone"))

    def tables(self) -> dict[str, DataFrame]:
        return {"agency": self.agency(), "calendar": self.calendar(),
                "calendar_dates": self.calendar_dates(), "feed_info": self.feed_info(),
                "routes": self.routes(), "stop_times": self.stop_times(),
                "stops": self.stops(), "trips": self.trips()}

    # ------------------------------------------------------------- queries --
    def board_queries(self) -> DataFrame:
        """Every stop of every feed at four instants, plus needles no feed has."""
        at = F.explode(F.array(*[
            F.struct(F.lit(n).alias("n"),
                     F.lit(t).cast("timestamp").alias("at")) for n, t in INSTANTS.items()]))
        known = self.stops().select(
            "feed_id", "snapshot_id", F.concat(F.lit("q-"), "stop_id").alias("tag"),
            F.when(F.col("stop_code") != "", F.col("stop_code"))
            .otherwise(F.col("stop_id")).alias("needle"),
            F.when(F.col("stop_id").endswith("7"), F.concat(
                F.lit("R"), F.substring("stop_id", -2, 1))).alias("route_7"))
        unknown = self._per_feed(self.raw("supplier").select(
            F.concat(F.lit("q-X"), F.col("s_suppkey").cast("string")).alias("tag"),
            F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("needle"),
            F.lit(None).cast("string").alias("route_7")))
        return known.unionByName(unknown).select("*", at.alias("i")).select(
            "feed_id", "snapshot_id",
            F.concat_ws("/", "feed_id", "tag", F.col("i.n").cast("string")).alias("query_id"),
            "needle",
            F.unix_seconds("i.at").alias("at_epoch"),
            F.lit(90).alias("window_minutes"),
            F.when(F.col("i.n") == 4, F.col("route_7")).alias("route_filter"))

    # ------------------------------------------------------------ realtime --
    def _updates(self) -> DataFrame:
        """Events as trip updates: one entity per event, one capture per feed and day.

        Times are moved 1009 days on, so that captures surround the November
        board queries.
        """
        e = F.col("event_id")
        trip = e * 2
        # NTZ in the files; the session zone is UTC.
        fetched = F.unix_seconds(F.col("ts").cast("timestamp")) + 1009 * 86_400
        return self.raw("events").select(
            F.concat(F.lit("F"), (trip % FEEDS).cast("string")).alias("feed_id"),
            F.concat(F.lit("C"), F.floor(fetched / 86_400).cast("string")).alias("capture_id"),
            e.alias("entity_pos"), F.concat(F.lit("T"), trip.cast("string")).alias("trip_id"),
            fetched.alias("seen_epoch"), "event_type", "value",
            ((F.col("value") * 10).cast("int") - 240).alias("delay"))

    def trip_updates(self) -> DataFrame:
        kind = F.col("event_type")
        return self._updates().select(
            "feed_id", "capture_id", "entity_pos", "trip_id", "seen_epoch",
            F.when((kind == "view") & (F.col("entity_pos") % 2 == 0), "20261101").otherwise("")
            .alias("start_date"),
            F.when(kind == "signup", "CANCELED").otherwise("SCHEDULED").alias("trip_relationship"),
            F.when(kind.isin("view", "signup"), F.col("delay")).alias("trip_delay"))

    def stop_updates(self) -> DataFrame:
        """One stop update per distinct call of the trip, named by id, number or both.

        Views carry none, so that the trip delay applies.
        """
        from pyspark.sql import Window

        calls = self.stop_times().select(
            "feed_id", "trip_id", "stop_id", "stop_sequence",
            times.gtfs_seconds(F.col("departure_time")).alias("seconds")).filter(
            F.col("seconds").isNotNull()).repartition("feed_id", "trip_id").distinct()
        # A trip's calls: a handful of rows, dealt by trip once.
        order = Window.partitionBy("feed_id", "trip_id").orderBy("stop_sequence", "stop_id")
        calls = calls.withColumn("stu_pos", (F.row_number().over(order) - 1).cast("int"))
        kind, e, pos = F.col("event_type"), F.col("entity_pos"), F.col("stu_pos")
        start = F.when(F.col("feed_id") == "F0", 1_793_512_800).when(
            F.col("feed_id") == "F1", 1_793_509_200).otherwise(1_793_516_400)
        at = F.when(F.col("value") > 300, F.lit(9_000_000_000)).otherwise(
            start + F.col("seconds") + F.col("delay"))
        return (self._updates().filter(kind != "view").join(calls, ["feed_id", "trip_id"]).select(
            "feed_id", "capture_id", "entity_pos", "stu_pos", "trip_id",
            F.when((e + pos) % 3 == 1, "").otherwise(F.col("stop_id")).alias("stop_id"),
            F.when((e + pos) % 3 == 0, "").otherwise(F.col("stop_sequence"))
            .alias("stop_sequence"),
            F.when((kind == "error") & (pos % 2 == 0), "SKIPPED").otherwise("SCHEDULED")
            .alias("relationship"),
            F.when((e % 5 != 4), F.when(e % 50 == 3, F.lit(90_000)).otherwise(
                F.col("delay") + 30 * pos)).cast("int").alias("event_delay"),
            F.when(kind == "purchase", at).cast("bigint").alias("event_time"), "seen_epoch"))

    def captures(self) -> DataFrame:
        return self._updates().groupBy("feed_id", "capture_id").agg(
            F.max("seen_epoch").alias("fetched_epoch"), F.count(F.lit(1)).alias("entities"))

    def headers(self) -> DataFrame:
        """One header per event: kind by event type, header time k seconds before fetch."""
        t = F.unix_seconds(F.col("ts").cast("timestamp"))
        k = F.get_json_object("props", "$.k").cast("bigint")
        kind = F.col("event_type")
        return self.raw("events").select(
            F.concat(F.lit("F"), (F.col("event_id") % FEEDS).cast("string")).alias("feed_id"),
            F.concat(F.lit("H"), F.col("event_id").cast("string")).alias("capture_id"),
            F.when(kind == "click", "trip_updates").when(kind == "view", "vehicle_positions")
            .otherwise("alerts").alias("entity_kind"),
            F.col("ts"), t.alias("fetched_epoch"), (t - k * 5).alias("header_ts"),
            (1000 + k).alias("bytes"), (k % 7).alias("entities"))

    def field_paths(self) -> DataFrame:
        """(feed, capture_id, path, wire_type) as the decoder emits them."""
        kind, p = F.col("event_type"), F.col("event_id") % 11

        def row(path, wire, cond=None):
            cell = F.struct(F.lit(path).alias("path"), F.lit(wire).alias("wire_type"))
            return cell if cond is None else F.when(cond, cell)

        cells = F.array_compact(F.array(
            row("header", "length-delimited"), row("header.timestamp", "varint"),
            row("entity", "length-delimited"),
            row("entity.trip_update", "length-delimited", kind != "view"),
            row("entity.trip_update.delay", "varint", kind == "signup"),
            row("entity.trip_update.delay", "fixed32", (kind == "signup") & (p == 3)),
            row("entity.?7", "varint", p == 0)))
        return self.raw("events").select(
            F.concat(F.lit("F"), (F.col("event_id") % FEEDS).cast("string")).alias("feed_id"),
            F.concat(F.lit("H"), F.col("event_id").cast("string")).alias("capture_id"),
            F.explode(cells).alias("c")).select("feed_id", "capture_id", "c.*")

    # --------------------------------------------------------------- pages --
    def pages(self) -> DataFrame:
        return self.raw("pages").select(
            F.col("page_id").cast("string").alias("page_key"), "page_id", "url", "html")

    def page_captures(self) -> DataFrame:
        """Two captures per page that differ in noise only, and in content for every ninth.

        Every tenth page was captured once.
        """
        k = F.col("page_id")
        version = F.explode(F.when(k % 10 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
        v = F.col("version")
        noise = F.concat(F.lit("<article><p>Served 2026-10-0"), v.cast("string"),
                         F.lit("T08:00:00Z by "),
                         F.md5(F.concat_ws("-", k.cast("string"), v.cast("string"))),
                         F.lit(" style.css?ver=1."), v.cast("string"), F.lit("</p>"))
        news = F.concat(F.lit("<p>Fares: $2.50 - $5.00 from September 7, 2026</p>"
                              "<p>Bus: Sunday schedule</p><a href=\"/pdfs/P"),
                        (k % 5).cast("string"),
                        F.lit("/r.pdf\">PDF</a><a href=\"https://x.example/?pickId=Q"),
                        (k % 3).cast("string"), F.lit("\">next</a></article>"))
        html = F.replace("html", F.lit("<article>"), noise)
        html = F.when((v == 2) & (k % 9 == 0), F.replace(html, F.lit("</article>"), news)) \
            .otherwise(html)
        # Some pages are all navigation, some ask robots to stay away.
        html = F.when(k % 19 == 4, F.replace(F.replace(html, F.lit("<article>"), F.lit("<article><nav>")),
                                             F.lit("</article>"), F.lit("</nav></article>"))).otherwise(html)
        html = F.when(k % 6 == 1, F.replace(html, F.lit("<article>"), F.lit(
            '<meta content="NoIndex, noarchive" id="r" name="robots"><article>'))).otherwise(html)
        return self.pages().withColumn("version", version).select(
            "page_key", "page_id", "url", "version",
            (F.lit(1_790_000_000) + k + v * 86_400).alias("fetched_epoch"), html.alias("html"),
            ((k % 13 != 5) | (v == 1)).alias("extraction_ok"))

    def expected_pages(self) -> DataFrame:
        """Every page, and some that are expected but were never captured."""
        k = F.col("page_id")
        planned = self.pages().filter(k % 17 == 3).select(
            F.concat(F.lit("planned-"), "page_key").alias("page_key"), F.lit("notable").alias("severity"))
        return self.pages().select("page_key", F.when(k % 4 == 0, "alarming").when(
            k % 4 == 1, "notable").otherwise("routine").alias("severity")).unionByName(planned)

    def snapshots(self) -> DataFrame:
        """Catalogue rows of the raw pages: digest, size, time, pin; every fifth stored twice."""
        k = F.col("page_id")
        copies = F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1)))
                           .otherwise(F.array(F.lit(0))))
        sha = F.sha2(F.col("html").cast("binary"), 256)
        return self.pages().withColumn("copy", copies).select(
            F.concat_ws("-", F.lit("web"), k.cast("string"), F.col("copy").cast("string"),
                        sha).alias("capture_ref"),
            F.lit("web").alias("kind"),
            F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"),
            F.when(k % 40 == 7, F.lit("0" * 64)).otherwise(sha).alias("sha256"),
            sha.alias("actual_sha256"), F.octet_length("html").alias("bytes"),
            (F.lit(1_790_000_000) + k * 60 + F.col("copy") * 30).alias("fetched_epoch"),
            F.when((k % 25 == 0) & (F.col("copy") == 0), F.concat(F.lit("pin-"), k.cast("string")))
            .alias("pin"))
