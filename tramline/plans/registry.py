"""Named queries over the demo views: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline import KEY
from tramline.functions import text, times
from tramline.operators import calendar as cal
from tramline.operators import departures as dep
from tramline.operators import artifacts, boards, diffs, pages, printed, profile, quality
from tramline.operators import realtime as rt
from tramline.operators import stops as st
from tramline.session import configure, written, shared_path
from tramline.sources import captures, feeds
from tramline.sources.demo import Demo
from tramline.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Demo], DataFrame]):
    """Register a query under its function name, run in a configured session."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Demo(configure(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


BOARD_COLUMNS = ["query_id", "feed_id", "stop_id", "route_id", "route_short_name",
                 "route_long_name", "route_type", "headsign", "direction_id", "trip_id",
                 "stop_sequence", "service_id", "service_date", "gtfs_time", "departure_epoch",
                 "departure_local", "minutes_away", "after_midnight", "rank", "total"]


@query
def departures(d: Demo) -> DataFrame:
    return dep.departures(d.board_queries(), d).select(*BOARD_COLUMNS)


@query
def departures_lookup(d: Demo) -> DataFrame:
    """The same boards, read from a written table of stop events."""
    dates = cal.candidate_dates(d.board_queries(), d.zones()).select(*KEY, "service_date").distinct()
    path = shared_path(d.spark, "stop-events")
    events = dep.write_stop_events(d, dates, path.rsplit("/", 1)[-1].replace("-", "_"), path)
    rows = dep.ranked(dep.looked_up(d.board_queries(), d, events))
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return rows.withColumn("total", total).select(*BOARD_COLUMNS)


# ------------------------------------------------------ sources, projections --
@query
def feed_gate(d: Demo) -> DataFrame:
    """Every feed of both snapshots, and one copy that lost its stops."""
    counts = feeds.row_counts(d.tables()).unionByName(feeds.row_counts(d.at("B").tables()))
    lost = counts.filter("snapshot_id = 'B' and table_name <> 'stops'").withColumn(
        "snapshot_id", F.lit("C"))
    return feeds.feed_gate(counts.unionByName(lost))


@query
def optional_columns(d: Demo) -> DataFrame:
    return feeds.with_optional(d.stops(), ["stop_id", "stop_name", "platform_code", "stop_desc"])


# ------------------------------------------------------- search and predicates --
SEARCH_TERMS = ["red", "RING", "_", "ll w"]


def _terms(d: Demo, terms: list[str]) -> DataFrame:
    return d.spark.createDataFrame([(t,) for t in terms], "term string")


@query
def stop_search(d: Demo) -> DataFrame:
    return st.stop_search(d.stops(), _terms(d, SEARCH_TERMS)).select(
        "feed_id", "term", "stop_id", "stop_code", "stop_name")


@query
def stop_search_by_code(d: Demo) -> DataFrame:
    codes = d.board_queries().select(*KEY, F.col("needle").alias("code")).distinct()
    return st.stops_by_code(d.stops(), codes).select("feed_id", "stop_id", "stop_code")


@query
def stop_search_by_route(d: Demo) -> DataFrame:
    pairs = st.serving_pairs(d.stop_times(), d.trips())
    return st.stops_on_routes(d.stops(), pairs).select(
        "feed_id", "route_id", "stop_id", "stop_name")


@query
def route_search(d: Demo) -> DataFrame:
    return st.route_search(d.routes(), d.trips(), _terms(d, ["nation_1", "l2", "%"])).select(
        "feed_id", "term", "route_id", "route_short_name", "route_long_name", "route_type",
        "route_type_name", "trip_count")


@query
def stop_search_words(d: Demo) -> DataFrame:
    """Every stop against the first word of every supplier's and customer's nation and every
    part's last word: as many terms as the tables have."""
    last = d.raw("part").select(F.element_at(F.split("p_name", " "), -1).alias("term"))
    names = d.raw("nation").select(F.lower("n_name").alias("term"))
    terms = last.unionByName(names).distinct()
    found = st.stop_search(d.stops(), terms)
    return found.groupBy("feed_id", "term").agg(F.count(F.lit(1)).alias("stops"), F.min("stop_id").alias("first_stop"))


@query
def boardable_filter(d: Demo) -> DataFrame:
    calls = st.boardable_calls(d.stop_times()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("calls"))
    stops = st.boardable_stops(d.stops()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("stops"))
    return calls.join(stops, KEY)


# ------------------------------------------------------------ time and calendar --
@query
def gtfs_time_parse(d: Demo) -> DataFrame:
    secs = times.gtfs_seconds(F.col("departure_time"))
    return d.stop_times().groupBy("departure_time").agg(F.count(F.lit(1)).alias("n")).select(
        "departure_time", secs.alias("seconds"), times.gtfs_time(secs).alias("formatted"), "n")


@query
def time_histogram(d: Demo) -> DataFrame:
    """Calls by length of the departure time, the published baseline query."""
    return d.stop_times().groupBy(F.length("departure_time").alias("length")).agg(
        F.count(F.lit(1)).alias("calls"))


@query
def service_day_instant(d: Demo) -> DataFrame:
    days = cal.service_calendar(d.calendar(), d.calendar_dates()).select(
        *KEY, "service_date").distinct()
    zoned = cal.zoned_days(days, d.zones())
    start = F.col("day_start")
    return zoned.select(
        "feed_id", "service_date", start.alias("day_start"),
        times.local_iso(start, F.col("zone")).alias("day_start_local"),
        times.local_iso(start + 26 * 3600, F.col("zone")).alias("t26_local"))


@query
def service_calendar(d: Demo) -> DataFrame:
    return cal.service_calendar(d.calendar(), d.calendar_dates()).select(
        "feed_id", "service_id", "service_date", "origin")


@query
def candidate_service_dates(d: Demo) -> DataFrame:
    return cal.candidate_dates(d.board_queries(), d.zones()).select("query_id", "service_date")


@query
def service_day_candidates(d: Demo) -> DataFrame:
    return cal.service_day_candidates(d.board_queries(), d.zones()).select(
        "query_id", "service_date", "day_start", "gtfs_seconds", "gtfs_time", "plausible",
        "after_midnight")


@query
def late_night(d: Demo) -> DataFrame:
    totals, calls = cal.late_night(d.stop_times(), d.trips(), "24:00:00")
    return calls.select(*KEY, "trip_id", "stop_id", "departure_time", "route_id",
                      "service_id").join(
        totals.select(*KEY, "total_calls", "distinct_trips", "max_time"), KEY).drop("snapshot_id")


@query
def feed_coverage(d: Demo) -> DataFrame:
    """Coverage as of each day the board queries fall on, in the agency's zone."""
    days = d.board_queries().select(*KEY, "at_epoch").distinct().join(d.zones(), KEY).select(
        *KEY, times.local_date(F.col("at_epoch"), F.col("zone")).alias("today")).distinct()
    return cal.feed_coverage(d.calendar(), d.calendar_dates(), days, d.feed_info()).select(
        "feed_id", "today", "service_start", "service_end", "days_remaining", "expired", "warn",
        "feed_version")


# ------------------------------------------------------------------------ joins --
CALL_COLUMNS = ["feed_id", "trip_id", "stop_id", "stop_sequence", "departure_time", "seconds",
                "route_id", "service_id", "trip_headsign", "direction_id", "route_short_name",
                "route_type"]


@query
def stop_resolve_join(d: Demo) -> DataFrame:
    return st.resolve_stops(d.board_queries(), d.stops()).select(
        "feed_id", "needle", "stop_id", "matched_by", "ambiguous", "status")


@query
def calls_join(d: Demo) -> DataFrame:
    return st.calls(d.stop_times(), d.trips(), d.routes()).select(*CALL_COLUMNS)


@query
def calls_left_join(d: Demo) -> DataFrame:
    """Trips of snapshot B name routes that B dropped; the left join keeps them."""
    b = d.at("B")
    return st.calls(b.stop_times(), b.trips(), b.routes(), "left").select(*CALL_COLUMNS)


@query
def serving_join(d: Demo) -> DataFrame:
    return st.serving(d.stop_times(), d.trips(), d.routes()).select(
        "feed_id", "stop_id", "route_id", "badge")


@query
def window_range_join(d: Demo) -> DataFrame:
    """Departures per query, counted: the window join without rank or limit."""
    return dep.all_departures(d.board_queries(), d).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("departure_epoch").alias("first"),
        F.max("departure_epoch").alias("last"))


@query
def presence_joins(d: Demo) -> DataFrame:
    both = diffs.presence(d.stops(), d.at("B").stops(), ["stop_id"], ["stop_code"])
    return both.select("feed_id", "stop_id", "side")


@query
def network_departures(d: Demo) -> DataFrame:
    dates = cal.candidate_dates(d.board_queries(), d.zones()).select(*KEY, "service_date")
    return dep.network_departures(d, dates.distinct()).drop("snapshot_id")


@query
def explain_empty(d: Demo) -> DataFrame:
    return dep.explain_empty(d.board_queries(), d).drop("snapshot_id")


# ---------------------------------------------------------------------- profile --
@query
def feed_profile(d: Demo) -> DataFrame:
    return profile.feed_profile(d.tables())


@query
def feed_profile_sketched(d: Demo) -> DataFrame:
    """Columns of both snapshots together, with estimated numbers of different values."""
    both = profile.column_sketches(d.tables()).unionByName(profile.column_sketches(d.at("B").tables()))
    return profile.sketched_profile(both, ["feed_id"])


@query
def feed_features(d: Demo) -> DataFrame:
    return profile.feed_features(profile.feed_profile(d.tables()), d.zones())


@query
def feed_absent_files(d: Demo) -> DataFrame:
    return profile.absent_files(feeds.row_counts(d.tables()), d.zones())


@query
def feed_stats(d: Demo) -> DataFrame:
    return profile.feed_stats(d.tables())


@query
def entity_summary(d: Demo) -> DataFrame:
    return profile.route_summary(d.trips(), d.stop_times()).drop("snapshot_id")


@query
def route_services(d: Demo) -> DataFrame:
    return profile.route_services(d.trips()).drop("snapshot_id")


@query
def stop_detail(d: Demo) -> DataFrame:
    pairs = st.serving(d.stop_times(), d.trips(), d.routes())
    return profile.stop_summary(d.stops(), d.stop_times(), pairs).drop("snapshot_id")


@query
def sign_number(d: Demo) -> DataFrame:
    return profile.sign_number(d.stops(), "10042").drop("snapshot_id")


# ------------------------------------------------------------------------ diffs --
@query
def diff_files(d: Demo) -> DataFrame:
    """Snapshot B also lost feed_info and gained a shapes table made from its stops."""
    b = d.at("B")
    after = b.tables()
    after["shapes"] = after["stops"].select(*KEY, F.col("stop_id").alias("shape_id"))
    del after["feed_info"]
    return diffs.diff_files(feeds.row_counts(d.tables()), feeds.row_counts(after))


@query
def diff_routes(d: Demo) -> DataFrame:
    return diffs.diff_routes(d.routes(), d.at("B").routes())


@query
def diff_stops(d: Demo) -> DataFrame:
    return diffs.diff_stops(d.stops(), d.at("B").stops())


@query
def id_survival(d: Demo) -> DataFrame:
    return diffs.id_survival(d.stops(), d.at("B").stops())


@query
def id_life_spans(d: Demo) -> DataFrame:
    """Ids and codes of the stops over six snapshots."""
    return diffs.id_life_spans(d.stop_history(), d.stop_snapshots())


@query
def diff_calendar(d: Demo) -> DataFrame:
    b = d.at("B")
    return diffs.diff_calendar(d.calendar(), d.calendar_dates(), b.calendar(), b.calendar_dates())


def _all_calls(d: Demo) -> DataFrame:
    return st.calls(d.stop_times(), d.trips(), d.routes(), "left")


@query
def diff_schedule(d: Demo) -> DataFrame:
    return diffs.diff_schedule(_all_calls(d), _all_calls(d.at("B")))


@query
def diff_route_schedule(d: Demo) -> DataFrame:
    return diffs.diff_route_schedule(_all_calls(d), _all_calls(d.at("B")))


@query
def diff_findings(d: Demo) -> DataFrame:
    b = d.at("B")
    return diffs.diff_findings(
        diffs.diff_files(feeds.row_counts(d.tables()), feeds.row_counts(b.tables())),
        diffs.diff_routes(d.routes(), b.routes()),
        diffs.diff_stops(d.stops(), b.stops()),
        diffs.id_survival(d.stops(), b.stops()),
        diffs.window_shift(d.calendar(), d.calendar_dates(), b.calendar(), b.calendar_dates()),
        diffs.diff_calendar(d.calendar(), d.calendar_dates(), b.calendar(), b.calendar_dates()))


# --------------------------------------------------------------------- realtime --
RT_KINDS = ["trip_updates", "vehicle_positions", "alerts", "shapes"]


@query
def rt_field_census(d: Demo) -> DataFrame:
    return rt.field_census(d.field_paths(), d.headers())


def _health(d: Demo) -> DataFrame:
    as_of = d.headers().groupBy("feed_id").agg((F.max("fetched_epoch") + 60).alias("as_of"))
    return rt.feed_health(d.headers(), as_of, RT_KINDS)


@query
def rt_feed_health(d: Demo) -> DataFrame:
    return _health(d)


@query
def rt_latest_update(d: Demo) -> DataFrame:
    return rt.latest_update(d.trip_updates()).drop("seen_epoch")


def _overlaid(d: Demo) -> DataFrame:
    queries = d.board_queries()
    # Written, so that the driver plans boards and captures one after the other.
    rows = written(dep.departures(queries, d), "departures")
    return rt.overlay(rows, queries, d.trip_updates(), d.stop_updates(),
                      d.captures())


@query
def rt_overlay(d: Demo) -> DataFrame:
    return _overlaid(d).select(
        "query_id", "rank", "trip_id", "stop_id", "stop_sequence", "service_date",
        "departure_epoch", "minutes_away", "capture_id", "realtime", "status", "delay_seconds",
        "delay_basis", "predicted_epoch", "minutes_predicted")


@query
def rt_match_rate(d: Demo) -> DataFrame:
    return rt.match_rate(_overlaid(d))


@query
def rt_join_rate(d: Demo) -> DataFrame:
    return rt.join_rate(d.trip_updates(), d.trips())


# ----------------------------------------------------------------------- boards --
@query
def expected_board(d: Demo) -> DataFrame:
    return boards.expected_board(
        d.board_queries(), d, d.trip_updates(), d.stop_updates(), d.captures()).drop("zone")


def _board_sides(d: Demo) -> tuple[DataFrame, DataFrame]:
    """Every departure board against a copy of it with deterministic faults.

    Boards differ in what they carry, so that every way of pairing occurs.
    """
    # Both sides are read several times.
    rows = written(dep.ranked(dep.all_departures(d.board_queries(), d)), "boards")
    t = F.substring("trip_id", 2, 20).cast("bigint")
    s = F.substring("stop_id", 2, 20).cast("bigint")
    base = rows.select(
        "feed_id", F.col("query_id").alias("board_id"), F.col("rank").alias("position"),
        "route_id", F.col("route_short_name").alias("route"), "headsign",
        F.col("departure_local").alias("departure"), "minutes_away",
        F.lit("SCHEDULED_ONLY").alias("status"), F.lit("false").alias("realtime"),
        "stop_id", "service_date", t.alias("t"), s.alias("s"), "departure_epoch", "gtfs_time",
        F.when(s % 2 == 0, F.col("trip_id")).alias("trip_id"))
    t, s = F.col("t"), F.col("s")
    clock = F.when(t % 13 == 0, F.concat(F.lit(" "), "gtfs_time")).when(
        t % 13 == 1, F.date_format(F.timestamp_seconds("departure_epoch"),
                                   "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("departure"))
    late = F.date_format(F.timestamp_seconds(F.col("departure_epoch") + 60),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    observed = base.filter(t % 17 != 0).select(
        "feed_id", "board_id", "position",
        F.when(s % 5 == 0, None).when(t % 7 == 0, F.col("route_id")).otherwise(F.col("route"))
        .alias("route"),
        F.when(t % 23 == 0, F.upper("headsign")).when(t % 29 == 0, F.lit("Depot"))
        .otherwise(F.col("headsign")).alias("headsign"),
        F.when(s % 11 == 0, F.lit("soon")).when(t % 19 == 0, late).otherwise(clock)
        .alias("departure"),
        F.concat("minutes_away", F.lit(".0")).alias("minutes_away"),
        F.initcap("realtime").alias("realtime"), "stop_id", "trip_id", "t")
    repeats = observed.filter(F.col("t") % 31 == 0).withColumn(
        "position", F.col("position") + 1000)
    return base, observed.unionByName(repeats)


@query
def board_reconcile(d: Demo) -> DataFrame:
    expected, observed = _board_sides(d)
    return boards.reconcile(expected, observed, d.zones())


@query
def board_reconcile_summary(d: Demo) -> DataFrame:
    expected, observed = _board_sides(d)
    return boards.reconcile_summary(boards.reconcile(expected, observed, d.zones()))


# ------------------------------------------------------------------------ pages --
@query
def page_scan(d: Demo) -> DataFrame:
    pages = captures.page_scan(d.spark, f"{d.dir}/pages.parquet")
    return pages.select("page_id", "url", F.octet_length("html").alias("bytes"),
                        F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


def _normalized(d: Demo, captures: DataFrame | None = None) -> DataFrame:
    """Spread by page first: a page table is few files, and the expressions are long."""
    captures = d.page_captures() if captures is None else captures
    return pages.normalize_pages(captures.repartition("page_key"), fold=False)


def _newest(d: Demo) -> DataFrame:
    """The newest capture of every page."""
    last = d.page_captures().groupBy("page_key").agg(F.max("version").alias("version"))
    return d.page_captures().join(last, ["page_key", "version"], "left_semi")


@query
def page_normalize(d: Demo) -> DataFrame:
    return _normalized(d).select(
        "page_key", "version", "strategy", "content_hash", "bytes_raw", "bytes_text",
        "signal_ratio", "word_count", "line_count", "noarchive", "nosnippet", "noindex")


@query
def page_drift(d: Demo) -> DataFrame:
    return pages.page_drift(d.expected_pages(), _normalized(d))


@query
def page_line_delta(d: Demo) -> DataFrame:
    return pages.line_delta(_normalized(d))


@query
def page_extract(d: Demo) -> DataFrame:
    """Facts printed on the newest capture of every page."""
    return pages.page_facts(_normalized(d, _newest(d)))


@query
def page_schedule_ids(d: Demo) -> DataFrame:
    return pages.schedule_ids(_newest(d))


@query
def page_field_delta(d: Demo) -> DataFrame:
    """Facts of the two newest captures as nested records, and how they differ by path."""
    normal = written(_normalized(d).select("page_key", "version", "fetched_epoch", "content_hash", "text"), "captures")
    facts = pages.page_facts(normal.withColumn("page_key", F.struct("page_key", "version"))).select(
        "page_key.*", F.col("line_no").cast("string").alias("line"), F.struct("cents", "date_iso", "phrase", "mode").alias("fact"))
    records = facts.groupBy("page_key", "version").agg(F.to_json(F.struct(F.map_from_entries(
        F.collect_list(F.struct("line", "fact"))).alias("lines"))).alias("record"))
    return pages.record_delta(normal.drop("text").join(records, ["page_key", "version"], "left"))


def _price_cell():
    """Printed prices of parts, in the spellings price tables use."""
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return (F.when(k % 7 == 0, "Free").when(k % 11 == 0, F.concat(F.lit("$"), price, F.lit("-$9")))
            .when(k % 13 == 0, F.concat(price, F.lit("9"))).when(
                k % 5 == 0, F.concat(F.lit("$1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
            .otherwise(F.concat(F.lit("$ "), price)))


@query
def price_normalize(d: Demo) -> DataFrame:
    rows = d.raw("part").select("p_partkey", _price_cell().alias("cell"))
    return rows.withColumn("p", text.price_cell(F.col("cell"))).select("p_partkey", "cell", "p.*")


@query
def fare_rows(d: Demo) -> DataFrame:
    """Fare tables of twenty pages, made of every part, under headings that vary."""
    k = F.col("p_partkey")
    cells = F.create_map(
        F.when(k % 3 == 0, "Fare Type").otherwise(" PRODUCT:"), F.col("p_name"), F.lit("Service"),
        F.when(k % 4 == 0, "Bus").when(k % 4 == 1, " Rail ").otherwise(""), F.lit("Rider Category"),
        F.concat(F.lit("Size "), F.col("p_size").cast("string")), F.when(k % 2 == 0, "Price").otherwise("Price (USD)"),
        F.when(k % 17 == 0, " ").otherwise(_price_cell()), F.lit("Notes"), F.when(k % 9 == 0, "Valid today").otherwise(""))
    return printed.fare_rows(d.raw("part").select(
        F.concat(F.lit("src"), (k % 20).cast("string")).alias("page_key"), k.alias("row_no"), cells.alias("cells")))


@query
def holiday_rows(d: Demo) -> DataFrame:
    """Holiday tables of fifteen pages, made of every order, for one year."""
    k = F.col("o_orderkey")
    cells = F.create_map(
        F.lit("Holiday"), F.concat(F.lit("H"), (k % 50).cast("string")), F.when(k % 2 == 0, "Date").otherwise("Observed"),
        _printed_day(), F.lit("Bus"), F.when(k % 4 == 0, "Sunday schedule").when(k % 4 == 1, "No Service").when(
            k % 4 == 2, "").otherwise("Regular"), F.lit("Light Rail"), F.when(k % 5 == 0, "Weekend").when(k % 5 == 1, "").when(
            k % 5 == 2, "Sunday").when(k % 5 == 3, "Snow").otherwise("Holiday"))
    return printed.holiday_rows(d.raw("orders").select(
        F.concat(F.lit("src"), (k % 15).cast("string")).alias("page_key"), k.alias("row_no"), cells.alias("cells")), 1995)


def _printed_day():
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return (F.when(k % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
            .when(k % 6 == 1, F.date_format(day, "yyyyMMdd"))
            .when(k % 6 == 2, F.date_format(day, "M/d/yy"))
            .when(k % 6 == 3, F.date_format(day, "M/d"))
            .when(k % 6 == 4, F.date_format(day, "EEEE, MMMM d, yyyy"))
            .otherwise(F.concat(F.date_format(day, "MMM"), F.lit(". "), F.dayofmonth(day))))


@query
def holiday_normalize(d: Demo) -> DataFrame:
    """Printed dates and service wording made from every order."""
    k = F.col("o_orderkey")
    words = F.concat(F.col("o_orderpriority"), F.when(k % 4 == 0, " Sunday schedule").when(
        k % 4 == 1, " No Service").when(k % 4 == 2, " light rail weekend service").otherwise(""))
    return d.raw("orders").select(
        "o_orderkey", _printed_day().alias("printed"), words.alias("words")).select(
        "o_orderkey", "printed", text.holiday_date(F.col("printed"), F.lit(2026)).alias("day"),
        text.service_type(F.col("words")).alias("service"),
        text.mode_of(F.col("words")).alias("mode"))


# ---------------------------------------------------------------------- quality --
def _expected_zones(d: Demo) -> DataFrame:
    """The zone each feed had when it was first read; one has moved since."""
    return d.zones().select("feed_id", F.when(F.col("feed_id") == "F2", "America/Phoenix")
                            .otherwise(F.col("zone")).alias("zone"))


def _suite(d: Demo) -> DataFrame:
    newest = pages.newest_two(_normalized(d))
    named = {"1": "fares", "2": "holidays", "4": "developer_terms"}
    label = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("page_key")]
    hashes = newest.select(label.alias("page_key"), F.col("now.content_hash")
                           .alias("content_hash")).filter("page_key IS NOT NULL")
    # Recorded: the first capture of the fares page, none for holidays, a wrong one for terms.
    recorded = newest.select(label.alias("page_key"), F.when(
        F.col("page_key") == "1", F.col("before.content_hash")).when(
        F.col("page_key") == "4", "0" * 64).otherwise("").alias("expected_hash")).filter(
        "page_key IS NOT NULL")
    tables = d.tables()
    today = d.zones().select(*KEY, F.lit("2026-11-01").cast("date").alias("today"))
    return quality.assumptions(quality.Inputs(
        zones=_expected_zones(d), tables=tables, feeds=today, baseline=d.at("B").tables(), rt_health=_health(d),
        rt_join=rt.join_rate(d.trip_updates(), d.trips()),
        rt_census=rt.field_census(d.field_paths(), d.headers()),
        page_hashes=hashes, recorded=recorded))


@query
def assumptions(d: Demo) -> DataFrame:
    return _suite(d).drop("snapshot_id")


@query
def assumptions_static_only(d: Demo) -> DataFrame:
    """Without optional inputs their checks are skips, never passes."""
    today = d.zones().select(*KEY, F.lit("2026-12-28").cast("date").alias("today"))
    return quality.assumptions(quality.Inputs(tables=d.tables(), feeds=today, zones=_expected_zones(d))).drop("snapshot_id")


@query
def feed_status(d: Demo) -> DataFrame:
    today = d.zones().select(*KEY, F.lit("2026-12-28").cast("date").alias("today"))
    # A page that is planned only belongs to the feed of the page it is planned beside.
    number = F.regexp_replace("page_key", "^planned-", "")
    drift = pages.page_drift(d.expected_pages(), _normalized(d)).select(
        F.concat(F.lit("F"), (number.cast("int") % 3).cast("string")).alias("feed_id"), "status")
    return quality.feed_status(
        d.zones(), cal.feed_coverage(d.calendar(), d.calendar_dates(), today), _suite(d),
        _health(d).filter("entity_kind <> 'shapes'"), drift, None)


# -------------------------------------------------------------------- artifacts --
@query
def snapshot_manifest(d: Demo) -> DataFrame:
    k = F.col("page_id")
    given = d.pages().select(
        F.lit("web").alias("kind"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"),
        F.col("html").cast("binary").alias("content"),
        (F.lit(1_790_000_000) + k * 60).alias("fetched_epoch"))
    pins = d.snapshots().filter("pin IS NOT NULL").select("pin", F.concat_ws(
        "-", F.lit("web"), "source", F.date_format(F.timestamp_seconds("fetched_epoch"),
                                                   "yyyyMMdd'T'HHmmss'Z'"),
        "actual_sha256").alias("capture_ref"))
    return captures.snapshot_manifest(given, pins)


@query
def snapshot_latest(d: Demo) -> DataFrame:
    return artifacts.snapshot_latest(d.snapshots())


@query
def snapshot_duplicates(d: Demo) -> DataFrame:
    return artifacts.snapshot_duplicates(d.snapshots())


@query
def snapshot_retention(d: Demo) -> DataFrame:
    return artifacts.retention(d.snapshots(), 5).select("capture_ref", "source", "bytes")


@query
def snapshot_integrity(d: Demo) -> DataFrame:
    return artifacts.integrity(d.snapshots()).select("capture_ref", "intact")


@query
def stops_index(d: Demo) -> DataFrame:
    pairs = st.serving(d.stop_times(), d.trips(), d.routes())
    return artifacts.stops_index(d.stops(), pairs).drop("snapshot_id")


@query
def stops_index_report(d: Demo) -> DataFrame:
    return artifacts.index_report(d.stops()).drop("snapshot_id")


@query
def compact_decisions(d: Demo) -> DataFrame:
    return artifacts.prune_decisions(profile.feed_profile(d.tables()), "balanced").drop("snapshot_id")


def _compacted(d: Demo) -> dict[str, DataFrame]:
    return artifacts.compact(d.tables(), "balanced", days=30)


@query
def compact_prune(d: Demo) -> DataFrame:
    return feeds.row_counts(_compacted(d)).drop("snapshot_id")


@query
def compact_sink(d: Demo) -> DataFrame:
    """Write the pruned feed clustered, read it back, and count rows and text."""
    path = shared_path(d.spark, "compact")
    tables = _compacted(d)
    artifacts.compact_sink(tables, path)
    out = None
    for name, df in sorted(tables.items()):
        back = d.spark.read.schema(df.schema).parquet(f"{path}/{name}")
        size = sum(F.length(F.coalesce(c, F.lit(""))) for c in back.columns if c not in KEY)
        part = back.groupBy("feed_id").agg(F.count(F.lit(1)).alias("rows"),
                                           F.sum(size).alias("characters")).select(
            "feed_id", F.lit(name).alias("table_name"), "rows", "characters",
            F.lit(",".join(sorted(c for c in back.columns if c not in KEY))).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def json_artifact_sink(d: Demo) -> DataFrame:
    pairs = st.serving(d.stop_times(), d.trips(), d.routes())
    index = artifacts.stops_index(d.stops(), pairs)
    return artifacts.json_rows(index, ["feed_id", "code"])


@query
def artifact_manifest(d: Demo) -> DataFrame:
    """Write two JSON artifacts and total their manifest."""
    root = shared_path(d.spark, "artifacts")
    pairs = st.serving(d.stop_times(), d.trips(), d.routes())
    index = artifacts.stops_index(d.stops(), pairs)
    artifacts.json_artifact_sink(index, ["feed_id", "code"], f"{root}/stops_index")
    artifacts.json_artifact_sink(d.routes(), ["feed_id", "route_id"], f"{root}/routes")
    files = artifacts.artifact_manifest(d.spark, {
        "stops_index": f"{root}/stops_index", "routes": f"{root}/routes"})
    return files.groupBy("name").agg(
        F.sum("rows").cast("bigint").alias("rows"), F.sum("bytes").alias("bytes"),
        F.min((F.length("sha256") == 64)).alias("hashed"))


@query
def golden_regression(d: Demo) -> DataFrame:
    """Today's boards against a recording with deterministic differences."""
    queries = d.board_queries()
    rows = artifacts.golden_rows(written(dep.ranked(dep.all_departures(queries, d)), "boards"))
    t = F.substring("trip_id", 2, 20).cast("bigint")
    golden = rows.filter(t % 41 != 0).withColumn("headsign", F.when(t % 43 == 0, "Depot").otherwise(
        F.col("headsign"))).withColumn("direction_id", F.when(t % 86 == 0, "9").otherwise(
            F.col("direction_id")))
    unresolved = st.resolve_stops(queries, d.stops()).filter("stop_id IS NULL").select(
        *KEY, "needle").join(queries.select(*KEY, "needle", "query_id"), [*KEY, "needle"]).select(
        F.col("query_id").alias("case_id"), F.lit("StopNotFound").alias("error"))
    recorded = unresolved.filter(~F.col("case_id").endswith("/3")).withColumn(
        "error", F.when(F.col("case_id").endswith("/2"), "FeedExpired").otherwise(F.col("error")))
    return artifacts.golden_regression(
        queries.select(F.col("query_id").alias("case_id")), golden, rows, recorded, unresolved)


@query
def feed_publish(d: Demo) -> DataFrame:
    """Publish two snapshots, then one without stops, which is refused; read what stands."""
    root = shared_path(d.spark, "published")
    tables = {n: d.tables()[n] for n in ("routes", "stops", "trips")}
    artifacts.publish(tables, root)
    artifacts.publish({n: d.at("B").tables()[n] for n in tables}, root)
    artifacts.publish({**tables, "stops": tables["stops"].filter("feed_id <> 'F1'"),
                       "trips": tables["trips"].filter("direction_id = '0'")}, root)
    return feeds.row_counts({n: artifacts.published(d.spark, root, n, df.schema) for n, df in tables.items()})


@query
def feed_sql(d: Demo) -> DataFrame:
    return artifacts.feed_sql(d.spark, d.tables(), """
        SELECT feed_id, service_id, route_id, count(*) AS calls, count(DISTINCT stop_id) AS stops
        FROM stop_times JOIN trips USING (feed_id, trip_id)
        GROUP BY feed_id, service_id, route_id""")


@query
def paginate(d: Demo) -> DataFrame:
    return artifacts.paginate(d.stops(), ["feed_id"], ["stop_name", "stop_id"], 100, 50).select(
        "feed_id", "row", "stop_id", "stop_name", "total", "has_more", "next_offset")


# ---------------------------------------------------------------------- landing --
@query
def gtfs_scan(d: Demo) -> DataFrame:
    """Write the feeds as text files with a byte order mark and shuffled columns, scan them."""
    root = shared_path(d.spark, "landed")
    tables = d.tables()
    out = None
    for name, df in sorted(tables.items()):
        columns = [c for c in df.columns if c not in KEY]
        path = f"{root}/{name}"
        (df.select(*KEY, *[F.col(c).alias(("\ufeff" if i == 0 else "") + c)
                           for i, c in enumerate(sorted(columns))])
         .write.partitionBy(*KEY).options(header=True, emptyValue="", ignoreLeadingWhiteSpace=False,
                                             ignoreTrailingWhiteSpace=False).csv(path))
        back = feeds.gtfs_scan(d.spark, path, columns, "*.csv").select(
            *KEY, *[F.col(c) for c in columns])
        size = sum(F.length(c) for c in columns)
        part = back.groupBy("feed_id").agg(F.count(F.lit(1)).alias("rows"),
                                           F.sum(size).alias("characters")).select(
            "feed_id", F.lit(name).alias("table_name"), "rows", "characters",
            F.lit(",".join(sorted(c for c in back.columns if c not in KEY))).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


# -------------------------------------------------------------------- streaming --
class _StreamDemo(Demo):
    """The demo views over the event stream instead of the event table."""

    def raw(self, name: str) -> DataFrame:
        table = super().raw(name)
        if name != "events":
            return table
        return self.spark.readStream.schema(table.schema).option(
            "pathGlobFilter", "events.parquet").parquet(self.dir)


@query
def stream_freshness(d: Demo) -> DataFrame:
    live = _StreamDemo(d.spark, d.dir).headers().withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_available(jobs.freshness(live), shared_path(d.spark, "freshness"))


def _trip_stream(d: Demo) -> DataFrame:
    """Updates of recurring trips (one per user), arriving out of header order."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    seen = F.unix_seconds(F.col("ts").cast("timestamp"))
    return d.raw("events").select(
        F.concat(F.lit("F"), (F.col("user_id") % 3).cast("string")).alias("feed_id"),
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("trip_id"),
        (seen - k * 60).alias("header_ts"), F.col("event_id").alias("entity_pos"),
        ((F.col("value") * 10).cast("int") - 240).alias("delay"), seen.alias("seen_epoch"),
        F.col("ts").cast("timestamp").alias("ts"))


@query
def stream_outages(d: Demo) -> DataFrame:
    """Silences of five minutes or more of each feed and kind."""
    live = _StreamDemo(d.spark, d.dir).headers().withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.outages(jobs.run_available(jobs.poll_spells(live), shared_path(d.spark, "spells")))


@query
def stream_latest_trip_state(d: Demo) -> DataFrame:
    state = jobs.TripState(d.spark, shared_path(d.spark, "trip-state"))
    return state.run(_trip_stream(_StreamDemo(d.spark, d.dir)))


@query
def stream_live_board(d: Demo) -> DataFrame:
    """Streamed stop updates against every departure that they reach, whatever its date.

    A trip's departures are built for the days around each of its captures: from the longest
    trip before to two days after, enough for any zone.
    """
    stream = _StreamDemo(d.spark, d.dir).stop_updates()
    longest = d.stop_times().groupBy("feed_id").agg(F.floor(
        F.max(times.gtfs_seconds(F.col("departure_time"))) / times.DAY).cast("int").alias("longest"))
    day = F.date_from_unix_date(F.floor(F.col("seen_epoch") / times.DAY).cast("int"))
    seen = d.trip_updates().select("feed_id", "trip_id", day.alias("day")).distinct()
    reached = seen.join(longest, "feed_id").select("feed_id", "trip_id", F.explode(F.sequence(
        F.date_sub("day", F.col("longest") + 1), F.date_add("day", 2))).alias("service_date")).distinct()
    dates = reached.select("feed_id", "service_date").distinct().join(d.zones(), "feed_id").select(*KEY, "service_date")
    static = dep.network_departures(d, dates, reached=reached).withColumn("minutes_away", F.lit(0))
    status = d.trip_updates().select("feed_id", "capture_id", "entity_pos", "start_date",
                                     "trip_relationship", "trip_delay")
    board = jobs.live_board(stream, status, static).select(
        "feed_id", "service_date", "trip_id", "stop_id", "stop_sequence", "departure_epoch",
        "capture_id", "entity", "stu_pos", "realtime", "status", "delay_seconds",
        "predicted_epoch")
    return jobs.LiveBoard(d.spark, shared_path(d.spark, "live-board")).run(board)
