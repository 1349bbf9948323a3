"""Scheduled departures: per query, for the whole network, and why none showed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline import FEED, KEY
from tramline.functions import times
from tramline.operators import calendar as cal
from tramline.operators import stops as st
from tramline.session import written

# Width of the second-of-service-day bucket in the window join. It turns the
# band condition into an equi key, so a stop holding a large share of all calls
# is spread over its hours and a query only meets the hours it asks for.
BUCKET_SECONDS = 3600

# Asked stops are told from others by a hash with so many values before calls are shuffled.
STOP_HASHES = 1 << 16

ORDER = ["departure_epoch", "route_short_name", "trip_id", "stop_sequence", "stop_id",
         "service_date", "headsign"]


def headsign():
    own = F.coalesce("stop_headsign", F.lit(""))
    return F.when(own != "", own).otherwise(F.coalesce("trip_headsign", F.lit("")))


def boardable(stop_times: DataFrame, trips: DataFrame,
              targets: DataFrame | None = None, hours: DataFrame | None = None) -> DataFrame:
    """Boardable calls with parsed seconds, joined to their trips.

    ``targets`` (feed, snapshot, stop_id) and ``hours`` (see ``asked_hours``; trips then
    carry ``service_days``) prune the calls before the trip join, so that few others than
    asked ones are shuffled. Both only prune: stops are told apart by a hash, so the
    caller joins them again.
    """
    rows = st.boardable_calls(stop_times)
    if targets is not None:
        # As many numbers as there are hashes at most, whatever is asked.
        asked = F.broadcast(targets.select(_stop_hash().alias("hash")).distinct())
        rows = rows.withColumn("hash", _stop_hash()).join(asked, "hash", "left_semi").drop("hash")
    if hours is None:
        calls = st.trip_calls(rows, trips)
    else:
        calls = in_hours(st.trip_calls(rows, trips, lambda c: in_hours(c, hours)), hours, F.coalesce(
            F.try_element_at("service_days", F.col("asked_word")), F.lit(0).cast("bigint")).bitwiseAND(F.col("asked_days")) != 0)
    return calls.filter(F.col("seconds").isNotNull()).drop("departure_time", "pickup_type")


def _stop_hash():
    return F.pmod(F.xxhash64(*KEY, "stop_id"), F.lit(STOP_HASHES))


def asked_hours(slots: DataFrame) -> DataFrame:
    """The service days asked for in each hour: per (feed, snapshot, bucket, word) a bitmap
    and the range of seconds. As many rows as hours, and words of asked dates, per feed."""
    day = F.col("service_date")
    return _bucketed(slots).groupBy(*KEY, "bucket", cal.word_of(day).alias("asked_word")).agg(
        F.bit_or(cal.day_bit(day)).alias("asked_days"), F.min("from_s").alias("since"), F.max("to_s").alias("until"))


def in_hours(calls: DataFrame, hours: DataFrame, also=None) -> DataFrame:
    """Calls in an hour of ``hours`` and its range, for which ``also`` holds."""
    asked = F.broadcast(hours.withColumnsRenamed({c: f"asked_{c}" for c in [*KEY, "bucket"]}))
    on = [F.col(c) == F.col(f"asked_{c}") for c in KEY]
    on += [F.floor(F.col("seconds") / BUCKET_SECONDS) == F.col("asked_bucket"), F.col("seconds").between(F.col("since"), F.col("until"))]
    return calls.join(asked, on if also is None else [*on, also], "left_semi")


def _bucketed(slots: DataFrame) -> DataFrame:
    """The slots, once for each hour they touch."""
    first, last = (F.floor(F.col(c) / BUCKET_SECONDS) for c in ("from_s", "to_s"))
    return slots.withColumn("bucket", F.explode(F.sequence(first, last)))


def window_slots(instants: DataFrame, zones: DataFrame, span: DataFrame) -> DataFrame:
    """The service dates each distinct instant may board, and the seconds on them.

    ``instants`` lists (at_epoch, window_minutes). Each is spread over its candidate
    dates, and its window becomes a range [from_s, to_s] of GTFS seconds there. All
    time-zone work is done here, once per instant instead of once per query or call.
    ``span`` (feed, snapshot, lo, hi) is the range of call seconds; dates outside it are
    dropped (mostly the two days back).
    """
    days = cal.candidate_dates(instants, zones).join(span, KEY)
    days = days.withColumn("day_start", times.day_start(F.col("service_date"), F.col("zone")))
    return days.withColumns({
        "from_s": F.greatest(F.col("at_epoch") - F.col("day_start"), F.col("lo")),
        "to_s": F.least(F.col("at_epoch") + F.col("window_minutes") * 60 - F.col("day_start"),
                        F.col("hi"))}).filter(F.col("from_s") <= F.col("to_s")).drop("lo", "hi")


def query_days(queries: DataFrame, resolved: DataFrame, slots: DataFrame) -> DataFrame:
    """(query, stop_id, service_date, bucket) a call must match; its service's bitmap then
    says whether it runs that day, so queries never meet the calendar.

    The buckets a window touches are, with the stop, the equi keys of the window join.
    """
    slots = _bucketed(slots)
    found = resolved.filter(F.col("stop_id").isNotNull()).select(*KEY, "needle", "stop_id")
    return (queries.withColumn("needle", F.trim("needle")).join(found, [*KEY, "needle"])
            .join(slots, [*KEY, "at_epoch", "window_minutes"]))


def call_span(stop_times: DataFrame) -> DataFrame:
    """Earliest and latest call second per (feed, snapshot)."""
    secs = times.gtfs_seconds(F.col("departure_time"))
    return stop_times.groupBy(*KEY).agg(F.min(secs).cast("bigint").alias("lo"),
                                        F.max(secs).cast("bigint").alias("hi"))


def window_join(days: DataFrame, calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls whose instant lies in [at, at + window], both ends included, and whose
    service runs on the date.

    Range and bit are tested inside the join. Routes join the hits, which are few,
    rather than travelling with all calls.
    """
    keyed = calls.withColumn("bucket", F.floor(F.col("seconds") / BUCKET_SECONDS))
    hits = days.join(keyed, [*KEY, "stop_id", "bucket"]).filter(
        F.col("seconds").between(F.col("from_s"), F.col("to_s"))
        & cal.runs_on(F.col("service_days"), F.col("service_date"))).drop("service_days")
    return of_route(st.with_route(hits, routes))


def of_route(hits: DataFrame) -> DataFrame:
    """Hits of the route that the query names by id or badge, if it names one."""
    if "route_filter" not in hits.columns:
        return hits
    return hits.filter(F.col("route_filter").isNull() | (F.col("route_filter") == F.col("route_id"))
                       | (F.col("route_filter") == F.col("route_short_name")))


def shaped(hits: DataFrame) -> DataFrame:
    """The departure record of each joined call."""
    instant = F.col("day_start") + F.col("seconds")
    return hits.select(
        *KEY, "query_id", "stop_id", "route_id", "route_short_name", "route_long_name",
        "route_type", headsign().alias("headsign"), "direction_id", "trip_id", "stop_sequence",
        "service_id", "service_date", times.gtfs_time(F.col("seconds")).alias("gtfs_time"),
        instant.alias("departure_epoch"),
        times.local_iso(instant, F.col("zone")).alias("departure_local"),
        F.floor((instant - F.col("at_epoch")) / 60).cast("int").alias("minutes_away"),
        (F.col("seconds") >= times.DAY).alias("after_midnight"), "zone", "at_epoch")


def running_trips(feed, dates: DataFrame) -> DataFrame:
    """Trips whose service runs near the asked dates, with its bitmap for them."""
    bitmaps = cal.service_bitmaps(cal.service_words(feed.calendar(), feed.calendar_dates(), dates))
    return feed.trips().join(bitmaps, [*KEY, "service_id"])


def resolved_stops(queries: DataFrame, feed) -> DataFrame:
    """The resolution of the queries' needles."""
    return st.resolve_stops(queries, feed.stops())


def all_departures(queries: DataFrame, feed, resolved: DataFrame | None = None) -> DataFrame:
    """Every departure of every query, without rank or limit.

    ``feed`` has the tables stops, stop_times, trips, routes, calendar,
    calendar_dates and zones as methods.
    """
    resolved = resolved_stops(queries, feed) if resolved is None else resolved
    zones = feed.zones()
    spans = queries.select(*KEY, "at_epoch", "window_minutes").distinct()
    dates = cal.candidate_dates(spans, zones).select(*KEY, "service_date").distinct()
    targets = resolved.filter(F.col("stop_id").isNotNull()).select(*KEY, "stop_id").distinct()
    # A row per instant and date; written, as calls are pruned by them twice.
    slots = written(window_slots(spans, zones, call_span(feed.stop_times())), "slots")
    rows = boardable(feed.stop_times(), running_trips(feed, dates), targets, asked_hours(slots))
    return shaped(window_join(query_days(queries, resolved, slots), rows, feed.routes()))


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Departures with their rank on the query's board; the first ``limit`` if given."""
    order = Window.partitionBy("query_id").orderBy(*ORDER)
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if limit is None else rows.filter(F.col("rank") <= limit)


def departures(queries: DataFrame, feed, limit: int | None = None) -> DataFrame:
    """Every departure of each query, ranked, with the query's total.

    With ``limit`` only the first are ranked: the total is then an aggregate of its
    own, so that the rank filter is applied before the shuffle.
    """
    rows = all_departures(queries, feed)
    if limit is None:
        whole = Window.partitionBy("query_id")
        return ranked(rows).withColumn("total", F.count(F.lit(1)).over(whole))
    totals = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return ranked(rows, limit).join(totals, "query_id")


def network_departures(feed, dates: DataFrame | None = None, details: bool = False,
                       reached: DataFrame | None = None) -> DataFrame:
    """Every departure of every stop on the requested service dates.

    A day's instant is resolved per (feed, date); calls add their seconds. With
    ``details`` the columns that a board shows of the route come along. With ``reached``
    (feed, trip_id, service_date), each once, only those trips on those dates: they are
    found among the trips, so that calls are not spread over days they do not need.
    """
    services = cal.service_calendar(feed.calendar(), feed.calendar_dates(), dates)
    days = cal.zoned_days(services, feed.zones())
    instant = F.col("day_start") + F.col("seconds")
    if reached is None:
        rows = st.with_route(boardable(feed.stop_times(), feed.trips()), feed.routes()).join(days, [*KEY, "service_id"])
    else:
        trips = feed.trips().join(reached, [*FEED, "trip_id"]).join(
            days.select(*KEY, "service_id", "service_date", "day_start"), [*KEY, "service_id", "service_date"])
        rows = st.with_route(boardable(feed.stop_times(), trips), feed.routes())
    return rows.select(
        *KEY, "service_date", "stop_id", "stop_sequence", "trip_id", "route_id",
        "route_short_name", headsign().alias("headsign"), "direction_id", "service_id",
        "seconds", instant.alias("departure_epoch"),
        (F.col("seconds") >= times.DAY).alias("after_midnight"),
        *(["route_long_name", "route_type", "stop_headsign", "trip_headsign"] if details else []))


EVENT_PLACE = [*KEY, "stop_id", "bucket"]


def write_stop_events(feed, dates: DataFrame, table: str, path: str, buckets: int = 16) -> DataFrame:
    """Write every departure of the requested dates as a table for stop lookups.

    Partitioned by service date and bucketed by feed, stop and hour, the keys that boards
    are joined on: a board reads the dates it asks for, and its join moves no call.
    """
    events = network_departures(feed, dates, details=True).withColumn("bucket", F.floor(F.col("seconds") / BUCKET_SECONDS))
    (events.repartition(buckets, "service_date", *EVENT_PLACE).write.partitionBy("service_date")
     .bucketBy(buckets, *EVENT_PLACE).sortBy(*EVENT_PLACE).option("path", path).saveAsTable(table))
    return feed.zones().sparkSession.table(table)


def looked_up(queries: DataFrame, feed, events: DataFrame) -> DataFrame:
    """Every departure of every query, from a table of stop events.

    The asked service dates, as many as days at most, are given to the scan as a list, so
    that other partitions are not read. The date is compared inside the join, whose keys
    are then just those of the table's buckets.
    """
    resolved, zones = resolved_stops(queries, feed), feed.zones()
    spans = queries.select(*KEY, "at_epoch", "window_minutes").distinct()
    span = events.groupBy(*KEY).agg(F.min("seconds").cast("bigint").alias("lo"), F.max("seconds").cast("bigint").alias("hi"))
    slots = written(window_slots(spans, zones, span), "slots")
    asked = [r[0] for r in slots.select("service_date").distinct().sort("service_date").collect()]
    days = query_days(queries, resolved, slots).withColumnRenamed("service_date", "asked_date")
    rows = events.filter(F.col("service_date").isin(asked))
    hits = days.join(rows, EVENT_PLACE).filter(
        (F.datediff("asked_date", "service_date") == 0) & F.col("seconds").between(F.col("from_s"), F.col("to_s")))
    return shaped(of_route(hits))


def departures_per_local_day(days: DataFrame, feed, targets: DataFrame) -> DataFrame:
    """(stop_id, local_date, n): departures between two local midnights, both included.

    A local day lasts 23 or 25 hours on a clock change, so it is a few ranges of seconds
    on the service dates that can reach it. The ranges are few and alike on most days:
    calls are counted per stop, service and range first, and only those counts meet the
    asked days, by the service's bitmap.
    """
    day = days.select(
        *KEY, "local_date", times.midnight(F.col("local_date"), F.col("zone")).alias("at_epoch"),
        ((times.midnight(F.date_add("local_date", 1), F.col("zone"))
          - times.midnight(F.col("local_date"), F.col("zone"))) / 60).cast("int")
        .alias("window_minutes")).distinct()
    zones = feed.zones()
    reach = cal.candidate_dates(day, zones).select(*KEY, "service_date").distinct()
    slots = written(window_slots(day, zones, call_span(feed.stop_times())).select(
        *KEY, "service_date", "local_date", "from_s", "to_s"), "slots")
    stops = targets.select(*KEY, "stop_id").distinct()
    # Calls of one stop, service and second are alike here: count them first.
    routed = boardable(feed.stop_times(), running_trips(feed, reach), stops, asked_hours(slots)).join(
        feed.routes().select(*KEY, "route_id"), [*KEY, "route_id"], "left_semi")
    place = [*KEY, "stop_id", "service_id"]
    rows = routed.groupBy(*place, "seconds").agg(
        F.count(F.lit(1)).alias("calls"), F.any_value("service_days").alias("service_days"))
    ranges = slots.select(*KEY, "from_s", "to_s").distinct()
    counts = (rows.join(ranges, KEY).filter(F.col("seconds").between(F.col("from_s"), F.col("to_s")))
              .groupBy(*place, "from_s", "to_s").agg(F.sum("calls").alias("calls"),
                                                     F.any_value("service_days").alias("service_days")))
    return (counts.join(slots, [*KEY, "from_s", "to_s"])
            .filter(cal.runs_on(F.col("service_days"), F.col("service_date")))
            .groupBy(*KEY, "stop_id", "local_date").agg(F.sum("calls").alias("n"))
            .join(stops, [*KEY, "stop_id"], "left_semi"))


def explain_empty(queries: DataFrame, feed) -> DataFrame:
    """The first failing check of each query, else WINDOW_TOO_NARROW.

    The day's service is the calendar of the query's own local date, as the
    reference verdict defines it, although departures also look two days back.
    """
    zones = feed.zones()
    q = queries.withColumn("needle", F.trim("needle"))
    # What several branches read is written: the plan of the verdicts stays small.
    resolved = written(resolved_stops(q, feed), "resolved")
    found = resolved.groupBy(*KEY, "needle").agg(
        F.count("stop_id").alias("platforms"), F.min("matched_by").alias("matched_by"))

    instants = q.select(*KEY, "at_epoch").distinct().join(zones, KEY).withColumn(
        "local_date", times.local_date(F.col("at_epoch"), F.col("zone")))
    local = q.join(instants, [*KEY, "at_epoch"])
    ends = feed.feed_info().groupBy(*KEY).agg(
        F.max(times.service_date(F.col("feed_end_date"))).alias("feed_end"))
    asked = instants.select(*KEY, "local_date", "zone").distinct()
    services = cal.service_calendar(feed.calendar(), feed.calendar_dates(),
                                    asked.withColumnRenamed("local_date", "service_date"))
    active = services.groupBy(*KEY, F.col("service_date").alias("local_date")).agg(
        F.count(F.lit(1)).alias("services"))

    targets = resolved.filter(F.col("stop_id").isNotNull()).select(*KEY, "needle", "stop_id")
    per_stop = feed.stop_times().groupBy(*KEY, "stop_id").agg(F.count(F.lit(1)).alias("n"))
    ever = targets.join(per_stop, [*KEY, "stop_id"]).groupBy(*KEY, "needle").agg(
        F.sum("n").alias("calls"))

    today = (targets.join(departures_per_local_day(asked, feed, targets), [*KEY, "stop_id"])
             .groupBy(*KEY, "needle", "local_date").agg(F.sum("n").alias("today")))

    rows = (local.join(found, [*KEY, "needle"], "left").join(ends, KEY, "left")
            .join(active, [*KEY, "local_date"], "left")
            .join(ever, [*KEY, "needle"], "left")
            .join(today, [*KEY, "needle", "local_date"], "left"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("platforms", "services", "calls", "today")}
    return rows.select(
        *KEY, "query_id", "needle", F.col("matched_by"), *zero.values(),
        F.when(F.coalesce("platforms", F.lit(0)) == 0, "STOP_NOT_FOUND")
        .when(F.col("local_date") > F.col("feed_end"), "FEED_EXPIRED")
        .when(F.coalesce("services", F.lit(0)) == 0, "NO_SERVICE_THAT_DAY")
        .when(F.coalesce("calls", F.lit(0)) == 0, "STOP_NEVER_SERVED")
        .when(F.coalesce("today", F.lit(0)) == 0, "NO_SERVICE_AT_STOP_TODAY")
        .otherwise("WINDOW_TOO_NARROW").alias("verdict"))
