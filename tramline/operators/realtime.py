"""Realtime captures: census, health, and predictions laid over the schedule.

Flat inputs, one row per item of a capture, positions kept because feed order
decides which record wins:

* trip updates (feed, capture_id, entity_pos, trip_id, start_date,
  trip_relationship, trip_delay)
* stop updates (feed, capture_id, entity_pos, stu_pos, stop_id, stop_sequence,
  relationship, event_delay, event_time)
* captures (feed, capture_id, fetched_epoch)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline import FEED, KEY

# Fixed values.
MAX_PLAUSIBLE_DELAY = 12 * 3600
EPOCH_RANGE = (-3_000_000_000, 6_000_000_000)
STALE_SECONDS = 300

# Width of the as-of bucket: a poll every half minute gives 20 captures in it.
ASOF_BUCKET = 600


def field_census(paths: DataFrame, captures: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Share of captures in which each field path occurs, with its wire types.

    ``paths`` is (feed, capture_id, path, wire_type), ``captures`` lists every
    capture, so one with no known path still counts in the denominator. A path
    holding ``?`` is not modelled.
    """
    total = captures.select(*on, "capture_id").distinct().groupBy(*on).agg(
        F.count(F.lit(1)).alias("captures"))
    seen = paths.groupBy(*on, "path", "capture_id").agg(
        F.collect_set("wire_type").alias("wires"))
    # Wire types are a closed set of four names, so the arrays stay tiny.
    census = seen.groupBy(*on, "path").agg(
        F.count(F.lit(1)).alias("present"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("wires")))), "|")
        .alias("wire_types"))
    return census.join(total, on).select(
        *on, "path", "present", F.round(F.col("present") / F.col("captures"), 4)
        .alias("presence_rate"), "wire_types", (~F.contains("path", F.lit("?"))).alias("modelled"))


def feed_health(headers: DataFrame, as_of: DataFrame, kinds: list[str],
                on: list[str] = FEED) -> DataFrame:
    """Newest capture per entity kind: age, staleness, spread of header times.

    Every kind of every feed gets a row; one without a capture is unavailable.
    """
    newest = headers.groupBy(*on, "entity_kind").agg(
        F.max(F.struct("fetched_epoch", "capture_id", "header_ts", "bytes", "entities"))
        .alias("h"))
    wanted = as_of.select(*on, "as_of", F.explode(F.array(*[F.lit(k) for k in kinds]))
                          .alias("entity_kind"))
    spread = newest.groupBy(*on).agg(
        (F.max("h.header_ts") - F.min("h.header_ts")).alias("header_spread"))
    age = F.col("as_of") - F.col("h.header_ts")
    return (wanted.join(newest, [*on, "entity_kind"], "left").join(spread, on, "left").select(
        *on, "entity_kind", F.col("h").isNotNull().alias("available"),
        F.col("h.capture_id").alias("capture_id"), F.col("h.header_ts").alias("header_ts"),
        age.alias("age_seconds"),
        (F.col("h.fetched_epoch") - F.col("h.header_ts")).alias("age_at_fetch"),
        (F.col("as_of") - F.col("h.fetched_epoch")).alias("fetched_ago"), F.coalesce(age > STALE_SECONDS, F.lit(False)).alias("stale"),
        F.col("h.bytes").alias("bytes"), F.col("h.entities").alias("entities"),
        "header_spread"))


def latest_update(trip_updates: DataFrame, on: list[str] = FEED) -> DataFrame:
    """The TripUpdate that wins per (capture, trip): the last in feed order."""
    fields = [c for c in trip_updates.columns
              if c not in (*on, "capture_id", "trip_id", "entity_pos")]
    return (trip_updates.filter(F.coalesce("trip_id", F.lit("")) != "")
            .groupBy(*on, "capture_id", "trip_id")
            .agg(F.max(F.struct("entity_pos", *fields)).alias("u"))
            .select(*on, "capture_id", "trip_id", "u.*"))


def asof_capture(instants: DataFrame, captures: DataFrame, on: list[str] = FEED) -> DataFrame:
    """The newest capture fetched at or before each (feed, at_epoch).

    Within a ten-minute bucket the match is an equi join; the newest capture of
    earlier buckets is carried in. The ordered window only sees one row per
    (feed, bucket), never the instants or captures themselves.
    """
    def bucket(epoch: str) -> Column:
        return F.floor(F.col(epoch) / ASOF_BUCKET).alias("bucket")

    asked = instants.select(*on, "at_epoch").distinct().select("*", bucket("at_epoch"))
    given = captures.select(*on, "capture_id", "fetched_epoch").distinct().select(
        "*", bucket("fetched_epoch"))
    newest = F.max(F.struct("fetched_epoch", "capture_id"))
    per_bucket = given.groupBy(*on, "bucket").agg(newest.alias("last"))
    every = asked.select(*on, "bucket").distinct().join(per_bucket, [*on, "bucket"], "full_outer")
    before = Window.partitionBy(*on).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = every.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select(
        *on, "bucket", "carried")
    inside = asked.join(given, [*on, "bucket"]).filter(
        F.col("fetched_epoch") <= F.col("at_epoch")).groupBy(*on, "at_epoch").agg(
        newest.alias("inside"))
    return (asked.join(carried, [*on, "bucket"]).join(inside, [*on, "at_epoch"], "left")
            .select(*on, "at_epoch", F.coalesce("inside.capture_id", "carried.capture_id")
                    .alias("capture_id"))
            .filter(F.col("capture_id").isNotNull()))


def _first_by_key(stop_updates: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
    """First stop update of the winning entity per stop id and per stop sequence: one
    aggregation over (name, key), where name says which of the two the key is."""
    record = F.struct("stu_pos", "relationship", "event_delay", "event_time")
    keys = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key"))
        for c in ("stop_id", "stop_sequence")]))
    return (stop_updates.join(winners.select(*on, "capture_id", "entity_pos"),
                              [*on, "capture_id", "entity_pos"], "left_semi")
            .withColumn("k", keys).filter("k.key <> ''")
            .groupBy(*on, "capture_id", "entity_pos", "k.name", "k.key")
            .agg(F.min(record).alias("first")))


def overlay(departures: DataFrame, queries: DataFrame, trip_updates: DataFrame,
            stop_updates: DataFrame, captures: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Departures with prediction, status and delay from the capture known then.

    ``queries`` gives the instants (feed, at_epoch) the departures were asked for.

    The stop update is the first in feed order whose stop_id or stop_sequence
    matches: two equi joins and the smaller position, never an OR join. A trip
    update naming a start date only applies to that service date, and a
    canceled trip is reported as such.
    """
    known = asof_capture(queries, captures, on)
    # Only captures known at an asked instant matter, of all ever made.
    asked = known.select(*on, "capture_id").distinct()
    winners = latest_update(trip_updates.join(asked, [*on, "capture_id"], "left_semi"), on)
    firsts = _first_by_key(stop_updates.join(asked, [*on, "capture_id"], "left_semi"), winners, on)

    def first_by(name: str, out: str) -> DataFrame:
        return firsts.filter(F.col("name") == name).select(
            *on, "capture_id", "entity_pos", F.col("key").alias(name), F.col("first").alias(out))

    by_stop, by_seq = first_by("stop_id", "by_stop"), first_by("stop_sequence", "by_seq")

    tu = winners.select(*on, "capture_id", "trip_id", "entity_pos",
                        F.coalesce("start_date", F.lit("")).alias("start_date"),
                        "trip_relationship", "trip_delay", F.lit(True).alias("has_tu"))
    rows = (departures.join(known, [*on, "at_epoch"], "left")
            .join(tu, [*on, "capture_id", "trip_id"], "left")
            .join(by_stop, [*on, "capture_id", "entity_pos", "stop_id"], "left")
            .join(by_seq, [*on, "capture_id", "entity_pos", "stop_sequence"], "left"))
    return with_prediction(rows)


def with_prediction(rows: DataFrame) -> DataFrame:
    """The prediction chain over rows carrying has_tu, by_stop and by_seq.

    Shared by the batch overlay and the live board stream.
    """
    applies = F.coalesce(F.col("has_tu"), F.lit(False)) & (
        (F.col("start_date") == "")
        | (F.col("start_date") == F.date_format("service_date", "yyyyMMdd")))
    first = F.when(F.col("by_seq").isNull()
                   | (F.col("by_stop.stu_pos") <= F.col("by_seq.stu_pos")), F.col("by_stop")) \
        .otherwise(F.col("by_seq"))
    rows = rows.withColumns({"realtime": applies, "stu": F.when(applies, first)})
    c = F.col
    has_stu = c("stu").isNotNull()
    rel = F.when(has_stu, F.coalesce("stu.relationship", F.lit("SCHEDULED"))) \
        .when(c("trip_delay").isNotNull(), "SCHEDULED").otherwise("NO_DATA")
    rows = rows.withColumns({
        "rel": rel,
        "epoch": c("stu.event_time"),
        "delay": F.when(has_stu, c("stu.event_delay")).otherwise(c("trip_delay")).cast("bigint")})
    canceled = F.coalesce(c("trip_relationship") == "CANCELED", F.lit(False))
    in_range = c("epoch").between(*EPOCH_RANGE)
    derived = F.when(c("epoch").isNotNull(),
                     F.when(in_range, c("epoch") - c("departure_epoch"))).otherwise(c("delay"))
    rows = rows.withColumn("derived", derived)
    measured = c("epoch").isNotNull() | c("delay").isNotNull()
    plausible = F.coalesce(F.abs("derived") <= MAX_PLAUSIBLE_DELAY, F.lit(False))
    live = c("realtime") & ~canceled & (c("rel") != "SKIPPED") & measured
    rows = rows.withColumn("predicted_epoch",
                           F.when(live & plausible, c("departure_epoch") + c("derived")))
    return rows.withColumns({
        "status": F.when(~c("realtime"), "SCHEDULED_ONLY").when(canceled, "CANCELED")
        .when(c("rel") == "SKIPPED", "SKIPPED")
        .when(measured & ~plausible, "IMPLAUSIBLE_DELAY").when(measured, c("rel"))
        .when(c("rel") == "SCHEDULED", "NO_PREDICTION").otherwise(c("rel")),
        "delay_seconds": F.when(live, F.coalesce("derived", "epoch")),
        "delay_basis": F.when(live & plausible, F.when(
            c("epoch").isNotNull(), "absolute_time").otherwise("delay")),
        # Half to even: 150 s is 2 minutes, 210 s is 4.
        "minutes_predicted": F.when(live & plausible, (
            c("minutes_away") + F.bround(c("derived") / 60)).cast("int")),
    }).drop("by_stop", "by_seq", "stu", "rel", "epoch", "delay", "derived", "has_tu",
            "entity_pos", "start_date", "trip_relationship", "trip_delay")


def match_rate(overlaid: DataFrame) -> DataFrame:
    """Matched over inspected departures per query."""
    return overlaid.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("inspected"),
        F.count(F.when(F.col("realtime"), 1)).alias("matched")).withColumn(
        "match_rate", F.round(F.col("matched") / F.col("inspected"), 4))


def join_rate(trip_updates: DataFrame, trips: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Share of distinct realtime trip ids found in the static trips, per feed.

    Feeds without realtime trips have no row: the rate is unmeasured, not 1.
    """
    ids = trip_updates.filter(F.coalesce("trip_id", F.lit("")) != "").select(
        *on, "trip_id").distinct()
    known = trips.select(*on, "trip_id").distinct().withColumn("known", F.lit(1))
    return ids.join(known, [*on, "trip_id"], "left").groupBy(*on).agg(
        F.count(F.lit(1)).alias("rt_trips"), F.count("known").alias("resolved")).withColumn(
        "join_rate", F.round(F.col("resolved") / F.col("rt_trips"), 4))
