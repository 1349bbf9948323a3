"""Boards a rider should have seen, and how an observed board differs from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline import FEED, KEY
from tramline.functions import times
from tramline.operators import departures as dep
from tramline.operators import realtime as rt
from tramline.operators import stops as st
from tramline.session import written

# Rows numbered per task when counting repeats of one pairing key.
CHUNK = 10_000


def expected_board(queries: DataFrame, feed, trip_updates: DataFrame, stop_updates: DataFrame,
                   captures: DataFrame) -> DataFrame:
    """Rows in the order a rider should see them; an empty board gives its reason.

    Predictions reorder the whole board. The stop code is carried only when the
    needle names a single one.
    """
    # Each part is written, so that the driver holds the plan of one part at a time.
    rows = written(dep.departures(queries, feed), "departures")
    live = rt.overlay(rows, queries, trip_updates, stop_updates, captures)
    resolved = st.resolve_stops(queries, feed.stops())
    codes = (resolved.filter("direct").select(*KEY, "needle", "stop_id")
             .join(feed.stops().select(*KEY, "stop_id", F.trim("stop_code").alias("code")),
                   [*KEY, "stop_id"])
             .filter(F.col("code") != "").groupBy(*KEY, "needle")
             .agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
             .select(*KEY, "needle", F.when(F.col("lo") == F.col("hi"), F.col("lo"))
                     .alias("stop_code")))
    asked = queries.select(*KEY, "query_id", F.trim("needle").alias("needle")).join(
        codes, [*KEY, "needle"], "left").select("query_id", "stop_code")
    short = F.coalesce("route_short_name", F.lit(""))
    shown = live.join(asked, "query_id", "left").select(
        "query_id", F.when(short != "", short).otherwise(F.col("route_id")).alias("route"),
        "headsign", F.coalesce("predicted_epoch", "departure_epoch").alias("shown_epoch"),
        F.col("departure_epoch").alias("scheduled_epoch"), "predicted_epoch",
        F.coalesce("minutes_predicted", "minutes_away").alias("minutes_away"), "realtime",
        "status", "trip_id", "stop_id", F.coalesce("stop_code", F.lit("")).alias("stop_code"),
        "route_id", "service_date", "gtfs_time", "stop_sequence", "zone",
        F.lit(None).cast("string").alias("reason"))
    order = Window.partitionBy("query_id").orderBy(
        "shown_epoch", "route", "trip_id", "stop_sequence", "stop_id", "service_date", "headsign")
    # Written once to the shared folder: the boards are the result and decide emptiness.
    shown = written(shown.withColumn("position", F.row_number().over(order)), "boards")
    empty = written(queries.join(shown.select("query_id").distinct(), "query_id", "left_anti"), "empty")
    why = dep.explain_empty(empty, feed).select("query_id", F.col("verdict").alias("reason"))
    return shown.unionByName(why, allowMissingColumns=True)


# ------------------------------------------------------------------ reconcile --

def time_key(text: Column, zone: Column) -> Column:
    """A printed departure as local HH:MM; 24:12 and 00:12 are the same minute.

    ISO instants with an offset are moved to the agency zone, without one they
    are taken at face value; anything else is searched for H:MM.
    """
    t = F.trim(text)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}")
    zoned = t.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    stamp = F.try_to_timestamp(t)
    clock = F.regexp_extract(t, r"(\d{1,2}):(\d{2})", 0)
    hour = (F.split(clock, ":")[0].try_cast("int") % 24).cast("string")
    bare = F.when(clock != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.right(clock, F.lit(2))))
    return F.when(iso & stamp.isNotNull(), F.when(zoned, F.date_format(
        F.from_utc_timestamp(stamp, zone), "HH:mm")).otherwise(F.date_format(stamp, "HH:mm"))) \
        .otherwise(bare)


def compare_key(value: Column) -> Column:
    """Case, spacing and number format are not data: '11' equals 11.0."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(text.try_cast("double").cast("string"), text)


def _occurrence(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """1-based number of each row among the rows with its key, by ``position``.

    Numbered inside chunks of the position and shifted by the sizes of earlier
    chunks, so a key held by very many rows is never ordered in one task.
    """
    rows = rows.withColumn("chunk", F.floor(F.col(position) / CHUNK))
    inner = Window.partitionBy(*keys, "chunk").orderBy(position)
    numbered = rows.withColumn("n", F.row_number().over(inner))
    sizes = rows.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "chunk", F.coalesce(F.sum("size").over(earlier), F.lit(0))
                         .alias("before"))
    return (numbered.join(shift, [*keys, "chunk"])
            .withColumn("occurrence", F.col("n") + F.col("before")).drop("chunk", "n", "before"))


# Fields compared when both sides carry them, with their other spelling.
COMPARED = ["route", "headsign", "departure", "minutes_away", "status", "realtime", "stop_id",
            "service_date"]
OTHER_SPELLING = {"route": "route_id", "stop_id": "stop_code"}
RECORD = [*COMPARED, "route_id", "stop_code", "trip_id"]


def reconcile(expected: DataFrame, observed: DataFrame, zones: DataFrame,
              on: list[str] = FEED) -> DataFrame:
    """Pair observed board rows with expected ones; missing, extra, differing.

    Both sides are (feed, board_id, position, RECORD...) as text, NULL or '' for
    what a side does not carry; the caller maps device spellings to these names.
    Per board, rows pair on trip_id when complete and unique on both sides, else
    on (HH:MM, route), else on HH:MM, else by position; repeats pair in order.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        cells = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns
                 else F.lit(None).cast("string").alias(c) for c in RECORD]
        out = df.select(*on, "board_id", "position", *cells).join(zones.select(*on, "zone"), on)
        return out.withColumns({"hhmm": time_key(F.col("departure"), F.col("zone")),
                                "side": F.lit(name)}).drop("zone")

    both = side(expected, "e").unionByName(side(observed, "o"))
    # Trip ids are counted per value first, so a board's ids are never collected.
    ids = both.groupBy(*on, "board_id", "side", "trip_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("hhmm").alias("timed"),
        F.count(F.coalesce("route", "route_id")).alias("routed"))
    sides = ids.groupBy(*on, "board_id", "side").agg(
        (F.max(F.when(F.col("trip_id").isNull(), 2).otherwise(F.col("n"))) == 1).alias("ids_ok"),
        (F.sum("n") == F.sum("timed")).alias("times_ok"),
        (F.sum("n") == F.sum("routed")).alias("routes_ok"))
    # An empty side has no ids and no routes, but no unreadable time either.
    modes = sides.groupBy(*on, "board_id").agg(
        (F.count(F.lit(1)) == 2).alias("full"), F.min("ids_ok").alias("ids_ok"),
        F.min("times_ok").alias("times_ok"), F.min("routes_ok").alias("routes_ok"))
    full = F.col("full")
    modes = modes.select(*on, "board_id", F.when(full & F.col("ids_ok"), "trip_id")
                         .when(full & F.col("times_ok") & F.col("routes_ok"), "departure_route")
                         .when(F.col("times_ok"), "departure").otherwise("position").alias("mode"))
    hhmm = F.coalesce("hhmm", F.lit(""))
    route = compare_key(F.coalesce("route", "route_id", F.lit("")))
    keyed = both.join(modes, [*on, "board_id"]).withColumn(
        "pair_key", F.when(F.col("mode") == "trip_id", F.coalesce("trip_id", F.lit("")))
        .when(F.col("mode") == "departure_route", F.concat_ws("|", hhmm, route))
        .when(F.col("mode") == "departure", hhmm)
        .otherwise(F.col("position").cast("string")))
    numbered = _occurrence(keyed, [*on, "board_id", "mode", "side", "pair_key"], "position")
    # Both sides meet in one aggregation: at most one row per side and number.
    record = F.struct("position", "hhmm", *RECORD)
    pairs = numbered.groupBy(*on, "board_id", "mode", "pair_key", "occurrence").agg(
        F.max(F.when(F.col("side") == "e", record)).alias("e"),
        F.max(F.when(F.col("side") == "o", record)).alias("o"))

    def differs(field: str) -> Column:
        other = OTHER_SPELLING.get(field)
        e, o = F.col(f"e.{field}"), F.col(f"o.{field}")
        if other:
            e, o = F.coalesce(e, F.col(f"e.{other}")), F.coalesce(o, F.col(f"o.{other}"))
        same = compare_key(e) == compare_key(o)
        if other:
            spellings = [F.array_compact(F.array(*[compare_key(F.col(f"{s}.{f}"))
                                                   for f in (field, other)])) for s in "eo"]
            same = same | F.arrays_overlap(*spellings)
        if field == "departure":
            same = same | F.coalesce(F.col("e.hhmm") == F.col("o.hhmm"), F.lit(False))
        return F.when(e.isNotNull() & o.isNotNull() & ~same, F.lit(field))

    fields = F.array_join(F.array_compact(F.array(*[differs(f) for f in COMPARED])), ",")
    matched = F.col("e").isNotNull() & F.col("o").isNotNull()
    return pairs.withColumn("differing", F.when(matched, fields).otherwise("")).select(
        *on, "board_id", "mode", "pair_key", "occurrence",
        F.when(F.col("o").isNull(), "missing").when(F.col("e").isNull(), "extra")
        .when(F.col("differing") != "", "differing").otherwise("matched").alias("outcome"),
        "differing", F.col("e.position").alias("expected_position"),
        F.col("o.position").alias("observed_position"))


def reconcile_summary(rows: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Counts and agreement per board."""
    def n(*outcomes: str) -> Column:
        return F.count(F.when(F.col("outcome").isin(*outcomes), 1))

    return rows.groupBy(*on, "board_id", "mode").agg(
        n("matched", "differing").alias("matched"), n("missing").alias("missing"),
        n("extra").alias("extra"), n("differing").alias("differing")).withColumn(
        "agrees", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("differing") == 0))
