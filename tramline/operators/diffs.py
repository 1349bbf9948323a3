"""What changed between two snapshots.

Every function takes the table before (``a``) and after (``b``). Rows are
matched within ``on`` (by default the feed), so a pair column added to both
sides compares many snapshot pairs in one job. Results are in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline import FEED
from tramline.functions import geo, times
from tramline.operators.calendar import WEEKDAYS

# Fixed values.
RAIL_TYPES = ["0", "1", "2", "5", "7", "12"]
SURVIVAL_FLOOR = 0.98
MOVED_THRESHOLD_M = 25.0
ROUTE_FIELDS = ["route_short_name", "route_long_name", "route_type"]
CALENDAR_FIELDS = [*WEEKDAYS, "start_date", "end_date"]
SEVERITY_RANK = {"alarming": 0, "notable": 1, "opportunity": 2, "routine": 3}
ESSENTIAL = ["stops", "trips", "stop_times", "calendar"]


def presence(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str],
             on: list[str] = FEED) -> DataFrame:
    """One row per key with both sides' fields as ``a`` and ``b`` structs, and its side."""
    left = a.select(*on, *keys, F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f)
                                           for f in fields]).alias("a"))
    right = b.select(*on, *keys, F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f)
                                            for f in fields]).alias("b"))
    return left.join(right, [*on, *keys], "full_outer").withColumn(
        "side", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .otherwise("common"))


def _changes(fields: list[str]) -> Column:
    """Array of (field, a, b) for the fields that differ."""
    return F.filter(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("a"), F.col(f"b.{f}").alias("b"))
        for f in fields]), lambda c: c["a"] != c["b"])


def diff_files(counts_a: DataFrame, counts_b: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Row counts per table on both sides, delta, relative change and status."""
    a = counts_a.select(*on, "table_name", F.col("rows").alias("rows_a"))
    b = counts_b.select(*on, "table_name", F.col("rows").alias("rows_b"))
    delta = F.col("rows_b") - F.col("rows_a")
    return a.join(b, [*on, "table_name"], "full_outer").select(
        *on, "table_name", "rows_a", "rows_b", delta.alias("delta"),
        F.round(delta / F.nullif(F.col("rows_a"), F.lit(0)), 4).alias("pct_change"),
        F.when(F.col("rows_a").isNull(), "added").when(F.col("rows_b").isNull(), "removed")
        .when(delta == 0, "unchanged").otherwise("changed").alias("status"))


def diff_routes(a: DataFrame, b: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Routes added and removed, and one row per changed field of the others."""
    both = presence(a, b, ["route_id"], ROUTE_FIELDS, on)
    none = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("a"), F.lit("").alias("b")))
    changes = _changes(ROUTE_FIELDS)
    rows = both.withColumn("cs", F.when(F.col("side") == "common", changes).otherwise(none))
    return rows.select(
        *on, "route_id", F.when(F.col("side") == "common", "changed").otherwise(F.col("side"))
        .alias("change"),
        F.coalesce("b.route_type", "a.route_type").alias("route_type"),
        F.exists("cs", lambda c: c["field"] == "route_type").alias("type_changed"),
        F.explode("cs").alias("c")).select(
        *on, "route_id", "change", "route_type", "type_changed", F.col("c.field").alias("field"),
        F.col("c.a").alias("value_a"), F.col("c.b").alias("value_b"))


def diff_stops(a: DataFrame, b: DataFrame, threshold_m: float = MOVED_THRESHOLD_M,
               on: list[str] = FEED) -> DataFrame:
    """Stops added, removed, renamed, moved past the threshold, or without coordinates.

    A stop both renamed and moved gives two rows.
    """
    both = presence(a, b, ["stop_id"], ["stop_code", "stop_name", "stop_lat", "stop_lon"], on)
    at = {f"{s}_{x}": geo.coordinate(F.col(f"{s}.stop_{x}")) for s in "ab" for x in ("lat", "lon")}
    rows = both.withColumns(at)
    blind = (F.col("a_lat").isNull() | F.col("a_lon").isNull()
             | F.col("b_lat").isNull() | F.col("b_lon").isNull())
    rows = rows.withColumn("metres", geo.haversine_m(
        F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    common = F.col("side") == "common"
    kinds = F.array_compact(F.array(
        F.when(~common, F.col("side")),
        F.when(common & (F.col("a.stop_name") != F.col("b.stop_name")), "renamed"),
        F.when(common & blind, "coordinates_missing"),
        F.when(common & (F.col("metres") > threshold_m), "moved")))
    return rows.withColumn("change", F.explode(kinds)).select(
        *on, "stop_id", "change", F.coalesce("b.stop_code", "a.stop_code").alias("stop_code"),
        F.coalesce("a.stop_name", F.lit("")).alias("name_a"),
        F.coalesce("b.stop_name", F.lit("")).alias("name_b"),
        F.when(F.col("change") == "moved", F.round("metres", 1)).alias("moved_m"))


def id_survival(a: DataFrame, b: DataFrame, floor: float = SURVIVAL_FLOOR,
                on: list[str] = FEED) -> DataFrame:
    """Share of the older feed's stop ids and codes that still exist, per feed.

    Empty values are not identifiers; the denominator is the older feed. The
    result is measured only when both sides have a code column and a rate
    exists; an unmeasured result never meets the floor.
    """
    has_code = "stop_code" in a.columns and "stop_code" in b.columns

    def side(df: DataFrame, flag: str) -> DataFrame:
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("field"),
                     (F.col(c) if c in df.columns else F.lit("")).alias("value"))
            for c in ("stop_id", "stop_code")]))
        return df.select(*on, cells.alias("c")).select(
            *on, "c.field", "c.value", F.lit(flag == "a").alias("in_a"),
            F.lit(flag == "b").alias("in_b")).filter(F.col("value") != "")

    # Values meet in one aggregation instead of two distincts and an outer join.
    seen = side(a, "a").unionByName(side(b, "b")).groupBy(*on, "field", "value").agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))

    def count(field: str, cond: Column) -> Column:
        return F.count(F.when((F.col("field") == field) & cond, 1))

    ina, inb = F.col("in_a"), F.col("in_b")
    aggs = []
    for f, p in (("stop_id", "id"), ("stop_code", "code")):
        aggs += [count(f, ina).alias(f"{p}_in_a"), count(f, inb).alias(f"{p}_in_b"),
                 count(f, ina & inb).alias(f"{p}_survived"),
                 count(f, ina & ~inb).alias(f"{p}_lost"),
                 count(f, inb & ~ina).alias(f"{p}_gained")]
    out = seen.groupBy(*on).agg(*aggs)
    for p in ("id", "code"):
        out = out.withColumn(f"{p}_rate", F.round(
            F.col(f"{p}_survived") / F.nullif(F.col(f"{p}_in_a"), F.lit(0)), 4))
    # least() skips NULLs: the worst of the rates that exist.
    out = out.withColumn("worst_rate", F.least("id_rate", "code_rate"))
    out = out.withColumn("measured", F.col("worst_rate").isNotNull() & F.lit(has_code))
    return out.withColumn("meets_floor", F.coalesce(
        F.col("measured") & (F.col("worst_rate") >= floor), F.lit(False)))


def _span(calendar: DataFrame, calendar_dates: DataFrame, on: list[str], side: str) -> DataFrame:
    days = calendar.select(*on, times.service_date(F.col("start_date")).alias("lo"),
                           times.service_date(F.col("end_date")).alias("hi")).unionByName(
        calendar_dates.select(*on, times.service_date(F.col("date")).alias("lo"),
                              times.service_date(F.col("date")).alias("hi")))
    return days.groupBy(*on).agg(F.min("lo").alias(f"start_{side}"),
                                 F.max("hi").alias(f"end_{side}"))


def window_shift(cal_a, dates_a, cal_b, dates_b, on: list[str] = FEED) -> DataFrame:
    """Service window on both sides and its shift in days."""
    return _span(cal_a, dates_a, on, "a").join(
        _span(cal_b, dates_b, on, "b"), on, "full_outer").withColumns({
            "start_shift": F.datediff("start_b", "start_a"),
            "end_shift": F.datediff("end_b", "end_a")})


def diff_calendar(cal_a, dates_a, cal_b, dates_b, on: list[str] = FEED) -> DataFrame:
    """Service ids, weekly-pattern fields, exceptions and window ends that differ.

    Long form: (change, service_id, field, value_a, value_b).
    """
    def ids(calendar, dates):
        return calendar.select(*on, "service_id").unionByName(
            dates.select(*on, "service_id")).distinct().withColumn("x", F.lit(""))

    def row(change: Column, service: Column, field: Column, va: Column, vb: Column):
        return [*on, change.alias("change"), service.alias("service_id"), field.alias("field"),
                va.alias("value_a"), vb.alias("value_b")]

    none = F.lit("")
    services = presence(ids(cal_a, dates_a), ids(cal_b, dates_b), ["service_id"], ["x"], on) \
        .filter("side <> 'common'").select(*row(
            F.concat(F.lit("service_"), "side"), F.col("service_id"), none, none, none))
    fields = presence(cal_a, cal_b, ["service_id"], CALENDAR_FIELDS, on) \
        .filter("side = 'common'").select(
            *on, "service_id", F.explode(_changes(CALENDAR_FIELDS)).alias("c")).select(*row(
                F.lit("field_changed"), F.col("service_id"), F.col("c.field"), F.col("c.a"),
                F.col("c.b")))
    exc = ["service_id", "date", "exception_type"]
    exceptions = presence(dates_a.select(*on, *exc).distinct().withColumn("x", none),
                          dates_b.select(*on, *exc).distinct().withColumn("x", none),
                          exc, ["x"], on).filter("side <> 'common'").select(*row(
                              F.concat(F.lit("exception_"), "side"), F.col("service_id"),
                              F.col("date"), F.col("exception_type"), none))
    shift = window_shift(cal_a, dates_a, cal_b, dates_b, on)
    ends = F.explode(F.array(*[F.struct(
        F.lit(e).alias("e"), F.col(f"{e}_a").cast("string").alias("a"),
        F.col(f"{e}_b").cast("string").alias("b")) for e in ("start", "end")]))
    window = shift.select(*on, ends.alias("w")).filter(~F.col("w.a").eqNullSafe(F.col("w.b"))) \
        .select(*row(F.lit("window_shift"), none, F.col("w.e"),
                     F.coalesce("w.a", none), F.coalesce("w.b", none)))
    return services.unionByName(fields).unionByName(exceptions).unionByName(window)


def _bag_diff(a: DataFrame, b: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Multiset difference on ``keys`` with one deterministic record per side.

    Both sides are tagged and aggregated together: one shuffle, combined
    map-side, instead of two counts and an outer join. The representative is
    the smallest (trip_id, fields).
    """
    record = F.struct("trip_id", *compared)
    tagged = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    is_a, is_b = F.col("side") == "a", F.col("side") == "b"
    both = tagged.groupBy(*keys).agg(
        F.count(F.when(is_a, 1)).alias("n_a"), F.count(F.when(is_b, 1)).alias("n_b"),
        F.min(F.when(is_a, record)).alias("a"), F.min(F.when(is_b, record)).alias("b"))
    fields = F.array_compact(F.array(*[
        F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.lit(f)) for f in compared]))
    both = both.withColumns({
        "added": F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0)),
        "removed": F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)),
        "changed_fields": F.when(F.col("a").isNotNull() & F.col("b").isNotNull(),
                                 F.array_join(fields, ",")).otherwise("")})
    values = [F.coalesce(f"b.{f}", f"a.{f}").alias(f) for f in compared]
    return both.filter("added > 0 or removed > 0 or changed_fields <> ''").select(
        *keys, "added", "removed", "changed_fields", *values)


def diff_schedule(calls_a: DataFrame, calls_b: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Calls added and removed at every stop, and calls whose detail changed.

    A call is (time, route, direction, stop); trip and service ids are left out
    because publishers regenerate them.
    """
    keys = [*on, "stop_id", "departure_time", "route_id", "direction_id"]

    def side(c: DataFrame) -> DataFrame:
        pickup = F.coalesce("pickup_type", F.lit(""))
        return c.select(*keys, "trip_id", F.coalesce("trip_headsign", F.lit("")).alias("headsign"),
                        F.when(pickup == "", "0").otherwise(pickup).alias("pickup_type"))

    return _bag_diff(side(calls_a), side(calls_b), keys, ["headsign", "pickup_type"])


def diff_route_schedule(calls_a: DataFrame, calls_b: DataFrame,
                        on: list[str] = FEED) -> DataFrame:
    """Trips added and removed per route, keyed on first departure and direction."""
    keys = [*on, "route_id", "direction_id", "first_departure"]

    def side(c: DataFrame) -> DataFrame:
        trips = c.filter(F.col("seconds").isNotNull()).groupBy(
            *on, "route_id", "direction_id", "trip_id", "trip_headsign", "service_id").agg(
            F.min("seconds").alias("lo"), F.max("seconds").alias("hi"),
            F.count(F.lit(1)).cast("string").alias("calls"))
        return trips.select(
            *on, "route_id", "direction_id", times.gtfs_time(F.col("lo")).alias("first_departure"),
            "trip_id", F.coalesce("trip_headsign", F.lit("")).alias("headsign"),
            times.gtfs_time(F.col("hi")).alias("last_departure"), "calls")

    return _bag_diff(side(calls_a), side(calls_b), keys, ["headsign", "last_departure", "calls"])


def diff_findings(files: DataFrame, routes: DataFrame, stops: DataFrame, survival: DataFrame,
                  shift: DataFrame, calendar: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Severity-ranked findings (severity, dimension, detail) over the diffs above."""
    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    def emit(df: DataFrame, dimension: str, *findings) -> DataFrame:
        """Rows of the (condition, severity, detail) triples that hold, in one pass."""
        triples = F.array_compact(F.array(*[
            F.when(cond, F.struct(severity.alias("severity"), detail.alias("detail")))
            for cond, severity, detail in findings]))
        return df.select(*on, F.explode(triples).alias("f")).select(
            *on, "f.severity", F.lit(dimension).alias("dimension"), "f.detail")

    c, lit = F.col, F.lit
    table, status = c("table_name"), c("status")
    r = routes.groupBy(*on).agg(
        F.count_distinct(F.when(c("change") == "removed", c("route_id"))).alias("removed"),
        F.count_distinct(F.when((c("change") == "removed") & F.trim("route_type").isin(RAIL_TYPES),
                                c("route_id"))).alias("rail_removed"),
        F.count_distinct(F.when(c("change") == "added", c("route_id"))).alias("added"),
        F.count_distinct(F.when(c("change") == "changed", c("route_id"))).alias("changed"),
        F.count_distinct(F.when(c("type_changed"), c("route_id"))).alias("retyped"))
    moved = stops.filter("change = 'moved'").groupBy(*on).agg(
        F.count(lit(1)).alias("moved"), F.max("moved_m").alias("furthest")).join(
        survival.select(*on, "id_survived"), on)
    ids = calendar.groupBy(*on).agg(
        F.count(F.when(c("change") == "service_removed", 1)).alias("gone"),
        F.count(F.when(c("change") == "service_added", 1)).alias("new"))
    parts = [
        emit(files, "files",
             (status == "added",
              F.when(table == "frequencies", "alarming")
              .when(table.startswith("fare_"), "opportunity").otherwise("notable"),
              text(table, ".txt appeared (", c("rows_b"), " rows)")),
             (status == "removed", F.when(table.isin(ESSENTIAL), "alarming").otherwise("notable"),
              text(table, ".txt disappeared (was ", c("rows_a"), " rows)"))),
        emit(survival, "stop_ids",
             (~c("meets_floor"), lit("alarming"), F.when(c("measured"), text(
                 "below the survival floor: ", c("code_lost"), " code(s) and ", c("id_lost"),
                 " id(s) retired")).otherwise("survival not measured")),
             (c("meets_floor") & ((c("code_lost") > 0) | (c("id_lost") > 0)), lit("routine"),
              text(c("code_lost"), " code(s) and ", c("id_lost"), " id(s) retired"))),
        emit(r, "routes",
             (c("rail_removed") > 0, lit("alarming"),
              text(c("rail_removed"), " rail route(s) removed")),
             ((c("rail_removed") == 0) & (c("removed") > 0), lit("notable"),
              text(c("removed"), " route(s) removed")),
             (c("added") > 0, lit("notable"), text(c("added"), " route(s) added")),
             (c("retyped") > 0, lit("alarming"), text(c("retyped"), " route(s) changed type")),
             ((c("retyped") == 0) & (c("changed") > 0), lit("routine"),
              text(c("changed"), " route(s) renamed"))),
        emit(moved, "stops",
             (c("moved") > 0, F.when(F.round(c("moved") / c("id_survived"), 4) > 0.01, "notable")
              .otherwise("routine"),
              text(c("moved"), " stop(s) moved; furthest ", F.round("furthest").cast("int"), " m"))),
        emit(shift, "calendar",
             (c("end_shift") > 0, lit("routine"),
              text("service ends ", c("end_shift"), " day(s) later")),
             (c("end_shift") < 0, lit("alarming"),
              text("service ends ", -c("end_shift"), " day(s) earlier"))),
        emit(ids, "calendar",
             ((c("gone") > 0) | (c("new") > 0), lit("routine"),
              text(c("gone"), " service id(s) removed, ", c("new"), " added"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = F.lit(9)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    return out.withColumn("severity_rank", rank.cast("int"))


def id_life_spans(stops: DataFrame, snapshots: DataFrame, on: list[str] = FEED) -> DataFrame:
    """Life of every stop id and stop code over all snapshots of a feed.

    ``stops`` has (feed, snapshot_id, stop_id, stop_code), ``snapshots`` (feed, snapshot_id,
    fetched_epoch) orders them (ties by id). Per (feed, kind, value): first and last
    snapshot, ``seen`` (snapshots it is in), ``spells`` (runs of consecutive snapshots),
    ``longest_gap`` (snapshots missed in between), ``alive`` (in the newest one), and
    ``holders``: how many different stop ids a code stood for, or codes an id had. Reduced
    to one row per value and snapshot first; a window then sees the snapshots of one value.
    """
    order = Window.partitionBy(*on).orderBy("fetched_epoch", "snapshot_id")
    places = snapshots.select(*on, "snapshot_id", "fetched_epoch").distinct().withColumn("n", F.row_number().over(order))
    newest = places.groupBy(*on).agg(F.max("n").alias("newest"))
    cells = F.explode(F.array(
        F.struct(F.lit("id").alias("kind"), F.col("stop_id").alias("value"), F.col("stop_code").alias("other")),
        F.struct(F.lit("code").alias("kind"), F.col("stop_code").alias("value"), F.col("stop_id").alias("other")))).alias("c")
    rows = stops.select(*on, "snapshot_id", cells).select(*on, "snapshot_id", "c.*").filter("value <> ''")
    key = [*on, "kind", "value"]
    holders = rows.select(*key, "other").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("holders"))
    held = rows.select(*key, "snapshot_id").distinct().join(places, [*on, "snapshot_id"])
    life = Window.partitionBy(*key).orderBy("n")
    gap = F.col("n") - F.lag("n").over(life) - 1
    spans = held.withColumn("gap", gap).groupBy(*key).agg(
        F.min_by("snapshot_id", "n").alias("first_snapshot"), F.max_by("snapshot_id", "n").alias("last_snapshot"),
        F.count(F.lit(1)).alias("seen"), (F.count_if(F.col("gap") > 0) + 1).alias("spells"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), F.max("n").alias("last_n"))
    return (spans.join(holders, key).join(newest, on)
            .select(*key, "first_snapshot", "last_snapshot", "seen", "spells", "longest_gap",
                    (F.col("last_n") == F.col("newest")).alias("alive"), "holders"))
