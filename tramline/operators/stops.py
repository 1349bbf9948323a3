"""Finding stops and routes, and which routes serve which stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline import KEY
from tramline.functions import times
from tramline.session import written

# Names of the route types.
ROUTE_TYPES = {
    "0": "tram/streetcar", "1": "subway", "2": "rail", "3": "bus", "4": "ferry",
    "5": "cable tram", "6": "aerial lift", "7": "funicular", "11": "trolleybus",
    "12": "monorail",
}


def route_type_name(value: Column) -> Column:
    name = F.concat(F.lit("type "), value)
    for code, text in ROUTE_TYPES.items():
        name = F.when(F.trim(value) == code, text).otherwise(name)
    return name


def boardable_calls(stop_times: DataFrame) -> DataFrame:
    """Calls with a departure time where a rider may board.

    Only pickup_type '1' forbids boarding; absent or empty allows it.
    """
    out = stop_times.filter(F.col("departure_time") != "")
    if "pickup_type" in stop_times.columns:
        out = out.filter(F.trim(F.coalesce("pickup_type", F.lit(""))) != "1")
    return out


def boardable_stops(stops: DataFrame) -> DataFrame:
    """Stops that carry a sign: not stations, entrances or nodes."""
    if "location_type" not in stops.columns:
        return stops
    return stops.filter(F.coalesce("location_type", F.lit("")).isin("", "0"))


GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Different runs of ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1))),
                                        lambda i: F.substring(text, i, size)))


def containing(rows: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """``rows`` x ``term`` for each term that the text contains, letter case aside.

    A term of three characters or more is looked up by its rarest trigram in an inverted
    index of the texts, a shorter one by itself, and every candidate is verified. Terms
    are a table (term) of any size: the plan does not grow with it. Grams no term asks for
    leave the index before it is shuffled; an empty term is in every text. The table of
    looked-up grams is written, so that its size is known; the exploded texts, many times
    the size that Spark guesses, are never the side that a join gathers in the driver.
    """
    wanted = terms.select("term").distinct().withColumn("needle", F.lower("term"))
    size = F.least(F.char_length("needle"), F.lit(GRAM))
    options = wanted.withColumn("gram", F.explode(_grams(F.col("needle"), size)))
    held = rows.withColumn("__text", text)
    every = F.explode(F.array_distinct(F.flatten(F.array(
        F.array(F.lit("")), *[_grams(F.col("__text"), F.lit(n)) for n in range(1, GRAM + 1)]))))
    index = held.select("__text", every.alias("gram"))
    counts = index.join(options.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A term with a gram that no text has is not found.
    rarest = options.join(counts, "gram", "left").groupBy("term", "needle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0").select(
        "term", "needle", F.col("g.gram").alias("gram"))
    rarest = written(rarest, "grams")
    held = held.withColumn("gram", every).join(rarest.select("gram").distinct(), "gram", "left_semi")
    found = held.join(rarest.hint("merge"), "gram").filter(F.contains("__text", F.col("needle")))
    return found.select(*rows.columns, "term")


def stop_search(stops: DataFrame, terms: DataFrame) -> DataFrame:
    """Stops whose lower-cased name contains a term (term), literally; one row per hit."""
    return containing(stops, F.lower(F.coalesce("stop_name", F.lit(""))), terms)


def stops_by_code(stops: DataFrame, codes: DataFrame) -> DataFrame:
    """Stops whose stop_code equals a requested code (feed, snapshot, code)."""
    return stops.join(codes, (stops.feed_id == codes.feed_id)
                      & (stops.snapshot_id == codes.snapshot_id)
                      & (stops.stop_code == codes.code), "left_semi")


def stops_on_routes(stops: DataFrame, serving: DataFrame) -> DataFrame:
    """(stop row, route_id) for every stop a route calls at."""
    return stops.join(serving.select(*KEY, "stop_id", "route_id"), [*KEY, "stop_id"])


def route_search(routes: DataFrame, trips: DataFrame, terms: DataFrame,
                 route_type: str | None = None) -> DataFrame:
    """Routes matching a term (term) in any column, with trip count and type name."""
    fields = [c for c in routes.columns if c not in KEY]
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
    rows = routes if route_type is None else routes.filter(F.trim("route_type") == route_type)
    counts = trips.groupBy(*KEY, "route_id").agg(F.count(F.lit(1)).alias("trip_count"))
    return (containing(rows, hay, terms).join(counts, [*KEY, "route_id"], "left")
            .withColumn("trip_count", F.coalesce("trip_count", F.lit(0)))
            .withColumn("route_type_name", route_type_name(F.col("route_type"))))


def resolve_stops(queries: DataFrame, stops: DataFrame) -> DataFrame:
    """Resolve needles to stop ids: by stop_code, else by stop_id.

    Returns one row per (query, stop_id) with ``matched_by`` and ``ambiguous``;
    a station also yields its platforms (``direct`` is false for those). A needle nothing matches gives one row
    with status STOP_NOT_FOUND and a NULL stop_id. Distinct needles are
    resolved once, so many queries for one stop cost one lookup.
    """
    needles = queries.select(*KEY, F.trim("needle").alias("needle")).distinct()
    # Each stop offers two keys; the code's rank wins over the id's.
    kind = F.coalesce(F.trim("location_type"), F.lit("")) if "location_type" in stops.columns \
        else F.lit("")
    base = stops.withColumn("is_station", kind == "1")
    by_id = base.select(*KEY, "stop_id", "is_station", F.lit(2).alias("tier"),
                        F.col("stop_id").alias("needle"))
    offers = by_id
    if "stop_code" in stops.columns:
        offers = offers.unionByName(base.select(
            *KEY, "stop_id", "is_station", F.lit(1).alias("tier"),
            F.col("stop_code").alias("needle")))
    hits = needles.join(offers, [*KEY, "needle"])
    tiers = hits.groupBy(*KEY, "needle").agg(
        F.min("tier").alias("tier"),
        F.count(F.when(F.col("tier") == 1, 1)).alias("n1"),
        F.count(F.when(F.col("tier") == 2, 1)).alias("n2"))
    matched = hits.join(tiers, [*KEY, "needle", "tier"]).select(
        *KEY, "needle", "stop_id", "is_station",
        F.when(F.col("tier") == 1, "stop_code").otherwise("stop_id").alias("matched_by"),
        (F.when(F.col("tier") == 1, F.col("n1")).otherwise(F.col("n2")) > 1).alias("ambiguous"))
    own = matched.drop("is_station").withColumn("direct", F.lit(True))
    if "parent_station" in stops.columns:
        children = stops.filter(F.col("parent_station") != "").select(
            *KEY, F.col("parent_station").alias("stop_id"), F.col("stop_id").alias("child_id"))
        platforms = matched.filter("is_station").join(children, [*KEY, "stop_id"]).select(
            *KEY, "needle", F.col("child_id").alias("stop_id"), "matched_by", "ambiguous",
            F.lit(False).alias("direct"))
        own = own.unionByName(platforms).groupBy(
            *KEY, "needle", "stop_id", "matched_by", "ambiguous").agg(
            F.max("direct").alias("direct"))
    return needles.join(own, [*KEY, "needle"], "left").withColumn(
        "status", F.when(F.col("stop_id").isNull(), "STOP_NOT_FOUND").otherwise("FOUND"))


def serving_pairs(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct (stop_id, route_id), reduced map-side before the final shuffle."""
    return (stop_times.select(*KEY, "stop_id", "trip_id")
            .join(trips.select(*KEY, "trip_id", "route_id"), [*KEY, "trip_id"])
            .select(*KEY, "stop_id", "route_id").distinct())


def serving(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Serving pairs with the badge shown to riders (short name, else route id)."""
    badge = F.when(F.coalesce("route_short_name", F.lit("")) != "",
                   F.col("route_short_name")).otherwise(F.col("route_id"))
    return serving_pairs(stop_times, trips).join(
        routes.select(*KEY, "route_id", "route_short_name", "route_long_name", "route_type"),
        [*KEY, "route_id"]).withColumn("badge", badge)


def trip_calls(stop_times: DataFrame, trips: DataFrame,
               prune: Callable[[DataFrame], DataFrame] = lambda calls: calls) -> DataFrame:
    """stop_times x trips with the columns a departure needs, and parsed seconds; the
    trips' ``service_days``, or ``service_date`` and ``day_start``, too, if they carry them.

    ``prune`` drops calls, by their parsed seconds, before they meet their trips.
    """
    optional = {"stop_headsign": "", "pickup_type": "0"}
    st = stop_times.withColumns({c: F.lit(v) for c, v in optional.items()
                                 if c not in stop_times.columns})
    tr = trips.withColumns({c: F.lit("") for c in ("trip_headsign", "direction_id")
                            if c not in trips.columns})
    return (prune(st.filter(F.col("departure_time") != "")
            .select(*KEY, "trip_id", "stop_id", "stop_sequence", "departure_time",
                    "pickup_type", "stop_headsign",
                    times.gtfs_seconds(F.col("departure_time")).alias("seconds")))
            .join(tr.select(*KEY, "trip_id", "route_id", "service_id", "trip_headsign", "direction_id",
                            *[c for c in ("service_days", "service_date", "day_start") if c in tr.columns]), [*KEY, "trip_id"]))


def with_route(rows: DataFrame, routes: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(routes.select(*KEY, "route_id", "route_short_name", "route_long_name",
                                   "route_type"), [*KEY, "route_id"], how)


def calls(stop_times: DataFrame, trips: DataFrame, routes: DataFrame,
          how: str = "inner") -> DataFrame:
    """stop_times x trips x routes; ``how='left'`` keeps trips without a route row."""
    return with_route(trip_calls(stop_times, trips), routes, how)
