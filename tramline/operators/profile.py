"""Column statistics, feature flags and entity summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline import KEY
from tramline.functions import times
from tramline.operators.stops import route_type_name

# Optional files whose absence is reported.
OPTIONAL_FILES = ["attributions", "calendar_dates", "fare_attributes", "fare_products",
                  "fare_rules", "feed_info", "frequencies", "levels", "pathways", "shapes",
                  "transfers", "translations"]

# Feature name, the table that carries it, and the column (or '').
FEATURES = [
    ("Bikes Allowed", "trips", "bikes_allowed"),
    ("Fares v1", "fare_attributes", ""),
    ("Fares v2", "fare_products", ""),
    ("Feed Information", "feed_info", ""),
    ("Frequency-Based Service", "frequencies", ""),
    ("Headsigns", "trips", "trip_headsign"),
    ("Location Types", "stops", "location_type"),
    ("Pathways", "pathways", ""),
    ("Route Colors", "routes", "route_color"),
    ("Shapes", "shapes", ""),
    ("Stops Wheelchair Accessibility", "stops", "wheelchair_boarding"),
    ("Transfers", "transfers", ""),
    ("Translations", "translations", ""),
    ("Trips Wheelchair Accessibility", "trips", "wheelchair_accessible"),
]


def _values(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct (table, column, value) with their row counts.

    Every column is profiled in one pass per table: rows are unpivoted and
    counted per value map-side, so only distinct values are shuffled.
    """
    out = None
    for name in sorted(tables):
        df = tables[name]
        columns = [c for c in df.columns if c not in KEY]
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("value"))
            for c in columns]))
        part = df.select(*KEY, F.lit(name).alias("table_name"), cells.alias("cell")).select(
            *KEY, "table_name", F.col("cell.column").alias("column_name"),
            F.col("cell.value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*KEY, "table_name", "column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))


def column_sketches(tables: dict[str, DataFrame], accuracy: int = 14) -> DataFrame:
    """(feed, snapshot, table_name, column_name, rows, non_empty, characters, first_value,
    last_value, sketch) of every column: the cells are folded into a HyperLogLog sketch of
    2 ** ``accuracy`` registers per task, so no value is shuffled."""
    out = None
    for name in sorted(tables):
        columns = [c for c in tables[name].columns if c not in KEY]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit("")).alias("value"))
                                    for c in columns])).alias("cell")
        part = tables[name].select(*KEY, F.lit(name).alias("table_name"), cells).select(*KEY, "table_name", "cell.*")
        out = part if out is None else out.unionByName(part)
    value = F.col("value")
    return out.groupBy(*KEY, "table_name", "column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(value != "", 1)).alias("non_empty"),
        F.sum(F.length(value)).alias("characters"), F.min(F.when(value != "", value)).alias("first_value"),
        F.max(F.when(value != "", value)).alias("last_value"), F.hll_sketch_agg(value, F.lit(accuracy)).alias("sketch"))


def sketched_profile(sketches: DataFrame, on: list[str] = KEY) -> DataFrame:
    """The profile of every column, merged over what ``on`` leaves out (snapshots, or feeds
    too), with ``distinct_estimate`` from the merged sketches (standard error 0.8 % at the
    default accuracy). The exact count is ``feed_profile``."""
    rows, filled = F.sum("rows"), F.sum("non_empty")
    return sketches.groupBy(*on, "table_name", "column_name").agg(
        rows.alias("rows"), filled.alias("non_empty"), F.round(1 - filled / F.nullif(rows, F.lit(0)), 4).alias("null_rate"),
        F.sum("characters").alias("characters"), F.min("first_value").alias("first_value"), F.max("last_value").alias("last_value"),
        # Sketches leave out the empty value, which counts as one.
        (F.hll_sketch_estimate(F.hll_union_agg("sketch")) + (rows > filled).cast("int")).alias("distinct_estimate"))


def feed_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per column: rows, non-empty, null rate, distinct, characters, first and last value.

    ``distinct`` counts the empty value too; ``text_bytes`` counts characters.
    """
    values = _values(tables)
    group = [*KEY, "table_name", "column_name"]
    stats = values.groupBy(*group).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value") != "", F.col("n")).otherwise(0)).alias("non_empty"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(F.length("value") * F.col("n")).alias("text_bytes"),
        F.min(F.nullif(F.col("value"), F.lit(""))).alias("first_value"),
        F.max(F.nullif(F.col("value"), F.lit(""))).alias("last_value"))
    return stats.select(
        *group, "rows", "non_empty",
        F.round(1 - F.col("non_empty") / F.col("rows"), 4).alias("null_rate"),
        "distinct", "text_bytes", (F.col("non_empty") == 0).alias("always_empty"),
        F.coalesce("first_value", F.lit("")).alias("first_value"),
        F.coalesce("last_value", F.lit("")).alias("last_value"))


def feed_features(profile: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feature flags per feed, from its profile; ``feeds`` is (feed, snapshot)."""
    spec = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(t).alias("table_name"), F.lit(c).alias("col"))
        for f, t, c in FEATURES]))
    asked = feeds.select(*KEY, spec.alias("s")).select(*KEY, "s.*")
    rows = profile.groupBy(*KEY, "table_name").agg(F.max("rows").alias("table_rows"))
    columns = profile.select(*KEY, "table_name", F.col("column_name").alias("col"), "non_empty")
    joined = asked.join(rows, [*KEY, "table_name"], "left").join(
        columns, [*KEY, "table_name", "col"], "left")
    no_table, no_column = F.col("table_rows").isNull(), F.col("non_empty").isNull()
    whole = F.col("col") == ""
    return joined.select(
        *KEY, "feature",
        F.when(no_table, False).when(whole, F.col("table_rows") > 0)
        .otherwise(F.coalesce(F.col("non_empty") > 0, F.lit(False))).alias("present"),
        F.when(no_table, F.concat("table_name", F.lit(".txt absent")))
        .when(whole, F.concat(F.col("table_rows").cast("string"), F.lit(" rows")))
        .when(no_column, F.concat(F.lit("column "), F.col("col"), F.lit(" absent")))
        .otherwise(F.concat(F.col("non_empty").cast("string"), F.lit(" non-empty values")))
        .alias("reason"))


def absent_files(profile: DataFrame, feeds: DataFrame) -> DataFrame:
    """Optional files a feed does not carry."""
    names = F.explode(F.array(*[F.lit(n) for n in OPTIONAL_FILES]))
    return feeds.select(*KEY, names.alias("table_name")).join(
        profile.select(*KEY, "table_name").distinct(), [*KEY, "table_name"], "left_anti")


def feed_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Headline counts as (metric, value): tables, routes by type, service ids."""
    counted = {"agency": "agencies", "routes": "routes", "stops": "stops", "trips": "trips",
               "stop_times": "stop_times", "shapes": "shapes_points",
               "calendar": "calendar_rows", "calendar_dates": "calendar_dates_rows"}
    out = None

    def add(part):
        nonlocal out
        out = part if out is None else out.unionByName(part)

    for table, metric in counted.items():
        if table in tables:
            add(tables[table].groupBy(*KEY).agg(F.count(F.lit(1)).alias("value"))
                .withColumn("metric", F.lit(metric)))
    if "routes" in tables:
        add(tables["routes"].groupBy(*KEY, route_type_name(F.col("route_type")).alias("t"))
            .agg(F.count(F.lit(1)).alias("value"))
            .select(*KEY, "value", F.concat(F.lit("routes: "), "t").alias("metric")))
    if "trips" in tables:
        add(tables["trips"].select(*KEY, "service_id").distinct().groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("service_ids")))
    return out.select(*KEY, "metric", "value")


def route_summary(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Per (route, direction): trips, headsigns (number, first, last), first and last
    departure; `route_headsigns` lists the headsigns.

    Calls shrink to one row per trip before they meet the trips.
    """
    group = [*KEY, "route_id", "direction_id"]
    spans = (stop_times.filter(F.col("departure_time") != "")
             .groupBy(*KEY, "trip_id").agg(
                 F.min(times.gtfs_seconds(F.col("departure_time"))).alias("first"),
                 F.max(times.gtfs_seconds(F.col("departure_time"))).alias("last")))
    per = (trips.join(spans, [*KEY, "trip_id"], "left")
           .groupBy(*group, "trip_headsign").agg(
               F.count(F.lit(1)).alias("trips"), F.min("first").alias("first"),
               F.max("last").alias("last"))
           .groupBy(*group).agg(
               F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("headsigns"),
               F.min("trip_headsign").alias("first_headsign"),
               F.max("trip_headsign").alias("last_headsign"), F.min("first").alias("first"),
               F.max("last").alias("last")))
    return per.select(
        *group, "trips", "headsigns", "first_headsign", "last_headsign", times.gtfs_time(F.col("first")).alias("first_departure"),
        times.gtfs_time(F.col("last")).alias("last_departure"))


def route_headsigns(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*KEY, "route_id", "direction_id", "trip_headsign").agg(
        F.count(F.lit(1)).alias("trips"))


def route_services(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*KEY, "route_id", "service_id").agg(F.count(F.lit(1)).alias("trips"))


def stop_summary(stops: DataFrame, stop_times: DataFrame, serving: DataFrame) -> DataFrame:
    """Per stop: calls, number of serving routes and their badges."""
    calls = stop_times.groupBy(*KEY, "stop_id").agg(F.count(F.lit(1)).alias("calls"))
    badges = serving.groupBy(*KEY, "stop_id").agg(
        F.count(F.lit(1)).alias("routes"),
        F.array_join(F.array_sort(F.collect_list("route_id")), "|").alias("route_ids"))
    return (stops.select(*KEY, "stop_id", "stop_code", "stop_name")
            .join(calls, [*KEY, "stop_id"], "left").join(badges, [*KEY, "stop_id"], "left")
            .withColumns({"calls": F.coalesce("calls", F.lit(0)),
                          "routes": F.coalesce("routes", F.lit(0)),
                          "route_ids": F.coalesce("route_ids", F.lit(""))}))


def sign_number(stops: DataFrame, example: str) -> DataFrame:
    """Which field holds the number printed on stop signs, such as ``example``, per feed."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("value"))
        for c in ("stop_code", "stop_id") if c in stops.columns]))
    values = (stops.select(*KEY, cells.alias("c")).select(*KEY, "c.field", "c.value")
              .groupBy(*KEY, "field", "value").agg(F.count(F.lit(1)).alias("n")))
    filled = F.when(F.col("value") != "", F.col("n")).otherwise(0)
    numeric = F.col("value").rlike("^[0-9]+$")
    fields = values.groupBy(*KEY, "field").agg(
        F.sum("n").alias("total"), F.sum(filled).alias("non_empty"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(F.when(numeric, F.col("n")).otherwise(0)).alias("numeric"),
        F.array_join(F.array_sort(F.collect_set(F.when(numeric, F.length("value")))), "|")
        .alias("lengths"),
        F.sum(F.when(F.col("value") == example, F.col("n")).otherwise(0)).alias("example_hits"))
    fields = fields.withColumns({
        "coverage": F.round(F.col("non_empty") / F.col("total"), 4),
        "is_unique": F.col("distinct") == F.col("non_empty"),
        "numeric_share": F.round(F.col("numeric") / F.nullif(F.col("non_empty"), F.lit(0)), 4)})

    def of(field: str, column: str):
        return F.max(F.when(F.col("field") == field, F.col(column)))

    verdict = fields.groupBy(*KEY).agg(
        F.when((of("stop_code", "coverage") > 0.9) & of("stop_code", "is_unique"), "stop_code")
        .when(of("stop_code", "example_hits") > 0, "stop_code")
        .when(of("stop_id", "example_hits") > 0, "stop_id")
        .otherwise("unknown").alias("verdict"))
    return fields.join(verdict, KEY).select(
        *KEY, "field", "total", "non_empty", "coverage", "distinct", "is_unique",
        "numeric_share", "lengths", "example_hits", "verdict")
