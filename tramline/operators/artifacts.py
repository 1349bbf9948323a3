"""Snapshot catalogue, lookup tables, pruned feeds, golden cases, paging."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline import KEY
from tramline.operators import calendar as cal
from tramline.session import written
from tramline.sources.feeds import feed_gate, row_counts


# --------------------------------------------------------------- snapshots --
def snapshot_latest(snapshots: DataFrame) -> DataFrame:
    """Newest capture per (kind, source)."""
    return snapshots.groupBy("kind", "source").agg(
        F.max(F.struct("fetched_epoch", "capture_ref", "sha256", "bytes")).alias("s")).select(
        "kind", "source", "s.*")


def snapshot_duplicates(snapshots: DataFrame) -> DataFrame:
    """Digests stored more than once per (kind, source), with the first capture."""
    return snapshots.groupBy("kind", "source", "sha256").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("bytes").alias("bytes"),
        F.min(F.struct("fetched_epoch", "capture_ref")).alias("f")).filter("copies > 1").select(
        "kind", "source", "sha256", "copies", "bytes", F.col("f.capture_ref").alias("first_ref"))


def retention(snapshots: DataFrame, keep: int = 5) -> DataFrame:
    """Captures beyond the newest ``keep`` per (kind, source) that are not pinned.

    Only the kept ones are ranked (the limit is applied before the shuffle);
    the rest is everything else. Nothing is deleted.
    """
    order = Window.partitionBy("kind", "source").orderBy(F.desc("fetched_epoch"), "capture_ref")
    kept = snapshots.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= keep).select("capture_ref")
    return snapshots.filter(F.col("pin").isNull()).join(kept, "capture_ref", "left_anti")


def integrity(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("capture_ref", "sha256", "actual_sha256",
                            (F.col("sha256") == F.col("actual_sha256")).alias("intact"))


# -------------------------------------------------------------- stops index --
def route_order(badge: Column) -> Column:
    """Badges as riders read them: numbers by value, then text."""
    number = badge.rlike("^[0-9]+$")
    return F.struct(F.when(number, 0).otherwise(1).alias("is_text"),
                    F.when(number, badge.cast("decimal(38,0)")).otherwise(0).alias("number"),
                    badge.alias("badge"))


def stops_index(stops: DataFrame, serving: DataFrame) -> DataFrame:
    """stop_code -> lowest stop_id, name and route badges; losers are counted.

    ``serving`` has distinct (stop_id, route_id, badge); the list of a stop is
    as long as the number of its routes.
    """
    badges = serving.select(*KEY, "stop_id", "badge").distinct().groupBy(*KEY, "stop_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(route_order(F.col("badge")))),
                                 lambda s: s["badge"]), "|").alias("routes"))
    coded = stops.withColumn("code", F.trim("stop_code")).filter("code <> ''")
    firsts = coded.groupBy(*KEY, "code").agg(
        F.min(F.struct("stop_id", "stop_name", "parent_station", "location_type")).alias("s"),
        F.count(F.lit(1)).alias("n")).select(
        *KEY, "code", "s.*", (F.col("n") - 1).alias("shadowed"))
    return firsts.join(badges, [*KEY, "stop_id"], "left").withColumns(
        {"routes": F.coalesce("routes", F.lit("")), "stop_name": F.trim("stop_name")})


def index_report(stops: DataFrame) -> DataFrame:
    """Per feed: stops, codes, codes shared by several stops, stops without a code."""
    per_code = stops.withColumn("code", F.trim("stop_code")).groupBy(*KEY, "code").agg(
        F.count(F.lit(1)).alias("n"))
    coded = F.col("code") != ""
    return per_code.groupBy(*KEY).agg(
        F.sum("n").alias("stops"), F.count(F.when(coded, 1)).alias("codes"),
        F.count(F.when(coded & (F.col("n") > 1), 1)).alias("shared_codes"),
        F.coalesce(F.sum(F.when(~coded, F.col("n"))), F.lit(0)).alias("without_code"))


# ------------------------------------------------------------------ compact --
# What each strategy keeps.
ESSENTIAL_TABLES = ["agency", "stops", "routes", "trips", "stop_times", "calendar",
                    "calendar_dates", "frequencies"]
BALANCED_TABLES = ["feed_info", "attributions"]
FULL_ONLY_TABLES = ["shapes", "transfers", "pathways", "levels", "translations",
                    "fare_attributes", "fare_rules", "fare_products", "fare_media",
                    "fare_leg_rules", "fare_transfer_rules", "rider_categories", "timeframes",
                    "areas", "networks"]
COLUMN_PLAN = {
    "stop_times": {
        "minimal": ["trip_id", "stop_id", "stop_sequence", "departure_time", "pickup_type"],
        "balanced": ["trip_id", "stop_id", "stop_sequence", "departure_time", "arrival_time",
                     "pickup_type", "drop_off_type"]},
    "stops": {
        "minimal": ["stop_id", "stop_code", "stop_name", "parent_station", "location_type"],
        "balanced": ["stop_id", "stop_code", "stop_name", "parent_station", "location_type",
                     "wheelchair_boarding"]},
    "trips": {
        "minimal": ["trip_id", "route_id", "service_id", "trip_headsign", "direction_id"],
        "balanced": ["trip_id", "route_id", "service_id", "trip_headsign", "direction_id",
                     "wheelchair_accessible"]},
    "routes": {
        "minimal": ["route_id", "route_short_name", "route_long_name", "route_type"],
        "balanced": ["route_id", "route_short_name", "route_long_name", "route_type"]},
    "agency": {
        "minimal": ["agency_id", "agency_name", "agency_timezone", "agency_url"],
        "balanced": ["agency_id", "agency_name", "agency_timezone", "agency_url", "agency_phone",
                     "agency_lang"]},
}
SORT_KEYS = {
    "agency": ["agency_id"], "calendar": ["service_id"],
    "calendar_dates": ["date", "service_id", "exception_type"], "routes": ["route_id"],
    "trips": ["trip_id"], "stops": ["stop_id"],
    "stop_times": ["stop_id", "departure_time", "trip_id", "stop_sequence"],
}


def kept_table(name: str, strategy: str) -> bool:
    if name in ESSENTIAL_TABLES or strategy == "full":
        return True
    # A table nobody reasoned about is kept except at the most aggressive level.
    return strategy == "balanced" and name not in FULL_ONLY_TABLES


def prune_decisions(profile: DataFrame, strategy: str) -> DataFrame:
    """One row per table and column: kept or dropped, why, estimated bytes saved.

    ``profile`` is `operators.profile.feed_profile`: a column is called empty
    because it was counted, in every feed that shares the table.
    """
    column = ["table_name", "column_name"]
    empty = profile.groupBy(*column).agg(F.bool_and("always_empty").alias("always_empty"))
    rows = profile.select(*KEY, *column, "rows", "text_bytes").join(empty, column)
    dropped_table = ~F.col("table_name").isin([
        t for t in [*ESSENTIAL_TABLES, *BALANCED_TABLES, *FULL_ONLY_TABLES]
        if kept_table(t, strategy)])
    if strategy != "minimal":
        known = [*ESSENTIAL_TABLES, *BALANCED_TABLES, *FULL_ONLY_TABLES]
        dropped_table = dropped_table & F.col("table_name").isin(known)
    planned = F.lit(True)
    if strategy != "full":
        for table, plans in COLUMN_PLAN.items():
            planned = F.when(F.col("table_name") == table,
                             F.col("column_name").isin(plans[strategy])).otherwise(planned)
    reason = (F.when(dropped_table, "table_not_kept")
              .when(F.col("always_empty") & F.lit(strategy != "full"), "empty_on_every_row")
              .when(~planned, "not_in_strategy").otherwise(""))
    return rows.select(
        *KEY, "table_name", "column_name", (reason == "").alias("kept"), reason.alias("reason"),
        F.when(reason != "", F.col("text_bytes") + F.col("rows")).otherwise(0)
        .alias("bytes_saved"))


def empty_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Columns without a value in any feed: one map-side aggregate per table, of which
    one row reaches the driver, for it decides a schema."""
    out = {}
    for name, df in tables.items():
        columns = [c for c in df.columns if c not in KEY]
        filled = df.agg(*[F.coalesce(F.max(F.coalesce(F.col(c), F.lit("")) != ""), F.lit(False)).alias(c)
                          for c in columns]).first()
        out[name] = [c for c in columns if not filled[c]]
    return out


def unknown_routes(tables: dict[str, DataFrame], routes: list[str]) -> list[str]:
    """The asked route ids that no feed has."""
    known = tables["routes"].filter(F.col("route_id").isin(routes)).select("route_id").distinct()
    return sorted(set(routes) - {r["route_id"] for r in known.collect()})


def compact(tables: dict[str, DataFrame], strategy: str = "balanced",
            routes: list[str] | None = None, days: int | None = None) -> dict[str, DataFrame]:
    """The pruned tables of every feed.

    Rows follow a semi-join chain: services of the first ``days`` service days
    -> trips (and ``routes``) -> calls -> stops with their parents. The window
    starts at each feed's first service date, so the result does not depend on
    the day it was made. Columns that are empty on every row of every feed are
    dropped, as `prune_decisions` says. Unknown route ids are an error.
    """
    out = {n: df for n, df in tables.items() if kept_table(n, strategy)}
    if routes is not None and (unknown := unknown_routes(tables, routes)):
        raise ValueError(f"No feed has the routes {', '.join(unknown)}.")
    empties = empty_columns(out) if strategy != "full" else {}
    trips, calls = out["trips"], out["stop_times"]
    if days is not None:
        span = cal.coverage(out["calendar"], out["calendar_dates"])
        asked = span.withColumn("service_date", F.explode(F.sequence(
            "service_start", F.least(F.col("service_end"), F.date_add("service_start", days - 1)))))
        services = cal.service_calendar(out["calendar"], out["calendar_dates"], asked).select(
            *KEY, "service_id").distinct()
        trips = trips.join(services, [*KEY, "service_id"], "left_semi")
        for name in ("calendar", "calendar_dates"):
            out[name] = out[name].join(services, [*KEY, "service_id"], "left_semi")
    if routes is not None:
        trips = trips.filter(F.col("route_id").isin(routes))
        out["routes"] = out["routes"].filter(F.col("route_id").isin(routes))
    if days is not None or routes is not None:
        calls = calls.join(trips.select(*KEY, "trip_id"), [*KEY, "trip_id"], "left_semi")
        called = calls.select(*KEY, "stop_id").distinct()
        stops = out["stops"]
        if "parent_station" in stops.columns:
            parents = (stops.join(called, [*KEY, "stop_id"], "left_semi")
                       .filter("parent_station <> ''")
                       .select(*KEY, F.col("parent_station").alias("stop_id")))
            called = called.unionByName(parents).distinct()
        out["stops"] = stops.join(called, [*KEY, "stop_id"], "left_semi")
    out["trips"], out["stop_times"] = trips, calls
    if strategy != "full":
        for name, df in out.items():
            empty = set(empties[name])
            keep = [c for c in df.columns if c not in KEY and c not in empty]
            plan = COLUMN_PLAN.get(name, {}).get(strategy)
            if plan is not None:
                keep = [c for c in plan if c in keep]
            out[name] = df.select(*KEY, *(keep or [c for c in df.columns if c not in KEY]))
    return out


def compact_sink(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table clustered by its access path.

    Range partitioning on (feed, snapshot, sort keys) splits a hot stop's calls
    by time and gives files whose min/max let a stop lookup skip the rest.
    """
    for name, df in tables.items():
        keys = [*KEY, *[c for c in SORT_KEYS.get(name, []) if c in df.columns]]
        if "stop_sequence" in keys:
            clustered = df.repartitionByRange(*keys).sortWithinPartitions(
                *[F.col(k).cast("int") if k == "stop_sequence" else F.col(k) for k in keys])
        else:
            clustered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        clustered.write.parquet(f"{path}/{name}")


# ---------------------------------------------------------------- artifacts --
def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with sorted keys; NULL fields are written out."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def json_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """(order..., json, sha256) of every row."""
    return df.withColumn("json", canonical_json(df)).select(
        *order, "json", F.sha2(F.col("json").cast("binary"), 256).alias("sha256"))


def json_artifact_sink(df: DataFrame, order: list[str], path: str) -> None:
    """Deterministic JSON lines, range partitioned and sorted by ``order``."""
    json_rows(df, order).repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("json").write.text(path)


def artifact_manifest(spark: SparkSession, artifacts: dict[str, str]) -> DataFrame:
    """(name, file, rows, bytes, sha256) of every file of the written artifacts.

    Files are hashed where they lie; totals per artifact are one aggregation.
    """
    out = None
    for name, path in sorted(artifacts.items()):
        text = F.col("content").cast("string")
        lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        part = spark.read.format("binaryFile").load(f"{path}/part-*").select(
            F.lit(name).alias("name"), F.col("path").alias("file"), lines.alias("rows"),
            F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------- golden --
GOLDEN_FIELDS = ["route_short_name", "headsign", "departure_local", "gtfs_time", "service_date",
                 "trip_id", "direction_id", "after_midnight"]


def golden_rows(departures: DataFrame) -> DataFrame:
    """(case_id, position, pinned fields as text) of ranked departures."""
    return departures.select(
        F.col("query_id").alias("case_id"), F.col("rank").alias("position"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GOLDEN_FIELDS])


def golden_regression(cases: DataFrame, golden: DataFrame, fresh: DataFrame,
                      golden_errors: DataFrame, fresh_errors: DataFrame) -> DataFrame:
    """Compare pinned rows and error types with recomputed ones, per case.

    ``cases`` lists every case_id; errors are (case_id, error). The reason names
    the error change, the count change, or the first row that differs and how.
    Without a case nothing would be checked, which is an error.
    """
    if cases.isEmpty():
        raise ValueError("The golden regression has no cases.")
    tag = {"g": golden, "f": fresh}
    record = F.struct(*GOLDEN_FIELDS)
    both = None
    for side, df in tag.items():
        part = df.select("case_id", "position", F.lit(side).alias("side"), record.alias("r"))
        both = part if both is None else both.unionByName(part)
    rows = both.groupBy("case_id", "position").agg(
        F.max(F.when(F.col("side") == "g", F.col("r"))).alias("g"),
        F.max(F.when(F.col("side") == "f", F.col("r"))).alias("f"))
    fields = F.array_join(F.array_compact(F.array(*[
        F.when(~F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")), F.lit(c))
        for c in sorted(GOLDEN_FIELDS)])), ", ")
    rows = rows.withColumn("diff", fields)
    per_case = rows.groupBy("case_id").agg(
        F.count("g").alias("expected_count"), F.count("f").alias("actual_count"),
        F.min(F.when(F.col("diff") != "", F.struct("position", "diff"))).alias("first"))
    out = (cases.select("case_id").join(per_case, "case_id", "left")
           .join(golden_errors.select("case_id", F.col("error").alias("expected_error")),
                 "case_id", "left")
           .join(fresh_errors.select("case_id", F.col("error").alias("actual_error")),
                 "case_id", "left"))
    n_g, n_f = (F.coalesce(c, F.lit(0)) for c in ("expected_count", "actual_count"))
    e_g, e_f = F.col("expected_error"), F.col("actual_error")
    reason = (F.when(~e_g.eqNullSafe(e_f), F.when(e_f.isNull(), F.concat(
        F.lit("expected "), e_g, F.lit(" but got departures"))).when(e_g.isNull(), F.concat(
            F.lit("expected departures but got "), e_f)).otherwise("error type changed"))
        .when(n_g != n_f, F.concat(F.lit("count changed: "), n_g.cast("string"), F.lit(" -> "),
                                   n_f.cast("string")))
        .when(F.col("first").isNotNull(), F.concat(
            F.lit("departure "), (F.col("first.position") - 1).cast("string"),
            F.lit(" differs on: "), F.col("first.diff"))))
    return out.select("case_id", reason.isNull().alias("matches"), n_g.alias("expected_count"),
                      n_f.alias("actual_count"), "expected_error", "actual_error",
                      reason.alias("reason"))


# ------------------------------------------------------------ SQL and paging --
def feed_sql(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """An ad-hoc SELECT, in Spark SQL, over temporary views of the feed's tables."""
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    for name, view in names.items():
        tables[name].createOrReplaceTempView(view)
    # The caller's views of these names stay: the query sees ours by common table expressions.
    ours = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in names.items())
    try:
        head = re.match(r"(?is)\s*WITH\s+(RECURSIVE\s+)?", query)
        return spark.sql(f"WITH {head.group(1) or ''}{ours}, {query[head.end():]}" if head else f"WITH {ours} {query}")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``row``, their number from 1 in the group's order, and ``total``.

    Rows are sorted into ranges over group, order and the other columns and written; a
    row's number is its place in its range plus the sizes of the group's earlier ranges.
    No task holds a group; the sizes are ranges x groups.
    """
    rest = [c for c in df.columns if c not in (*group, *order)]
    ranged = written(df.repartitionByRange(*group, *order, *rest).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("n").over(before), F.lit(0)),
                               "total": F.sum("n").over(Window.partitionBy(*group))}).drop("n")
    place = Window.partitionBy(*group, "__range").orderBy(*order, *rest)
    return ranged.join(sizes, [*group, "__range"]).withColumn(
        "row", F.col("__before") + F.row_number().over(place)).drop("__before", "__range")


def paginate(df: DataFrame, group: list[str], order: list[str], offset: int = 0,
             limit: int = 50) -> DataFrame:
    """One page of ``limit`` rows per group in a total order, with total, has_more and next_offset.

    However deep the page, only ranges are sorted (see ``numbered``); rows equal in
    ``order`` are told apart by their other columns.
    """
    size, offset = max(1, limit), max(0, offset)
    page = numbered(df, group, order).filter(F.col("row").between(offset + 1, offset + size))
    more = F.col("total") > offset + size
    return page.withColumns({"row": F.col("row").cast("int"), "has_more": more,
                             "next_offset": F.when(more, F.lit(offset + size))})


# ---------------------------------------------------------------- publishing --
def publish(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Publish the feeds' tables version by version; the verdict per (feed, snapshot).

    Tables are staged below a new version, read back and audited by the gate: row counts
    must be those of the input, and the feed must be accepted. Only then does one small
    commit name the version for the accepted feeds. Readers (``published``) follow the
    commits, so until then, and for a refused feed or a write that breaks off, the
    version before stays what they read; its files are never touched.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.partitionBy(*KEY).parquet(f"{root}/data/{name}/version={version}")
    given = row_counts(tables)
    staged = row_counts({name: _version(spark, root, name, version, df.schema) for name, df in tables.items()})
    lost = given.exceptAll(staged).unionByName(staged.exceptAll(given)).select(*KEY).distinct().withColumn("lost", F.lit(True))
    verdict = feed_gate(given).join(lost, KEY, "left")
    verdict = verdict.withColumns({"accepted": F.col("accepted") & F.col("lost").isNull(), "reason": F.when(
        F.col("accepted") & F.col("lost").isNotNull(), "STAGED_ROWS_DIFFER").otherwise(F.col("reason"))}).drop("lost")
    verdict = written(verdict, "verdict")
    commits = verdict.filter("accepted").select(*KEY, F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("at"))
    commits.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return verdict


COMMITS = "feed_id string, snapshot_id string, version string, at bigint"


def _version(spark: SparkSession, root: str, name: str, version: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{root}/data/{name}/version={version}").parquet(
        f"{root}/data/{name}/version={version}")


def published(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """The table ``name`` of every feed and snapshot, as last published.

    The commits, one row per publication, say which versions are read; other folders
    are not opened.
    """
    commits = spark.read.schema(COMMITS).parquet(f"{root}/commits")
    current = commits.groupBy(*KEY).agg(F.max_by("version", F.struct("at", "version")).alias("version"))
    out = spark.createDataFrame([], schema)
    for version in sorted(r[0] for r in current.select("version").distinct().collect()):
        rows = _version(spark, root, name, version, schema)
        mine = current.filter(F.col("version") == version).select(*KEY)
        out = out.unionByName(rows.join(mine, KEY, "left_semi"))
    return out
