"""Assumptions checked on every feed, and the status they roll up to.

Each check is one aggregate plan over all feeds giving (feed, snapshot,
observed, ok) for the feeds it could measure. A feed without a measurement, or
a check whose input is missing, is a skip and never a pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline import FEED, KEY
from tramline.functions import times
from tramline.operators import calendar as cal
from tramline.operators.stops import boardable_stops

# Id, severity, category and threshold text of every assumption.
ASSUMPTIONS = [
    ("feed_not_expiring", "critical", "static", "7"),
    ("max_time_bounded", "high", "static", "< 28:00:00"),
    ("no_fare_files", "opportunity", "static", ""),
    ("no_frequencies_file", "high", "static", "0"),
    ("stop_code_format", "high", "static", "0.99"),
    ("stop_code_present", "critical", "static", "0.99"),
    ("stop_code_unique", "critical", "static", "0"),
    ("timezone_unchanged", "critical", "static", "expected zone"),
    ("rail_route_ids_stable", "medium", "stability", ""),
    ("stop_ids_stable", "high", "stability", "0.98"),
    ("rt_fresh", "high", "realtime", "300"),
    ("rt_join_rate", "high", "realtime", "0.95"),
    ("rt_wire_shape", "medium", "realtime", "0.05"),
    ("fares_unchanged", "high", "web", "fares"),
    ("holidays_unchanged", "medium", "web", "holidays"),
    ("terms_unchanged", "critical", "web", "developer_terms"),
]
CATEGORY_RANK = {"static": 0, "stability": 1, "realtime": 2, "web": 3}
FARE_TABLES = ["fare_attributes", "fare_rules", "fare_products", "fare_media", "fare_leg_rules",
               "fare_transfer_rules", "rider_categories", "timeframes", "areas", "networks"]
RAIL_TYPES = ["0", "1", "2"]
REQUIRED_RT = ["trip_updates", "vehicle_positions", "alerts"]
MIN_DAYS, MAX_SECONDS, RT_CEILING = 7, 28 * 3600, 300
MIN_COVERAGE, MIN_FORMAT, MIN_SURVIVAL, MIN_JOIN, MAX_UNMODELLED = 0.99, 0.99, 0.98, 0.95, 0.05
CODE_FORMAT = "^[0-9]{4,5}$"


@dataclass
class Inputs:
    """What the suite may read; a missing optional input makes its checks skip."""

    tables: dict[str, DataFrame]
    feeds: DataFrame                      # feed, snapshot, today
    zones: DataFrame | None = None        # feed, zone: the expected time zones
    baseline: dict[str, DataFrame] | None = None
    rt_health: DataFrame | None = None
    rt_join: DataFrame | None = None
    rt_census: DataFrame | None = None
    page_hashes: DataFrame | None = None  # page_key, content_hash
    recorded: DataFrame | None = None     # page_key, expected_hash
    extra: dict = field(default_factory=dict)


def _row(df: DataFrame, observed: Column, ok: Column, keys=KEY) -> DataFrame:
    return df.select(*keys, observed.cast("string").alias("observed"), ok.alias("ok"))


def _codes(stops: DataFrame) -> DataFrame:
    return stops.filter(F.col("stop_code") != "")


def stop_code_present(i: Inputs) -> DataFrame:
    rate = F.round(F.avg(F.when(F.col("stop_code") != "", 1.0).otherwise(0.0)), 4)
    out = boardable_stops(i.tables["stops"]).groupBy(*KEY).agg(rate.alias("rate"))
    return _row(out, F.col("rate"), F.col("rate") >= MIN_COVERAGE)


def stop_code_unique(i: Inputs) -> DataFrame:
    per_code = _codes(i.tables["stops"]).groupBy(*KEY, "stop_code").agg(F.count(F.lit(1)).alias("n"))
    out = per_code.groupBy(*KEY).agg(F.count(F.when(F.col("n") > 1, 1)).alias("dups"))
    out = i.feeds.select(*KEY).join(out, KEY, "left").withColumn(
        "dups", F.coalesce("dups", F.lit(0)))
    return _row(out, F.col("dups"), F.col("dups") <= 0)


def stop_code_format(i: Inputs) -> DataFrame:
    rate = F.round(F.avg(F.when(F.col("stop_code").rlike(CODE_FORMAT), 1.0).otherwise(0.0)), 4)
    out = _codes(i.tables["stops"]).groupBy(*KEY).agg(rate.alias("rate"))
    return _row(out, F.col("rate"), F.col("rate") >= MIN_FORMAT)


def feed_not_expiring(i: Inputs) -> DataFrame:
    out = cal.feed_coverage(i.tables["calendar"], i.tables["calendar_dates"], i.feeds).filter(
        F.col("days_remaining").isNotNull())
    return _row(out, F.col("days_remaining"), F.col("days_remaining") >= MIN_DAYS)


def no_frequencies_file(i: Inputs) -> DataFrame:
    rows = i.feeds.select(*KEY)
    if "frequencies" in i.tables:
        n = i.tables["frequencies"].groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(n, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        rows = rows.withColumn("n", F.lit(0))
    return _row(rows, F.col("n"), F.col("n") <= 0)


def max_time_bounded(i: Inputs) -> DataFrame:
    cells = F.explode(F.array(*[F.col(c) for c in ("departure_time", "arrival_time")
                                if c in i.tables["stop_times"].columns]))
    out = (i.tables["stop_times"].select(*KEY, cells.alias("t")).filter(F.col("t") != "")
           .withColumn("s", times.gtfs_seconds(F.col("t"))).groupBy(*KEY).agg(
               F.max("s").alias("worst"), F.count(F.when(F.col("s").isNull(), 1)).alias("bad")))
    return _row(out, times.gtfs_time(F.col("worst")),
                (F.col("bad") == 0) & (F.col("worst") < MAX_SECONDS))


def timezone_unchanged(i: Inputs) -> DataFrame:
    zones = i.tables["agency"].select(*KEY, F.trim("agency_timezone").alias("z")).filter(
        "z <> ''").distinct()
    out = zones.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("z")), ",").alias("z"))
    out = i.feeds.select(*KEY).join(out, KEY, "left")
    want = i.zones.select(*FEED, F.col("zone").alias("want"))
    return _row(out.join(want, FEED, "left"), F.col("z"), F.coalesce(F.col("z") == F.col("want"), F.lit(False)))


def no_fare_files(i: Inputs) -> DataFrame:
    rows = i.feeds.select(*KEY, F.lit(None).cast("string").alias("t"))
    for name in FARE_TABLES:
        if name in i.tables:
            rows = rows.unionByName(i.tables[name].select(*KEY).distinct().withColumn("t", F.lit(name)))
    out = rows.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("t"))
    return _row(out, F.col("t"), F.col("t") == "")


def stop_ids_stable(i: Inputs) -> DataFrame:
    base = _codes(i.baseline["stops"]).select("feed_id", "stop_code").distinct()
    now = _codes(i.tables["stops"]).select("feed_id", "stop_code").distinct().withColumn(
        "alive", F.lit(1.0))
    rate = F.round(F.avg(F.coalesce("alive", F.lit(0.0))), 4)
    out = base.join(now, ["feed_id", "stop_code"], "left").groupBy("feed_id").agg(rate.alias("rate"))
    return _row(out, F.col("rate"), F.col("rate") >= MIN_SURVIVAL, ["feed_id"])


def rail_route_ids_stable(i: Inputs) -> DataFrame:
    def rail(tables, flag):
        return tables["routes"].filter(F.trim("route_type").isin(RAIL_TYPES)).select(
            "feed_id", "route_id").distinct().withColumn(flag, F.lit(1))

    both = rail(i.baseline, "a").join(rail(i.tables, "b"), ["feed_id", "route_id"], "full_outer")
    out = both.groupBy("feed_id").agg(
        F.count("a").alias("base"), F.count(F.when(F.col("a").isNull(), 1)).alias("new"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("gone")).filter("base > 0")
    return _row(out, F.concat(F.lit("-"), F.col("gone").cast("string"), F.lit("/+"),
                              F.col("new").cast("string")),
                (F.col("gone") == 0) & (F.col("new") == 0), ["feed_id"])


def rt_fresh(i: Inputs) -> DataFrame:
    """Age of each required feed when it was fetched; an old sample cannot testify."""
    h = i.rt_health.filter(F.col("entity_kind").isin(REQUIRED_RT))
    out = h.groupBy("feed_id").agg(
        F.max("age_at_fetch").alias("worst"), F.min("fetched_ago").alias("since"),
        F.count(F.when(~F.col("available"), 1)).alias("missing"))
    out = out.filter(((F.col("worst").isNotNull()) | (F.col("missing") > 0))
                     & (F.coalesce("since", F.lit(0)) <= RT_CEILING))
    return _row(out, F.col("worst"), (F.col("missing") == 0) & (F.col("worst") <= RT_CEILING),
                ["feed_id"])


def rt_join_rate(i: Inputs) -> DataFrame:
    return _row(i.rt_join, F.col("join_rate"), F.col("join_rate") >= MIN_JOIN, ["feed_id"])


def rt_wire_shape(i: Inputs) -> DataFrame:
    out = i.rt_census.groupBy("feed_id").agg(F.coalesce(
        F.max(F.when(~F.col("modelled"), F.col("presence_rate"))), F.lit(0.0)).alias("rate"))
    return _row(out, F.col("rate"), F.col("rate") <= MAX_UNMODELLED, ["feed_id"])


def page_unchanged(i: Inputs, page: str) -> DataFrame:
    """The page's newest hash equals the recorded one; unrecorded pages are unmeasured."""
    hit = i.page_hashes.filter(F.col("page_key") == page).join(
        i.recorded.filter(F.coalesce("expected_hash", F.lit("")) != ""), "page_key")
    return hit.select(F.col("content_hash").alias("observed"),
                      (F.col("content_hash") == F.col("expected_hash")).alias("ok"), "page_key")


CHECKS = {
    "stop_code_present": (stop_code_present, None), "stop_code_unique": (stop_code_unique, None),
    "stop_code_format": (stop_code_format, None), "feed_not_expiring": (feed_not_expiring, None),
    "no_frequencies_file": (no_frequencies_file, None),
    "max_time_bounded": (max_time_bounded, None),
    "timezone_unchanged": (timezone_unchanged, "zones"), "no_fare_files": (no_fare_files, None),
    "stop_ids_stable": (stop_ids_stable, "baseline"),
    "rail_route_ids_stable": (rail_route_ids_stable, "baseline"),
    "rt_fresh": (rt_fresh, "rt_health"), "rt_join_rate": (rt_join_rate, "rt_join"),
    "rt_wire_shape": (rt_wire_shape, "rt_census"),
}


def assumptions(i: Inputs, only: list[str] | None = None) -> DataFrame:
    """One row per (feed, assumption): status, observed, expected, in a fixed order."""
    out = None
    for name, severity, category, expected in ASSUMPTIONS:
        if only is not None and name not in only:
            continue
        base = i.feeds.select(*KEY)
        if category == "web":
            measured = None
            if i.page_hashes is not None and i.recorded is not None:
                tag = base.withColumn("page_key", F.lit(expected))
                measured = tag.join(page_unchanged(i, expected), "page_key", "left").drop("page_key")
        else:
            check, need = CHECKS[name]
            part = check(i) if need is None or getattr(i, need) is not None else None
            on = [k for k in KEY if part is not None and k in part.columns]
            measured = None if part is None else base.join(part, on, "left")
        if measured is None:
            measured = base.withColumns({"observed": F.lit(None).cast("string"),
                                         "ok": F.lit(None).cast("boolean")})
        failed = "opportunity" if severity == "opportunity" else "fail"
        rows = measured.select(
            *KEY, F.lit(name).alias("id"),
            F.when(F.col("ok").isNull(), "skip").when(F.col("ok"), "pass").otherwise(failed)
            .alias("status"),
            F.when(F.col("ok").isNotNull(), F.col("observed")).alias("observed"),
            F.lit(expected).alias("expected"), F.lit(severity).alias("severity"),
            F.lit(category).alias("category"),
            F.lit(CATEGORY_RANK[category]).alias("category_rank"))
        out = rows if out is None else out.unionByName(rows)
    return out


AREAS = ["feed", "assertions", "realtime", "drift", "snapshots"]


def feed_status(feeds: DataFrame, coverage: DataFrame | None = None,
                checks: DataFrame | None = None, health: DataFrame | None = None,
                drift: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """broken, attention or ok per feed, with the areas nobody measured.

    ``drift`` and ``snapshots`` are (feed, status) and (feed, pinned); an absent
    input is listed as not checked and never counted as passing.
    """
    def finding(df: DataFrame, rank: Column, area: str) -> DataFrame:
        return df.select("feed_id", rank.cast("int").alias("rank"), F.lit(area).alias("area"))

    ids = feeds.select("feed_id").distinct()
    missing, parts = [], []

    def add(area, df, rank, absent):
        if df is None:
            missing.append(area)
            parts.append(finding(ids, F.lit(absent), area))
        else:
            parts.append(finding(df, rank, area))

    days = F.col("days_remaining")
    add("feed", coverage, F.when(F.col("expired"), 2).when(days.isNull() | (days < MIN_DAYS), 1)
        .otherwise(0), 1)
    add("assertions", checks, F.when(F.col("status") == "fail", 2).otherwise(0), 0)
    add("realtime", health, F.when(~F.col("available") | F.col("stale"), 1).otherwise(0), 0)
    add("drift", drift, F.when(F.col("status").isin("changed", "extraction_failed"), 1)
        .otherwise(0), 0)
    add("snapshots", snapshots, F.lit(0), 1)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    out = ids.join(rows, "feed_id", "left").groupBy("feed_id").agg(
        F.max("rank").alias("rank"), *[
            F.count(F.when((F.col("area") == a) & (F.col("rank") > 0), 1)).alias(f"{a}_findings")
            for a in AREAS])
    return out.select(
        "feed_id", F.when(F.col("rank") == 2, "broken").when(F.col("rank") == 1, "attention")
        .otherwise("ok").alias("status"), *[f"{a}_findings" for a in AREAS],
        F.lit(",".join(missing)).alias("not_checked"))
