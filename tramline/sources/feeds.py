"""Reading feeds: all-string tables, optional columns, zip landing, acceptance."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline import KEY


def with_optional(df: DataFrame | None, columns: list[str]) -> DataFrame | None:
    """Project ``columns``; an absent column reads as ``''``, NULL reads as ``''``."""
    if df is None:
        return None
    have = set(df.columns)
    return df.select(*[k for k in KEY if k in have and k not in columns], *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have
        else F.lit("").alias(c) for c in columns])


def gtfs_scan(spark: SparkSession, root: str, columns: list[str], files: str, quoted_lines: bool = True) -> DataFrame:
    """One table of every feed: ``root/feed_id=*/snapshot_id=*/<files>``.

    ``files`` names the table's file, such as ``stops.txt``, or a pattern.

    Feeds order their columns differently, so a positional schema would misread
    them: the files are read once for their header lines (one small row a file),
    then, grouped by header, with that header's columns as the schema. All values
    stay strings; an absent column or cell is ``''``; a byte order mark is dropped.
    Quoted fields may hold commas, doubled quotes and, with ``quoted_lines``, line feeds; a
    file is then one task, so turn it off for files of many gigabytes without them.
    """
    lines = spark.read.option("basePath", root).text(f"{root}/*/*/{files}").select(
        F.regexp_replace("value", "[\\r\ufeff]", "").alias("header"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    firsts = lines.filter("block = 0").groupBy("file").agg(F.min_by("header", "line").alias("header"))
    by_header: dict[str, list[str]] = {}
    for r in firsts.sort("file").collect():  # as many rows as files, which the driver lists anyway
        by_header.setdefault(r["header"], []).append(r["file"])
    out = None
    for header, paths in by_header.items():
        names = [n.strip() for n in next(csv.reader([header]), [""])]
        place = {n: i for i, n in reversed(list(enumerate(names)))}
        body = (spark.read.option("basePath", root).option("header", True).option("escape", '"')
                .option("multiLine", quoted_lines)
                .schema(", ".join([*(f"c{i} string" for i in range(len(names))), *(f"{k} string" for k in KEY)]))
                .csv(paths))
        part = body.select(*KEY, *[
            (F.coalesce(f"c{place[c]}", F.lit("")) if c in place else F.lit("")).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*KEY, *columns]))
    return out


def land_zips(spark: SparkSession, pattern: str) -> DataFrame:
    """Members of zipped feeds as rows (path, table_name, line_no, line).

    A zip cannot be split, so one archive is one unit of work and many archives
    run in parallel; members are streamed line by line. Written partitioned by
    feed, snapshot and table as text, the result is what `gtfs_scan` reads.
    """
    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        name = member.rsplit("/", 1)[-1].lower()
                        if not name.endswith(".txt"):
                            continue
                        with archive.open(member) as handle:
                            text = io.TextIOWrapper(handle, "utf-8-sig", newline="")
                            rows = []
                            for number, line in enumerate(text):
                                rows.append((path, name[:-4], number, line.rstrip("\r\n")))
                                if len(rows) == 20_000:
                                    yield pd.DataFrame(rows, columns=_LANDED)
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=_LANDED)

    return (spark.read.format("binaryFile").load(pattern).select("path", "content")
            .mapInPandas(unpack, "path string, table_name string, line_no int, line string"))


_LANDED = ["path", "table_name", "line_no", "line"]


def feed_gate(counts: DataFrame) -> DataFrame:
    """Accept or refuse each (feed, snapshot) from (table_name, rows) counts.

    A feed without any row, or without stops, is refused; publishing is writing
    the accepted partitions, so a refused one leaves the previous version alone.
    """
    verdict = counts.groupBy(*KEY).agg(
        F.sum("rows").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("table_name") == "stops", F.col("rows"))), F.lit(0))
        .alias("stop_rows"))
    return verdict.withColumn(
        "reason", F.when(F.col("total_rows") == 0, "EMPTY_FEED")
        .when(F.col("stop_rows") == 0, "NO_STOPS").otherwise("")).withColumn(
        "accepted", F.col("reason") == "")


def accepted_only(df: DataFrame, verdict: DataFrame) -> DataFrame:
    return df.join(verdict.filter("accepted").select(*KEY), KEY, "left_semi")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(feed, snapshot, table_name, rows) for every table, one aggregation each."""
    out = None
    for name in sorted(tables):
        part = tables[name].groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).select(
            *KEY, F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


# Columns the operators read, per table.
TABLES = {
    "agency": ["agency_id", "agency_name", "agency_url", "agency_timezone"],
    "stops": ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "location_type",
              "parent_station", "wheelchair_boarding"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type", "route_color"],
    "trips": ["route_id", "service_id", "trip_id", "trip_headsign", "direction_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence",
                   "pickup_type", "drop_off_type", "stop_headsign"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
                 "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "feed_info": ["feed_publisher_name", "feed_publisher_url", "feed_lang", "feed_start_date",
                  "feed_end_date", "feed_version"],
}


class Feed:
    """The tables of any number of feeds and snapshots, as the operators take them.

    Absent tables read as empty and absent columns as ``''``; further tables
    (fares, shapes, frequencies...) are kept as given.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.given = tables
        self._tables = dict(tables)
        for name, columns in TABLES.items():
            if name in tables:
                extra = [c for c in tables[name].columns if c not in columns and c not in KEY]
                self._tables[name] = with_optional(tables[name], [*columns, *extra])
            else:
                self._tables[name] = spark.createDataFrame(
                    [], ", ".join(f"{c} string" for c in [*KEY, *columns]))

    @classmethod
    def scan(cls, spark: SparkSession, root: str, extra: dict[str, list[str]] | None = None) -> "Feed":
        """Read unpacked feeds below ``root/feed_id=*/snapshot_id=*/``."""
        tables = {name: gtfs_scan(spark, root, columns, f"{name}.txt")
                  for name, columns in {**TABLES, **(extra or {})}.items()}
        return cls(spark, tables)

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return lambda: self._tables[name]

    def tables(self) -> dict[str, DataFrame]:
        return {n: self._tables[n] for n in self.given}

    def zones(self) -> DataFrame:
        """(feed_id, snapshot_id, zone): the zone of the feed's agency."""
        return self._tables["agency"].filter("agency_timezone <> ''").groupBy(*KEY).agg(
            F.min(F.trim("agency_timezone")).alias("zone"))
