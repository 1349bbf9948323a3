"""Service calendars and the instants, windows and reports derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline import KEY
from tramline.functions import times

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


# Days of one word of a service's bitmap.
WORD = 64
_WEEKLY = [sum(1 << i for i in range(r, WORD, 7)) for r in range(7)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def word_of(day: Column) -> Column:
    """The number of the 64-day word a date falls in."""
    return F.floor(F.unix_date(day) / WORD).cast("int")


def bit_of(day: Column) -> Column:
    """The date's place in its word."""
    return F.pmod(F.unix_date(day), F.lit(WORD))


def _one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def day_bit(day: Column) -> Column:
    """The date's bit in its word."""
    return _one_bit(bit_of(day))


def _weekly_bits() -> Column:
    """Days of ``word`` that the weekly pattern and the service's first and last day
    (``lo``, ``hi``, as days since 1970) allow."""
    base = F.col("word") * WORD
    masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in _WEEKLY])
    bits = F.lit(0).cast("bigint")
    for i, name in enumerate(WEEKDAYS):
        # Day 0 of the word has weekday (base + 3) % 7, as 1970 began on a Thursday.
        first = F.pmod(F.lit(i - 3) - base, F.lit(7))
        bits = bits.bitwiseOR(F.when(F.trim(name) == "1", F.get(masks, first)).otherwise(0))
    every = F.lit(-1).cast("bigint")
    since = F.call_function("shiftleft", every, F.greatest(F.col("lo") - base, F.lit(0)))
    until = F.call_function("shiftrightunsigned", every, F.lit(WORD - 1) - F.least(F.col("hi") - base, F.lit(WORD - 1)))
    return bits.bitwiseAND(since).bitwiseAND(until)


def service_words(calendar: DataFrame, calendar_dates: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(feed, snapshot, service_id, word, weekly, active): the days of each service, 64 in a
    word; only words that hold one of ``dates`` (feed, snapshot, service_date), if given.

    The weekly pattern sets bits, exception type 1 sets one, any other type clears one,
    and clearing wins. Everything is or-ed together, so several rows of a service count
    as one; no row stands for a day.
    """
    start, end = times.service_date(F.col("start_date")), times.service_date(F.col("end_date"))
    weekly = (calendar.withColumns({"lo": F.unix_date(start), "hi": F.unix_date(end)}).filter("lo <= hi")
              .withColumn("word", F.explode(F.sequence(word_of(start), word_of(end))))
              .select(*KEY, "service_id", "word", _weekly_bits().alias("weekly"),
                      *[F.lit(0).cast("bigint").alias(c) for c in ("added", "removed")]))
    day, none = times.service_date(F.col("date")), F.lit(0).cast("bigint")
    adds = F.trim("exception_type") == "1"
    exceptions = calendar_dates.filter(day.isNotNull()).select(
        *KEY, "service_id", word_of(day).alias("word"), none.alias("weekly"),
        F.when(adds, day_bit(day)).otherwise(none).alias("added"),
        F.when(adds, none).otherwise(day_bit(day)).alias("removed"))
    words = weekly.unionByName(exceptions)
    if dates is not None:
        asked = dates.select(*KEY, word_of(F.col("service_date")).alias("word")).distinct()
        words = words.join(asked, [*KEY, "word"], "left_semi")
    kept = F.bitwise_not(F.col("removed"))
    return (words.groupBy(*KEY, "service_id", "word")
            .agg(*[F.bit_or(c).alias(c) for c in ("weekly", "added", "removed")])
            .select(*KEY, "service_id", "word", F.col("weekly").bitwiseAND(kept).alias("weekly"),
                    F.col("weekly").bitwiseOR(F.col("added")).bitwiseAND(kept).alias("active"))
            .filter("active <> 0"))


def service_bitmaps(words: DataFrame) -> DataFrame:
    """(feed, snapshot, service_id, service_days): one map of word to bits per service."""
    return words.groupBy(*KEY, "service_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "active"))).alias("service_days"))


def runs_on(service_days: Column, day: Column) -> Column:
    """Whether the bitmap has the date."""
    bits = F.coalesce(F.try_element_at(service_days, word_of(day)), F.lit(0).cast("bigint"))
    return F.getbit(bits, bit_of(day)) == 1


def active_days(words: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(feed, snapshot, service_id, service_date, origin) of every bit, or of those of ``dates``."""
    if dates is not None:
        asked = dates.select(*KEY, "service_date").distinct().withColumn("word", word_of(F.col("service_date")))
        rows = words.join(asked, [*KEY, "word"])
    else:
        rows = words.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).withColumn(
            "service_date", F.date_from_unix_date(F.col("word") * WORD + F.col("place")))
    place = bit_of(F.col("service_date"))
    return rows.filter(F.getbit("active", place) == 1).select(
        *KEY, "service_id", "service_date",
        F.when(F.getbit("weekly", place) == 1, "weekly").otherwise("exception").alias("origin"))


def service_calendar(calendar: DataFrame, calendar_dates: DataFrame,
                     dates: DataFrame | None = None) -> DataFrame:
    """(feed, snapshot, service_id, service_date, origin) of every active day.

    ``dates`` (feed, snapshot, service_date) restricts them to requested days.
    Size: services x days; only the result has a row per day.
    """
    return active_days(service_words(calendar, calendar_dates, dates), dates)


def zoned_days(days: DataFrame, zones: DataFrame) -> DataFrame:
    """Add the zone and the epoch second each service date counts from.

    Resolved once per (feed, date): calls then only add their seconds.
    """
    return days.join(zones, KEY).withColumn(
        "day_start", times.day_start(F.col("service_date"), F.col("zone")))


def candidate_dates(queries: DataFrame, zones: DataFrame) -> DataFrame:
    """Service dates that can hold a call in each query's window.

    From two days before the local start date to the local end date; the two
    days back cover times past 24:00 and past 48:00.
    """
    q = queries.join(zones, KEY)
    end = F.col("at_epoch") + F.col("window_minutes") * 60
    return q.withColumn("service_date", F.explode(F.sequence(
        F.date_sub(times.local_date(F.col("at_epoch"), F.col("zone")), 2),
        times.local_date(end, F.col("zone")))))


def service_day_candidates(instants: DataFrame, zones: DataFrame) -> DataFrame:
    """Yesterday and today as service dates of each instant, with GTFS seconds."""
    q = instants.join(zones, KEY).withColumn(
        "today", times.local_date(F.col("at_epoch"), F.col("zone")))
    rows = q.withColumn("service_date", F.explode(F.array(F.date_sub("today", 1), F.col("today"))))
    secs = (F.col("at_epoch") - F.col("day_start")).cast("int")
    return (rows.withColumn("day_start", times.day_start(F.col("service_date"), F.col("zone")))
            .withColumn("gtfs_seconds", secs)
            .withColumn("gtfs_time", F.when(F.col("gtfs_seconds").between(0, 48 * 3600 - 1),
                                            times.gtfs_time(F.col("gtfs_seconds"))))
            .withColumn("plausible", F.col("gtfs_seconds").between(0, 30 * 3600 - 1))
            .withColumn("after_midnight", F.col("gtfs_seconds") >= times.DAY)
            .drop("today"))


def coverage(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """First and last service date of each (feed, snapshot)."""
    spans = calendar.select(
        *KEY, times.service_date(F.col("start_date")).alias("first"),
        times.service_date(F.col("end_date")).alias("last")).unionByName(
        calendar_dates.select(*KEY, times.service_date(F.col("date")).alias("first"),
                              times.service_date(F.col("date")).alias("last")))
    return spans.groupBy(*KEY).agg(F.min("first").alias("service_start"),
                                   F.max("last").alias("service_end"))


def feed_coverage(calendar: DataFrame, calendar_dates: DataFrame, as_of: DataFrame,
                  feed_info: DataFrame | None = None) -> DataFrame:
    """Coverage, days remaining, expiry flags, as of ``as_of`` (feed, snapshot, today).

    ``today`` is a date in the agency's zone, given by the caller.
    """
    out = as_of.join(coverage(calendar, calendar_dates), KEY, "left")
    days = F.datediff("service_end", "today")
    out = (out.withColumn("days_remaining", days)
           .withColumn("expired", F.coalesce(F.col("days_remaining") < 0, F.lit(False)))
           .withColumn("warn", F.coalesce(F.col("days_remaining") < 7, F.lit(False))))
    if feed_info is not None:
        info = feed_info.groupBy(*KEY).agg(F.min("feed_version").alias("feed_version"),
                                           F.max("feed_end_date").alias("feed_end_date"))
        out = out.join(info, KEY, "left")
    return out


def late_night(stop_times: DataFrame, trips: DataFrame, threshold: str = "24:00:00",
               limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Calls at or past ``threshold``: per-feed totals, and all of them; with ``limit``
    the latest ones, ranked.

    Compared on parsed seconds, so unpadded values are ranked rightly.
    """
    from pyspark.sql import Window

    secs = times.gtfs_seconds(F.col("departure_time"))
    floor = times.gtfs_seconds(F.lit(threshold))
    calls = (stop_times.select(*KEY, "trip_id", "stop_id", "departure_time", "stop_sequence",
                               secs.alias("seconds"))
             .filter(F.col("seconds") >= floor)
             .join(trips.select(*KEY, "trip_id", "route_id", "service_id"), [*KEY, "trip_id"]))
    totals = (calls.groupBy(*KEY, "trip_id")
              .agg(F.count(F.lit(1)).alias("n"), F.max("seconds").alias("latest"))
              .groupBy(*KEY).agg(F.sum("n").alias("total_calls"),
                                 F.max("latest").alias("max_seconds"),
                                 F.count(F.lit(1)).alias("distinct_trips"))
              .withColumn("max_time", times.gtfs_time(F.col("max_seconds"))))
    if limit is None:
        return totals, calls
    order = Window.partitionBy(*KEY).orderBy(
        F.desc("seconds"), "trip_id", "stop_sequence", "stop_id", "departure_time")
    top = calls.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return totals, top
