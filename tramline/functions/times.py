"""GTFS time and service-day arithmetic as column expressions.

A GTFS time counts seconds from noon minus twelve hours of its service date,
in the agency's zone; it may exceed 24 hours. It stays an INT until a service
date resolves it to an instant. Instants are epoch seconds (BIGINT).
The session zone must be UTC (``tramline.session.configure``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
HALF_DAY = 43_200


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it.

    Column expressions are inlined wherever they are named, and grow past what the JVM
    compiles; the variable of a one-element transform is not.
    """
    return F.transform(F.array(value), body)[0]


def gtfs_seconds(value: Column) -> Column:
    """``H+:MM:SS`` to INT seconds; NULL when it is not three whole numbers."""
    def total(parts: Column) -> Column:
        secs = F.try_multiply(parts[0], F.lit(3600)) + parts[1] * 60 + parts[2]
        return F.when((F.size(parts) == 3) & (F.array_min(parts) >= 0), secs.try_cast("int"))

    return bound(F.split(value, ":").try_cast("array<bigint>"), total)


def _two_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(number < 10, F.concat(F.lit("0"), text)).otherwise(text)


def gtfs_time(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS``, hours padded to two digits and not wrapped."""
    s = seconds.cast("int")
    hours, rest = F.floor(s / 3600).cast("int"), F.pmod(s, F.lit(3600))
    return F.concat(_two_digits(hours), F.lit(":"), _two_digits(F.floor(rest / 60).cast("int")),
                    F.lit(":"), _two_digits(F.pmod(s, F.lit(60))))


def service_date(value: Column) -> Column:
    return F.try_to_date(F.trim(value), "yyyyMMdd")


def day_start(day: Column, zone: Column) -> Column:
    """Epoch second a service date counts from: local noon minus 12 hours."""
    noon = F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL 12 HOURS"), zone)
    return F.unix_seconds(noon) - HALF_DAY


def midnight(day: Column, zone: Column) -> Column:
    """Epoch second of local midnight (differs from `day_start` on DST days)."""
    return F.unix_seconds(F.to_utc_timestamp(day.cast("timestamp"), zone))


def local_clock(epoch: Column, zone: Column) -> Column:
    """Wall clock in ``zone``, held in a UTC timestamp for formatting."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)


def local_date(epoch: Column, zone: Column) -> Column:
    return F.to_date(local_clock(epoch, zone))


def local_iso(epoch: Column, zone: Column) -> Column:
    """``2026-11-01T01:30:00-05:00``; the offset tells the repeated hour apart."""
    def text(clocks: Column) -> Column:
        wall = clocks["wall"]
        offset = (F.unix_seconds(wall) - clocks["epoch"]).cast("int")
        size = F.abs(offset)
        return F.concat(
            F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(offset < 0, "-").otherwise("+"),
            _two_digits(F.floor(size / 3600).cast("int")), F.lit(":"),
            _two_digits(F.floor(F.pmod(size, F.lit(3600)) / 60).cast("int")),
        )

    return bound(F.struct(local_clock(epoch, zone).alias("wall"), epoch.alias("epoch")), text)


def local_hhmm(epoch: Column, zone: Column) -> Column:
    return F.date_format(local_clock(epoch, zone), "HH:mm")
