"""Fare and holiday tables printed on web pages, as typed rows.

Input is one row per printed table row: a source (page) key, ``row_no``, and ``cells``, a
map of column heading to text. Headings differ from page to page, so each field is looked
for under several; the first that is not empty counts. Rows that cannot be read are kept,
with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import text as tx

# ------------------------------------------------------------ fixed values --
# Headings of each field, the preferred first.
LABEL = ["label", "fare_type", "product", "pass", "name", "item", "description", "fare"]
CATEGORY = ["category", "rider", "rider_category", "rider_type", "type", "group"]
MODE = ["mode", "service", "system", "vehicle", "agency"]
PRICE = ["price", "price_usd", "amount", "cost", "fare_price", "value", "fare"]
NOTES = ["notes", "note", "detail", "details", "conditions", "footnote"]
HOLIDAY = ["holiday", "name", "holiday_name", "occasion", "event", "day"]
DAY = ["date", "observed", "observed_date", "when", "day_of"]
# Headings of the service of each mode; a caller adds its systems' own names.
SERVICES = {"bus": ["bus", "bus_service", "bus_schedule"], "rail": ["rail", "train", "light_rail", "rail_service"],
            "paratransit": ["paratransit", "van"]}
# ----------------------------------------------------------------------------


def headings(cells: Column) -> Column:
    """The map with headings lower-cased, other characters than letters and digits as one
    underscore; of headings that become equal the last counts."""
    def plain(k: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), F.lit("_"))

    entries = F.transform(F.map_entries(cells), lambda e: F.struct(plain(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.array_distinct(F.transform(entries, lambda e: F.struct(
        e["key"].alias("key"), F.element_at(F.filter(entries, lambda o: o["key"] == e["key"]), -1)["value"].alias("value")))))


def first_of(cells: Column, names: list[str]) -> Column:
    """The first of the fields that is not blank, trimmed; else ''."""
    blank = F.lit("")
    return F.coalesce(*[F.nullif(F.trim(F.replace(F.try_element_at(cells, F.lit(n)), F.lit(tx.NO_BREAK_SPACE), F.lit(" "))), blank)
                        for n in names], blank)


def dollars(cents: Column) -> Column:
    """250 to ``$2.50``."""
    return F.concat(F.lit("$"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def fare_rows(rows: DataFrame, source: str = "page_key") -> DataFrame:
    """(source, row_no, fare_id, mode, category, label, price_cents, price,
    price_as_published, notes, reason) of every printed fare.

    ``price`` is made from the cents, so the two cannot differ. A row without a price, or
    with one that is not a single amount, has a reason and no cents or id. ``fare_id`` is
    made of mode, category and label, and unique in its source: repeats are numbered in
    row order.
    """
    cells = headings(F.col("cells"))
    fields = {n: first_of(F.col("__cells"), keys) for n, keys in (
        ("mode", MODE), ("category", CATEGORY), ("label", LABEL), ("price_as_published", PRICE), ("notes", NOTES))}
    out = rows.select(source, "row_no", cells.alias("__cells")).withColumns(fields).drop("__cells")
    out = out.withColumn("p", tx.price_cell(F.col("price_as_published")))
    reason = F.when(F.col("price_as_published") == "", "NO_PRICE").otherwise(F.col("p.problem"))
    out = out.withColumns({"reason": F.nullif(reason, F.lit("")), "price_cents": F.col("p.cents")}).drop("p")
    cents = F.when(F.col("reason").isNull(), F.col("price_cents"))
    slug = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "mode", "category", "label")), "[^a-z0-9]+", "-"), F.lit("-"))
    out = out.withColumns({"price_cents": cents, "slug": F.when(F.col("reason").isNull(), slug)})
    turn = F.row_number().over(Window.partitionBy(source, "slug").orderBy("row_no", "price_cents", "price_as_published", "notes"))
    fare_id = F.when(turn == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), turn.cast("string")))
    return out.withColumn("fare_id", fare_id).select(
        source, "row_no", "fare_id", "mode", "category", "label", "price_cents", dollars(F.col("price_cents")).alias("price"),
        "price_as_published", "notes", "reason")


def holiday_rows(rows: DataFrame, year: int, source: str = "page_key", services: dict[str, list[str]] = SERVICES) -> DataFrame:
    """(source, row_no, name, date_as_published, date, weekday, mode, published,
    service_type, modes_differ, reason): one row per printed holiday and mode.

    Modes are never merged, even where they agree; ``modes_differ`` says that bus and rail
    have different services that day. A row whose date is unreadable or belongs to another
    year, or that names no service, has one row with a reason and no mode.
    """
    cells = headings(F.col("cells"))
    out = rows.select(source, "row_no", cells.alias("__cells"))
    named = {m: first_of(F.col("__cells"), keys) for m, keys in services.items()}
    out = out.withColumns({"name": first_of(F.col("__cells"), HOLIDAY), "date_as_published": first_of(F.col("__cells"), DAY), **named})
    day = tx.holiday_date(F.col("date_as_published"), F.lit(year))
    found = F.filter(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("published"), tx.service_type(F.col(m)).alias("service_type"))
                               for m in services]), lambda s: s["published"] != "")
    out = out.withColumns({"date": day, "found": found})
    reason = (F.when(F.col("date").isNull(), "DATE_UNREADABLE").when(F.year("date") != year, "OTHER_YEAR")
              .when(F.size("found") == 0, "NO_SERVICE_NAMED"))
    bus, rail = (tx.service_type(F.col(m)) for m in ("bus", "rail"))
    out = out.withColumns({"reason": reason, "modes_differ": (F.col("bus") != "") & (F.col("rail") != "") & (bus != rail)})
    shown = F.when(F.col("reason").isNull(), F.col("found"))
    return out.select(source, "row_no", "name", "date_as_published", "date", F.date_format("date", "EEEE").alias("weekday"),
                      F.explode_outer(shown).alias("s"), "modes_differ", "reason").select(
        source, "row_no", "name", "date_as_published", "date", "weekday", "s.mode", "s.published", "s.service_type",
        "modes_differ", "reason")


def modes_missing(holidays: DataFrame, source: str = "page_key") -> DataFrame:
    """(source, missing): sources that name a bus service but never rail, or the other way."""
    have = holidays.groupBy(source).agg(F.bool_or(F.col("mode") == "bus").alias("bus"), F.bool_or(F.col("mode") == "rail").alias("rail"))
    return have.filter("bus <> rail").select(source, F.when(F.col("bus"), "rail").otherwise("bus").alias("missing"))
