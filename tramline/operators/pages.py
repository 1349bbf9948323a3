"""Web page captures: stable text, drift between captures, facts on the page."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import text as tx
from tramline.session import written

SEVERITY_RANK = {"alarming": 0, "notable": 1, "routine": 2}


def robots(html) -> Column:
    """The robots directives of a page, in lower case, joined; attributes in any order."""
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    named = F.filter(metas, lambda m: m.rlike(r"(?i)\bname\s*=\s*[\"']?(?:robots|googlebot)[\"'\s/>]"))
    quoted = r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    return F.lower(F.array_join(F.transform(named, lambda m: F.concat(
        *[F.regexp_extract(m, quoted, i) for i in (1, 2, 3)])), ", "))


def normalize_pages(captures: DataFrame, fold: bool = False) -> DataFrame:
    """Text, hash and measures of (page_key, fetched_epoch, html) captures.

    The hash covers the main content only; ``+chrome_kept`` in the strategy says that
    leaving site chrome out would have left nothing. ``fold`` adds compatibility folding
    and full entity decoding, which need Python.
    """
    region = captures.withColumn("region", tx.content_region(F.col("html")))
    stripped = tx.strip_markup(F.col("region.html"))
    if fold:
        stripped = tx.nfkc(stripped)
    rows = region.withColumn("text", tx.scrub(stripped))
    kept = tx.strip_markup(F.col("region.html"), chrome=False)
    bare = F.col("text") == ""
    rows = rows.withColumns({"text": F.when(bare, tx.scrub(kept)).otherwise(F.col("text")), "strategy": F.concat(
        F.col("region.strategy"), F.when(bare, "+chrome_kept").otherwise("")), "robots": robots("html")})
    said = F.col("robots")
    empty = F.col("text") == ""
    raw, size = F.octet_length("html"), F.octet_length("text")
    return rows.withColumns({
        "content_hash": F.sha2(F.col("text").cast("binary"), 256),
        "bytes_raw": raw, "bytes_text": size,
        "signal_ratio": F.round(size / F.nullif(raw, F.lit(0)), 4),
        "word_count": F.when(empty, 0).otherwise(F.size(F.split("text", r"[ \n]+"))),
        "line_count": F.when(empty, 0).otherwise(F.size(F.split("text", "\n"))),
        "noarchive": F.contains(said, F.lit("noarchive")),
        "nosnippet": F.contains(said, F.lit("nosnippet")),
        "noindex": F.contains(said, F.lit("noindex")),
    }).drop("region", "robots")


def newest_two(captures: DataFrame) -> DataFrame:
    """One row per page: newest and previous capture, and how many there are.

    Captures of one second are told apart by their content, the larger hash first. The
    rank filter runs before the shuffle, so a page with very many captures sends two
    rows per task.
    """
    order = Window.partitionBy("page_key").orderBy(F.desc("fetched_epoch"), F.desc("content_hash"))
    fields = [c for c in captures.columns if c not in ("page_key", "html")]
    top = captures.drop("html").withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    pair = top.groupBy("page_key").agg(*[
        F.max(F.when(F.col("rank") == r, F.struct(*fields))).alias(n)
        for r, n in ((1, "now"), (2, "before"))])
    counts = captures.groupBy("page_key").agg(F.count(F.lit(1)).alias("captures"))
    return pair.join(counts, "page_key")


def page_drift(expected: DataFrame, captures: DataFrame) -> DataFrame:
    """Status of every expected page: (page_key, severity) against its captures.

    ``captures`` has page_key, fetched_epoch, content_hash and extraction_ok.
    """
    rows = expected.join(newest_two(captures), "page_key", "left")
    changed = F.coalesce(F.col("now.content_hash") != F.col("before.content_hash"), F.lit(False))
    status = (F.when(F.col("now").isNull(), "never_captured")
              .when(~F.coalesce("now.extraction_ok", F.lit(False)), "extraction_failed")
              .when(changed, "changed").when(F.col("before").isNull(), "single_capture")
              .otherwise("unchanged"))
    rank = F.lit(9)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    return rows.select(
        "page_key", "severity", rank.cast("int").alias("severity_rank"), status.alias("status"),
        changed.alias("changed"), F.coalesce("captures", F.lit(0)).alias("captures"),
        F.col("now.content_hash").alias("current_hash"),
        F.col("before.content_hash").alias("previous_hash"),
        F.col("now.fetched_epoch").alias("last_fetched"))


def line_delta(captures: DataFrame) -> DataFrame:
    """Lines added and removed between a page's two newest captures, as bags."""
    both = newest_two(captures.select("page_key", "fetched_epoch", "content_hash", "text")) \
        .filter(F.col("now.content_hash") != F.col("before.content_hash"))
    sides = F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), F.col("now.text").alias("text")),
        F.struct(F.lit(-1).alias("sign"), F.col("before.text").alias("text"))))
    lines = both.select("page_key", sides.alias("s")).select(
        "page_key", "s.sign", F.explode(F.split("s.text", "\n")).alias("line"))
    net = lines.groupBy("page_key", "line").agg(F.sum("sign").alias("net"))
    return net.filter("net <> 0").groupBy("page_key").agg(
        F.sum(F.greatest("net", F.lit(0))).alias("lines_added"),
        F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("lines_removed"))


def field_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Extracted fields that differ: (page_key, path, value) on both sides."""
    a = before.select("page_key", "path", F.col("value").alias("value_a"))
    b = after.select("page_key", "path", F.col("value").alias("value_b"))
    return a.join(b, ["page_key", "path"], "full_outer").filter(
        ~F.col("value_a").eqNullSafe(F.col("value_b"))).withColumn(
        "status", F.when(F.col("value_a").isNull(), "added")
        .when(F.col("value_b").isNull(), "removed").otherwise("changed"))


def json_fields(rows: DataFrame) -> DataFrame:
    """(page_key, path, value) of every scalar in the JSON text ``record`` of each page.

    Records may nest to any depth: each round opens one level of what is left as
    VARIANT, so the number of rounds is the depth of the deepest record. Paths are dotted
    (``a.b[0].c``); nulls and records that are not JSON give no row.
    """
    level = rows.select("page_key", F.lit("").alias("path"), F.try_parse_json("record").alias("node")).filter("node IS NOT NULL")
    out = None
    while True:
        kind = F.schema_of_variant("node")
        level = written(level.select("page_key", "path", "node", kind.alias("kind")), "json-level")
        leaves = level.filter(~F.col("kind").rlike("^(OBJECT|ARRAY)<") & (F.col("kind") != "VOID")).select(
            "page_key", "path", F.try_variant_get("node", "$", "string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.filter(F.col("kind").rlike("^(OBJECT|ARRAY)<"))
        if inner.isEmpty():
            return out
        step = (F.when(F.col("key").isNull(), F.format_string("%s[%d]", "path", "pos"))
                .when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key")))
        inner.createOrReplaceTempView(view := f"json_level_{uuid.uuid4().hex}")
        opened = rows.sparkSession.sql(f"SELECT page_key, path, e.* FROM {view}, LATERAL variant_explode_outer(node) e")
        level = opened.filter("value IS NOT NULL").select("page_key", step.alias("path"), F.col("value").alias("node"))
        rows.sparkSession.catalog.dropTempView(view)


def record_delta(captures: DataFrame) -> DataFrame:
    """Fields that differ between the records of a page's two newest captures.

    ``captures`` has page_key, fetched_epoch, content_hash and record, a JSON text of any
    depth. A page captured once has nothing to compare.
    """
    both = newest_two(captures.select("page_key", "fetched_epoch", "content_hash", "record")).filter("before IS NOT NULL")
    before, now = (json_fields(both.select("page_key", f"{side}.record")) for side in ("before", "now"))
    return field_delta(before, now)


def page_facts(pages: DataFrame) -> DataFrame:
    """Prices, dates and service phrases per text line of (page_key, text)."""
    lines = pages.select("page_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    mentions = F.regexp_extract_all("line", F.lit(tx.MONEY), F.lit(0))
    cents = F.transform(mentions, lambda m: tx.amount_cents(m).cast("string"))
    free = F.col("line").rlike(tx.FREE_CELL)
    phrase = F.lower(F.regexp_replace(F.regexp_extract("line", tx.SERVICE_PHRASE, 0), r"\s+", " "))
    rows = lines.select(
        "page_key", "line_no",
        F.when(F.size(cents) > 0, F.array_join(cents, "|")).when(free, "0").alias("cents"),
        (F.size(cents) > 1).alias("is_range"),
        tx.printed_date(F.col("line")).alias("date_iso"),
        F.when(phrase != "", phrase).alias("phrase"),
        F.when(phrase != "", tx.service_type(phrase)).alias("service_type"),
        tx.mode_of(F.col("line")).alias("mode"))
    return rows.filter(F.coalesce("cents", "date_iso", "phrase").isNotNull())


def schedule_ids(pages: DataFrame) -> DataFrame:
    """Schedule ids in a page's URLs; the first matching pattern of each URL wins."""
    urls = F.array_distinct(F.array_union(
        F.regexp_extract_all("html", F.lit(tx.URL_ATTRIBUTE), F.lit(1)),
        F.regexp_extract_all("html", F.lit(tx.URL_IN_TEXT), F.lit(0))))
    rows = pages.select("page_key", F.explode(urls).alias("url")).filter(
        ~F.col("url").rlike(r"^(#|javascript:|mailto:|tel:)"))
    is_pdf = F.contains(F.lower("url"), F.lit(".pdf"))
    found = F.lit(None)
    for name, pattern, pdf_only in reversed(tx.PICKS):
        value = F.regexp_extract("url", pattern, 1)
        cond = (value != "") & is_pdf if pdf_only else value != ""
        found = F.when(cond, F.struct(F.lit(name).alias("strategy"), value.alias("schedule_id"))) \
            .otherwise(found)
    return (rows.withColumn("f", found).filter(F.col("f").isNotNull())
            .groupBy("page_key", "f.schedule_id").agg(
                F.min("f.strategy").alias("strategy"), F.count(F.lit(1)).alias("url_count")))
