"""Page text and the facts printed in it, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------ fixed values --
# Elements dropped whole, and site chrome dropped from the main content.
DROP_TAGS = ["script", "style", "noscript", "svg", "head", "template", "iframe", "object", "canvas"]
CHROME_TAGS = ["nav", "aside", "footer"]
# Inline elements do not start a new line.
INLINE_TAGS = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em",
               "font", "i", "img", "ins", "kbd", "mark", "nobr", "q", "s", "samp", "small", "span",
               "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"]
# Shapes that change without the page changing, with what they become.
NOISE = [
    (r"(?i)[?&](?:v|ver|version|cb|cache|rev|nocache|_|t|ts)=[A-Za-z0-9._%-]+", ""),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[nonce]"),
    (r"\b[0-9a-fA-F]{16,}\b", "[nonce]"),
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?"
     r"(?:Z|[+-][0-9]{2}:?[0-9]{2})?\b", "[timestamp]"),
    (r"\b1[0-9]{12}\b", "[timestamp]"),
]
OPAQUE_TOKEN = (r"\b(?=[A-Za-z0-9_-]*[A-Za-z])(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{24,}\b",
                "[nonce]")
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff]"
NO_BREAK_SPACE = "\u00a0"
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
            ("&amp;", "&")]
MONEY = r"\$[ \t]*(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{1,2})?"
PRICE_CELL = r"^\$?[ \t]*([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.([0-9]+))?$"
FREE_WORDS = ["free", "no charge", "no fare", "0", "n/a"]
FREE_CELL = r"(?i)^\s*(free|no charge|no cost|n/?a)\s*$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATE_ISO = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
DATE_WORDS = (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+([0-9]{1,2})"
              r"(?:st|nd|rd|th)?(?:\s*,\s*([0-9]{4}))?")
DATE_SLASH = r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4})\b"
SERVICE_PHRASE = (r"(?i)\b(sunday|saturday|weekday|weekend|holiday|regular|normal|modified|no)\s+"
                  r"(schedule|service)\b")
BUS = r"(?i)\b(metro\s*bus|buses|bus)\b"
RAIL = r"(?i)\b(metro\s*link|light\s*rail|rail|train)\b"
SERVICE_TYPES = [("no service", "no_service"), ("holiday", "holiday"), ("weekend", "weekend"),
                 ("sunday", "sunday"), ("saturday", "saturday"), ("weekday", "weekday"),
                 ("regular", "regular"), ("normal", "regular"), ("modified", "modified"),
                 ("reduced", "reduced")]
# Schedule ids in URLs, most explicit first; the last two only count in PDF links.
PICKS = [
    ("pick_query", r"(?i)[?&]pick(?:[_-]?id)?=([A-Za-z0-9._-]+)", False),
    ("pick_path", r"(?i)/pick(?:[_-]?id)?[/=-]([A-Za-z0-9._-]+)", False),
    ("schedule_path", r"(?i)/(?:schedules?|timetables?|pdfs?)/([A-Za-z0-9._-]+)/[^/]+\.pdf", True),
    ("dated_filename", r"(?i)(20[0-9]{2}[-_]?(?:0[1-9]|1[0-2])[-_]?[0-3][0-9])", True),
]
URL_ATTRIBUTE = r"(?i)\b(?:href|src|data-href|data-url|data-file)\s*=\s*[\"']([^\"']+)[\"']"
URL_IN_TEXT = r"(?i)https?://[^\s\"'<>)]+"
# ----------------------------------------------------------------------------


def _whole(tags: list[str]) -> str:
    return "(?is)" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in tags)


def strip_markup(html: Column, chrome: bool = True) -> Column:
    """HTML to text with one line per block element; entities decoded."""
    dropped = DROP_TAGS + CHROME_TAGS if chrome else DROP_TAGS
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, _whole(dropped), "\n")
    out = F.regexp_replace(out, rf"(?is)</?(?:{'|'.join(INLINE_TAGS)})\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "\n")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit(NO_BREAK_SPACE), F.lit(" "))


def scrub(text: Column) -> Column:
    """Mask noise, collapse blanks, drop empty lines."""
    out = F.regexp_replace(text, ZERO_WIDTH, "")
    for pattern, mask in [*NOISE, OPAQUE_TOKEN]:
        out = F.regexp_replace(out, pattern, mask)
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(out, r" ?(?:\n ?)+", "\n"), F.lit(" \n"))


def content_region(html: Column) -> Column:
    """(strategy, html) of the main element, the only article, or the body."""
    def element(tag: str) -> Column:
        return F.regexp_extract(html, rf"(?is)<{tag}\b.*</{tag}\s*>", 0)

    one_article = F.regexp_count(html, F.lit(r"(?i)<article\b")) == 1
    main, article, body = element("main"), element("article"), element("body")
    return F.when(main != "", F.struct(F.lit("main_element").alias("strategy"), main.alias("html"))) \
        .when(one_article & (article != ""),
              F.struct(F.lit("single_article").alias("strategy"), article.alias("html"))) \
        .when(body != "", F.struct(F.lit("body").alias("strategy"), body.alias("html"))) \
        .otherwise(F.struct(F.lit("whole_document").alias("strategy"), html.alias("html")))


def nfkc(text: Column) -> Column:
    """Compatibility normalisation and full entity decoding, in Arrow batches.

    Spark has no built-in for either; everything else stays in the JVM.
    """
    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        import html
        import unicodedata
        return values.map(lambda v: v if v is None
                          else unicodedata.normalize("NFKC", html.unescape(v)))

    return fold(text)


def amount_cents(mention: Column) -> Column:
    """A matched price mention to BIGINT cents, through DECIMAL."""
    digits = F.regexp_replace(mention, r"[$, \t]", "")
    return (digits.try_cast("decimal(18,2)") * 100).cast("bigint")


def price_cell(cell: Column) -> Column:
    """A whole price cell as (cents, problem); free words are 0 cents.

    More than two decimals is refused, not rounded.
    """
    text = F.trim(F.replace(cell, F.lit(NO_BREAK_SPACE), F.lit(" ")))
    matches = text.rlike(PRICE_CELL)
    decimals = F.length(F.regexp_extract(text, PRICE_CELL, 2))
    free = F.lower(text).isin(FREE_WORDS)
    return F.struct(
        F.when(free, F.lit(0).cast("bigint")).when(matches & (decimals <= 2), amount_cents(text))
        .alias("cents"),
        F.when(free, "").when(~matches, "NOT_A_PRICE").when(decimals > 2, "TOO_MANY_DECIMALS")
        .otherwise("").alias("problem"))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"),
                    F.lpad(day, 2, "0"))


def _month_number(word: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, str(i))])
    return numbers[F.lower(F.substring(word, 1, 3))]


def printed_date(text: Column) -> Column:
    """First ISO, worded or slashed date as ``yyyy-mm-dd`` text; NULL without a year."""
    iso = F.regexp_extract(text, DATE_ISO, 0)
    wy, wm, wd = (F.regexp_extract(text, DATE_WORDS, i) for i in (3, 1, 2))
    sm, sd, sy = (F.regexp_extract(text, DATE_SLASH, i) for i in (1, 2, 3))
    year = F.when(sy.try_cast("int") < 100, (sy.try_cast("int") + 2000).cast("string")).otherwise(sy)
    return F.when(iso != "", iso).when(wy != "", _iso(wy, _month_number(wm), wd)) \
        .when(sy != "", _iso(year, sm, sd))


def holiday_date(text: Column, year: Column) -> Column:
    """A printed holiday date; a missing year is taken from ``year``. Bad dates are NULL."""
    t = F.trim(text)
    compact = F.when(t.rlike(r"^[0-9]{8}$"), F.concat_ws(
        "-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    short = r"^([0-9]{1,2})/([0-9]{1,2})$"
    slash = F.when(t.rlike(short), _iso(year.cast("string"), F.regexp_extract(t, short, 1),
                                        F.regexp_extract(t, short, 2)))
    wm, wd = F.regexp_extract(t, DATE_WORDS, 1), F.regexp_extract(t, DATE_WORDS, 2)
    worded = F.when(wm != "", _iso(year.cast("string"), _month_number(wm), wd))
    return F.try_to_date(F.coalesce(printed_date(t), compact, slash, worded), "yyyy-MM-dd")


def service_type(text: Column) -> Column:
    """Published service wording to a token; unknown wording is not guessed."""
    low = F.lower(F.trim(text))
    out = F.lit("unrecognised")
    for needle, token in reversed(SERVICE_TYPES):
        out = F.when(F.contains(low, F.lit(needle)), token).otherwise(out)
    return F.when(low == "", "unknown").otherwise(out)


def mode_of(text: Column) -> Column:
    """'bus' or 'rail' when only that one is named; never merged or guessed."""
    bus, rail = text.rlike(BUS), text.rlike(RAIL)
    return F.when(rail & ~bus, "rail").when(bus & ~rail, "bus")
