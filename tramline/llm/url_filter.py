"""URL verdicts from a blocked Bloom filter and an exact hash join.

Listed canonical URLs are of two kinds: rules (a host and the beginning of a path, for
the host and its subdomains) and single pages (host and whole path). A URL asks for a
key of each shape that the rules have (so many host labels, so long a path beginning)
and for its own; the filter passes the possible hits, and the join by key drops the
false ones. The longest rule decides, else a listed page is blocked, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.bloom import BlockedBloom

BROADCAST_KEYS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next slash, question mark or hash, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The different (host labels, path length) of the rules; a handful in practice."""
    return [tuple(r) for r in rules.select(F.size(F.split("host", r"\.")), F.char_length("path")).distinct()
            .sort(F.size(F.split("host", r"\.")), F.char_length("path")).collect()]


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per input row: id_col, host, path, rule, verdict.

    ``rules``: host, path, verdict (block or allow); of rules given twice the first by
    verdict counts. ``listed``: host, path of blocked pages. A rule fits its host and
    subdomains if the path starts with its path; the longest (host and path together,
    then the longer host) wins. ``rule`` is its host and path, null if none fits. A null
    URL, or one without ``://``, has an empty host and path. Repeated rows stay; other
    columns are not read.
    """
    rules = (rules.select(F.concat("host", "path").alias("key"), "verdict", F.char_length("host").alias("hosted"))
             .groupBy("key").agg(F.min("verdict").alias("verdict"), F.max("hosted").alias("hosted"))
             .withColumn("is_rule", F.lit(True)))
    shapes = rule_shapes(rules.select(F.expr("substring(key, 1, hosted)").alias("host"),
                                      F.expr("substring(key, hosted + 1)").alias("path")))
    keys = rules
    if listed is not None:
        keys = keys.unionByName(listed.select(
            F.concat("host", "path").alias("key"), F.lit("block").alias("verdict"),
            F.char_length("host").alias("hosted"), F.lit(False).alias("is_rule")).distinct())
    bloom = BlockedBloom(keys, "key")
    n_keys = keys.count()
    url = F.col(url_col)
    # Rows with the same outcome are judged once and given back as often as they came.
    rows = (pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
            .groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("copies")))
    labels = F.split("host", r"\.")
    asked = [F.struct(F.concat("host", "path").alias("key"), F.lit(False).alias("as_rule"))]
    for n, length in shapes:
        fits = (F.size(labels) >= n) & (F.char_length("path") >= length)
        suffix = F.array_join(F.slice(labels, -n, n), ".")
        asked.append(F.when(fits, F.struct(F.concat(suffix, F.expr(f"substring(path, 1, {length})")).alias("key"),
                                           F.lit(True).alias("as_rule"))))
    asked_rows = rows.withColumn("ask", F.explode(F.array_compact(F.array(*asked)))).select(
        "id", "host", "path", "copies", "ask.*")
    # The row's own key stays, whatever the filter says, and so keeps the row.
    possible = (bloom.mark(asked_rows, "key", "maybe").where("maybe OR NOT as_rule")
                .withColumn("key", F.when(F.col("maybe"), F.col("key"))).drop("maybe"))
    k = keys.withColumnRenamed("key", "listed_key")
    joined = possible.join(F.broadcast(k) if n_keys <= BROADCAST_KEYS else k,
                           (F.col("key") == F.col("listed_key")) & (F.col("as_rule") == F.col("is_rule")), "left")
    hit = F.when(F.col("listed_key").isNotNull(), F.struct(
        F.char_length("listed_key").alias("length"), "hosted", F.col("listed_key").alias("rule"), "verdict"))
    return (joined.groupBy("id", "host", "path", "copies")
            .agg(F.max(F.when(F.col("as_rule"), hit)).alias("by_rule"),
                 F.bool_or(~F.col("as_rule") & F.col("listed_key").isNotNull()).alias("is_listed"))
            .select(F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"), "*")
            .select(F.col("id").alias(id_col), "host", "path", F.col("by_rule.rule").alias("rule"),
                    F.coalesce("by_rule.verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
                    .alias("verdict")))
