"""Corpus cleaning in stages: each reads what its predecessor wrote.

Toxic documents go, then exact copies, near copies, passages repeated across documents;
what is left is packed into training sequences. All stages but the last return the
columns of ``documents``; documents that a stage empties keep their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from tramline.llm.words import text_digest
from tramline.session import shared_path, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _same(a: str, b: str) -> Column:
    """Whether two rows have the same id and the same digest of their text."""
    on = F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    for c in ("h", "g"):
        on = on & (F.col(f"{a}.__{c}") == F.col(f"{b}.{c}"))
    return on


def _digested(docs: DataFrame) -> DataFrame:
    h, g = text_digest("text")
    return docs.withColumns({"__h": h, "__g": g})


def _without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id and text are not those of a row of ``gone`` (doc_id, h, g)."""
    return _digested(docs).alias("d").join(gone.distinct().alias("r"), _same("d", "r"), "left_anti").drop("__h", "__g")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier does not reject; each row by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity.toxicity_scores(docs, labels, digest=True)
    return _without_rows(docs, scores.where("predicted = 1").select("doc_id", "h", "g"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest id and, of rows that repeat it, the
    first by text, then by a hash of the row."""
    groups = exact_dedup.exact_groups(docs)
    # A row's id and text decide whether it is kept; copies of such a row are told apart below.
    marks = written(groups.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                    .where("NOT kept OR n > 1"), "copies")
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                             "abcdefghijklmnopqrstuvwxyz"), 256)
    d = docs.withColumn("__sha", sha).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.__sha") == F.col("r.text_sha256"))
    alone = d.join(marks.alias("r"), same, "left_anti").drop("__sha")
    several = marks.where("kept")
    if several.isEmpty():
        return alone
    order = Window.partitionBy("doc_id", "__sha").orderBy("text", F.xxhash64(*docs.columns))
    one = (d.join(several.alias("r"), same, "left_semi").withColumn("__n", F.row_number().over(order))
           .where("__n = 1").drop("__sha", "__n"))
    return alone.unionByName(one)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the smallest id (null ids last) and, of rows
    that repeat it, the smallest digest. Rows equal in id and text stand or go together;
    ``drop_copies`` has left one of them."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__h").alias("h"), F.col("__g").alias("g"))
    classes = ngram_join.near_duplicates(_digested(docs).select(key.alias("row"), "text"), id_col="row")
    return _without_rows(docs, classes.where("NOT row <=> class_id").select("row.doc_id", "row.h", "row.g"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages that start in a document with a smaller id (null ids last;
    rows that share an id or have none are ordered by the digest of their text). Texts that
    lose nothing stay as they are; the others' words are joined by one space."""
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1")
    if unclear.isEmpty():
        cut = substring_dedup.without_repeats(docs)
    else:
        d = _digested(docs)
        keys = d.select("doc_id", F.col("__h").alias("h"), F.col("__g").alias("g")).distinct()
        places = written(keys.orderBy(F.col("doc_id").isNull(), "doc_id", "h", "g")
                         .withColumn("__place", F.monotonically_increasing_id()), "places")
        placed = d.alias("d").join(places.alias("r"), _same("d", "r")).select(*(f"d.`{c}`" for c in docs.columns), "__place")
        cut = substring_dedup.without_repeats(placed, id_col="__place").drop("__place")
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: Not expressible in SQL (a trained classifier, a packing heuristic); the tests hold
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = shared_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
