"""Exact deduplication by content-defined chunk recipes.

A text, lower-cased in A-Z, is cut where a hash of the last 16 bytes has a given
form, so equal texts are cut alike. Its recipe is the ordered list of its chunks'
identifiers. Texts with equal recipes are equal once the identifiers are verified:
for recipes that occur twice, the bytes of each chunk are moved once per batch and
compared; documents that hold an identifier standing for two different chunks are
compared by their whole text instead. Only recipes travel otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.words import slabs, texts_of
from tramline.session import written

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 512, 11, 1 << 16
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)


def cut_points(data: bytes) -> np.ndarray:
    """Places where the 16-byte window ending there asks for a cut."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint64(step)
    return np.flatnonzero(h >> np.uint64(64 - MEAN_BITS) == 0) + 1


def chunks_of(start: int, end: int, cuts: np.ndarray) -> list[tuple[int, int]]:
    """Chunk ranges of the text ``start:end``; none for an empty text."""
    out, at = [], start
    lo, hi = np.searchsorted(cuts, [start + MIN_CHUNK, end])
    for cut in cuts[lo:hi].tolist():
        while cut - at > MAX_CHUNK:
            out.append((at, at + MAX_CHUNK))
            at += MAX_CHUNK
        if cut - at >= MIN_CHUNK:
            out.append((at, cut))
            at = cut
    while end - at > MAX_CHUNK:
        out.append((at, at + MAX_CHUNK))
        at += MAX_CHUNK
    if at < end:
        out.append((at, end))
    return out


def _chunked(column: pa.Array) -> Iterator[tuple[bytes, list[bytes]]]:
    """Each normalised text with its chunks."""
    texts = texts_of(column)
    for first, last in slabs(texts):
        part = [t.lower() for t in texts[first:last]]
        data = b"".join(part)
        cuts, at = cut_points(data) if data else np.zeros(0, np.int64), 0
        for text in part:
            spans = chunks_of(at, at + len(text), cuts)
            yield text, [data[a:b] for a, b in spans]
            at += len(text)


def _id(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipes, digests = [], []
        for text, chunks in _chunked(batch.column(1)):
            recipes.append([_id(c) for c in chunks])
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(recipes, pa.list_(pa.binary())), pa.array(digests, pa.string())],
            names=["id", "recipe", "text_sha256"])


def _chunk_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different chunk of a batch once, in small output batches."""
    for batch in batches:
        seen, size = set(), 0
        ids, out = [], []
        for _, chunks in _chunked(batch.column(0)):
            for chunk in chunks:
                if chunk not in seen:
                    seen.add(chunk)
                    ids.append(_id(chunk))
                    out.append(chunk)
                    size += len(chunk)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.binary())],
                                                 names=["chunk", "bytes"])
                size, ids, out, seen = 0, [], [], set()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.binary())],
                                             names=["chunk", "bytes"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id stays; rows that repeat that id with the same text
    all count as kept. A null id is never the largest unless all are null. Other
    columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    recipes = written(rows.mapInArrow(_recipes, f"id {kind}, recipe array<binary>, text_sha256 string"),
                      "recipes")
    repeated = recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    suspects = recipes.join(repeated, "recipe", "left_semi").select("id")
    # Rows that share an id with a suspect come along: more is verified, never less.
    moved = rows.join(suspects.distinct(), rows.id.eqNullSafe(suspects.id), "left_semi").select("text")
    variants = moved.mapInArrow(_chunk_bytes, "chunk binary, bytes binary").distinct()
    clashing = written(variants.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "clashes")
    if clashing.isEmpty():
        keyed = recipes.withColumn("text", F.lit(None).cast("string"))
    else:
        keyed = _with_clashing_texts(rows, recipes, clashing)
    groups = keyed.groupBy("recipe", "text").agg(F.max("id").alias("keep_id"),
                                                 F.count(F.lit(1)).alias("group_size"))
    k, g = keyed.alias("k"), groups.alias("g")
    return (k.join(g, (F.col("k.recipe") == F.col("g.recipe"))
                   & F.col("k.text").eqNullSafe(F.col("g.text")))
            .select(F.col("k.id").alias(id_col), "keep_id", "group_size",
                    F.col("k.id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def _with_clashing_texts(rows: DataFrame, recipes: DataFrame, clashing: DataFrame) -> DataFrame:
    """Recipes, with the whole normalised text beside those that use a clashing identifier."""
    hit = (recipes.select("recipe", F.explode("recipe").alias("chunk"))
           .join(clashing, "chunk", "left_semi").select("recipe").distinct())
    marked = recipes.join(hit.withColumn("hit", F.lit(True)), "recipe", "left")
    texts = rows.select("id", F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                          "abcdefghijklmnopqrstuvwxyz").alias("text"))
    texts = texts.withColumn("text_sha256", F.sha2("text", 256)).distinct()
    m, t = marked.alias("m"), texts.alias("t")
    return (m.join(t, F.col("m.hit") & F.col("m.id").eqNullSafe(F.col("t.id"))
                   & (F.col("m.text_sha256") == F.col("t.text_sha256")), "left")
            .select("m.id", "m.recipe", "m.text_sha256", "t.text"))
