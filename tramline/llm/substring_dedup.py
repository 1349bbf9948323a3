"""Substring deduplication by prefix-partitioned suffix trees over words.

A repeat of ``width`` words or more is an internal node of depth ``width`` or more in
the suffix tree of all texts, cut at that depth. The suffixes are split before any
tree is built: each is keyed by its prefix up to the end of the smallest gram within
its first ``width`` words, a prefix whose length the content decides, so equal
suffixes meet and the groups stay small; suffixes with a common last gram go to one
bucket of bounded size. A suffix whose gram starts in one document only hangs from
the top of the tree as a leaf and is never moved. In each bucket the suffixes are
sorted into their subtrees; a node of depth ``width`` that holds several documents
gives its smallest document, and every other suffix below it is a repeat. Runs of
such suffixes are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.words import Words, slabs, texts_of, windows
from tramline.session import written

WIDTH = 50
BUCKET_SUFFIXES = 1 << 20
SLAB = 4 << 20


def smallest_grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each suffix of at least ``width`` words, the smallest gram of its first ``width``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    gram = width // 2 + 1
    low, span = windows(hashes, gram).view(np.int64), width - gram + 1
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[span - size:span - size + n])


def _grams(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for first, last in slabs(texts):
                w = Words(texts[first:last])
                h = w.hashes()
                found = [np.unique(smallest_grams(h[a:b], width)) for a, b in zip(w.bounds, w.bounds[1:])]
                rows = np.repeat(np.arange(first, last), [len(g) for g in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), batch.column(0).take(pa.array(rows))], names=["gram", "id"])
    return run


def tree_minima(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> np.ndarray:
    """For each suffix, the smallest document in its node; a node is one value of ``keys``."""
    order = np.lexsort((docs, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        ordered = k[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    out = np.empty(len(order), docs.dtype)
    out[order] = np.repeat(docs[order[heads]], np.diff(np.append(heads, len(order))))
    return out


def _runs(*changing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs in which nothing changes but the last, which counts up."""
    n = len(changing[-1])
    new = np.ones(n, bool)
    if n:
        new[1:] = changing[-1][1:] != changing[-1][:-1] + 1
        for c in changing[:-1]:
            new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def _suffixes(width: int, buckets: int) -> Callable:
    """Suffixes with a repeated gram, a row for each run of one gram. Of equal suffixes
    in a slab only those of its smallest document travel; the others are settled here
    and leave as rows without prints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = texts_of(batch.column(2)), batch.column(3).to_pylist()
            ids = batch.column(0)
            for first, last in slabs(texts, SLAB):
                w = Words(texts[first:last])
                h = w.hashes()
                parts = []
                for row in range(first, last):
                    x = h[w.bounds[row - first]:w.bounds[row - first + 1]]
                    low = smallest_grams(x, width)
                    at = np.flatnonzero(np.isin(low, np.array(marks[row], np.int64)))
                    if len(at):
                        parts.append((np.full(len(at), row), at, low[at], windows(x, width)[at]))
                if not parts:
                    continue
                row, at, gram, node = (np.concatenate(p) for p in zip(*parts))
                doc = ids.take(pa.array(row)).to_numpy(zero_copy_only=False)
                settled = tree_minima((gram, node), doc) < doc
                out = []
                for done in (False, True):
                    pick = np.flatnonzero(settled == done)
                    s, n = _runs(row[pick], gram[pick], at[pick])
                    prints = node[pick].tobytes()
                    out.append((row[pick][s], gram[pick][s], at[pick][s], n,
                                [None if done else prints[8 * a:8 * (a + c)] for a, c in zip(s.tolist(), n.tolist())]))
                row, gram, at, n = (np.concatenate(p) for p in list(zip(*out))[:4])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((gram.view(np.uint64) % np.uint64(buckets)).astype(np.int32)), pa.array(gram),
                     ids.take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(out[0][4] + out[1][4], pa.binary())],
                    names=["bucket", "gram", "id", "h", "start", "n", "prints"])
    return run


def _subtrees(group: pa.Table) -> pa.Table:
    """One bucket: its subtrees' repeats, as runs of suffixes."""
    group = group.combine_chunks()
    done = group.column("prints").is_null()
    settled, open_ = group.filter(done), group.filter(pc.invert(done))
    names = ["id", "h", "start", "n"]
    if not open_.num_rows:
        return settled.select(names)
    n = open_.column("n").to_numpy()
    node = np.frombuffer(b"".join(open_.column("prints").to_pylist()), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    at = open_.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    doc = open_.column("id").to_numpy()[row]
    pick = np.flatnonzero(tree_minima((open_.column("gram").to_numpy()[row], node), doc) < doc)
    s, length = _runs(row[pick], at[pick])
    take = pa.array(row[pick][s])
    found = pa.table([open_.column("id").take(take), open_.column("h").take(take),
                      pa.array(at[pick][s].astype(np.int32)), pa.array(length.astype(np.int32))], names=names)
    return pa.concat_tables([settled.select(names), found])


def _ranges(runs: list[dict] | None, width: int) -> list[list[int]]:
    """Word ranges covered by the windows that start in the runs, in order, apart."""
    out: list[list[int]] = []
    for r in sorted(runs or (), key=lambda r: r["start"]):
        end = r["start"] + r["n"] + width - 1
        if out and r["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([r["start"], end])
    return out


def _cut(width: int, at: int) -> Callable:
    """Rows with their repeats cut from the column ``at``; the last column has the runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, runs in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if runs:
                    words = texts[i].encode().split()
                    for a, b in reversed(_ranges(runs, width)):
                        del words[a:b]
                    texts[i] = b" ".join(words).decode()
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
    return run


def _without(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = texts_of(batch.column(1)), batch.column(2).to_pylist()
            for first, last in slabs(texts):
                n_words, n_removed, kept, spans = [], [], [], []
                for text, found in zip(texts[first:last], runs[first:last]):
                    words = text.split()
                    ranges = _ranges(found, width)
                    gone = sum(b - a for a, b in ranges)
                    for a, b in reversed(ranges):
                        del words[a:b]
                    n_words.append(len(words) + gone)
                    n_removed.append(gone)
                    kept.append(b" ".join(words))
                    spans.append([{"start": a, "end": b} for a, b in ranges])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n_words, pa.int64()),
                     pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["id", "n_words", "n_removed", "kept", "spans"])
    return run


def repeated_runs(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, h, runs (array of start, n) of repeated suffixes for rows of id, text, h, where h
    is xxhash64 of the text."""
    known = rows.where("id IS NOT NULL")
    grams = written(known.mapInArrow(_grams(width), "gram long, id long"), "grams")
    repeated = (grams.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b"))
                .where("a <> b").select("gram"))
    marks = written(grams.join(repeated, "gram", "left_semi").groupBy("id")
                    .agg(F.collect_list("gram").alias("grams")), "marks")
    suffixes = marks.agg(F.sum(F.size("grams"))).first()[0] or 0  # about width / 4 suffixes share a gram
    buckets = max(1, suffixes * (width // 4 + 1) // BUCKET_SUFFIXES)
    return (rows.join(marks, "id")
            .select("id", "h", "text", "grams")
            .mapInArrow(_suffixes(width, buckets),
                        "bucket int, gram long, id long, h long, start int, n int, prints binary")
            .groupBy("bucket").applyInArrow(_subtrees, "id long, h long, start int, n int")
            .groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("runs")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed (long), kept (the words that
    stay, joined by one space), spans (array of start, end: removed words).

    A word goes if it is covered by ``width`` consecutive words that also start in a
    document with a smaller id. Ids must be integers. A null id is neither smaller nor
    larger than another, so such rows lose nothing and cost others nothing; rows that
    share an id don't count for each other. Null texts have no words. Other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    k, r = keyed.alias("k"), repeated_runs(keyed, width).alias("r")
    out = (k.join(r, (F.col("k.id") == F.col("r.id")) & (F.col("k.h") == F.col("r.h")), "left")
           .select("k.id", "k.text", "r.runs")
           .mapInArrow(_without(width), "id long, n_words long, n_removed long, kept string, "
                       "spans array<struct<start int, end int>>"))
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """All rows and columns of ``docs``. Texts that hold repeats (see remove_repeats) lose
    them and keep the other words joined by one space; others stay as they are."""
    d = docs.withColumn("__h", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    runs = repeated_runs(rows.withColumn("h", F.xxhash64("text")), width).withColumnRenamed("runs", "__runs").alias("r")
    joined = d.alias("d").join(runs, (F.col(f"d.{id_col}") == F.col("r.id")) & (F.col("d.__h") == F.col("r.h")), "left")
    return (joined.select(*(f"d.`{c}`" for c in docs.columns), "r.__runs")
            .mapInArrow(_cut(width, docs.columns.index(text_col)), docs.schema))
