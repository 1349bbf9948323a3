"""Near duplicates by HyperMinHash: banded compressed registers, corrected estimates, exact checks.

Texts with the same words form one class. A class's sketch has ``BANDS`` bands of
``BUCKETS`` buckets; in each band every shingle has one 32-bit value, whose range says its
bucket, and a bucket's register keeps the leading-zero count and the first ``MANTISSA``
mantissa bits of its smallest value (the next bucket's, if it is empty). Classes that
agree in all registers of a band meet under its key.

Of the classes under a key the one that meets most others is the hub. Every class is
checked against its best hub first, which joins most copies with one comparison each.
Then only parts not yet joined are compared, by sketches inside a key; those that may
link form clusters, whose rows are compared by whole shingle sets, again across parts
only. A sketch comparison is an estimate of the similarity from the registers, corrected
for those that agree by chance, with a margin that no linked pair misses in practice;
whole sets decide. Large keys and clusters are compared in blocks, and what leaves a task
are the edges that join parts, so no task holds a hot group and no group becomes pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.bloom import BlockedBloom
from tramline.llm.graph import components
from tramline.llm.words import Words, mix, slabs, text_digest, texts_of, windows
from tramline.session import written

SHINGLE, PERCENT = 2, 80
BANDS, BUCKETS, MANTISSA = 40, 5, 10
MARGIN_SIGMAS = 4.5
BLOCK = 1024
BLOCK_CELLS = 1 << 19
_FACTORS = np.random.default_rng(29).integers(1, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLICE = np.uint32((1 << 32) // BUCKETS)


def registers(smallest: np.ndarray) -> np.ndarray:
    """16-bit registers of 32-bit minima: leading zeros, then the bits after the first one."""
    value = smallest.astype(np.float64) + 0.5
    power = np.frexp(value)[1]  # value = f * 2 ** power, f in [1/2, 1)
    mantissa = (np.ldexp(value, 1 - power) - 1.0) * (1 << MANTISSA)
    return ((32 - power) * (1 << MANTISSA) + mantissa.astype(np.int64)).astype(np.uint16)


@functools.lru_cache(maxsize=None)
def _chance(step: int) -> float:
    """How often two unrelated sets of 2 ** (step / 4) shingles have equal registers: the sum
    of the squared probabilities of a register's values."""
    each = max(1.0, 2 ** (step / 4) / BUCKETS)
    mantissas = np.arange(1 << MANTISSA) / (1 << MANTISSA)
    total = 0.0
    for zeros in range(33):
        scale = 2.0 ** -(zeros + 1)
        low = np.minimum((1 + mantissas) * scale * BUCKETS, 1.0)
        high = np.minimum((1 + mantissas + 1 / (1 << MANTISSA)) * scale * BUCKETS, 1.0)
        total += float((((1 - low) ** each - (1 - high) ** each) ** 2).sum())
    return total


def estimate(equal: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that a share of equal registers stands for, when sets of
    ``size`` shingles agree in some by chance."""
    steps = np.round(4 * np.log2(np.maximum(size, 1))).astype(np.int64)
    rate = np.zeros(len(steps))
    for s in np.unique(steps):
        rate[steps == s] = _chance(int(s))
    return (equal - rate) / (1 - rate)


def least_estimate(size: np.ndarray, percent: int) -> np.ndarray:
    """The estimate that pairs at the threshold stay above; a small set fills few buckets."""
    j, n = percent / 100, BANDS * np.minimum(BUCKETS, np.maximum(1, size / 2))
    return j - MARGIN_SIGMAS * np.sqrt(j * (1 - j) / n)


def _sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of several texts one after another, and where each text's end."""
    parts = []
    for a, b in zip(bounds, bounds[1:]):
        parts.append(np.unique(windows(hashes[a:b], min(width, int(b - a)))) if b > a else np.zeros(0, np.uint64))
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The registers (one row per set) of the sets that begin at ``starts``, none empty."""
    out = np.empty((len(starts), BANDS * BUCKETS), np.uint16)
    for band in range(BANDS):
        v = ((values * _FACTORS[band]) >> np.uint64(32)).astype(np.uint32)
        for bucket in range(BUCKETS):
            out[:, band * BUCKETS + bucket] = registers(np.minimum.reduceat(v, starts))
            v -= _SLICE  # the next bucket's values become the smallest
    return out


def _key(hashes: np.ndarray) -> bytes:
    """128 bits of a word sequence."""
    n = len(hashes)
    place = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    pair = [int(mix(hashes * (place | np.uint64(1)) + place).sum()), int(mix(hashes ^ mix(place + np.uint64(n))).sum())]
    return np.array(pair, np.uint64).tobytes()


def _signed(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower() for t in texts_of(batch.column(1))]
            for first, last in slabs(texts):
                w = Words(texts[first:last])
                h = w.hashes()
                values, ends = _sets(h, w.bounds, width)
                sizes = np.diff(ends, prepend=0)
                some = np.flatnonzero(sizes)
                found = sketches(values, (ends - sizes)[some]) if len(some) else np.zeros((0, 0), np.uint16)
                words, signs = [None] * (last - first), [None] * (last - first)
                for row, at in enumerate(some.tolist()):
                    words[at] = _key(h[w.bounds[at]:w.bounds[at + 1]])
                    signs[at] = found[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, last - first) for c in (0, 2, 3)]
                    + [pa.array(words, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                    names=["id", "h", "g", "words", "n", "sketch"])
    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, BUCKETS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sketch.shape[:2])
        for bucket in range(BUCKETS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, bucket])
        owner = pa.array(np.repeat(np.arange(len(sketch)), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(owner)],
                                         names=["key", "node"])


def _possible(equal: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs with this share of equal registers, of sets of these sizes, may link."""
    low, high = np.minimum(one, other), np.maximum(one, other)
    return (100 * low >= percent * high) & (estimate(equal, low) >= least_estimate(low, percent))


def _estimated(percent: int) -> Callable:
    """The pairs (a, b) that their sketches allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                          for c in ("a_sketch", "b_sketch"))
            good = _possible((one == other).mean(axis=1), batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), percent) \
                if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(good))
    return run


def _spanning(a: np.ndarray, b: np.ndarray, part: list[int]) -> list[int]:
    """Places of the pairs that join two parts not yet joined; ``part`` is where each row
    stands before and, in the end, after."""
    def top(x: int) -> int:
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            part[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _compared(group: pa.Table, test: Callable) -> pa.Table:
    """Edges (a, b) that join the parts (``root``) of each ``place`` as far as ``test`` links
    rows of different parts; where rows have sides, only across them. ``test(i, rest)`` says
    which of the rows ``rest`` link to row i. At most one edge less than parts leaves."""
    nodes, roots = group.column("node").to_numpy(), group.column("root").to_numpy()
    side, place = group.column("side").to_numpy(), group.column("place").to_numpy()
    order = np.argsort(place, kind="stable")
    out_a, out_b = [], []
    for members in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        _, first, number = np.unique(roots[members], return_index=True, return_inverse=True)
        if len(first) == 1:
            continue
        part, cross = list(range(len(first))), side[members].any()
        for i, m in enumerate(members[:-1]):
            own = number[i]
            rest = members[i + 1:]
            open_ = number[i + 1:] != own
            if cross:
                open_ &= side[rest] != side[m]
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            at = at[test(m, rest[at])]
            joined = _spanning(np.full(len(at), own), number[i + 1 + at], part)
            out_a += [m] * len(joined)
            out_b += rest[at[joined]].tolist()
    return pa.table({"a": pa.array(nodes[out_a], pa.int64()), "b": pa.array(nodes[out_b], pa.int64())})


def _alike(percent: int) -> Callable:
    """Edges between the parts that meet under one key and that sketches allow to link."""
    def run(group: pa.Table) -> pa.Table:
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(group.num_rows, -1)
        n = group.column("n").to_numpy()

        def test(i: int, rest: np.ndarray) -> np.ndarray:
            return _possible((sketch[rest] == sketch[i]).mean(axis=1), np.full(len(rest), n[i]), n[rest], percent)

        return _compared(group, test)
    return run


def _linked(percent: int) -> Callable:
    """Edges between the parts of one candidate cluster that whole sets link."""
    def run(group: pa.Table) -> pa.Table:
        sets = group.column("cells").combine_chunks()
        n = group.column("n").to_numpy()
        flat, at = sets.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])  # sorted as such
        cells = [flat[x:y] for x, y in zip(at, at[1:])]

        def test(i: int, rest: np.ndarray) -> np.ndarray:
            near = (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
            for k in np.flatnonzero(near):
                other = cells[rest[k]]
                found = np.searchsorted(cells[i], other)
                found[found == n[i]] = 0
                shared = int((cells[i][found] == other).sum())
                near[k] = 100 * shared >= percent * (int(n[i]) + len(other) - shared)
            return near

        return _compared(group, test)
    return run


def _with_both(pairs: DataFrame, table: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Pairs with the table's columns of either end. An end b that stands in many pairs is
    copied once for each ``block`` of them, so that no task gets them all."""
    fan = pairs.groupBy("b").agg(F.floor(F.count(F.lit(1)) / block).cast("int").alias("__fan"))
    right = table.join(fan, table["node"] == fan["b"]).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("__fan"))).alias("__copy"), *(F.col(c).alias(f"b_{c}") for c in columns))
    left = (pairs.join(fan, "b").withColumn("__copy", F.pmod(F.xxhash64("a"), F.col("__fan") + 1).cast("int")).drop("__fan")
            .join(table.select(F.col("node").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns)), "a"))
    return left.join(right, ["b", "__copy"]).drop("__copy")


def _shingled(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower() for t in texts_of(batch.column(0))]
            for first, last in slabs(texts):
                w = Words(texts[first:last])
                values, ends = _sets(w.hashes(), w.bounds, width)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, last - first), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))],
                    names=["node", "cells"])
    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per input row: id_col, n_shingles (long), component_id, kept.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; a text's set
    holds its different runs of ``shingle`` words, the whole sequence if it has fewer, and
    nothing if it is null or has no words. Rows link when 100 times the size of the
    intersection of their sets is at least ``percent`` times that of the union.
    ``component_id`` is the smallest id among the rows reached by links (null ids come
    last), the row's own if it has none; ``kept`` says that it is the row's id, so rows
    that repeat the smallest id, and those of a group without any, are all kept. Other
    columns are not read.
    """
    h, g = text_digest(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h, g)
    kind = rows.schema["id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_signed(shingle), f"id {kind}, h long, g long, words binary, n long, sketch binary"), "signed")
    # The first row of a class stands for it; equal word sequences have equal sketches. A
    # class's number is fixed when the table is written.
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h", "g")
    classes = written(signed.where("words IS NOT NULL").groupBy("words").agg(
        F.min(first).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = classes.select("node", "sketch").mapInArrow(_banded, "key long, node long")
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.min("node").alias("low"),
                                      F.bit_xor(F.xxhash64("node")).alias("members")).where("of > 1")
    # Keys of different bands that hold the same classes are looked at once.
    keys = keys.groupBy("of", "low", "members").agg(F.min("key").alias("key"))
    met = written(entries.join(keys.select("key", "of"), "key"), "met")

    degree = met.groupBy("node").agg(F.sum("of").alias("degree"))
    score = F.struct("degree", "node")
    hubs = met.join(degree, "node").groupBy("key").agg(F.max(score).alias("hub"))
    stars = met.join(hubs, "key").where("node <> hub.node").groupBy("node").agg(F.max("hub").alias("hub"))
    stars = written(stars.select(F.col("node").alias("a"), F.col("hub.node").alias("b")), "stars")

    # The shingle sets of the classes that met, each from its first row.
    members = written(met.select("node").distinct().join(classes.drop("words"), "node"), "members")
    wanted = BlockedBloom(members.select(F.col("first.h").alias("h")), "h")
    m, d = members.alias("m"), wanted.possible(rows, "h").alias("d")
    same = F.col("m.first.h") == F.col("d.h")
    for c in ("g", "id"):
        same = same & F.col(f"m.first.{c}").eqNullSafe(F.col(f"d.{c}"))
    cells = written(m.join(d, same).select("d.text", "m.node").mapInArrow(_shingled(shingle), "node long, cells array<bigint>")
                    .dropDuplicates(["node"]), "cells")

    tried = _with_both(stars, members, ["n", "sketch"], block).select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    tried = tried.mapInArrow(_estimated(percent), "a long, b long")
    both = _with_both(tried, cells, ["cells"], block)
    shared = F.size(F.array_intersect("a_cells", "b_cells"))
    both = both.where(100 * shared >= percent * (F.size("a_cells") + F.size("b_cells") - shared))
    edges = written(both.select("a", "b"), "edges")
    roots = components(edges)

    sketched = members.select("node", "n", "sketch")
    placed = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_ = _dealt(placed.withColumn("size", F.lit(1)), "key", block).join(sketched, "node")
    maybe = written(open_.groupBy("task").applyInArrow(_alike(percent), "a long, b long"), "maybe")
    if not maybe.isEmpty():
        # Clusters of parts that may link; their rows are compared by whole sets.
        part = members.select("node", "n").join(roots, "node", "left").select(
            "node", F.coalesce("root", "node").alias("root"), F.col("n").alias("size"))
        ends = maybe
        for c in ("a", "b"):
            ends = ends.join(part.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c)
        clusters = components(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        grouped = part.join(clusters.select(F.col("node").alias("root"), F.col("root").alias("key")), "root")
        dealt = _dealt(grouped, "key", BLOCK_CELLS).join(cells.withColumn("n", F.size("cells").cast("long")), "node")
        more = written(dealt.groupBy("task").applyInArrow(_linked(percent), "a long, b long"), "more")
        if not more.isEmpty():
            roots = components(edges.unionByName(more))

    named = classes.select("words", "node", "first.id").join(roots, "node", "left").select(
        "words", "id", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(ids, "root").select("words", "component_id")
    own = F.when(F.col("words").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (signed.select("id", "words", "n").join(named, "words", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                    F.col("id").eqNullSafe(own).alias("kept")))


def _dealt(placed: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (node, root, size) of keys with several parts, dealt to tasks: task, place, side.

    A key whose sizes add up to more than ``block`` is cut. Its largest part is its major
    one: it is dealt to blocks that each meet every block of the others, and is not
    compared in itself; the others' blocks meet each other too. Small keys share tasks.
    """
    parts = placed.groupBy(key, "root").agg(F.sum("size").alias("c"))
    mixed = parts.groupBy(key).agg(F.sum("c").alias("of"), F.max(F.struct("c", "root")).alias("major"),
                                   F.count(F.lit(1)).alias("parts")).where("parts > 1")
    held = placed.join(mixed, key)

    def blocks(c: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(c / block)).cast("int")

    held = held.select(key, "node", "root", "size", (F.col("root") == F.col("major.root")).alias("is_major"),
                       (F.col("of") <= block).alias("one"), blocks(F.col("major.c")).alias("majors"),
                       blocks(F.col("of") - F.col("major.c")).alias("minors"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    # Blocks of minors count from 0, of majors from -1 down.
    mine = F.when(F.col("is_major"), -1 - own).otherwise(own)
    others = F.when(F.col("one"), F.array(F.lit(0))).when(
        F.col("is_major"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(
        F.sequence(-F.col("majors"), F.col("minors") - 1))
    dealt = held.withColumn("mine", mine).withColumn("other", F.explode(others))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    place = F.when(F.col("one"), F.xxhash64(key)).otherwise(F.xxhash64(key, lo, hi))
    side = F.when(F.col("one") | (lo == hi), 0).otherwise((F.col("mine") == hi).cast("int"))
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    task = F.when(F.col("one"), F.pmod(F.xxhash64(key), F.lit(total // (16 * block) + 1))).otherwise(place)
    return dealt.select(task.alias("task"), place.alias("place"), side.alias("side"), "node", "root")
