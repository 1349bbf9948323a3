"""Best-fit packing into sequences of several permitted lengths.

Texts are pieces of tokens; pieces are packed in descending order, each into the open
bin with the least room that holds it. Where none does, the bin size is opened that
costs least for each token it is expected to hold, given what is still to be packed;
at the end every bin shrinks to the least permitted length that holds its contents.
Pieces are dealt by hash to shards of bounded size, so packing needs no global order
and a shard fits in a task; what a shard loses is less than one bin of each size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.words import texts_of

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD, QUADRATIC = 64, 16384
SHARD_PIECES = 20_000


def cost(length: int) -> float:
    """Cost of a sequence in tokens: a fixed part, its length, and what attention adds."""
    return OVERHEAD + length + length * length / QUADRATIC


def best_fit(sizes: Sequence[int], lengths: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each piece (sizes in descending order), and each bin's length."""
    lengths = sorted(lengths)
    rest, room, by_room, bins, starts, used = sum(sizes), [], {}, [], [], []
    capacity: list[int] = []
    for size in sizes:
        at = bisect_left(room, size)
        if at < len(room):
            left = room[at]
            stack = by_room[left]
            b = stack.pop()
            if not stack:
                del by_room[left]
                room.pop(at)
        else:
            fitting = [c for c in lengths if c >= size]
            best = min(fitting, key=lambda c: (cost(c) / min(c, rest), c))
            b = len(capacity)
            capacity.append(best)
            used.append(0)
        bins.append(b)
        starts.append(used[b])
        used[b] += size
        rest -= size
        left = capacity[b] - used[b]
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(b)
    return bins, starts, [lengths[bisect_left(lengths, u)] for u in used]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.split()) for t in texts_of(batch.column(1))], pa.int64())],
            names=["id", "n"])


def _packed(lengths: Sequence[int]) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        n = group.column("n_tokens").to_numpy()
        order = np.lexsort((group.column("piece").to_numpy(), -n))
        bins, starts, size = best_fit(n[order].tolist(), lengths)
        group = group.take(pa.array(order))
        return pa.table({"id": group.column("id"), "piece": group.column("piece"), "piece_start": group.column("piece_start"),
                         "n_tokens": group.column("n_tokens"), "shard": group.column("shard"),
                         "bin": pa.array(bins, pa.int32()), "bin_length": pa.array([size[b] for b in bins], pa.int32()),
                         "bin_start": pa.array(starts, pa.int32())})
    return run


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece (from 0), piece_start, n_tokens, shard, bin,
    bin_length, bin_start; shard and bin name a sequence, bin_start is the piece's place.

    Tokens are words between ASCII white space. A text longer than the longest length is
    cut into pieces of that length and a rest. A text without words, or null, is one
    piece of no tokens with null shard and bin. Rows that repeat an id are packed apart;
    other columns are not read. Bins are numbered within their shard.
    """
    longest = max(lengths)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = (rows.mapInArrow(_sizes, f"id {kind}, n long")
              .withColumn("row", F.monotonically_increasing_id())
              .select("id", "row", "n", F.explode(F.sequence(
                  F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / longest)).cast("int"))).alias("piece"))
              .select("id", "row", "piece", (F.col("piece") * F.lit(longest).cast("long")).alias("piece_start"),
                      F.least(F.col("n") - F.col("piece") * F.lit(longest).cast("long"), F.lit(longest)).alias("n_tokens")))
    count = rows.count()
    shards = count // SHARD_PIECES + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int")).drop("row")
    shape = (f"id {kind}, piece int, piece_start long, n_tokens long, shard int, bin int, bin_length int, bin_start int")
    full = dealt.where("n_tokens > 0").groupBy("shard").applyInArrow(_packed(lengths), shape)
    empty = dealt.where("n_tokens = 0").select("id", "piece", "piece_start", "n_tokens", *(
        F.lit(None).cast("int").alias(c) for c in ("shard", "bin", "bin_length", "bin_start")))
    return full.unionByName(empty).withColumnRenamed("id", id_col)
