"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs of ``BITS`` projections, several rotations of
the centred space, each learned on a bounded sample so that signs lose little. A code
is split into 8-bit substrings, each with a table of the codes by substring value.
All codes within a Hamming radius have a substring within the radius divided by the
number of substrings (pigeonhole), so probing the table entries that near finds every
one of them; their exact distances then decide. The radius is learned on the sample
so that the true neighbours lie within it; a query that finds fewer than ``k`` codes
widens it until it has enough.

Vectors are dealt to blocks of bounded size and queries to groups; every group meets
every block, and only the best of each block leave the task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 512
SAMPLE = 4096
RECALL = 0.97
BLOCK_ROWS, GROUP_ROWS = 32768, 8192
_NEAR = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= r).astype(np.uint8) for r in range(9)]


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 5, rounds: int = 10) -> np.ndarray:
    """Projections (dimension x bits): rotations turned by alternating signs and Procrustes."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    out = []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(sample.T @ np.sign(sample @ r))
            r = u @ vt
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def encode(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits((x - centre) @ rotation > 0, axis=1)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int32)


class MultiIndex:
    """Tables of codes by the value of each 8-bit substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        values = np.arange(257)
        self.tables = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.first = [np.searchsorted(codes[t, j], values).tolist() for j, t in enumerate(self.tables)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius. If none of p substrings were within
        ``near``, the codes would differ in p * (near + 1) bits or more; p is chosen so
        that this exceeds the radius, and the other tables need no probe."""
        parts = len(self.tables)
        near = min(radius // parts, 8)
        lists = []
        for j in range(min(parts, radius // (near + 1) + 1)):
            table, first = self.tables[j], self.first[j]
            lists += [table[first[v]:first[v + 1]] for v in (_NEAR[near] ^ code[j]).tolist()]
        hit = np.zeros(len(self.codes), bool)
        hit[np.concatenate(lists)] = True
        found = np.flatnonzero(hit)
        return found[hamming(self.codes[found], code) <= radius]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(axis=1))


def learn_radius(sample: np.ndarray, codes: np.ndarray, k: int, recall: float) -> int:
    """The Hamming distance within which the share ``recall`` of true neighbours lies."""
    seen = []
    for i in range(0, len(sample), max(1, len(sample) // 256)):
        near = distances(sample, sample[i])
        near[i] = np.inf
        best = np.argsort(near, kind="stable")[:min(k, len(sample) - 1)]
        seen.append(hamming(codes[best], codes[i]))
    return int(np.quantile(np.concatenate(seen), recall, method="higher")) if seen and len(seen[0]) else codes.shape[1] * 8


def _search(centre: np.ndarray, rotation: np.ndarray, radius: int, k: int) -> Callable:
    d = len(centre)

    def vectors(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(-1, d)

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_ids, ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
        keys = queries.column("q").to_numpy()
        out_q, out_k, out_v, out_d = [], [], [], []
        if len(q_ids) and len(ids):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], vectors(rows)[order]
            index, q = MultiIndex(encode(x, centre, rotation)), vectors(queries)
            codes = encode(q, centre, rotation)
            for i in range(len(q)):
                reach = radius
                while True:
                    found = index.within(codes[i], reach)
                    found = found[ids[found] != q_ids[i]]
                    if len(found) >= k or reach >= rotation.shape[1]:
                        break
                    reach = min(rotation.shape[1], reach + rotation.shape[1] // 32)
                near = distances(x[found], q[i])
                best = np.argsort(near, kind="stable")[:k]  # ids ascend, so ties go to the smaller
                out_q.append(np.full(len(best), q_ids[i]))
                out_k.append(np.full(len(best), keys[i]))
                out_v.append(ids[found[best]])
                out_d.append(near[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        return pa.table({"query_id": join(out_q, np.int64), "q": join(out_k, np.int64), "vec_id": join(out_v, np.int64),
                         "score": join(out_d, np.float64)})
    return run


def _packed(batches):
    """Vectors as bytes of doubles; those that are null, zero or not finite drop out, and
    so do vectors of another length than ``n``."""
    for batch in batches:
        keep, out = [], []
        for i, (v, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if v is not None and len(v) == n and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    out.append((x + 0.0).tobytes())  # no negative zeros: equal vectors have equal bytes
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(out, pa.binary())], names=["id", "v"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", bits: int = BITS, recall: float = RECALL,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's ``k``
    nearest found; ties go to the smaller vec_id; all candidates, if fewer.

    ``queries`` has the same columns as ``vectors``. A candidate is every row but those
    with the query's id. Vectors that are null, zero, hold null or non-finite components,
    or have another length than the most rows take no part, nor do rows with a null id;
    candidates that repeat an id count each. Queries equal in id and vector are asked once;
    queries that share an id but not the vector have a list each, ranked apart. Rotation and radius are learned on at most
    ``SAMPLE`` vectors, the first by a hash of their id; every row is indexed.
    """
    def packed(df: DataFrame) -> DataFrame:
        return (df.where(F.col(id_col).isNotNull())
                .select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.lit(d).alias("n"))
                .mapInArrow(_packed, "id long, v binary"))

    size = (vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first())
    n_queries = queries.count()
    if size is None or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = size
    rows = packed(vectors)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    x = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), np.float64).reshape(-1, d)
    centre = x.mean(axis=0) if len(x) else np.zeros(d)
    bits = -(-bits // 64) * 64
    rotation = learn_rotations(x - centre, bits)
    radius = learn_radius(x, encode(x, centre, rotation), k, recall)
    blocks, groups = -(-n // block_rows), -(-n_queries // GROUP_ROWS)
    # Copies of one row are dealt to all blocks, by a salt; queries are different already.
    key, salt = F.xxhash64("id", "v"), F.monotonically_increasing_id()
    block, group = F.pmod(F.xxhash64("id", "v", salt), F.lit(blocks)), F.pmod(F.col("q"), F.lit(groups))
    left = (packed(queries).distinct().withColumn("q", key).withColumn("g", group)
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = rows.withColumn("b", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cast = lambda df, *more: df.select(F.col("g").cast("int").alias("g"), F.col("b").cast("int").alias("b"), "id", "v", *more)
    found = (cast(left, "q").groupBy("g", "b").cogroup(cast(right).groupBy("g", "b"))
             .applyInArrow(_search(centre, rotation, radius, k), "query_id long, q long, vec_id long, score double"))
    order = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
