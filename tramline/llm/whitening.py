"""Embedding whitening: covariance on Spark, leading components by contour integration.

Vectors are read where they lie and never shuffled. One pass sums the integer vectors, a
second the centred outer products, a third those of the whitened vectors; a task sends
sums only, of dimension squared at most. The components of the one d x d covariance come
from ``feast.leading``, and a last pass projects every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import feast

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Entries whose scaled value is beyond this have no exact place in a sum of longs.
BOUND = 2.0 ** 47
#: Eigenvalues at most this share of the largest are rounding of zero.
ZERO = 1e-13
LONGEST = 2.0 ** 63 - 2.0 ** 11


def _usable(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part, and their integer vectors."""
    lists = batch.column(1)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == d)
    flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * flat.astype(np.float64).reshape(-1, d))
        good = (np.abs(scaled) < BOUND).all(axis=1)  # false for NaN too
    return rows[good], scaled[good].astype(np.int64) + OFFSET


def _sums(d: int) -> Callable:
    """Per task: each dimension's sum and the number of rows, in exact integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            _, x = _usable(batch, d)
            for at in range(0, len(x), 8192):
                total = [t + int(s) for t, s in zip(total, x[at:at + 8192].sum(axis=0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
                 pa.array([n] * d, pa.int64())], names=["cell", "total", "n"])
    return run


def _products(d: int, mean: np.ndarray, turn: np.ndarray | None, shift: np.ndarray | float) -> Callable:
    """Per task: sums of products of centred entries (after ``turn``), upper triangle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _usable(batch, d)[1] - mean
            y = (y if turn is None else y @ turn) - shift
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            cells = np.flatnonzero(np.triu(np.ones_like(total)).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.ravel()[cells])],
                                             names=["cell", "total"])
    return run


def _projected(d: int, n: int, sums: list[int], mean: np.ndarray, turn: np.ndarray) -> Callable:
    """Every row with its deviation and one row per component."""
    k = turn.shape[1]
    least = np.array([s - (1 << 64) * ((s + (1 << 63)) >> 64) for s in sums], np.int64)  # modulo 2^64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _usable(batch, d)
            about = ((n * (x - mean)) ** 2).sum(axis=1)
            far = np.int64(n) * x - least  # wraps, and is exact wherever the result fits
            deviation, fits = (far * far).sum(axis=1), about < LONGEST
            y = (x - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(rows, k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                 pa.array(np.repeat(deviation, k), pa.int64(), mask=np.repeat(~fits, k)),
                 pa.array(y.ravel(), pa.float64(), mask=~np.isfinite(y.ravel()))],
                names=["id", "component", "deviation", "whitened"])
    return run


def _symmetric(cells: DataFrame, d: int) -> np.ndarray:
    """The matrix whose upper triangle is summed over the tasks: d * d values at most."""
    m = np.zeros(d * d)
    for r in cells.groupBy("cell").agg(F.sum("total").alias("total")).collect():
        m[r["cell"]] = r["total"]
    m = m.reshape(d, d)
    return np.triu(m) + np.triu(m, 1).T


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component (int, from 1), n, deviation (long), whitened, explained,
    identity_error (double): one row per usable row and component.

    Entries become integers, floor(1024 c) + 100000. Vectors that are null, hold null or
    non-finite entries or entries beyond 2^37, or have another length than the most rows
    (ties: the longer) take no part; rows with null or repeated ids do, each as a row. With
    fewer than ``k`` dimensions there are fewer components. Where a component's eigenvalue
    is zero (few or equal rows), ``whitened`` is null and ``identity_error`` leaves it out;
    ``explained`` is null if no entry varies. A ``deviation`` that no long holds is null. A
    table without usable vectors gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    out_kinds = f"id {kind}, component int, deviation long, whitened double"
    lengths = (rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), F.desc("d")).first())
    d = lengths["d"] if lengths else 1
    totals = {r["cell"]: (int(r["total"]), r["n"]) for r in
              rows.mapInArrow(_sums(d), "cell int, total decimal(38,0), n long").groupBy("cell")
              .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    if not totals:
        empty = spark.createDataFrame([], out_kinds.replace("deviation", "n long, deviation", 1))
        return empty.withColumns({c: F.lit(None).cast("double") for c in ("explained", "identity_error")}).withColumnRenamed("id", id_col)
    sums, n = [totals[j][0] for j in range(d)], totals[0][1]
    mean = np.array([s / n for s in sums])

    centred = rows.mapInArrow(_products(d, mean, None, 0.0), "cell int, total double")
    covariance = _symmetric(centred, d) / n
    values, vectors_of = feast.leading(covariance, k)
    trace = float(np.trace(covariance))
    live = values > ZERO * max(float(values.max(initial=0.0)), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(live, vectors_of / np.sqrt(np.where(live, values, 1.0)), np.nan)
    error = None
    if live.any():
        left = np.array([float(Fraction(s, n) - Fraction(m)) for s, m in zip(sums, mean)])  # the mean's rounding
        used = turn[:, live]
        again = rows.mapInArrow(_products(d, mean, used, left @ used), "cell int, total double")
        error = float(np.abs(_symmetric(again, used.shape[1]) / n - np.eye(used.shape[1])).max())
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    out = rows.mapInArrow(_projected(d, n, sums, mean, turn), out_kinds)
    return out.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(shares, F.col("component")).alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))
