"""A blocked Bloom filter as a table, in built-in functions.

A key sets one bit in each of the eight 32-bit words of one block, so a test reads one
row of the filter. The filter is broadcast while its size, known from the number of
keys, is within ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, WORDS = 16, 8
BROADCAST_BYTES = 16 << 20


class BlockedBloom:
    def __init__(self, keys: DataFrame, key: str):
        """The filter of the values of a column (nulls are left out)."""
        keys = keys.select(F.col(key).alias("key")).where("key IS NOT NULL")
        self.blocks = max(1, -(-keys.count() * BITS_PER_KEY // (32 * WORDS)))
        self.table = (keys.groupBy(self._block(F.col("key")).alias("__block"))
                      .agg(*(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col("key"), i))).alias(f"__w{i}")
                             for i in range(WORDS))))

    @property
    def small(self) -> bool:
        return self.blocks * 16 * WORDS <= BROADCAST_BYTES

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    @staticmethod
    def _bit(key: Column, i: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key, F.lit("bits")), 5 * i).bitwiseAND(F.lit(31)).cast("int")

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with a column: whether the key may be one of the filter's."""
        table = F.broadcast(self.table) if self.small else self.table
        words = [f"__w{i}" for i in range(WORDS)]
        test = F.lit(True)
        for i, w in enumerate(words):
            test = test & (F.call_function("shiftright", F.col(w), self._bit(F.col(key), i)).bitwiseAND(F.lit(1)) == 1)
        return (df.withColumn("__at", self._block(F.col(key)))
                .join(table, F.col("__at") == F.col("__block"), "left")
                .withColumn(name, F.coalesce(test & F.col(key).isNotNull(), F.lit(False)))
                .drop("__at", "__block", *words))

    def possible(self, df: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be one of the filter's; all rows if the filter is too
        large to broadcast, for then it would be moved as much as a join."""
        if not self.small:
            return df
        return self.mark(df, key, "__maybe").where("__maybe").drop("__maybe")
