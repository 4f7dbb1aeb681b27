"""A blocked Bloom filter as a DataFrame: its blocks are rows, so building and probing stay inside Spark.

A key marks ``MARKS`` bits of one block of 512 bits. The filter has 16 bits a key, a power of two of blocks, ``most`` at the most; with that many bits
fewer than one key in a hundred passes that was never put in. Beyond ``most`` blocks it lets more pass, and never
fewer: who probes it must treat a pass as a maybe. A filter of ``most`` blocks has 32 MB, the bound of what is sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

MARKS = 4
MOST = 1 << 19


def blocks_for(keys: int, most: int = MOST) -> int:
    """How many blocks of 512 bits ``keys`` keys need."""
    blocks = 1
    while blocks * 32 < keys and blocks < most:
        blocks *= 2
    return blocks


class Sieve:
    """Holds the keys of ``rows(key)``; ``probed`` adds whether a row's key may be among them."""

    def __init__(self, rows: DataFrame, key: str, most: int = MOST):
        self.key = key
        self.blocks = blocks_for(rows.count(), most)
        bits = rows.select(self.block().alias("__block"), F.explode(F.array(*self.bits())).alias("bit"))
        word = lambda k: F.coalesce(F.bit_or(F.when(F.shiftright("bit", 6) == k, F.expr("shiftleft(1L, int(bit & 63))"))), F.lit(0).cast("long"))
        self.table = cut(bits.groupBy("__block").agg(*[word(k).alias(f"__w{k}") for k in range(8)]), "sieve")

    def block(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.blocks))

    def bits(self) -> list[Column]:
        other = F.xxhash64(F.lit(17), F.col(self.key))
        return [F.shiftright(other, 9 * k).bitwiseAND(511).cast("int") for k in range(MARKS)]

    def probed(self, rows: DataFrame, name: str = "hit") -> DataFrame:
        out = rows.withColumn("__block", self.block()).join(F.broadcast(self.table), "__block", "left")
        found = None
        for bit in self.bits():
            at = F.shiftright(bit, 6)
            word = F.col("__w7")
            for k in range(6, -1, -1):
                word = F.when(at == k, F.col(f"__w{k}")).otherwise(word)
            one = F.getbit(word, bit.bitwiseAND(63)) == 1
            found = one if found is None else found & one
        return out.withColumn(name, F.coalesce(found, F.lit(False))).drop("__block", *[f"__w{k}" for k in range(8)])

    def clear(self) -> None:
        drop(self.table)
