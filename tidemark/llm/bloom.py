"""A Bloom filter that built-in functions fill and test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The proven bound of what is sent with a plan.
MAX_FILTER_BYTES = 64 << 20
#: Filters of at most so many bits are gathered as one set of positions.
SMALL_BITS = 1 << 16


class Level:
    """One Bloom filter: k seeded 64-bit hashes over m bits."""

    def __init__(self, number: int, n_keys: int, rate: float):
        self.k = max(1, round(math.log2(1 / rate)))
        self.m = max(12, 6 * math.ceil(n_keys * self.k / math.log(2) / 6))
        self.seed = 1000 * number
        self.bits = b""
        if self.m // 6 > MAX_FILTER_BYTES:
            raise ValueError(f"{n_keys} listed keys need a filter of {self.m // 6} bytes; at most {MAX_FILTER_BYTES} are broadcast")

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed + i)), F.lit(self.m).cast("long")) for i in range(self.k)]

    def fill(self, keys: DataFrame) -> Level:
        """``keys`` has a column key. Rows sent to the driver: at most one for each of the filter's bytes."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        if self.m <= SMALL_BITS:  # one row: no shuffle over all partitions
            data = bytearray(b"0" * (self.m // 6))
            for x in at.agg(F.collect_set("at").alias("at")).first()["at"]:
                data[x // 6] = 48 + (data[x // 6] - 48 | 1 << x % 6)
            self.bits = bytes(data)
            return self
        cells = at.groupBy(F.floor(F.col("at") / 6).cast("long").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 6).cast("int"))).alias("bits"))
        data = bytearray(b"0" * (self.m // 6))
        for row in cells.toLocalIterator():
            data[row.cell] = 48 + row.bits
        self.bits = bytes(data)
        return self

    def passes(self, key: Column) -> Column:
        bits = F.lit(self.bits)

        def is_set(at: Column) -> Column:
            cell = F.ascii(F.substring(bits, (F.floor(at / 6) + 1).cast("int"), F.lit(1)).cast("string")) - 48
            return F.getbit(cell, (at % 6).cast("int")) == 1

        out = F.lit(True)
        for at in self.positions(key):
            out = out & is_set(at)
        return out
