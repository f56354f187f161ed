"""A bit filter over ids, to choose rows of a large table without shuffling them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.shared import free_name, run_once

#: Bits of the filter, at most: 16 MB are broadcast. Beyond a few hundred million ids more rows pass; none is lost.
MOST_BITS = 1 << 27


class IdFilter:
    """Holds a bit for the hash of each id of a one-column table; what has no bit is not among them."""

    def __init__(self, ids: DataFrame):
        self.ids = ids
        (self.column,) = ids.columns
        with run_once(ids.sparkSession):
            count = ids.count()
            self.bits = min(MOST_BITS, max(1 << 10, 1 << (8 * count).bit_length()))
            words = ids.groupBy(F.expr(f"shiftright(pmod(xxhash64({self.column}), {self.bits}), 6)").alias("w")).agg(
                F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({self.column}), {self.bits}) % 64 as int))")).alias("v")
            )
            got = words.toArrow()  # at most MOST_BITS / 64 rows
        table = np.zeros(self.bits // 64, dtype=np.int64)
        table[got["w"].to_numpy()] = got["v"].to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(table)

    def slot(self, column: Column) -> Column:
        """The place of an id's bit; -1 for a null id."""
        return F.when(column.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(column.cast("long")), F.lit(self.bits))).cast("long")

    @staticmethod
    def hits(table: np.ndarray, slots: pa.Array) -> np.ndarray:
        """Which slots have a bit in the broadcast table."""
        at = slots.to_numpy(zero_copy_only=False)
        known = at >= 0
        at = np.maximum(at, 0)
        return known & (((table[at >> 6] >> (at & 63)) & 1) == 1)

    def rows(self, df: DataFrame, column: str, hit: bool) -> DataFrame:
        """The rows of df, all columns, whose id has a bit (hit) or has none; null ids have none."""
        shared, names = self.shared, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = IdFilter.hits(shared.value, batch.columns[-1])
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(found == hit))

        return df.select("*", self.slot(df[column]).alias(free_name(df, "_slot"))).mapInArrow(run, df.schema)

    def without(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df whose id is not among the ids. Only rows with a bit are joined."""
        sure = self.rows(df, column, False)
        maybe = self.rows(df, column, True)
        return sure.unionByName(maybe.join(self.ids, maybe[column] == self.ids[self.column], "left_anti"))
