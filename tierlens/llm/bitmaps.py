"""Bit maps of bounded size that tell for sure what can't be in a table, or can't be there twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a map.  A fuller map lets more pass that a join drops later; it changes no result.
BITS = 1 << 26
#: Bytes of a map that tasks hand on together.
BLOCK = 1 << 16

PARTS = "block long, once binary, twice binary"


def test(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place's bit is set."""
    return (bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Seen:
    """Which of the values that a task saw came once or more, and twice or more, by their low bits."""

    def __init__(self):
        self.once, self.twice = np.zeros(BITS >> 3, np.uint8), np.zeros(BITS >> 3, np.uint8)

    def add(self, values: np.ndarray) -> None:
        place, n = np.unique(values & np.uint64(BITS - 1), return_counts=True)
        again = place[(n > 1) | test(self.once, place)]
        for bits, some in ((self.twice, again), (self.once, place)):
            np.bitwise_or.at(bits, (some >> np.uint64(3)).astype(np.int64), np.left_shift(1, some & np.uint64(7)).astype(np.uint8))

    def parts(self) -> pa.RecordBatch:
        once, twice = self.once.reshape(-1, BLOCK), self.twice.reshape(-1, BLOCK)
        some = np.flatnonzero(once.any(1))
        return pa.RecordBatch.from_arrays(
            [pa.array(some), *[pa.array([bits[b].tobytes() for b in some], pa.binary()) for bits in (once, twice)]], names=["block", "once", "twice"]
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts of all tasks, block by block: a value that two tasks saw once came twice."""
    block = once = twice = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([twice.tobytes()], pa.binary())], names=["block", "twice"])

    for batch in batches:
        for b, o, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
            if b != block:
                if block is not None:
                    yield done()
                block, once, twice = b, o, t
            else:
                once, twice = once | o, twice | t | (once & o)
    if block is not None:
        yield done()


def seen_twice(parts: DataFrame) -> np.ndarray:
    """The map of values that came twice or more over all tasks' Seen.parts."""
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block long, twice binary").toArrow()
    out = np.zeros(BITS >> 3, np.uint8)
    for block, twice in zip(merged["block"].to_pylist(), merged["twice"].to_pylist()):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(twice, np.uint8)
    return out


def row_places(rows: np.ndarray) -> np.ndarray:
    """Place of a row number (partition and place in it) in a map; _row_place is the same for a column."""
    rows = rows.astype(np.uint64)
    return (rows ^ ((rows >> np.uint64(33)) * np.uint64(0x9E3779B1))) & np.uint64(BITS - 1)


def _row_place(row: Column) -> Column:
    return row.bitwiseXOR(F.shiftrightunsigned(row, 33) * F.lit(0x9E3779B1)).bitwiseAND(F.lit(BITS - 1))


def of_rows(rows: DataFrame, column: str) -> np.ndarray:
    """The map of a column of row numbers."""
    place = _row_place(F.col(column))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    filled = rows.select(F.shiftright(place, 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)
