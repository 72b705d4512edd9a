"""A bit table of ids, built on the executors and of bounded size, that lets a scan leave out most rows before a shuffle.

A hit may be false, a miss never is; callers join afterwards. Beyond ``MAX_BITS`` bits more hits are false,
which costs shuffle but no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BITS = 1 << 27  # 16 MiB
SLOTS, SLOTS_AT_ONCE = 1024, 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def id_filter(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """``ids``: one long column. Gives a function from an array of ids to a mask of possible members."""
    spark = ids.sparkSession
    bits, wanted = 1 << 16, min(MAX_BITS, 8 * ids.count())
    while bits < wanted:
        bits *= 2
    width = bits // SLOTS // 8
    schema = "slot int, bits binary"

    def batches_of(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        items = list(tables.items())
        for low in range(0, len(items), SLOTS_AT_ONCE):
            part = items[low : low + SLOTS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([t.tobytes() for _, t in part], pa.binary())], ["slot", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(table, at >> 3, (0x80 >> (at & 7)).astype(np.uint8))
        rows = table.reshape(SLOTS, width)
        yield from batches_of({int(k): rows[k] for k in np.flatnonzero(rows.any(1))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tables.setdefault(slot, np.zeros(width, np.uint8))[:] |= np.frombuffer(part.as_py(), np.uint8)
        yield from batches_of(tables)

    table = np.zeros(bits // 8, np.uint8)
    for slot, part in ids.mapInArrow(mark, schema).repartition(16, "slot").mapInArrow(merge, schema).collect():  # bits / 8 bytes
        table[slot * width : (slot + 1) * width] = np.frombuffer(part, np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def mask(values: np.ndarray) -> np.ndarray:
        at = (mix(values.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
        return ((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)

    return mask
