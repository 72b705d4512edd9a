"""Gapless numbers for rows, without one task that sees them all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_number(stored: DataFrame, column: str) -> int:
    """One more than the largest stored number; 1 where there is none."""
    return stored.agg(F.coalesce(F.max(column), F.lit(0)) + 1).first()[0]


def gapless(rows: DataFrame, order: list[str], folder: str, start: int = 1, name: str = "number") -> DataFrame:
    """``rows`` plus ``name``: ``start``, ``start`` + 1, ... by ``order``, which should tell rows apart; the same on every run.

    Rows are cut into ranges of ``order``, sorted and written below ``folder`` with their place in the range. The ranges' sizes, one row each,
    give every range its offset. No window runs over all rows.
    """
    path = f"{folder.rstrip('/')}/numbered-{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = rows.sparkSession.read.schema(placed.schema).parquet(path).withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_at") + F.lit(start)).select(*rows.columns, name)
