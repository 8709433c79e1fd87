"""Bounded choices of rows that merge in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bottom_k(rows: DataFrame, group: list[str], order: list[Column | str], k: int, fans: tuple[int, ...] = (4096, 64)) -> DataFrame:
    """The ``k`` rows of least ``order`` of every group, all columns kept.

    Each task first keeps its own k rows of a group; then the tasks' rows meet in ``fans`` slots, level by level, and in the end the last level's
    survivors meet: at most ``fans[-1] * k`` rows of a group come together, however many tasks and rows there are. Which slot a task's rows take doesn't matter to the result.
    """
    place, slot = "bottom_place", "bottom_slot"
    cut = lambda frame, keys: frame.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k).drop(place)
    out = rows
    for fan in fans:
        out = cut(out.withColumn(slot, F.spark_partition_id() % fan), [*group, slot]).drop(slot)
    return cut(out, group)
