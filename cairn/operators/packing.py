"""Packing of small items, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import fold, running_total


def first_fit(rows: DataFrame, group: str, order: str, size: str, room: int = 4096, look_back: int = 16) -> DataFrame:
    """Each item of a group, in order, goes into the first of the last `look_back` blocks that has room for
    it, else into a new block. Each choice depends on the ones before, so a group (a directory) is one fold; it
    holds only the room left in those blocks."""

    def step(state: tuple, wanted: int) -> tuple[tuple, int]:
        gone, free = state  # blocks that are out of sight, and what is free in the others
        at = next((i for i, left in enumerate(free) if left >= wanted), len(free))
        if at == len(free):
            free = (*free, room)
        free = (*free[:at], free[at] - wanted, *free[at + 1 :])
        block = gone + at
        over = max(0, len(free) - look_back)
        return (gone + over, free[over:]), block

    return fold(rows, group, order, F.least(F.col(size).cast("long"), F.lit(room)), "long", (0, ()), step, "block")


def write_batches(rows: DataFrame, order: list[str], blocks: Column, most: int = 1000) -> DataFrame:
    """Batches of about `most` blocks, by the blocks written before."""
    return running_total(rows, order, blocks, "before").withColumn("batch", F.floor(F.col("before") / most))
