"""Introspection: each section is a plan of its own, made only when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slab import chunk_blocks


def introspect(slab: DataFrame, ends: DataFrame, sections: list[str]) -> DataFrame:
    """(what, n) of the sections."""
    make = {
        "chunks": lambda: slab.agg(F.count("*").alias("n")),
        "present": lambda: slab.filter("present").agg(F.count("*").alias("n")),
        "slabs": lambda: ends.agg(F.count("*").alias("n")),
        "blocks": lambda: chunk_blocks(slab.drop("blocks"), ends).agg(F.sum("blocks").alias("n")),
    }
    out = None
    for s in sections:
        d = make[s]().select(F.lit(s).alias("what"), "n")
        out = d if out is None else out.unionByName(d)
    return out
