"""Address space: slabs of blocks that chunks are allotted in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .ordered import running_total

RESERVED, SLAB_BLOCKS, MANIFEST_SLAB, BLOCK = 4, 1 << 28, 10_000, 4096


def allocate(rows: DataFrame, order: list[str], blocks: str = "blocks", slab_blocks: int = SLAB_BLOCKS, taken: int = RESERVED, widest: int = 256) -> DataFrame:
    """Addresses by prefix sum over first occurrences of digests (order: unique, its first column
    numeric); a repeated digest has the address of its first. A slab takes chunks that start in all but its last
    `widest` blocks (the widest chunk), so none crosses its end; then the next slab follows."""
    own = [c for c in order if c != "digest"]
    first = rows.groupBy("digest").agg(F.min(F.struct(*own, blocks)).alias("f")).select("digest", "f.*")
    room = slab_blocks - taken - widest
    d = running_total(first, [*order], F.col(blocks), "before")
    return d.select("digest", F.floor(F.col("before") / room).cast("int").alias("slab_id"), (F.col("before") % room + taken).alias("addr"), F.col(blocks).cast("long").alias("blocks"))


def _next(slab: DataFrame, at, name: str, width: int = 1 << 16) -> DataFrame:
    """Adds, to each address, the next greater one of its slab that `at` gives (null where it gives none). Addresses
    are cut into ranges: a window works inside each, and the ranges' first values (one row each) are looked up behind it, so
    that a slab of any size is many tasks' work."""
    d = slab.withColumn("range_", F.floor(F.col("addr") / width)).withColumn("at_", at)
    inside = W.partitionBy("slab_id", "range_").orderBy(F.col("addr").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("slab_id").orderBy(F.col("range_").desc()).rowsBetween(W.unboundedPreceding, -1)
    firsts = d.groupBy("slab_id", "range_").agg(F.min("at_").alias("first_")).select("slab_id", "range_", F.last("first_", ignorenulls=True).over(later).alias("beyond_"))
    d = d.withColumn("near_", F.last("at_", ignorenulls=True).over(inside)).join(firsts, ["slab_id", "range_"])
    return d.withColumn(name, F.coalesce("near_", "beyond_")).drop("range_", "at_", "near_", "beyond_")


def chunk_blocks(slab: DataFrame, ends: DataFrame) -> DataFrame:
    """A chunk's blocks reach to the next address; the last one's to the slab's end."""
    d = _next(slab, F.col("addr"), "next_").join(ends, "slab_id", "left")
    return d.withColumn("blocks", F.coalesce("next_", "slab_end") - F.col("addr")).drop("next_", "slab_end")


def slab_stats(sized: DataFrame) -> DataFrame:
    """Per slab chunks, blocks, those present, and how many chunks have so many blocks."""
    sizes = sized.groupBy("slab_id", "blocks").agg(F.count("*").alias("n"), F.count_if("present").alias("here"))
    totals = [F.sum("n").alias("chunks"), F.sum(F.col("n") * F.col("blocks")).alias("total_blocks"), F.sum("here").alias("present_chunks"), F.sum(F.col("here") * F.col("blocks")).alias("present_blocks")]
    histogram = F.array_sort(F.collect_list(F.struct("blocks", "n")))
    return sizes.groupBy("slab_id").agg(*totals, F.to_json(F.map_from_entries(histogram)).alias("histogram"))


def freed_ranges(slab: DataFrame, ends: DataFrame, dead: str = "dead") -> DataFrame:
    """Each dead chunk's range reaches to the next chunk that lives (or the slab's end); of those with
    the same end the first is the range."""
    d = _next(slab, F.when(~F.col(dead), F.col("addr")), "end")
    d = d.filter(dead).join(ends, "slab_id", "left").withColumn("end", F.coalesce("end", "slab_end"))
    return d.groupBy("slab_id", "end").agg(F.min("addr").alias("addr"))


def punched(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Number of ranges and their bytes."""
    return ranges.agg(F.count("*").alias("punch_locs"), F.coalesce(F.sum((F.col("end") - F.col("addr")) * block), F.lit(0)).alias("punch_bytes"))


def locate(reads: DataFrame, sized: DataFrame, widest: int = 256) -> DataFrame:
    """The chunk that holds each read address. Chunks have at most `widest` blocks, so each lies in two
    buckets of that width at most: an equi-join on (slab, bucket) with a range filter, no global order."""
    first, last = F.floor(F.col("addr") / widest), F.floor((F.col("addr") + F.col("blocks") - 1) / widest)
    chunks = sized.select("slab_id", F.col("addr").alias("chunk_addr"), "blocks", "digest", F.explode(F.sequence(first, last)).alias("bucket_"))
    d = reads.withColumn("bucket_", F.floor(F.col("addr") / widest)).join(chunks, ["slab_id", "bucket_"])
    return d.filter((F.col("addr") >= F.col("chunk_addr")) & (F.col("addr") < F.col("chunk_addr") + F.col("blocks"))).drop("bucket_")
