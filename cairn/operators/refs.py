"""Who refers to which chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sharing_histogram(chunks: DataFrame, owner: str, digest: str = "digest") -> DataFrame:
    """How many chunks have so many owners. Two aggregations; owners of a chunk are counted, not gathered."""
    owners = chunks.select(digest, owner).distinct().groupBy(digest).agg(F.count("*").alias("n_owners"))
    return owners.groupBy("n_owners").agg(F.count("*").alias("n_chunks"))


def ordered_refs(chunks: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """A chunk's owners in the order of arrival, each once."""
    first = chunks.groupBy("digest", owner).agg(F.min(F.struct(*order)).alias("first"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(owner).alias("owner")))), lambda r: r["owner"])
    return first.groupBy("digest").agg(refs.alias("refs"))


def image_stats(chunks: DataFrame, present: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Chunks and blocks, in all and present, per image (or image and path)."""
    d = chunks.join(present.select("digest", F.lit(True).alias("here_")).distinct(), "digest", "left")
    blocks, here = F.ceil(F.col("chunk_size") / block), F.col("here_").isNotNull()
    return d.groupBy(*keys).agg(F.count("*").alias("total_chunks"), F.sum(blocks).alias("total_blocks"), F.count_if(here).alias("present_chunks"), F.coalesce(F.sum(F.when(here, blocks)), F.lit(0)).alias("present_blocks"))


def located(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """Strict lookup; a digest without a location raises."""
    d = chunks.join(locations, "digest", "left")
    return d.withColumn("addr", F.when(F.col("addr").isNotNull(), F.col("addr")).otherwise(F.raise_error(F.concat(F.lit("no location of "), F.col("digest"))).cast("long")))


def named_refs(refs: DataFrame, catalog: DataFrame, prefix: int = 20) -> DataFrame:
    """Names of back-references that keep only the first hex digits of a hash; of several hashes with
    these digits the least counts. Without a name: null."""
    first = catalog.groupBy(F.substring("sph", 1, prefix).alias("prefix")).agg(F.min_by("name", "sph").alias("name"))
    return refs.join(first, "prefix", "left")


def kept_refs(refs: DataFrame, keep: DataFrame, owner: str = "owner") -> DataFrame:
    """Which references stay (their owner is kept), and whether the chunk's list must be rewritten."""
    d = refs.join(keep.select(owner, F.lit(True).alias("keep_")).distinct(), owner, "left")
    kept = F.count_if(F.col("keep_").isNotNull())
    return d.groupBy("digest").agg(F.count("*").alias("n_refs"), kept.alias("n_kept")).withColumn("rewrite", F.col("n_kept") < F.col("n_refs"))
