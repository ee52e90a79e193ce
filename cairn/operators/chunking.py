"""Content-addressed chunking: route, cut, digest, deduplicate, store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import digests, numbers


def route(entries: DataFrame, size: str = "size", cutoff: int = numbers.INLINE_FILE) -> DataFrame:
    """small files are kept inline, others are cut."""
    return entries.withColumn("route", F.when(numbers.is_inline(F.col(size), cutoff), "inline").otherwise("chunked"))


def cut(entries: DataFrame, keys: list[str], payload: str = "payload", piece: int | Callable[[Column], Column] = 1 << 16) -> DataFrame:
    """Keys, seq, offset, chunk_size, data, digest: payload cut at multiples of piece (a size, or an
    expression of the payload's size). One row becomes one row per chunk; nothing is shuffled."""
    size = F.octet_length(payload).cast("long")
    step = F.lit(piece).cast("long") if isinstance(piece, int) else piece(size).cast("long")
    d = entries.select(*keys, F.col(payload).alias("payload_"), size.alias("size_"), step.alias("step_")).filter("size_ > 0")
    # the pieces are cut before the rows are made, so that no row carries the whole payload
    places = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size_") - 1) / F.col("step_")))
    pieces = F.transform(places, lambda i: F.struct(i.alias("seq"), (i * F.col("step_")).alias("offset"), F.substring("payload_", (i * F.col("step_") + 1).cast("int"), F.col("step_").cast("int")).alias("data")))
    d = d.select(*keys, F.explode(pieces).alias("piece_")).select(*keys, "piece_.*")
    return d.withColumn("chunk_size", F.octet_length("data").cast("long")).withColumn("digest", digests.digest(F.col("data")))


def put_if_absent(chunks: DataFrame, store: DataFrame | None, key: str = "digest") -> DataFrame:
    """One row for each key that the store lacks; these are what a write adds."""
    new = chunks.dropDuplicates([key])
    return new if store is None else new.join(store.select(key), key, "left_anti")


def build_stats(chunks: DataFrame, store: DataFrame, manifest: str = "package") -> DataFrame:
    """What building these manifests reads and what it adds to the store: one pass per digest, one over digests."""
    per = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("all_"), F.max("chunk_size").alias("one_"))
    per = per.join(store.select("digest", F.lit(True).alias("old_")).distinct(), "digest", "left")
    new = F.col("old_").isNull()
    sums = per.agg(F.sum("n").alias("total_chunks"), F.sum("all_").alias("total_bytes"), F.count_if(new).alias("new_chunks"), F.coalesce(F.sum(F.when(new, F.col("one_"))), F.lit(0)).alias("new_bytes"))
    return beside(chunks.agg(F.count_distinct(manifest).alias("manifests")), sums)


def beside(*one_row: DataFrame) -> DataFrame:
    """The columns of frames of one row each, in one row."""
    out = one_row[0]
    for d in one_row[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def first_seen(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the place where each was first seen."""
    return rows.groupBy(value).agg(F.min(F.struct(*order)).alias("first")).select(value, "first.*")


def shard_of(chunks: DataFrame, order: list[str], n: int) -> DataFrame:
    """Shard by global chunk ordinal."""
    from .ordered import running_total

    return running_total(chunks, order, F.lit(1), "ordinal").withColumn("shard", F.col("ordinal") % n)


def reassembled(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The payload back from its chunks, in order, with its SHA-256."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "data")))
    d = chunks.groupBy(*keys).agg(parts.alias("parts_"))
    # joined as hex: one copy, where appending chunk by chunk copies the payload for each
    whole = F.unhex(F.array_join(F.transform("parts_", lambda p: F.hex(p["data"])), ""))
    d = d.select(*keys, F.size("parts_").alias("n_chunks"), whole.alias("payload"))
    return d.select(*keys, "n_chunks", F.sha2("payload", 256).alias("sha256"), "payload")


def walk(entries: DataFrame, default_shift: int = 16) -> DataFrame:
    """Every digest of every entry with its size; entries without digests give none. An entry's
    chunk_shift of 0 stands for the default."""
    shift = numbers.or_default(F.col("chunk_shift"), F.lit(default_shift))
    d = entries.select("*", F.posexplode("digests").alias("idx", "digest"))
    piece = F.pow(F.lit(2), shift).cast("long")
    return d.withColumn("chunk_size", F.least(piece, F.col("size") - F.col("idx") * piece))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("row_")).select(*keys, "row_.*")


def batches(rows: DataFrame, order: list[str], size: int, n_buckets: int | None = None) -> DataFrame:
    """Rows in batches of a size."""
    from .ordered import running_total

    return running_total(rows, order, F.lit(1), "ordinal", n_buckets).withColumn("batch", F.floor(F.col("ordinal") / size))
