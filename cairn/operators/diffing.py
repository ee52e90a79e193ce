"""Differences of chunk series, as a server makes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from .chunking import reassembled


def served(requests: DataFrame, store: DataFrame) -> DataFrame:
    """For requests(request, part, expand, bases, wanted), whose parts give digests of a base and of what is wanted, and whether
    ('gz', 'xz') both are unpacked first (null: not): a row per request with its statistics, the length of each part's
    wanted data, the base data, and the patch that makes all wanted data, end to end, from all base data.

    store(digest, data) has each digest once; a digest that it lacks raises. No digests are no data. A request is bounded by
    the limits of planning (chunks and bytes), so that it fits a row; its chunks are joined by digest."""
    digests = F.array(F.struct(F.lit("base").alias("side"), F.col("bases").alias("digests")), F.struct(F.lit("wanted").alias("side"), F.col("wanted").alias("digests")))
    sides = requests.select("request", "part", "expand", F.inline(digests))
    chunks = sides.select("request", "part", "side", F.posexplode("digests").alias("seq", "digest")).join(store.select("digest", F.col("data").alias("data_")), "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no chunk "), F.col("digest"))).cast("binary")
    chunks = chunks.withColumn("data", F.when(F.col("data_").isNotNull(), F.col("data_")).otherwise(lost))
    whole = reassembled(chunks, ["request", "part", "side"]).drop("sha256")
    data = sides.drop("digests").join(whole, ["request", "part", "side"], "left")
    data = data.withColumn("data", F.coalesce(codecs.unpacked(F.col("expand"), F.col("payload")), F.lit(b"")))
    side = lambda name: F.col("side") == name
    ordered = lambda name: F.array_sort(F.collect_list(F.when(side(name), F.struct("part", "data"))))
    count = lambda name: F.coalesce(F.sum(F.when(side(name), F.col("n_chunks"))), F.lit(0))
    d = data.groupBy("request").agg(F.count_if(side("base") & F.col("expand").isNotNull()).alias("expands"), count("base").alias("base_chunks"), count("wanted").alias("wanted_chunks"), ordered("base").alias("b_"), ordered("wanted").alias("w_"))
    joined = lambda parts: F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["data"])), ""))
    d = d.withColumns({"lengths": F.transform("w_", lambda p: F.octet_length(p["data"])), "base_data": joined("b_"), "wanted_data": joined("w_")})
    d = d.withColumns({"base_bytes": F.octet_length("base_data").cast("long"), "wanted_bytes": F.octet_length("wanted_data").cast("long"), "patch": codecs.make_patch(F.col("base_data"), F.col("wanted_data"))})
    return d.select("request", "expands", "base_chunks", "wanted_chunks", "base_bytes", "wanted_bytes", F.octet_length("patch").alias("diff_bytes"), "lengths", "base_data", "patch")
