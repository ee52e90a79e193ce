"""Queries of the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, numbers, text
from ..operators import packing, slab as sl
from ..streaming import events as ev
from .adapters import ARCHIVES, CATALOG, CHUNKS, IMAGES, PATHS, catalog, chunks, events, images, page_archives, store_paths, table
from .registry import query
from .source_queries import scratch


@query("K03_build_roots", "SELECT 'build@' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '@r' || o_custkey || '@c' AS key, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def k03(spark, d):
    """Records are appended by year and read again."""
    o = table(spark, d, "orders")
    key = F.concat(F.lit("build@"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("@r"), F.col("o_custkey").cast("string"), F.lit("@c"))
    folder = scratch(spark, "roots")
    o.groupBy(key.alias("key"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).write.mode("append").partitionBy("year").parquet(folder)
    return spark.read.parquet(folder).select("key", "n", "keys")


@query("K15_memory_store", f"WITH {CHUNKS} SELECT digest, max(chunk_size) AS chunk_size FROM chunks WHERE doc_id % 5 = 0 GROUP BY digest")
def k15(spark, d):
    """A store that lives only as long as the session: a view."""
    chunks(spark, d).filter("doc_id % 5 = 0").groupBy("digest").agg(F.max("chunk_size").alias("chunk_size")).createOrReplaceTempView("memory_store")
    return spark.table("memory_store")


@query("K15_memory_store_all")
def k15_all(spark, d):
    """K15 with all chunks in the store."""
    chunks(spark, d).groupBy("digest").agg(F.max("chunk_size").alias("chunk_size")).createOrReplaceTempView("memory_store_all")
    return spark.table("memory_store_all")


@query("F22_keep_list", f"WITH {CATALOG} SELECT name, 'root' AS list, count(*) AS n FROM catalog GROUP BY 1 UNION ALL SELECT name, 'build', count(*) FROM catalog WHERE name NOT LIKE '%red%' GROUP BY 1")
def f22(spark, d):
    """The root keeps everything; what is built leaves some packages out."""
    c = catalog(spark, d)
    count = lambda x, name: x.groupBy("name").agg(F.count("*").alias("n")).select("name", F.lit(name).alias("list"), "n")
    return count(c, "root").unionByName(count(c.filter(~F.col("name").contains("red")), "build"))


@query("J19_rendezvous", f"WITH {IMAGES} SELECT event_id, image, state FROM events JOIN images ON image = event_id % 1000 WHERE event_type = 'view'")
def j19(spark, d):
    """Messages meet the requests that wait for them, by key (on a stream: a stream-static join)."""
    e = events(spark, d).filter("event_type = 'view'").select("event_id", (F.col("event_id") % 1000).alias("image"))
    return e.join(images(spark, d).select("image", "state"), "image").select("event_id", "image", "state")


@query("U05_union", "SELECT 'channel' AS source, count(*) AS n FROM part UNION ALL SELECT 'repository', count(*) FROM orders UNION ALL SELECT 'signal', count(*) FROM events WHERE event_type = 'signup'")
def u05(spark, d):
    tagged = lambda x, k: x.select(F.lit(k).alias("source"))
    all_ = tagged(table(spark, d, "part"), "channel").unionByName(tagged(table(spark, d, "orders"), "repository")).unionByName(tagged(events(spark, d).filter("event_type = 'signup'"), "signal"))
    return all_.groupBy("source").agg(F.count("*").alias("n"))


@query("T11_restored", "SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, {'t': ts, 'e': event_id}) = 'view'")
def t11(spark, d):
    """What a restart mounts again: keys whose last state is Mounted."""
    return ev.states(events(spark, d), "user_id", ["ts", "event_id"]).filter("state = 'Mounted'").select("user_id")


@query("T09_retry", "SELECT o_orderkey, o_orderkey % 600 IN (502, 503, 504) OR o_orderkey % 7 = 0 AS retry FROM orders")
def t09(spark, d):
    """Asked again: no answer at all, or one of three server states."""
    code = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 600)
    return table(spark, d, "orders").select("o_orderkey", numbers.retryable(code).alias("retry"))


@query("X15_log_line", "SELECT o_orderkey, printf('%s: %d chunks, %d bytes', o_orderstatus, o_custkey, floor(o_totalprice)::BIGINT) AS line FROM orders")
def x15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("%s: %d chunks, %d bytes", "o_orderstatus", "o_custkey", F.floor("o_totalprice")).alias("line"))


@query("H08_fingerprint", f"WITH {PATHS} SELECT p_partkey, '1;' || path || ';sha256:' || sha256(name) || ';' || p_partkey * 7 || ';/store/a,/store/b' AS fingerprint FROM paths")
def h08(spark, d):
    """The text that a signature signs (signatures themselves are out of scope)."""
    refs = F.array_join(F.transform(F.array(F.lit("a"), F.lit("b")), lambda r: F.concat(F.lit("/store/"), r)), ",")
    hashed = F.concat(F.lit("sha256:"), F.sha2(F.col("name").cast("binary"), 256))
    return store_paths(spark, d).select("p_partkey", F.concat_ws(";", F.lit("1"), "path", hashed, (F.col("p_partkey") * 7).cast("string"), refs).alias("fingerprint"))


_ALLOTTED = f"""{CHUNKS}, n AS (SELECT digest, min({{'d': doc_id, 's': seq}}) AS f, arg_min((chunk_size + 63) // 64, {{'d': doc_id, 's': seq}}) AS blocks FROM chunks GROUP BY digest),
s AS (SELECT digest, blocks, coalesce(sum(blocks) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n)"""


@query("G11_reserve_and_place", f"WITH {_ALLOTTED} SELECT digest, (before // 49740)::INT AS slab_id, before % 49740 + 4 AS addr, blocks::BIGINT AS blocks FROM s")
def g11(spark, d):
    """Local files are cut, digested and given places in the order they are first met; copies share a place."""
    c = chunks(spark, d).select("doc_id", "seq", "digest", F.ceil(F.col("chunk_size") / 64).alias("blocks"))
    return sl.allocate(c, ["doc_id", "seq"], slab_blocks=50_000)


@query("W10_write_batches", f"WITH {_ALLOTTED} SELECT digest, before // 1000 AS batch FROM s")
def w10(spark, d):
    c = chunks(spark, d).groupBy("digest").agg(F.min(F.struct("doc_id", "seq", F.ceil(F.col("chunk_size") / 64).alias("blocks"))).alias("f")).select("digest", "f.*")
    return packing.write_batches(c, ["doc_id", "seq"], F.col("blocks")).select("digest", "batch")


@query("W09_first_fit")
def w09(spark, d):
    """Rows only (a fold with look-back); tested against a plain loop."""
    o = table(spark, d, "orders").withColumn("bytes", F.col("o_orderkey") % 1500 + 32)
    return packing.first_fit(o, "o_custkey", "o_orderkey", "bytes")


@query("G21_archive_manifests", f"""WITH {ARCHIVES}, n AS (SELECT page_id, archive, CASE WHEN page_id % 7 = 5 THEN 'nixexprs-nixos-25.11.' || page_id ELSE regexp_replace(regexp_replace(regexp_replace(list_last(string_split(archive, '/')), '\\.gz$', ''), '\\.xz$', ''), '\\.tar$', '') END AS name FROM archives),
k AS (SELECT *, 'v1-' || substr(translate(to_base64(unhex(sha256('archives' || chr(10) || 'u=' || archive || chr(10) || 'm=tarball' || chr(10) || 'e=' || name || chr(10) || 'p=16:sha256:192' || chr(10)))), '+/', '-_'), 1, 36) AS key FROM n)
SELECT page_id, name, key, page_id % 3 <> 0 AS build FROM k""")
def g21(spark, d):
    """Addresses to names and request keys; those with a stored answer are not built again."""
    a = page_archives(spark, d).withColumn("name", text.archive_name(F.col("archive")))
    a = a.withColumn("key", digests.cache_key("archives", F.col("archive"), F.lit(None).cast("string"), F.col("name")))
    stored = a.filter("page_id % 3 = 0").select("key", F.lit(True).alias("hit"))
    return a.join(stored, "key", "left").select("page_id", "name", "key", F.col("hit").isNull().alias("build"))


@query("S20_messages", "SELECT event_id % 3 AS kind, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def s20(spark, d):
    """A stream of messages, as micro-batches, into a table; then counted by kind."""
    out, progress = scratch(spark, "messages"), scratch(spark, "progress")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select((F.col("event_id") % 3).alias("kind"), "user_id")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("keys"))
