"""Queries of records kept in step, logs of work, and look-ups that meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat, gc, planning
from ..operators.worklog import WorkLog
from .adapters import CATALOG, IMAGES, SLAB_ENDS, catalog, events, image_chunks, images, slab_and_ends, table
from .registry import query
from .relational_queries import _FREED, freed
from .source_queries import scratch


@query("K02_answers", """WITH b AS (SELECT 'v1-' || doc_id % 700 AS key, CASE WHEN doc_id % 5 > 0 THEN 'etag-' || substr(sha256(coalesce(text, '')), 1, 12) END AS alias, sha256(coalesce(text, '')) AS digest, doc_id FROM documents),
r AS (SELECT key, digest FROM b UNION ALL SELECT alias, digest FROM b WHERE alias IS NOT NULL) SELECT key, min(digest) AS digest FROM r WHERE key NOT IN (SELECT key FROM b WHERE doc_id % 3 = 0) GROUP BY key""")
def k02(spark, d):
    """Answers under their request's key and under the alias of what was fetched, unless they are there."""
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    b = table(spark, d, "documents").select("doc_id", F.concat(F.lit("v1-"), (F.col("doc_id") % 700).cast("string")).alias("key"), sha.alias("digest"))
    b = b.withColumn("alias", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("etag-"), F.substring("digest", 1, 12))))
    return cat.answers(b, b.filter("doc_id % 3 = 0"))


_UPSERTS = f"""{CATALOG}, u AS (SELECT lpad((p_partkey % 150)::VARCHAR, 4, '0') AS sph, CASE WHEN p_partkey % 4 = 0 THEN 'M/' ELSE '' END || name AS name, p_partkey FROM catalog),
l AS (SELECT sph, arg_max(name, p_partkey) AS name FROM u GROUP BY sph)"""


@query("K06_two_indexes", f"""WITH {_UPSERTS} SELECT 'name' AS "index", name || '/' || sph AS key, '' AS value FROM l UNION ALL SELECT 'sph', sph, name FROM l""")
def k06(spark, d):
    """The catalog by name and by hash, manifests in their own namespace, after upserts over what is stored."""
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "M/").otherwise(""), F.col("name"))
    u = catalog(spark, d).select("p_partkey", F.lpad((F.col("p_partkey") % 150).cast("string"), 4, "0").alias("sph"), name.alias("name"))
    return cat.two_indexes(u.filter("p_partkey % 3 = 0"), u.filter("p_partkey % 3 > 0"), "p_partkey")


_FILES = "f AS (SELECT p_partkey, p_partkey // 2 % 40 AS pair, '/lib/modules/6.1.' || p_size % 3 || '/kernel/' || p_partkey % 3 || CASE WHEN p_partkey % 5 = 0 THEN '.ko.gz' ELSE '.ko.xz' END AS path FROM part)"
_BLANK = "regexp_replace({}, '^/lib/modules/[^/]+/', '/lib/modules/*/')"


@query("J11_base_file", f"""WITH {_FILES}, b AS (SELECT DISTINCT pair, path FROM f WHERE p_partkey % 2 = 1), l AS (SELECT pair, {_BLANK.format("path")} AS blank, min(path) AS other FROM b WHERE path LIKE '%.ko.xz' GROUP BY ALL)
SELECT p_partkey, f.path, coalesce(b.path, CASE WHEN f.pair % 4 > 0 AND f.path LIKE '%.ko.xz' THEN other END, '') AS base_path FROM f LEFT JOIN b ON b.pair = f.pair AND b.path = f.path LEFT JOIN l ON l.pair = f.pair AND l.blank = {_BLANK.format("f.path")} WHERE p_partkey % 2 = 0""")
def j11_base(spark, d):
    """Even parts' files look for theirs among the odd ones'; three pairs of four are kernels."""
    k = F.col("p_partkey")
    suffix = F.when(k % 5 == 0, ".ko.gz").otherwise(".ko.xz")
    path = F.concat(F.lit("/lib/modules/6.1."), (F.col("p_size") % 3).cast("string"), F.lit("/kernel/"), (k % 3).cast("string"), suffix)
    f = table(spark, d, "part").select("p_partkey", (F.floor(k / 2) % 40).alias("pair"), path.alias("path"))
    out = planning.base_files(f.filter("p_partkey % 2 = 0"), f.filter("p_partkey % 2 = 1"), F.col("pair") % 4 > 0)
    return out.select("p_partkey", "path", F.coalesce("base_path", F.lit("")).alias("base_path"))


@query("J19_rendezvous_stream", f"WITH {IMAGES} SELECT event_id, image, state FROM events JOIN images ON image = event_id % 1000 WHERE event_type = 'view'")
def j19_stream(spark, d):
    """A stream of messages meets the table of requests that wait for them."""
    out, progress = scratch(spark, "met"), scratch(spark, "progress")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    messages = stream.filter("event_type = 'view'").select("event_id", (F.col("event_id") % 1000).alias("image"))
    met = messages.join(images(spark, d).select("image", "state"), "image").select("event_id", "image", "state")
    met.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(met.schema).parquet(out)


@query("T10_work_log", f"WITH {_FREED} SELECT slab_id, addr, \"end\" FROM freed WHERE (addr % 3 = 0 OR addr % 5 = 0) AND addr % 2 > 0")
def t10(spark, d):
    """Ranges to punch, two thirds of them punched by a first run; a second one intends a fifth again, does half of what is
    then to do, and leaves the rest."""
    ranges = freed(spark, d).select("slab_id", "addr", "end")
    log = WorkLog(spark, scratch(spark, "work"), "slab_id int, addr long, end long")
    log.intend(ranges, 1)
    log.succeeded(log.pending().filter("addr % 3 > 0"), 1)
    log.intend(ranges.filter("addr % 5 = 0"), 2)
    log.succeeded(log.pending().filter("addr % 2 = 0"), 2)
    return log.pending()


@query("G16_rewritten", f"""WITH {SLAB_ENDS}, {IMAGES}, r AS (SELECT digest, count(*) AS n_refs, count(*) FILTER (state <> 'F') AS n_kept FROM image_chunks JOIN images USING (image) GROUP BY digest),
a AS (SELECT s.*, n_refs, n_kept, min(CASE WHEN n_kept > 0 THEN addr END) OVER (PARTITION BY slab_id ORDER BY addr ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM slab s JOIN r USING (digest)),
p AS (SELECT slab_id, coalesce(nxt, slab_end) AS e, min(addr) AS addr FROM a JOIN ends USING (slab_id) WHERE n_kept = 0 GROUP BY ALL), q AS (SELECT slab_id, count(*) AS punches, sum(e - addr)::BIGINT AS punched FROM p GROUP BY slab_id)
SELECT slab_id, count(*) FILTER (n_kept > 0) AS kept, count(*) FILTER (n_kept > 0 AND n_kept < n_refs) AS rewritten, count(*) FILTER (n_kept = 0) AS dead, coalesce(any_value(punches), 0) AS punches, coalesce(any_value(punched), 0) AS punched FROM a LEFT JOIN q USING (slab_id) GROUP BY slab_id""")
def g16_rewritten(spark, d):
    """References that stay, chunks whose list is written anew, chunks that go and the ranges they leave, by slab."""
    s, ends = slab_and_ends(spark, d)
    owners = image_chunks(spark, d).select("digest", F.col("image").alias("owner"))
    keep = gc.roots(images(spark, d), ["F"]).select(F.col("image").alias("owner"))
    chunks, ranges = gc.local(s, ends, owners, keep)
    a = chunks.groupBy("slab_id").agg(F.count_if(~F.col("dead")).alias("kept"), F.count_if("rewrite").alias("rewritten"), F.count_if("dead").alias("dead"))
    q = ranges.groupBy("slab_id").agg(F.count("*").alias("punches"), F.sum(F.col("end") - F.col("addr")).alias("punched"))
    return a.join(q, "slab_id", "left").fillna(0, ["punches", "punched"])
