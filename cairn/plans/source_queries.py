"""Queries of sources, sinks, codecs and streams. Sources read what the query itself wrote to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, digests
from ..operators import diffing
from ..operators.chunking import cut, put_if_absent
from ..session import shared_folder
from ..sources import archives, texts
from ..streaming import events as ev
from .adapters import CATALOG, CHUNKS, ENTRIES, PATHS, PIECE, catalog, chunks, entries, events, store_paths, table
from .registry import query


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share."""
    return f"{shared_folder(spark)}/cairn/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select(F.col("doc_id").cast("string").alias("name"), "path", (F.col("doc_id") % 2 == 0).alias("executable"), F.col("payload").alias("data"))


_TREE = """SELECT doc_id::VARCHAR AS archive, '/' AS path, 2 AS type, 0 AS size, false AS executable, '' AS sha FROM entries UNION ALL SELECT doc_id::VARCHAR, '/' || split_part(path, '/', 2), 2, 0, false, '' FROM entries
UNION ALL SELECT doc_id::VARCHAR, path, 1, size, doc_id % 2 = 0, sha256(payload) FROM entries UNION ALL SELECT doc_id::VARCHAR, '/latest', 3, len(path), false, sha256(path) FROM entries"""


def _listed(scanned: DataFrame) -> DataFrame:
    sha = F.when(F.col("type") == 2, "").otherwise(F.sha2("data", 256))
    return scanned.select("archive", "path", "type", "size", "executable", sha.alias("sha"))


@query("S01_archive_scan", f"WITH {ENTRIES} {_TREE}")
def s01(spark, d):
    """An archive per document, packed with zstandard and scanned."""
    return _listed(archives.scan(archives.pack(files(spark, d), codec="zstd")))


@query("S05_tar_scan", f"WITH {ENTRIES} {_TREE}")
def s05(spark, d):
    """With gzip; the single top directory becomes the root."""
    return _listed(archives.scan(archives.pack(files(spark, d), kind="tar", codec="gz"), kind="tar"))


@query("S03_archive_errors", f"WITH {ENTRIES} SELECT doc_id::VARCHAR AS archive, doc_id % 10 = 0 AS bad FROM entries")
def s03(spark, d):
    """What can't be read is a row with an error, not a failure."""
    packed = archives.pack(files(spark, d)).withColumn("content", F.when(F.col("name").cast("long") % 10 == 0, F.substring("content", 1, 40)).otherwise(F.col("content")))
    return archives.scan(packed).groupBy("archive").agg(F.bool_or(F.col("error").isNotNull()).alias("bad"))


@query("S04_narinfo", f"WITH {PATHS} SELECT p_partkey, path AS store_path, p_partkey * 7 AS nar_size, 2 AS n_refs, 'k1:a' || p_partkey || ',k2:b' AS sigs, '' AS deriver FROM paths")
def s04(spark, d):
    lines = F.concat_ws("\n", F.concat(F.lit("StorePath: "), "path"), F.concat(F.lit("NarSize: "), (F.col("p_partkey") * 7).cast("string")), F.lit("References: a b"), F.concat(F.lit("Sig: k1:a"), F.col("p_partkey").cast("string")), F.lit("Sig: k2:b"), F.lit(""))
    info = texts.narinfo(F.col("text"))
    p = store_paths(spark, d).select("p_partkey", lines.alias("text"))
    return p.select("p_partkey", info["StorePath"].alias("store_path"), info["NarSize"].alias("nar_size"), F.size(info["References"]).alias("n_refs"), F.array_join(info["Sig"], ",").alias("sigs"), F.coalesce(info["Deriver"], F.lit("")).alias("deriver"))


@query("S06_folder", f"WITH {ENTRIES} SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s06(spark, d):
    """Written as a folder of files, walked again."""
    folder = scratch(spark, "folder")
    table(spark, d, "documents").select("lang", "doc_id").write.partitionBy("lang").json(folder)
    walked = texts.files(spark, folder).filter(F.col("path").endswith(".json"))
    rows = walked.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> ''")
    return rows.groupBy("lang").agg(F.count("*").alias("n"))


@query("S07_listing", f"WITH {CHUNKS}, k AS (SELECT DISTINCT 'chunk/' || rtrim(translate(to_base64(unhex(digest)), '+/', '-_'), '=') AS key FROM chunks) SELECT substr(key, 7, 1) AS first, count(*) AS n FROM k GROUP BY 1")
def s07(spark, d):
    """By first letter."""
    keys = chunks(spark, d).select("digest").distinct().select(F.concat(F.lit("chunk/"), digests.base64url(F.unhex("digest"))).alias("key"))
    return texts.partitioned_listing(keys).groupBy(F.substring("key", 7, 1).alias("first")).agg(F.count("*").alias("n"))


@query("S13_listed_keys", f"WITH {CATALOG}, k AS (SELECT CASE WHEN e % 3 = 0 THEN '??' || e ELSE lpad((e * 2)::VARCHAR, 10, '0') END AS sph FROM range(0, 2000) t(e)) SELECT sph, coalesce(name, '') AS name, CASE WHEN starts_with(sph, '?') THEN 'bad' WHEN name IS NULL THEN 'missing' ELSE '' END AS problem FROM k LEFT JOIN catalog USING (sph)")
def s13(spark, d):
    e = F.col("id")
    keys = spark.range(2000).select(F.when(e % 3 == 0, F.concat(F.lit("??"), e.cast("string"))).otherwise(F.lpad((e * 2).cast("string"), 10, "0")).alias("sph"))
    out = texts.listed_keys(keys, catalog(spark, d).select("sph", "name"), "sph", F.col("sph").rlike("^[0-9]+$"))
    return out.select("sph", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("problem", F.lit("")).alias("problem"))


@query("S15_extents", "SELECT p_partkey, unnest(range(p_partkey * 10, p_partkey * 10 + p_size + 1)) AS block FROM part WHERE p_partkey % 5 <> 0")
def s15(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, F.lit("header")).otherwise(F.format_string(" %d: %8d.. %7d: 100.. 200: 5: flags", k, k * 10, k * 10 + F.col("p_size")))
    return table(spark, d, "part").select("p_partkey", F.explode(texts.extent_blocks(line)).alias("block"))


@query("S16_path_info", f"WITH {PATHS} SELECT p_partkey, path, p_partkey * 7 AS size, (p_partkey % 3)::INT AS n_signatures FROM paths")
def s16(spark, d):
    k = F.col("p_partkey")
    sigs = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("a:1"))).otherwise(F.array(F.lit("a:1"), F.lit("b:1")))
    json = F.to_json(F.map_from_arrays(F.array("path"), F.array(F.struct((k * 7).alias("narSize"), sigs.alias("signatures")))))
    return store_paths(spark, d).select("p_partkey", F.inline(texts.path_info(json))).select("p_partkey", "path", "size", F.size("signatures").alias("n_signatures"))


@query("S17_changed", f"WITH {CATALOG} SELECT p_partkey, name FROM catalog WHERE p_partkey % 4 = 0 OR p_partkey >= 1500")
def s17(spark, d):
    """Against the last snapshot."""
    c = catalog(spark, d).select("p_partkey", "name")
    before = c.filter("p_partkey < 1500").withColumn("name", F.when(F.col("p_partkey") % 4 == 0, F.concat("name", F.lit("-old"))).otherwise(F.col("name")))
    return texts.changed(c, before, "p_partkey", "name")


@query("S18_refs", "SELECT p_partkey % 100 AS repo, 'r' || p_partkey AS ref, CASE p_partkey % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'tag' ELSE '' END AS hash FROM part")
def s18(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select((k % 100).alias("repo"), F.concat(F.lit("r"), k.cast("string")).alias("ref"), (k % 4).alias("k"))
    heads = p.filter("k = 0").select("repo", F.concat(F.lit("refs/heads/"), "ref").alias("name"), F.lit("head").alias("hash"))
    tags = p.filter("k < 2").select("repo", F.concat(F.lit("refs/tags/"), "ref").alias("name"), F.lit("tag").alias("hash"))
    out = texts.resolved_refs(p.select("repo", "ref"), heads.union(tags))
    return out.select("repo", "ref", F.coalesce("hash", F.lit("")).alias("hash"))


@query("S19_blob", "SELECT 1 AS n, 'a' || chr(10) || 'b' AS value")
def s19(spark, d):
    folder = scratch(spark, "blob")
    spark.range(1).select(F.lit("a\nb").alias("value")).coalesce(1).write.text(folder)
    return texts.blob(spark, folder).select(F.lit(1).alias("n"), F.rtrim("value", F.lit("\n")).alias("value"))


@query("S21_pins", f"WITH {CATALOG} SELECT name, sph FROM catalog WHERE p_partkey < 50")
def s21(spark, d):
    """Saved as a JSON document and read again."""
    folder = scratch(spark, "pins")
    texts.save_pins(catalog(spark, d).filter("p_partkey < 50").select("name", "sph")).write.text(folder)
    return texts.pins(spark, folder).select("name", "sph")


@query("S09_transparent_zstd", f"WITH {ENTRIES} SELECT doc_id, sha256(payload) AS sha FROM entries")
def s09(spark, d):
    """Compressed objects come out plain."""
    return entries(spark, d).select("doc_id", F.sha2(codecs.decompress("zstd", codecs.compress("zstd", F.col("payload"))), 256).alias("sha"))


@query("H12_codecs", f"WITH {ENTRIES} SELECT doc_id, true AS gz, true AS xz FROM entries")
def h12(spark, d):
    """Round trips."""
    e = entries(spark, d)
    for c in ("gz", "xz"):
        e = e.withColumn(c, codecs.decompress(c, codecs.compress(c, F.col("payload"))) == F.col("payload"))
    return e.select("doc_id", "gz", "xz")


def patches(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the one 1 before, as its next version: the first half of its own and that one's end."""
    e = entries(spark, d).select("doc_id", "payload")
    base = e.select((F.col("doc_id") + 1).alias("doc_id"), F.col("payload").alias("other"))
    j = e.join(base, "doc_id")
    half = F.floor(F.octet_length("payload") / 2).cast("int")
    return j.withColumn("base", F.concat(F.substring("payload", F.lit(1), half), F.col("other"))).select("doc_id", "payload", "base", codecs.make_patch(F.col("base"), F.col("payload")).alias("patch"))


@query("H13_patch_size")
def h13(spark, d):
    """Sizes of patches."""
    return patches(spark, d).select("doc_id", F.octet_length("payload").alias("bytes"), F.octet_length("patch").alias("patch_bytes"))


@query("G14_diff_server", """WITH e AS (SELECT doc_id, text, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL),
j AS (SELECT e.doc_id // 2 AS request, e.doc_id % 2 AS part, e.doc_id % 3 < 2 AS x, e.text, e.size, b.size AS base_size FROM e JOIN e b ON b.doc_id = e.doc_id - 3)
SELECT request, count(*) FILTER (x) AS expands, sum(base_size)::BIGINT AS base_bytes, sum(size)::BIGINT AS wanted_bytes, string_agg(size::VARCHAR, ',' ORDER BY part) AS lengths, sha256(string_agg(text, '' ORDER BY part)) AS sha256 FROM j GROUP BY request""")
def g14(spark, d):
    """Documents stored in chunks, two of three packed, are asked for against those three before; two parts a request. The
    patch, applied, gives the wanted data."""
    form = F.when(F.col("doc_id") % 3 == 0, "gz").when(F.col("doc_id") % 3 == 1, "xz")
    e = entries(spark, d).filter("payload is not null").withColumn("expand", form)
    plain = e.filter("expand is null")
    packed = [e.filter(F.col("expand") == c).withColumn("payload", codecs.compress(c, F.col("payload"))) for c in ("gz", "xz")]
    stored = packed[0].unionByName(packed[1]).withColumn("size", F.octet_length("payload").cast("long")).unionByName(plain)
    c = cut(stored, ["doc_id"], piece=PIECE)
    series = c.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda x: x["digest"]).alias("digests"))
    files = e.select("doc_id", "expand").join(series, "doc_id", "left").withColumn("digests", F.coalesce("digests", F.array().cast("array<string>")))
    base = files.select((F.col("doc_id") + 3).alias("doc_id"), F.col("digests").alias("bases"))
    asked = files.join(base, "doc_id").select(F.floor(F.col("doc_id") / 2).alias("request"), (F.col("doc_id") % 2).alias("part"), "expand", "bases", F.col("digests").alias("wanted"))
    out = diffing.served(asked, put_if_absent(c.select("digest", "data"), None))
    made = F.sha2(codecs.apply_patch(F.col("base_data"), F.col("patch")), 256)
    return out.select("request", "expands", "base_bytes", "wanted_bytes", F.array_join(F.col("lengths").cast("array<string>"), ",").alias("lengths"), made.alias("sha256"))


@query("G15_apply_patch", f"WITH {ENTRIES} SELECT doc_id, substr(sha256(payload), 1, 48) AS digest, true AS verified FROM entries WHERE doc_id > 0")
def g15(spark, d):
    """Patched, then held against its digest."""
    p = patches(spark, d).withColumn("made", codecs.apply_patch(F.col("base"), F.col("patch")))
    return p.select("doc_id", digests.digest(F.col("made")).alias("digest"), digests.matches(F.col("made"), digests.digest(F.col("payload"))).alias("verified"))


@query("K04_verified_write", f"WITH {CHUNKS} SELECT digest, max(chunk_size) AS bytes FROM chunks WHERE doc_id % 3 <> 0 GROUP BY digest")
def k04(spark, d):
    """Only what matches its digest is stored, each digest once."""
    c = chunks(spark, d).withColumn("digest_", F.when(F.col("doc_id") % 3 == 0, F.lit("0" * 48)).otherwise(F.col("digest")))
    return c.filter(digests.matches(F.col("data"), F.col("digest_"))).groupBy("digest").agg(F.max("chunk_size").alias("bytes"))


@query("T02_sessions", "WITH s AS (SELECT *, sum(CASE WHEN ts - l >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events)) SELECT user_id, count(*) AS reads, epoch_us(min(ts)) AS first_read, epoch_us(max(ts)) AS last_read FROM s GROUP BY user_id, g")
def t02(spark, d):
    s = ev.sessions(events(spark, d), "user_id", "6 hours")
    return s.select("user_id", "reads", F.unix_micros("first_read").alias("first_read"), F.unix_micros("last_read").alias("last_read"))


_TTL = """WITH RECURSIVE o AS (SELECT event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events),
f AS (SELECT event_type, t, k, t AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.t, o.k, CASE WHEN o.t - f.last > 3600000000 THEN o.t ELSE f.last END, o.t - f.last > 3600000000 FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)
SELECT event_type, t FROM f WHERE kept"""


@query("T03_first_within", _TTL)
def t03(spark, d):
    return ev.first_within(events(spark, d), "event_type", "1 hour").select("event_type", F.unix_micros("ts").alias("t"))


@query("T04_coalesced", "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, count(*) AS reads FROM events GROUP BY ALL")
def t04(spark, d):
    return ev.coalesced(events(spark, d), "user_id", "1 hour").select("user_id", F.unix_micros("start").alias("start"), "reads")


_STATES = "CASE arg_max(event_type, {'t': ts, 'e': event_id}) WHEN 'signup' THEN 'Requested' WHEN 'view' THEN 'Mounted' WHEN 'error' THEN 'MountError' WHEN 'click' THEN 'UnmountRequested' WHEN 'purchase' THEN 'Unmounted' ELSE 'Unknown' END"


@query("T06_states", f"SELECT user_id, {_STATES} AS state, count(*) AS events FROM events GROUP BY user_id")
def t06(spark, d):
    return ev.states(events(spark, d), "user_id", ["ts", "event_id"])


@query("A16_pending", f"WITH s AS (SELECT user_id, {_STATES} AS state FROM events GROUP BY user_id) SELECT state, count(*) AS n, bool_or(state = 'MountError') AS failed FROM s GROUP BY state")
def a16(spark, d):
    s = ev.states(events(spark, d), "user_id", ["ts", "event_id"])
    return s.groupBy("state").agg(F.count("*").alias("n"), F.bool_or(F.col("state") == "MountError").alias("failed"))


_GATED = """e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 ELSE 0 END AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT user_id, event_id, k, CASE WHEN w = 1 THEN 1 ELSE 0 END AS s, w = 1 AS accepted FROM e WHERE k = 1 UNION ALL
SELECT n.user_id, n.event_id, n.k, CASE WHEN n.ok THEN n.w ELSE n.s END, n.ok FROM (SELECT e.*, g.s, (e.w = 1 AND g.s IN (0, 3, 5)) OR (e.w IN (2, 3) AND g.s = 1) OR (e.w = 4 AND g.s = 2) OR (e.w = 5 AND g.s = 4) AS ok FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1) n),
gated AS (SELECT user_id, event_id, ['Unknown', 'Requested', 'Mounted', 'MountError', 'UnmountRequested', 'Unmounted'][s + 1] AS state, accepted FROM g)"""


@query("T06_gated_states", f"WITH RECURSIVE {_GATED} SELECT * FROM gated")
def t06_gated(spark, d):
    """Each event, with the state after it and whether it was allowed from the one before."""
    return ev.gated(events(spark, d), "user_id", "event_id")


@query("K05_gated_upsert", f"WITH RECURSIVE {_GATED} SELECT user_id, arg_max(state, event_id) AS state, max(event_id) FILTER (accepted) AS written, count(*) FILTER (NOT accepted) AS refused FROM gated GROUP BY user_id")
def k05(spark, d):
    """The record of each key after its read-modify-writes; refused ones leave it as it was."""
    g = ev.gated(events(spark, d), "user_id", "event_id")
    return g.groupBy("user_id").agg(F.max_by("state", "event_id").alias("state"), F.max(F.when(F.col("accepted"), F.col("event_id"))).alias("written"), F.count_if(~F.col("accepted")).alias("refused"))


@query("T05_upsert_stream", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def t05(spark, d):
    """A stream of the events into a snapshot per batch, the latest row of each key winning."""
    out, check = scratch(spark, "upsert"), scratch(spark, "progress")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "event_id", "event_type")
    q = stream.withColumn("version_", F.col("event_id")).writeStream.foreachBatch(ev.upsert(spark, out, ["user_id"], "version_"))
    q.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return ev.read_snapshot(spark, out).select("user_id", "event_id", "event_type")


@query("T02_sessions_stream")
def t02_stream(spark, d):
    """T01, T02 on a stream: sessions that the watermark has closed (those still open stay in the state)."""
    out, check = scratch(spark, "sessions"), scratch(spark, "progress")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = ev.sessions(stream, "user_id", "6 hours", "1 hour")
    closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(out)
