"""Queries of joins, aggregations, ordered and set operators, and of the composite dataflows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digests, text
from ..operators import catalog as cat, chunking, gc, ordered, planning, refs, reports, slab as sl
from .adapters import CATALOG, CHUNKS, ENTRIES, IMAGE_CHUNKS, IMAGES, MANIFEST_CHUNKS, PIECE, SLAB, SLAB_ENDS, catalog, chunks, entries, events, image_chunks, images, manifest_chunks, slab, slab_and_ends, table
from .registry import query


@query("A05_chunk_sharing", f"WITH {CHUNKS}, o AS (SELECT digest, count(DISTINCT doc_id) AS n_owners FROM chunks GROUP BY digest) SELECT n_owners, count(*) AS n_chunks FROM o GROUP BY n_owners")
def a05(spark, d):
    return refs.sharing_histogram(chunks(spark, d), "doc_id")


@query("G10_cut_and_digest", f"WITH {CHUNKS} SELECT doc_id, seq, \"offset\", chunk_size, digest FROM chunks")
def g10(spark, d):
    return chunks(spark, d).select("doc_id", "seq", "offset", "chunk_size", "digest")


@query("K01_put_if_absent", f"WITH {CHUNKS}, store AS (SELECT DISTINCT digest FROM chunks WHERE doc_id % 3 = 0) SELECT digest, any_value(chunk_size) AS chunk_size FROM chunks WHERE digest NOT IN (SELECT digest FROM store) GROUP BY digest")
def k01(spark, d):
    c = chunks(spark, d)
    return chunking.put_if_absent(c.select("digest", "chunk_size"), c.filter("doc_id % 3 = 0").select("digest").distinct())


@query("A01_build_stats", f"WITH {CHUNKS}, store AS (SELECT DISTINCT digest FROM chunks WHERE doc_id % 3 = 0), n AS (SELECT digest, any_value(chunk_size) AS s FROM chunks WHERE digest NOT IN (SELECT digest FROM store) GROUP BY digest) SELECT count(DISTINCT package) AS manifests, count(*) AS total_chunks, sum(chunk_size)::BIGINT AS total_bytes, (SELECT count(*) FROM n) AS new_chunks, (SELECT sum(s)::BIGINT FROM n) AS new_bytes FROM chunks")
def a01(spark, d):
    c = chunks(spark, d)
    return chunking.build_stats(c.select("package", "digest", "chunk_size"), c.filter("doc_id % 3 = 0").select("digest"))


_PRESENT = "present AS (SELECT DISTINCT digest FROM chunks WHERE doc_id % 2 = 0)"


@query("A02_image_stats", f"WITH {CHUNKS}, {_PRESENT} SELECT package, count(*) AS total_chunks, sum(((chunk_size + 63) // 64))::BIGINT AS total_blocks, count(*) FILTER (digest IN (FROM present)) AS present_chunks, coalesce(sum((chunk_size + 63) // 64) FILTER (digest IN (FROM present)), 0)::BIGINT AS present_blocks FROM chunks GROUP BY package")
def a02(spark, d):
    c = chunks(spark, d).select("doc_id", "package", "digest", "chunk_size")
    return refs.image_stats(c, c.filter("doc_id % 2 = 0"), ["package"], 64)


@query("A03_entry_stats", f"WITH {CHUNKS}, {_PRESENT} SELECT package, path, count(*) AS total_chunks, sum(((chunk_size + 63) // 64))::BIGINT AS total_blocks, count(*) FILTER (digest IN (FROM present)) AS present_chunks, coalesce(sum((chunk_size + 63) // 64) FILTER (digest IN (FROM present)), 0)::BIGINT AS present_blocks FROM chunks GROUP BY package, path")
def a03(spark, d):
    c = chunks(spark, d).select("doc_id", "package", "path", "digest", "chunk_size")
    return refs.image_stats(c, c.filter("doc_id % 2 = 0"), ["package", "path"], 64)


@query("A07_first_seen", f"WITH {CHUNKS} SELECT digest, min({{'d': doc_id, 's': seq}}).d AS doc_id, min({{'d': doc_id, 's': seq}}).s AS seq FROM chunks WHERE starts_with(path, '/en/') GROUP BY digest")
def a07(spark, d):
    return chunking.first_seen(chunks(spark, d).filter(text.under(F.col("path"), F.lit("/en"))), "digest", ["doc_id", "seq"])


@query("A13_ordered_refs", f"WITH {CHUNKS}, f AS (SELECT digest, package, min({{'d': doc_id, 's': seq}}) AS first FROM chunks GROUP BY ALL) SELECT digest, string_agg(package, ',' ORDER BY first) AS refs FROM f GROUP BY digest")
def a13(spark, d):
    r = refs.ordered_refs(chunks(spark, d), "package", ["doc_id", "seq"])
    return r.select("digest", F.array_join("refs", ",").alias("refs"))


@query("W05_shards", f"WITH {CHUNKS} SELECT doc_id, seq, (row_number() OVER (ORDER BY doc_id, seq) - 1) % 7 AS shard FROM chunks")
def w05(spark, d):
    """W05, F12, G22."""
    return chunking.shard_of(chunks(spark, d).select("doc_id", "seq"), ["doc_id", "seq"], 7).select("doc_id", "seq", "shard")


@query("W04_walk", f"WITH {CHUNKS}, e AS (SELECT doc_id, any_value(size) AS size FROM pieces GROUP BY doc_id) SELECT doc_id, seq AS idx, digest, least(256, size - seq * 256) AS chunk_size, row_number() OVER (ORDER BY doc_id, seq) - 1 AS ordinal FROM chunks JOIN e USING (doc_id)")
def w04(spark, d):
    """Digests of each entry (an array) back to rows."""
    c = chunks(spark, d)
    e = c.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda x: x["digest"]).alias("digests"), F.sum("chunk_size").alias("size"), F.lit(8).alias("chunk_shift"))
    walked = chunking.walk(e).select("doc_id", "idx", "digest", "chunk_size")
    return ordered.running_total(walked, ["doc_id", "idx"], F.lit(1), "ordinal")


@query("K07_reassembled", f"WITH {ENTRIES} SELECT doc_id, (size + 255) // 256 AS n_chunks, sha256(payload) AS sha256 FROM entries WHERE size > 224")
def k07(spark, d):
    """K07, A20, S14."""
    return chunking.reassembled(chunks(spark, d), ["doc_id"]).select("doc_id", "n_chunks", "sha256")


@query("J01_located", f"WITH {SLAB} SELECT image, digest, slab_id, addr FROM image_chunks JOIN slab USING (digest)")
def j01(spark, d):
    return refs.located(image_chunks(spark, d).select("image", "digest"), slab(spark, d).select("digest", "slab_id", "addr"))


@query("J02_named_refs", f"WITH {CATALOG}, {CHUNKS}, r AS (SELECT DISTINCT digest, substr(lpad((doc_id % 50)::VARCHAR, 10, '0'), 1, 9) AS prefix FROM chunks), n AS (SELECT substr(sph, 1, 9) AS prefix, arg_min(name, sph) AS name FROM catalog GROUP BY 1) SELECT digest, r.prefix, name FROM r LEFT JOIN n USING (prefix)")
def j02(spark, d):
    r = chunks(spark, d).select("digest", F.substring(F.lpad((F.col("doc_id") % 50).cast("string"), 10, "0"), 1, 9).alias("prefix")).distinct()
    return refs.named_refs(r, catalog(spark, d), 9).select("digest", "prefix", "name")


_J03 = f"""WITH {CATALOG}, n AS (SELECT name, sph, len(name) - len(replace(name, '-', '')) AS dashes, CASE WHEN instr(name, '-') > 0 THEN split_part(name, '-', 1) || '-' ELSE name END AS head FROM catalog),
p AS (SELECT a.name, a.sph, b.name AS base_name, b.sph AS base_sph, len(list_filter(range(1, least(len(a.name), len(b.name)) + 1), lambda i: substr(a.name, 1, i) = substr(b.name, 1, i)))::INT AS "match"
FROM n a JOIN n b ON a.dashes = b.dashes AND a.sph <> b.sph AND (a.dashes > 0 AND a.head = b.head OR a.dashes = 0 AND starts_with(b.name, a.name)) WHERE len(a.name) >= 3 AND a.name <> 'source')
SELECT name, sph, base_name, base_sph, "match" FROM p QUALIFY row_number() OVER (PARTITION BY name, sph ORDER BY "match" DESC, base_name DESC, base_sph DESC) = 1"""


@query("J03_best_base", _J03)
def j03(spark, d):
    """J03, A14, O08, S11."""
    return cat.best_base(catalog(spark, d))


@query("S11_prefix_range", f"WITH {CATALOG} SELECT p_partkey, name FROM catalog WHERE name LIKE 'red-%'")
def s11(spark, d):
    return catalog(spark, d).filter(F.startswith("name", F.lit("red-"))).select("p_partkey", "name")


@query("S12_point_lookup", f"WITH {CATALOG} SELECT p_partkey, name FROM catalog WHERE p_partkey = 42")
def s12(spark, d):
    return catalog(spark, d).filter("p_partkey = 42").select("p_partkey", "name")


_READS = "reads AS (SELECT event_id, (event_id % 3)::INT AS slab_id, 4 + event_id * 37 % 90000 AS addr FROM events)"


def reads(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", (e % 3).cast("int").alias("slab_id"), (4 + e * 37 % 90000).alias("addr"))


@query("J04_locate", f"WITH {SLAB}, {_READS} SELECT event_id, r.slab_id, r.addr, s.addr AS chunk_addr, s.blocks, s.digest FROM reads r JOIN slab s ON r.slab_id = s.slab_id AND r.addr >= s.addr AND r.addr < s.addr + s.blocks")
def j04(spark, d):
    return sl.locate(reads(spark, d), slab(spark, d)).select("event_id", "slab_id", "addr", "chunk_addr", "blocks", "digest")


@query("J04_as_of", f"WITH {SLAB}, {_READS} SELECT event_id, r.slab_id, r.addr, coalesce(s.digest, -1) AS digest, coalesce(s.addr, -1) AS matched_addr FROM reads r ASOF LEFT JOIN slab s ON r.slab_id = s.slab_id AND r.addr >= s.addr")
def j04b(spark, d):
    found = ordered.as_of(reads(spark, d), slab(spark, d), ["slab_id"], "addr", ["digest"])
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("digest", "matched_addr")})


@query("W01_allocate", f"WITH {SLAB} SELECT digest, slab_id, addr, blocks FROM slab")
def w01(spark, d):
    return slab(spark, d).select("digest", "slab_id", "addr", "blocks")


_SIZED = f"{SLAB_ENDS}, sized AS (SELECT slab_id, addr, digest, present, coalesce(lead(addr) OVER (PARTITION BY slab_id ORDER BY addr), slab_end) - addr AS blocks FROM slab JOIN ends USING (slab_id))"


@query("W02_chunk_blocks", f"WITH {_SIZED} SELECT slab_id, addr, blocks FROM sized")
def w02(spark, d):
    s, ends = slab_and_ends(spark, d)
    return sl.chunk_blocks(s.drop("blocks"), ends).select("slab_id", "addr", "blocks")


@query("A04_slab_stats", f"WITH {_SIZED}, h AS (SELECT slab_id, blocks, count(*) AS n, count(*) FILTER (present) AS here FROM sized GROUP BY ALL) SELECT slab_id, sum(n)::BIGINT AS chunks, sum(n * blocks)::BIGINT AS total_blocks, sum(here)::BIGINT AS present_chunks, sum(here * blocks)::BIGINT AS present_blocks, '{{' || string_agg('\"' || blocks || '\":' || n, ',' ORDER BY blocks) || '}}' AS histogram FROM h GROUP BY slab_id")
def a04(spark, d):
    s, ends = slab_and_ends(spark, d)
    return sl.slab_stats(sl.chunk_blocks(s.drop("blocks"), ends))


_FREED = f"{SLAB_ENDS}, ahead AS (SELECT slab_id, addr, digest % 5 < 3 AS dead, min(CASE WHEN digest % 5 >= 3 THEN addr END) OVER (PARTITION BY slab_id ORDER BY addr ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM slab), freed AS (SELECT slab_id, coalesce(nxt, slab_end) AS \"end\", min(addr) AS addr FROM ahead JOIN ends USING (slab_id) WHERE dead GROUP BY ALL)"


def freed(spark, d):
    s, ends = slab_and_ends(spark, d)
    return sl.freed_ranges(s.withColumn("dead", F.col("digest") % 5 < 3), ends)


@query("W03_freed_ranges", f"WITH {_FREED} SELECT slab_id, \"end\", addr FROM freed")
def w03(spark, d):
    """W03, K10, O02."""
    return freed(spark, d)


@query("A09_punched", f"WITH {_FREED} SELECT count(*) AS punch_locs, sum((\"end\" - addr) * 4096)::BIGINT AS punch_bytes FROM freed")
def a09(spark, d):
    return sl.punched(freed(spark, d))


_GC = f"{IMAGES}, {IMAGE_CHUNKS}, {MANIFEST_CHUNKS}, kept AS (SELECT image FROM images WHERE state <> 'F'), live AS (SELECT digest FROM (SELECT image, digest FROM image_chunks UNION ALL SELECT image, digest FROM manifest_chunks) WHERE image IN (FROM kept) GROUP BY digest), stored AS (SELECT digest FROM image_chunks UNION SELECT digest FROM manifest_chunks)"


def gc_frames(spark, d):
    i, c, m = images(spark, d), image_chunks(spark, d), manifest_chunks(spark, d)
    kept = gc.roots(i, ["F"])
    return i, c, m, kept, gc.live_digests(c, m, kept), c.select("digest").union(m.select("digest")).distinct()


@query("U01_live", f"WITH {_GC} SELECT digest FROM live")
def u01(spark, d):
    """U01, J05."""
    return gc_frames(spark, d)[4]


@query("J06_dead", f"WITH {_GC} SELECT digest FROM stored WHERE digest NOT IN (FROM live)")
def j06(spark, d):
    """J06, U02."""
    *_, live, stored = gc_frames(spark, d)
    return gc.dead(stored, live, "digest")


@query("U03_kept_refs", f"WITH {_GC} SELECT digest, count(*) AS n_refs, count(k.image) AS n_kept, count(k.image) < count(*) AS rewrite FROM image_chunks c LEFT JOIN kept k USING (image) GROUP BY digest")
def u03(spark, d):
    _, c, _, kept, _, _ = gc_frames(spark, d)
    return refs.kept_refs(c.select("digest", F.col("image").alias("owner")), kept.select(F.col("image").alias("owner")))


@query("A06_gc_summary", f"""WITH {_GC} SELECT CASE WHEN state = 'F' THEN 'delete_images' ELSE 'remain_images' END AS metric, state, count(*) AS value FROM images GROUP BY ALL
UNION ALL SELECT 'remain_ref_chunks', '', count(*) FROM live UNION ALL SELECT 'remain_have_chunks', '', count(*) FROM stored WHERE digest IN (FROM live) UNION ALL SELECT 'delete_chunks', '', count(*) FROM stored WHERE digest NOT IN (FROM live)""")
def a06(spark, d):
    i, _, _, kept, live, stored = gc_frames(spark, d)
    return gc.summary(i, kept, stored, live)


@query("G16_local_gc", f"""WITH {_GC}, fi AS (SELECT digest, min(image) AS image, arg_min(blocks, image) AS blocks FROM image_chunks GROUP BY digest), su AS (SELECT *, coalesce(sum(blocks) OVER (ORDER BY image, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM fi),
sl AS (SELECT digest, (before // 99740)::INT AS slab_id, before % 99740 + 4 AS addr, blocks FROM su), en AS (SELECT slab_id, max(addr + blocks) AS e FROM sl GROUP BY 1),
nx AS (SELECT slab_id, addr, digest NOT IN (FROM live) AS dead, min(CASE WHEN digest IN (FROM live) THEN addr END) OVER (PARTITION BY slab_id ORDER BY addr ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM sl)
SELECT slab_id, min(addr) AS addr, coalesce(nxt, e)::BIGINT AS "end" FROM nx JOIN en USING (slab_id) WHERE dead GROUP BY slab_id, coalesce(nxt, e)""")
def g16(spark, d):
    """Mark, sweep, and the ranges to punch."""
    live = gc_frames(spark, d)[4]
    s, ends = slab_and_ends(spark, d)
    s = s.join(live.withColumn("l_", F.lit(True)), "digest", "left").withColumn("dead", F.col("l_").isNull()).drop("l_")
    return sl.freed_ranges(s, ends)


_ROOTS = "roots AS (SELECT o_custkey, list(o_orderkey) AS k FROM orders WHERE o_orderkey % 5 NOT IN (3, 4) AND o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 700 DAY GROUP BY o_custkey)"
_REACH = f"""{IMAGES}, {IMAGE_CHUNKS}, {MANIFEST_CHUNKS}, {_ROOTS}, ids AS (SELECT DISTINCT unnest(k) AS image FROM roots),
reach AS (SELECT 'package' AS kind, 'p' || image AS id FROM ids WHERE image % 7 <> 0 UNION SELECT 'manifest', 'm' || image FROM ids WHERE image % 9 <> 0
UNION SELECT 'chunk', digest::VARCHAR FROM manifest_chunks JOIN ids USING (image) WHERE image % 9 <> 0 UNION SELECT 'chunk', digest::VARCHAR FROM image_chunks JOIN ids USING (image) WHERE image % 9 <> 0)"""


def reach_frames(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    at = F.when(k % 5 == 4, F.lit("yesterday")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    key = F.concat(F.lit("build@"), at, F.when(k % 5 == 3, F.lit("@r")).otherwise(F.lit("@r@c")))
    valid = o.filter(gc.root_is_valid(key, F.lit("2000-06-01 00:00:00").cast("timestamp"), 700))
    named = lambda p: F.collect_list(F.concat(F.lit(p), k.cast("string")))
    roots = valid.groupBy("o_custkey").agg(named("p").alias("sphs"), named("m").alias("manifest_keys"))
    packages = o.filter("o_orderkey % 7 <> 0").select(F.concat(F.lit("p"), k.cast("string")).alias("sph"))
    manifests = manifest_chunks(spark, d).filter("image % 9 <> 0").select(F.concat(F.lit("m"), F.col("image").cast("string")).alias("key"), F.array(F.col("digest").cast("string")).alias("digests"))
    files = image_chunks(spark, d).select(F.concat(F.lit("m"), F.col("image").cast("string")).alias("key"), F.col("digest").cast("string").alias("digest"))
    return gc.reach(roots, packages, manifests, files)


@query("J15_reach", f"WITH {_REACH} SELECT kind, id FROM reach")
def j15(spark, d):
    return reach_frames(spark, d)


_OBJECTS = """objects AS (SELECT 'cache/nar/p' || o_orderkey AS key, o_custkey AS size FROM orders UNION ALL SELECT 'cache/p' || o_orderkey || '.narinfo', 10 FROM orders UNION ALL SELECT 'cache/cache-info', 5
UNION ALL SELECT 'cache/odd', 7 UNION ALL SELECT 'manifest/m' || o_orderkey, 100 FROM orders UNION ALL SELECT 'chunk/' || (l_partkey * 1000000 + l_suppkey), max(l_quantity)::BIGINT FROM lineitem GROUP BY 1)"""
_GOOD = f"{_REACH}, good AS (SELECT kind, id FROM reach WHERE kind <> 'package' UNION SELECT 'nar', id FROM reach WHERE kind = 'package' UNION SELECT 'narinfo', id FROM reach WHERE kind = 'package')"
_SWEPT = f"""{_GOOD}, {_OBJECTS}, classed AS (SELECT key, size, CASE WHEN starts_with(key, 'cache/nar/') THEN 'nar' WHEN ends_with(key, '.narinfo') THEN 'narinfo' WHEN key = 'cache/cache-info' THEN 'always' WHEN starts_with(key, 'manifest/') THEN 'manifest' WHEN starts_with(key, 'chunk/') THEN 'chunk' ELSE 'unknown' END AS kind,
replace(list_last(string_split(key, '/')), '.narinfo', '') AS id FROM objects), swept AS (SELECT key, c.kind, size, c.kind = 'always' OR g.id IS NOT NULL AS keep FROM classed c LEFT JOIN good g ON c.kind = g.kind AND c.id = g.id)"""


def swept(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    c = image_chunks(spark, d).groupBy("digest").agg(F.max("blocks").cast("long").alias("size"))
    parts = [o.select(F.concat(F.lit("cache/nar/p"), k).alias("key"), F.col("o_custkey").alias("size")), o.select(F.concat(F.lit("cache/p"), k, F.lit(".narinfo")).alias("key"), F.lit(10).cast("long").alias("size"))]
    parts += [spark.range(1).select(F.lit(n).alias("key"), F.lit(s).cast("long").alias("size")) for n, s in (("cache/cache-info", 5), ("cache/odd", 7))]
    parts += [o.select(F.concat(F.lit("manifest/m"), k).alias("key"), F.lit(100).cast("long").alias("size")), c.select(F.concat(F.lit("chunk/"), F.col("digest").cast("string")).alias("key"), "size")]
    objects = parts[0]
    for p in parts[1:]:
        objects = objects.unionByName(p)
    reached = reach_frames(spark, d)
    good = reached.filter("kind <> 'package'")
    for kind in ("nar", "narinfo"):
        good = good.unionByName(reached.filter("kind = 'package'").select(F.lit(kind).alias("kind"), "id"))
    return gc.sweep(objects, good)


@query("J07_sweep", f"WITH {_SWEPT} SELECT key, kind, size, keep FROM swept")
def j07(spark, d):
    return swept(spark, d).select("key", "kind", "size", "keep")


@query("A08_gc_totals", f"WITH {_SWEPT} SELECT count(*) AS total_count, sum(size)::BIGINT AS total_bytes, count(*) FILTER (NOT keep) AS removed_count, sum(size) FILTER (NOT keep)::BIGINT AS removed_bytes, count(*) FILTER (keep) AS kept_count, sum(size) FILTER (keep)::BIGINT AS kept_bytes FROM swept")
def a08(spark, d):
    """A08, G17."""
    return gc.totals(swept(spark, d))


@query("K09_delete_batches", f"WITH {_GC}, x AS (SELECT image, row_number() OVER (ORDER BY image) - 1 AS ordinal FROM images WHERE state = 'F') SELECT image, ordinal // 100 AS batch FROM x")
def k09(spark, d):
    return chunking.batches(images(spark, d).filter("state = 'F'").select("image"), ["image"], 100).select("image", "batch")


@query("J16_closure", "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 2), c AS (SELECT p_partkey AS start, p_partkey AS node FROM part WHERE p_partkey % 100 = 99 UNION SELECT start, dst FROM c JOIN e ON node = src) SELECT start, node FROM c")
def j16(spark, d):
    return part_closure(spark, d, "src % 100 = 99")


@query("J16_closure_all")
def j16_all(spark, d):
    """J16 from all parts."""
    return part_closure(spark, d, "true")


def part_closure(spark, d, starts):
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"))
    edges = p.filter("src > 1").select("src", F.floor(F.col("src") / 2).alias("dst")).union(p.filter("src % 3 = 0 and src > 2").select("src", F.floor(F.col("src") / 3).alias("dst"))).distinct()
    return gc.closure(edges, p.filter(starts).select(F.col("src").alias("node")))


_ALIGNED = """b AS (SELECT 0 AS x), w AS (SELECT l_orderkey // 2 AS pair, l_orderkey % 2 AS side, CASE WHEN l_returnflag = 'N' THEN 'n' || l_orderkey % 4 ELSE l_returnflag END AS path, l_partkey * 1000000 + l_suppkey AS digest, max(l_quantity::INT)::BIGINT AS size FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY pair, side, path ORDER BY digest) - 1 AS idx, row_number() OVER (PARTITION BY pair, side ORDER BY path, digest) - 1 AS ordinal FROM w),
wanted AS (SELECT * FROM o WHERE side = 1), base AS (SELECT * FROM o WHERE side = 0),
aligned AS (SELECT w.pair, w.path, w.idx, w.ordinal, w.digest, w.size, p.digest AS base_digest, p.size AS base_size, 'path' AS how FROM wanted w LEFT JOIN base p ON w.pair = p.pair AND w.path = p.path AND w.idx = p.idx WHERE EXISTS (SELECT 1 FROM base q WHERE q.pair = w.pair AND q.path = w.path)
UNION ALL SELECT w.pair, w.path, w.idx, w.ordinal, w.digest, w.size, p.digest, p.size, 'ordinal' FROM wanted w LEFT JOIN base p ON w.pair = p.pair AND w.ordinal = p.ordinal WHERE NOT EXISTS (SELECT 1 FROM base q WHERE q.pair = w.pair AND q.path = w.path))"""


def sides(spark, d):
    li = table(spark, d, "lineitem")
    path = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("n"), (F.col("l_orderkey") % 4).cast("string"))).otherwise(F.col("l_returnflag"))
    w = li.groupBy(F.floor(F.col("l_orderkey") / 2).alias("pair"), (F.col("l_orderkey") % 2).alias("side"), path.alias("path"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("digest")).agg(F.max(F.col("l_quantity").cast("int")).cast("long").alias("size"))
    place = lambda keys, order: (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    w = w.withColumn("idx", place(["pair", "side", "path"], ["digest"])).withColumn("ordinal", place(["pair", "side"], ["path", "digest"]))
    return w.filter("side = 1").drop("side"), w.filter("side = 0").drop("side")


@query("J10_aligned", f"WITH {_ALIGNED} SELECT pair, path, idx, ordinal, digest, coalesce(base_digest, -1) AS base_digest, how FROM aligned")
def j10(spark, d):
    a = planning.aligned(*sides(spark, d))
    return a.select("pair", "path", "idx", "ordinal", "digest", F.coalesce("base_digest", F.lit(-1)).alias("base_digest"), "how")


@query("G12_plan", f"""WITH RECURSIVE {_ALIGNED}, present AS (SELECT DISTINCT digest FROM o WHERE digest % 3 = 0), need AS (SELECT a.*, p.digest IS NOT NULL AS here FROM aligned a LEFT JOIN present p ON a.base_digest = p.digest WHERE a.digest NOT IN (FROM present)),
f AS (SELECT *, row_number() OVER (PARTITION BY pair, digest ORDER BY ordinal) AS rn FROM need), g AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ordinal) AS k FROM f WHERE rn = 1),
fold AS (SELECT pair, ordinal, k, size, 0 AS op, 1 AS n, size AS b FROM g WHERE k = 1 UNION ALL SELECT g.pair, g.ordinal, g.k, g.size, fold.op + (fold.n >= 3 OR fold.b >= 60)::INT, CASE WHEN fold.n >= 3 OR fold.b >= 60 THEN 1 ELSE fold.n + 1 END, CASE WHEN fold.n >= 3 OR fold.b >= 60 THEN g.size ELSE fold.b + g.size END FROM fold JOIN g ON g.pair = fold.pair AND g.k = fold.k + 1),
r AS (SELECT pair, op AS request, count(*) AS chunks, sum(g.size)::BIGINT AS bytes, count(*) FILTER (here) AS base_chunks, coalesce(sum(base_size) FILTER (here), 0)::BIGINT AS base_bytes FROM fold JOIN g USING (pair, ordinal) GROUP BY ALL)
SELECT pair, request, chunks, bytes, base_chunks, base_bytes, CASE WHEN base_chunks > 0 THEN 'diff' WHEN chunks > 1 THEN 'batch' ELSE 'single' END AS how FROM r""")
def g12(spark, d):
    wanted, base = sides(spark, d)
    present = wanted.select("digest").union(base.select("digest")).filter("digest % 3 = 0").distinct()
    return planning.plan(wanted, base, present, most_chunks=3, most_bytes=60)


@query("G12_plan_sources")
def g12_sources(spark, d):
    """Up to three versions of an image as sources of its first chunk's requests."""
    wanted, base = sides(spark, d)
    versions = F.explode(F.array(*map(F.lit, range(5)))).alias("source")
    both = wanted.withColumn("side", F.lit("wanted")).unionByName(base.withColumn("side", F.lit("base")))
    both = both.select("*", versions).filter("ordinal = 0 or (ordinal + source) % 5 > 0").withColumnRenamed("pair", "key")
    targets = wanted.filter("ordinal = 0 and digest % 3 > 0").select(F.col("pair").alias("key"), "digest")
    present = wanted.select("digest").union(base.select("digest")).filter("digest % 3 = 0")
    return planning.extended_plan(both, targets, present, most_chunks=3, most_bytes=60, most_ops=2)


@query("J11_blank_component", "SELECT p_partkey, '/lib/modules/*/kernel/' || p_partkey AS path FROM part")
def j11(spark, d):
    s = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/lib/modules/6.1."), F.col("p_size").cast("string"), F.lit("/kernel/"), s)
    return table(spark, d, "part").select("p_partkey", planning.blank_component(path).alias("path"))


@query("J12_join", f"WITH {IMAGES}, {IMAGE_CHUNKS} SELECT image, state, count(*) AS n FROM images JOIN image_chunks USING (image) GROUP BY ALL")
def j12(spark, d):
    return images(spark, d).join(image_chunks(spark, d), "image").groupBy("image", "state").agg(F.count("*").alias("n"))


@query("J13_missing", f"WITH {IMAGE_CHUNKS} SELECT DISTINCT digest FROM image_chunks WHERE image % 2 = 0 AND digest NOT IN (SELECT digest FROM image_chunks WHERE image % 10 = 1) AND digest NOT IN (SELECT digest FROM image_chunks WHERE image % 10 = 3)")
def j13(spark, d):
    """J13, F14, G20."""
    c = image_chunks(spark, d)
    return planning.missing(c.filter("image % 2 = 0").select("digest"), c.filter("image % 10 = 1"), c.filter("image % 10 = 3"))


@query("G20_prefetch", f"""WITH RECURSIVE {CHUNKS}, want AS (SELECT package, digest, min(doc_id * 100000 + seq) AS place, max(chunk_size)::BIGINT AS size FROM chunks WHERE starts_with(path, '/en/') GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY place) AS k FROM want WHERE digest NOT IN (SELECT digest FROM chunks WHERE starts_with(path, '/de/')) AND substr(digest, 1, 1) > '3'),
fold AS (SELECT package, place, k, size, 0 AS op, 1 AS n, size AS b FROM g WHERE k = 1 UNION ALL SELECT g.package, g.place, g.k, g.size, fold.op + (fold.n >= 40 OR fold.b >= 9000)::INT, CASE WHEN fold.n >= 40 OR fold.b >= 9000 THEN 1 ELSE fold.n + 1 END, CASE WHEN fold.n >= 40 OR fold.b >= 9000 THEN g.size ELSE fold.b + g.size END FROM fold JOIN g ON g.package = fold.package AND g.k = fold.k + 1)
SELECT package, op AS request, count(*) AS chunks, sum(size)::BIGINT AS bytes, min(place) AS first FROM fold GROUP BY ALL""")
def g20(spark, d):
    """The requests that fetch the rest of a directory of every package."""
    c = chunks(spark, d).withColumn("place", F.col("doc_id") * 100_000 + F.col("seq"))
    held = c.filter(F.startswith("path", F.lit("/de/"))).select("digest").union(c.filter(F.substring("digest", 1, 1) <= "3").select("digest"))
    out = planning.prefetch(c, F.lit("/en"), held, most_chunks=40, most_bytes=9000)
    return out.groupBy("package", "request").agg(F.count("*").alias("chunks"), F.sum("chunk_size").alias("bytes"), F.min("place").alias("first"))


@query("J14_retry_list", f"WITH {IMAGES} SELECT p_partkey AS op, coalesce(any_value(state), '') AS upstream FROM part LEFT JOIN images ON image = p_partkey * 3 WHERE p_partkey % 5 = 0 GROUP BY 1")
def j14(spark, d):
    ops = table(spark, d, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("op"), (F.col("p_partkey") * 3).alias("image"))
    return ops.join(images(spark, d), "image", "left").dropDuplicates(["op"]).select("op", F.coalesce("state", F.lit("")).alias("upstream"))


@query("J18_cache_lookup", f"WITH {CATALOG}, stored AS (SELECT name AS cache_key, max(sph) AS manifest FROM catalog WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, coalesce(manifest, '') AS manifest, manifest IS NULL AS build FROM catalog LEFT JOIN stored ON name = cache_key")
def j18(spark, d):
    """Hits, and what is left to build."""
    c = catalog(spark, d)
    stored = c.filter("p_partkey % 2 = 0").groupBy(F.col("name").alias("cache_key")).agg(F.max("sph").alias("manifest"))
    hit = c.join(stored, F.col("name") == F.col("cache_key"), "left")
    return hit.select("p_partkey", F.coalesce("manifest", F.lit("")).alias("manifest"), F.col("manifest").isNull().alias("build"))


@query("J17_patterns", r"""WITH c AS (SELECT DISTINCT split_part(p_name, ' ', 1) || '-' AS inc FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) || '-' || substr(split_part(p_name, ' ', 2), 1, 1) FROM part),
kept AS (SELECT a.inc FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE len(a.inc) > len(b.inc) AND starts_with(a.inc, b.inc))), safe AS (SELECT inc FROM kept WHERE inc NOT LIKE 'red-%')
SELECT p_partkey FROM part JOIN safe ON starts_with(replace(p_name, ' ', '-'), inc)""")
def j17(spark, d):
    """Patterns that another subsumes and those that hit an excluded package go; then packages are matched.
    Patterns are kept by people or made per package name and few: they are matched in blocks, as a broadcast side."""
    p = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"))
    first = F.concat(F.substring_index("name", "-", 1), F.lit("-"))
    c = p.select(first.alias("inc")).union(p.select(F.concat(first, F.substring(F.substring_index("name", "-", -1), 1, 1)))).distinct()
    b = c.select(F.col("inc").alias("other"))
    kept = c.join(F.broadcast(b), F.expr("length(inc) > length(other) and inc rlike concat('^(?:', other, ')')"), "left_anti")
    bad = p.filter("name like 'red-%'").select(F.col("name").alias("excluded")).distinct()
    safe = kept.join(F.broadcast(bad), F.expr("excluded rlike concat('^(?:', inc, ')')"), "left_anti")
    return p.join(F.broadcast(safe), F.expr("name rlike concat('^(?:', inc, ')')"), "left_semi").select("p_partkey")


@query("W06_read_ahead", "WITH s AS (SELECT *, sum(CASE WHEN ts - lag > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag FROM events)), r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1 AS n FROM s), m AS (SELECT event_id, greatest(n - 2, n, 0) AS n FROM r) SELECT event_id, least(128, 8 * pow(2, least(n, 4)))::INT AS max_chunks, least(8, pow(2, greatest(n - 4, 0)))::INT AS max_ops FROM m")
def w06(spark, d):
    from ..functions.numbers import read_ahead
    from ..streaming.events import prior_reads

    e = prior_reads(events(spark, d), "user_id", 1800)
    size, ops = read_ahead(F.col("reads"), F.col("reads"))
    return e.select("event_id", size.alias("max_chunks"), ops.alias("max_ops"))


@query("W07_bin_pack", """WITH RECURSIVE g AS (SELECT o_custkey, o_orderkey, o_totalprice::BIGINT AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
f AS (SELECT o_custkey, o_orderkey, k, 0 AS op, 1 AS n, s AS b FROM g WHERE k = 1 UNION ALL SELECT g.o_custkey, g.o_orderkey, g.k, f.op + (f.n >= 4 OR f.b >= 500000)::INT, CASE WHEN f.n >= 4 OR f.b >= 500000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 4 OR f.b >= 500000 THEN g.s ELSE f.b + g.s END FROM f JOIN g ON g.o_custkey = f.o_custkey AND g.k = f.k + 1)
SELECT o_custkey, o_orderkey, op AS request FROM f""")
def w07(spark, d):
    """W07, O09."""
    o = table(spark, d, "orders").withColumn("s", F.rint("o_totalprice").cast("long"))
    return planning.packed(o, "o_custkey", "o_orderkey", "s", 4, 500000)


@query("A15_request_totals", "WITH x AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS request, o_totalprice::BIGINT AS s, o_orderstatus FROM orders) SELECT o_custkey, request::INT AS request, count(*) AS chunks, sum(s)::BIGINT AS bytes, bool_or(o_orderstatus = 'P') AS any_base FROM x GROUP BY ALL")
def a15(spark, d):
    """A15, A16, A18, A21."""
    o = table(spark, d, "orders").withColumn("s", F.rint("o_totalprice").cast("long"))
    p = planning.packed(o, "o_custkey", "o_orderkey", "s", 4, 1 << 60)
    return o.join(p, ["o_custkey", "o_orderkey"]).groupBy("o_custkey", "request").agg(F.count("*").alias("chunks"), F.sum("s").alias("bytes"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_base"))


@query("W12_newest_sources", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 3")
def w12(spark, d):
    return planning.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("G13_recompressible", "SELECT p_partkey, p_partkey % 3 <> 2 AND p_size * 3 <= 128 AND p_partkey % 2 = 0 AS whole FROM part")
def g13(spark, d):
    s, k = F.col("p_partkey").cast("string"), F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/share/man/man1/"), s, F.lit(".1.gz"))).when(k % 3 == 1, F.concat(F.lit("/lib/modules/6/kernel/"), s, F.lit(".ko.xz"))).otherwise(s)
    n = (F.col("p_size") * 3).cast("long")
    f = table(spark, d, "part").select("p_partkey", path.alias("path"), n.alias("chunks"), (n * 65536).alias("bytes"), n.alias("base_chunks"), (n * 65536).alias("base_bytes"), (n - k % 2).alias("base_present"))
    return planning.recompressible(f, most_bytes=1 << 40).select("p_partkey", "whole")


@query("T13_fallback", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'diff' WHEN p_partkey % 3 = 0 THEN 'again' ELSE 'single' END AS how FROM part")
def t13(spark, d):
    k = F.col("p_partkey")
    out = F.struct(F.when(k % 2 == 0, "diff").alias("diff"), F.when(k % 3 == 0, "again").alias("again"), F.lit("single").alias("single"))
    return table(spark, d, "part").select("p_partkey", planning.fallback(out).alias("how"))


_VERSIONS = rf"{CATALOG}, v AS (SELECT regexp_extract(name, '{text.VERSION}', 1) AS package, regexp_extract(name, '{text.VERSION}', 2) AS version, p_partkey FROM catalog), a AS (SELECT package, arg_max(version, p_partkey) AS version FROM v WHERE package <> '' AND p_partkey % 2 = 0 AND package <> 'red-bolt' GROUP BY 1), b AS (SELECT package, arg_max(version, p_partkey) AS version FROM v WHERE package <> '' AND p_partkey % 2 = 1 AND package <> 'hot-ring' GROUP BY 1)"


def version_frames(spark, d):
    c = catalog(spark, d)
    drop = lambda f, name: f.filter(F.col("package") != name)
    return drop(reports.versions(c.filter("p_partkey % 2 = 0"), "p_partkey"), "red-bolt"), drop(reports.versions(c.filter("p_partkey % 2 = 1"), "p_partkey"), "hot-ring")


@query("J08_version_diff", f"WITH {_VERSIONS} SELECT package, coalesce(a.version, '') AS old, coalesce(b.version, '') AS new, CASE WHEN a.version IS NULL THEN 'added' WHEN b.version IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (package) WHERE a.version IS DISTINCT FROM b.version")
def j08(spark, d):
    out = reports.version_diff(*version_frames(spark, d))
    return out.select("package", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"), "change")


@query("K11_report", f"WITH {_VERSIONS} SELECT package, package || ': ' || coalesce(a.version, 'none') || ' -> ' || coalesce(b.version, 'none') AS line FROM a FULL JOIN b USING (package) WHERE a.version IS DISTINCT FROM b.version")
def k11(spark, d):
    return reports.report_line(reports.version_diff(*version_frames(spark, d))).orderBy("line")


@query("A12_names", f"WITH {CATALOG} SELECT p_partkey % 10 AS g, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM catalog GROUP BY 1")
def a12(spark, d):
    """A12, O05."""
    return catalog(spark, d).groupBy((F.col("p_partkey") % 10).alias("g")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("A17_last_write", f"WITH {CATALOG} SELECT name, arg_max(sph, p_partkey) AS sph, max(p_partkey) AS p_partkey FROM catalog GROUP BY name")
def a17(spark, d):
    """A17, K05, K06."""
    c = catalog(spark, d).withColumn("version", F.col("p_partkey"))
    return chunking.latest(c, ["name"], "version").select("name", "sph", "p_partkey")


@query("J09_reconcile", "WITH r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 4 <> 0) SELECT k, CASE WHEN f.k IS NULL THEN 'unmark' ELSE 'mark' END AS action FROM (SELECT coalesce(r.k, f.k) AS k, r.k AS rk, f.k AS fk FROM r FULL JOIN f ON r.k = f.k) f(k, rk, fk) WHERE rk IS NULL OR fk IS NULL".replace("CASE WHEN f.k IS NULL", "CASE WHEN fk IS NULL"))
def j09(spark, d):
    """J09, G19."""
    r = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"))
    f = table(spark, d, "lineitem").filter("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("k")).distinct()
    return reports.reconcile(r, f, "k")


_KINDS = ("view", "signup", "click", "error", "purchase")


@query("A10_counter_delta", "WITH c AS (SELECT event_type AS k, count(*) FILTER (event_id < 5000) AS b, count(*) AS a FROM events GROUP BY 1) SELECT sum(CASE WHEN k = 'view' THEN a - b ELSE 0 END)::BIGINT AS single_reqs, sum(CASE WHEN k = 'click' THEN a - b ELSE 0 END)::BIGINT AS batch_reqs, sum(CASE WHEN k = 'purchase' THEN a - b ELSE 0 END)::BIGINT AS diff_reqs, sum(CASE WHEN k IN ('view', 'click', 'purchase') THEN a - b ELSE 0 END)::BIGINT AS total_reqs FROM c")
def a10(spark, d):
    names = {"single_reqs": "view", "batch_reqs": "click", "diff_reqs": "purchase"}
    snapshot = lambda e: e.agg(*[F.count_if(F.col("event_type") == k).alias(n) for n, k in names.items()])
    e = table(spark, d, "events")
    return reports.counter_delta(snapshot(e.filter("event_id < 5000")), snapshot(e), tuple(names))


@query("A11_diff_stats", "SELECT count(*) AS reqs, sum(l_quantity)::BIGINT AS req_bytes, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS diff_bytes, round(100 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS pct FROM lineitem")
def a11(spark, d):
    diff = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0))
    return table(spark, d, "lineitem").agg(F.count("*").alias("reqs"), F.sum("l_quantity").cast("long").alias("req_bytes"), diff.cast("long").alias("diff_bytes"), F.round(F.try_divide(diff * 100, F.sum("l_quantity")), 6).alias("pct"))


@query("A19_set_size", "SELECT p_brand, sum(p_size)::BIGINT AS size FROM part GROUP BY p_brand")
def a19(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("size"))


@query("O01_path_order", "SELECT page_id, row_number() OVER (ORDER BY string_split(p, '/'), page_id) AS place FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)")
def o01(spark, d):
    """An explicit total order; places by prefix sums over sorted ranges."""
    from .source_queries import scratch

    p = table(spark, d, "pages").select("page_id", F.split(F.regexp_replace("url", "^https?://", ""), "/").alias("parts"))
    return ordered.ranked(p, ["parts", "page_id"], "place", scratch(spark, "places")).select("page_id", "place")


@query("U04_maps_and_lists", "SELECT o_orderkey, '{\"a\":' || o_custkey || ',\"b\":2}' AS merged, 'x' || o_orderkey || 'y' AS joined FROM orders")
def u04(spark, d):
    """U04, U06, P01."""
    o = table(spark, d, "orders")
    merged = F.map_concat(F.create_map(F.lit("a"), F.col("o_custkey")), F.map_filter(F.create_map(F.lit("b"), F.lit(2).cast("long"), F.lit("c"), F.lit(0).cast("long")), lambda k, v: v > 0))
    return o.select("o_orderkey", F.to_json(merged).alias("merged"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit("y")).alias("joined"))


@query("X12_strip_root", "SELECT p_partkey // 10 AS archive, p_partkey, CASE WHEN (p_partkey // 10) % 2 = 0 THEN '/f' || p_partkey ELSE '/d' || p_partkey % 2 || '/f' || p_partkey END AS path FROM part")
def x12(spark, d):
    """A single top directory of all an archive's paths is left out."""
    k = F.col("p_partkey")
    a = F.floor(k / 10)
    top = F.when(a % 2 == 0, F.lit("/top")).otherwise(F.concat(F.lit("/d"), (k % 2).cast("string")))
    rows = table(spark, d, "part").select(a.alias("archive"), "p_partkey", F.concat(top, F.lit("/f"), k.cast("string")).alias("path"))
    tops = rows.groupBy("archive").agg(F.min(F.split_part("path", F.lit("/"), F.lit(2))).alias("lo"), F.max(F.split_part("path", F.lit("/"), F.lit(2))).alias("hi"))
    cut = F.when(F.col("lo") == F.col("hi"), F.substring("path", F.length("lo") + 2, F.length("path"))).otherwise(F.col("path"))
    return rows.join(tops, "archive").select("archive", "p_partkey", cut.alias("path"))


@query("G18_introspect", f"WITH {_SIZED} SELECT 'chunks' AS what, count(*) AS n FROM slab UNION ALL SELECT 'present', count(*) FROM slab WHERE present UNION ALL SELECT 'slabs', count(*) FROM ends UNION ALL SELECT 'blocks', sum(blocks)::BIGINT FROM sized")
def g18(spark, d):
    """Only the parts that are asked for are planned."""
    from ..operators.introspect import introspect

    return introspect(*slab_and_ends(spark, d), ["chunks", "present", "slabs", "blocks"])


@query("G23_closure_pipeline", f"""WITH {CATALOG}, p AS (SELECT p_partkey, '/store/' || substr(translate(md5(p_partkey::VARCHAR), 'e', 'g'), 1, 32) || '-' || name AS path, name FROM catalog WHERE name NOT LIKE '%red%')
SELECT substr(path, 8, 32) AS sph, substr(path, 41) AS name, CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'own' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'public' ELSE 'own' END END AS origin FROM p""")
def g23(spark, d):
    """A JSON listing, filtered, classified."""
    from ..sources.texts import path_info

    c, k = catalog(spark, d), F.col("p_partkey")
    path = F.concat(F.lit("/store/"), F.translate(F.md5(k.cast("string").cast("binary")), "e", "g"), F.lit("-"), F.col("name"))
    signatures = F.when(k % 3 == 0, F.array(F.lit("trusted-1:x"))).when(k % 3 == 1, F.array(F.lit("o:x"))).otherwise(F.array().cast("array<string>"))
    json = F.to_json(F.map_from_arrays(F.array(path), F.array(F.struct((k * 7).alias("narSize"), signatures.alias("signatures")))))
    rows = c.select("p_partkey", F.inline(path_info(json))).filter(~F.col("path").contains("red"))
    public = text.is_public(F.col("signatures"), "trusted-1:", k % 2 == 0)
    return rows.select(F.substring("path", 8, 32).alias("sph"), F.substring("path", 41, 500).alias("name"), F.when(public, "public").otherwise("own").alias("origin"))
