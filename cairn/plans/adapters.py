"""Test tables in the shapes of the data model (the mapping is this repository's own), and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE, INLINE = 256, 224
SLAB_BLOCKS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file /lang/doc_id of the package `source`; its payload is its text in UTF-8."""
    d = table(spark, sf_dir, "documents")
    payload = F.encode("text", "UTF-8")
    return d.select("doc_id", F.col("source").alias("package"), F.concat_ws("/", F.lit(""), "lang", F.col("doc_id").cast("string")).alias("path"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"))


ENTRIES = "entries AS (SELECT doc_id, source AS package, '/' || lang || '/' || doc_id AS path, encode(text) AS payload, octet_length(encode(text))::BIGINT AS size FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of PIECE bytes of all files over the inline size."""
    from ..operators.chunking import cut

    return cut(entries(spark, sf_dir).filter(F.col("size") > INLINE), ["doc_id", "package", "path"], piece=PIECE)


CHUNKS = f"""{ENTRIES}, pieces AS (SELECT doc_id, package, path, size, payload, unnest(range(0, (size + {PIECE - 1}) // {PIECE})) AS seq FROM entries WHERE size > {INLINE}),
cut AS (SELECT doc_id, package, path, seq, seq * {PIECE} AS "offset", array_slice(payload, seq * {PIECE} + 1, least((seq + 1) * {PIECE}, size)) AS data, least({PIECE}, size - seq * {PIECE}) AS chunk_size FROM pieces),
chunks AS (SELECT *, substr(sha256(data), 1, 48) AS digest FROM cut)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages: name-like names with a version, every seventh without a dash."""
    d = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string")))
    return d.select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("sph"), name.alias("name"))


CATALOG = "catalog AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 10, '0') AS sph, CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '') ELSE replace(p_name, ' ', '-') || '-' || p_size END AS name FROM part)"


def store_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "e", "g")
    h = F.when(F.col("p_partkey") % 11 == 0, F.substring(h, 1, 31)).otherwise(h)
    return catalog(spark, sf_dir).withColumn("path", F.concat(F.lit("/store/"), h, F.lit("-"), F.col("name")))


PATHS = f"{CATALOG}, paths AS (SELECT *, '/store/' || CASE WHEN p_partkey % 11 = 0 THEN substr(translate(md5(p_partkey::VARCHAR), 'e', 'g'), 1, 31) ELSE translate(md5(p_partkey::VARCHAR), 'e', 'g') END || '-' || name AS path FROM catalog)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("image_size"))


IMAGES = "images AS (SELECT o_orderkey AS image, o_orderstatus AS state, o_totalprice AS image_size FROM orders)"


def image_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as its chunks: digest from part and supplier, blocks from the quantity."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("digest"), F.col("l_quantity").cast("int").alias("blocks"))
    return d.groupBy("image", "digest").agg(F.max("blocks").alias("blocks"))


IMAGE_CHUNKS = "image_chunks AS (SELECT l_orderkey AS image, l_partkey * 1000000 + l_suppkey AS digest, max(l_quantity::INT) AS blocks FROM lineitem GROUP BY ALL)"


def manifest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("image", (-F.col("image") - 1).alias("digest"))


MANIFEST_CHUNKS = "manifest_chunks AS (SELECT image, -image - 1 AS digest FROM images)"


def slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allotted chunks: slab_id, addr, digest, blocks, owner (first image), present (three of four)."""
    from ..operators.slab import allocate

    d = allocate(image_chunks(spark, sf_dir), ["image", "digest"], slab_blocks=SLAB_BLOCKS)
    return d.withColumn("present", F.col("digest") % 4 != 0)


ROOM = SLAB_BLOCKS - 4 - 256
SLAB = f"""{IMAGE_CHUNKS}, firsts AS (SELECT digest, min(image) AS image, arg_min(blocks, image) AS blocks FROM image_chunks GROUP BY digest),
sums AS (SELECT *, coalesce(sum(blocks) OVER (ORDER BY image, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM firsts),
slab AS (SELECT digest, (before // {ROOM})::INT AS slab_id, before % {ROOM} + 4 AS addr, blocks::BIGINT AS blocks, digest % 4 <> 0 AS present FROM sums)"""


def slab_and_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Allotted once, as both are asked for together; a checkpoint, so that it outlives a lost executor."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    s = slab(spark, sf_dir).checkpoint()
    return s, ends_of(s)


def ends_of(s: DataFrame) -> DataFrame:
    return s.groupBy("slab_id").agg(F.max(F.col("addr") + F.col("blocks")).alias("slab_end"))


SLAB_ENDS = f"{SLAB}, ends AS (SELECT slab_id, max(addr + blocks) AS slab_end FROM slab GROUP BY slab_id)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def page_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' ids as archive addresses of forges and releases."""
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    commit = F.sha1(s.cast("binary"))
    url = (
        F.when(k % 7 == 0, F.concat(F.lit("https://github.com/o"), s, F.lit("/r/archive/v"), s, F.lit(".tar.gz")))
        .when(k % 7 == 1, F.concat(F.lit("https://gitlab.com/o"), s, F.lit("/r/-/archive/v1/r-v1.tar.gz")))
        .when(k % 7 == 2, F.concat(F.lit("https://bitbucket.org/o/r"), s, F.lit("/get/main.tar.gz")))
        .when(k % 7 == 3, F.concat(F.lit("https://codeberg.org/o"), s, F.lit("/r/archive/main.tar.gz")))
        .when(k % 7 == 4, F.concat(F.lit("https://git.sr.ht/~o/r"), s, F.lit("/archive/main.tar.gz")))
        .when(k % 7 == 5, F.concat(F.lit("https://releases.nixos.org/nixos/25.11/nixos-25.11."), s, F.lit(".d9bc5c7dceb3/nixexprs.tar.xz")))
        .otherwise(F.concat(F.lit("https://example.org/dl/pkg-"), s, F.lit(".tar.gz")))
    )
    return table(spark, sf_dir, "pages").select("page_id", commit.alias("commit"), url.alias("archive"))


ARCHIVES = """archives AS (SELECT page_id, sha1(page_id::VARCHAR) AS "commit", CASE page_id % 7
WHEN 0 THEN 'https://github.com/o' || page_id || '/r/archive/v' || page_id || '.tar.gz' WHEN 1 THEN 'https://gitlab.com/o' || page_id || '/r/-/archive/v1/r-v1.tar.gz'
WHEN 2 THEN 'https://bitbucket.org/o/r' || page_id || '/get/main.tar.gz' WHEN 3 THEN 'https://codeberg.org/o' || page_id || '/r/archive/main.tar.gz'
WHEN 4 THEN 'https://git.sr.ht/~o/r' || page_id || '/archive/main.tar.gz' WHEN 5 THEN 'https://releases.nixos.org/nixos/25.11/nixos-25.11.' || page_id || '.d9bc5c7dceb3/nixexprs.tar.xz'
ELSE 'https://example.org/dl/pkg-' || page_id || '.tar.gz' END AS archive FROM pages)"""
