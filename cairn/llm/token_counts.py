"""Token counts through a digest cache.

The cache is a table of (version, digest, n_tokens): version is the digest of the model file with the library's name
and version, digest that of the text (a null text counts as empty; nothing else is normalised, since counts must
be those of the whole text as it stands). Distinct texts are anti-joined with it, only the misses are
encoded, and their counts are appended; then all documents join the cache. Texts move once, to find the
distinct ones, and copies are dropped before that move. Digests of more than one row in MOST_HOT are fewer than
MOST_HOT: their counts are broadcast, and their rows are dealt by number in the join. Appends of a failed or
repeated job leave either no row or the same row again, so reading takes one row per digest.

Rows that repeat stay rows. Empty table: empty result, and nothing is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, text_or_empty, written
from .units import MOST_UNITS, units

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
MOST_HOT = 2000
BLANK = "▁"
_loaded: dict = {}


def version_of(path: str) -> str:
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return f"{library.__name__}-{library.__version__}-{hashlib.sha256(Path(path).read_bytes()).hexdigest()}"


class PieceCounter:
    """Counts of a sentencepiece model, unit by unit where that is the same as at once."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inside = [p for p in pieces if BLANK in p[1:] and p.strip(BLANK)]
        odd = "".join(chr(c) for c in (0x20AC, 0xFB01, 0xA0, 0x3000, 0x0301))  # would be changed by a normaliser
        same = self.model.decode(self.model.encode(f"a {odd} b")) == f"a {odd} b"
        self.by_unit = not inside and same
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        known = self.known
        if len(known) > MOST_UNITS:
            known.clear()
        whole, cut = {}, []
        for i, t in enumerate(texts):
            if BLANK in t or "\0" in t:
                whole[i] = t
                cut.append([])
            else:
                cut.append(units(t) if t else [])
        new = list(set().union(*cut) - known.keys())
        known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        out = [sum(map(known.__getitem__, c)) for c in cut]
        for i, n in zip(whole, self.model.encode(list(whole.values()), num_threads=1)):
            out[i] = len(n)
        return out


class TokenizerCounter:
    """Counts of a tokenizers file."""

    def __init__(self, path: str) -> None:
        from .token_files import UnitEncoder

        self.encoder = UnitEncoder(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode(texts)]


def counter(path: str):
    if path not in _loaded:
        _loaded[path] = (PieceCounter if path.endswith(".model") else TokenizerCounter)(path)
    return _loaded[path]


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """digest, text -> digest, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                n = counter(path).counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's counts of this version; a cache that isn't there yet is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def join_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with n_tokens of their digest, however many share one. Rows of a hot digest get a key that no digest
    has (a row number is shorter), so they are spread over the tasks of the join that looks up the others."""
    least = rows.count() // MOST_HOT
    hot = rows.groupBy("digest").agg(F.count("*").alias("rows_")).filter(F.col("rows_") > least).select("digest")
    known = hot.join(counts, "digest").withColumnRenamed("n_tokens", "hot_")
    number = F.monotonically_increasing_id().cast("string").cast("binary")
    dealt = rows.join(F.broadcast(known), "digest", "left").withColumn("digest", F.when(F.col("hot_").isNull(), F.col("digest")).otherwise(number))
    return dealt.join(counts, "digest", "left").withColumn("n_tokens", F.coalesce("hot_", "n_tokens")).drop("hot_")


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. cache: a folder of the table, made if missing."""
    spark = docs.sparkSession
    cache, version = cache or fresh_path(spark, "token-cache"), version_of(path)
    text = text_or_empty()
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    distinct = keyed.select("digest", "text").dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")
    encode_misses(misses, path).select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    out = join_counts(written(keyed.drop("text"), "digests"), read_cache(spark, cache, version))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
