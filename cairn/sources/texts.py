"""Text, JSON and listing sources as Column expressions and readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NARINFO_KEYS = ("StorePath", "URL", "Compression", "FileHash", "FileSize", "NarHash", "NarSize", "References", "Deriver", "System", "Sig", "CA")
#: first letters of base64url digests: one input partition each
LISTING_PARTS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def narinfo(text: Column) -> dict[str, Column]:
    """Fields of a text of `Key: value` lines; a missing one is null. Sig may repeat (an array)."""
    first = lambda k: F.when(text.rlike(rf"(?m)^{k}: "), F.regexp_extract(text, rf"(?m)^{k}: (.*)$", 1))
    out = {k: first(k) for k in NARINFO_KEYS if k != "Sig"}
    out["Sig"] = F.regexp_extract_all(text, F.lit(r"(?m)^Sig: (.*)$"), F.lit(1))
    for k in ("FileSize", "NarSize"):
        out[k] = out[k].try_cast("long")
    out["References"] = F.when(F.coalesce(out["References"], F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(out["References"], " "))
    return out


def narinfo_files(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.read.text(folder, wholetext=True)
    return d.select(*[c.alias(k) for k, c in narinfo(F.col("value")).items()])


def path_info(json: Column) -> Column:
    """A JSON object of store path -> info, as an array of (path, size, signatures)."""
    m = F.from_json(json, "map<string, struct<narSize: bigint, signatures: array<string>>>")
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("path"), e["value"]["narSize"].alias("size"), F.coalesce(e["value"]["signatures"], F.array().cast("array<string>")).alias("signatures")))


def extent_blocks(line: Column) -> Column:
    """Blocks of a line `index: first..last: physical...`; none of other lines."""
    a = F.regexp_extract(line, r"^\s*\d+:\s*(\d+)\.\.\s*(\d+):", 1).try_cast("long")
    b = F.regexp_extract(line, r"^\s*\d+:\s*(\d+)\.\.\s*(\d+):", 2).try_cast("long")
    return F.when(a.isNull() | b.isNull() | (b < a), F.array().cast("array<long>")).otherwise(F.sequence(a, F.greatest(a, b)))


def pins(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON document with a list `pins`."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("pins"))


def save_pins(rows: DataFrame) -> DataFrame:
    """The document of the rows; a list that people keep by hand, so one row."""
    return rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("pins")), {"pretty": "true"}).alias("value"))


def partitioned_listing(objects: DataFrame, key: str = "key") -> DataFrame:
    """A listing dealt out by the first letter of the objects' names."""
    first = F.substring(F.substring_index(key, "/", -1), 1, 1)
    part = F.instr(F.lit(LISTING_PARTS), first)
    return objects.withColumn("part", part).repartitionByRange(64, "part", key)


def changed(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """What a poll sees anew: keys that are new or have another value than in the last snapshot."""
    b = before.select(key, F.col(value).alias("was_"))
    return now.join(b, key, "left").filter(~F.col(value).eqNullSafe(F.col("was_"))).drop("was_")


def resolved_refs(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """requests(repo, ref) to hashes: a commit is itself; else heads, then tags, then the full name."""
    from ..functions.text import is_commit

    forms = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(p), F.col("ref")).alias("name")) for i, p in enumerate(("refs/heads/", "refs/tags/", ""))])
    d = requests.select("repo", "ref", F.inline(forms)).join(refs, ["repo", "name"])
    best = d.groupBy("repo", "ref").agg(F.min_by("hash", "rank").alias("found"))
    return requests.join(best, ["repo", "ref"], "left").withColumn("hash", F.when(is_commit(F.col("ref")), F.col("ref")).otherwise(F.col("found"))).drop("found")


def listed_keys(keys: DataFrame, table: DataFrame, key: str, valid: Column) -> DataFrame:
    """Rows of an explicit list of keys; bad and missing ones come out with what is wrong."""
    bad = F.when(~valid, "bad").when(F.col("hit_").isNull(), "missing")
    return keys.join(table.withColumn("hit_", F.lit(True)), key, "left").withColumn("problem", bad).drop("hit_")


def blob(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one value."""
    return spark.read.text(path, wholetext=True)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's files with their bytes, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
