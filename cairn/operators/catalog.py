"""Similar names: the best package to take a difference from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text


def best_base(names: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """For each (name, sph) the other one with the same text through the first dash and as many
    dashes whose common prefix with it is longest; of several the last by (name, sph). A name without a dash
    matches names without one that start with it. Names of fewer than 3 letters and `source` get none.

    In sorted order the longest common prefix stands beside a name, so it is found among its two neighbours;
    the last name with that prefix is then one of the prefix's two greatest. Sorting and grouping, no pairs."""
    n = names.select("name", "sph").withColumn("dashes", text.dash_count(F.col("name"))).withColumn("head", text.head_token(F.col("name")))
    dashed, plain = n.filter("dashes > 0"), n.filter("dashes = 0")
    w = W.partitionBy("head", "dashes").orderBy("name", "sph")
    lcp = lambda other: F.when(other.isNotNull(), text.common_prefix(F.col("name"), other))
    near = dashed.withColumn("m", F.greatest(lcp(F.lag("name").over(w)), lcp(F.lead("name").over(w)))).filter("m is not null")
    near = near.withColumn("prefix", F.substring("name", F.lit(1), F.col("m")))
    # all names that could answer for a prefix: those that start with it
    cuts = near.select("head", "dashes", "m").distinct()
    longer = dashed.join(cuts, ["head", "dashes"]).filter(F.length("name") >= F.col("m")).withColumn("prefix", F.substring("name", F.lit(1), F.col("m")))
    top = _two_last(longer, ["head", "dashes", "prefix"])
    a = _other(near.join(top, ["head", "dashes", "prefix"]))
    starts = plain.select("name", "sph", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("k")).withColumn("prefix", F.substring("name", F.lit(1), F.col("k")))
    b = _other(plain.withColumn("m", F.length("name")).join(_two_last(starts, ["prefix"]).withColumnRenamed("prefix", "name"), "name"))
    out = a.unionByName(b).filter((F.length("name") >= 3) & (F.col("name") != "source"))
    return out if requests is None else out.join(requests.select("name", "sph"), ["name", "sph"], "left_semi")


def _two_last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group its greatest (name, sph) and the one before."""
    last = rows.groupBy(*keys).agg(F.max(F.struct("name", "sph")).alias("last"))
    before = rows.join(last, keys).filter(F.struct("name", "sph") < F.col("last")).groupBy(*keys).agg(F.max(F.struct("name", "sph")).alias("before"))
    return last.join(before, keys, "left")


def _other(rows: DataFrame) -> DataFrame:
    own = F.col("last") == F.struct("name", "sph")
    d = rows.withColumn("base", F.when(own, F.col("before")).otherwise(F.col("last"))).filter("base is not null")
    return d.select("name", "sph", F.col("base.name").alias("base_name"), F.col("base.sph").alias("base_sph"), F.col("m").alias("match"))


def two_indexes(stored: DataFrame, upserts: DataFrame, version: str) -> DataFrame:
    """The catalog's rows (index, key, value) after upserts(sph, name, version): `name` has name and hash as its key,
    `sph` the hash with the name as value. Both are made from the last write of each hash, so that they agree."""
    from .chunking import latest

    columns = ["sph", "name", version]
    rows = latest(stored.select(*columns).unionByName(upserts.select(*columns)), ["sph"], version)
    by_name = F.struct(F.lit("name").alias("index"), F.concat_ws("/", "name", "sph").alias("key"), F.lit("").alias("value"))
    by_hash = F.struct(F.lit("sph").alias("index"), F.col("sph").alias("key"), F.col("name").alias("value"))
    return rows.select(F.inline(F.array(by_name, by_hash)))


def answers(built: DataFrame, stored: DataFrame) -> DataFrame:
    """What the cache takes of built(key, alias, digest): a row (key, digest) under the key and one under the alias (none
    where it is null), but for keys that stored(key) has. Of several answers to a key the least digest counts."""
    rows = built.select(F.explode(F.array("key", "alias")).alias("key"), "digest").filter("key is not null")
    return rows.groupBy("key").agg(F.min("digest").alias("digest")).join(stored.select("key"), "key", "left_anti")
