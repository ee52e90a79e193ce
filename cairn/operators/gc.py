"""Garbage collection: mark from roots, sweep, summarise."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roots(images: DataFrame, dead_states: list) -> DataFrame:
    """images in no deleted state."""
    return images.filter(~F.col("state").isin(dead_states))


def live_digests(image_chunks: DataFrame, manifest_chunks: DataFrame, keep: DataFrame) -> DataFrame:
    """Digests of kept images' files and of their manifests, each once."""
    both = image_chunks.select("image", "digest").unionByName(manifest_chunks.select("image", "digest"))
    return both.join(keep.select("image"), "image", "left_semi").select("digest").distinct()


def dead(rows: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not kept."""
    return rows.join(keep.select(key), key, "left_anti")


def summary(images: DataFrame, kept: DataFrame, stored: DataFrame, live: DataFrame) -> DataFrame:
    """Metric, state, value: images by state that go and stay, and chunk counts (state empty)."""
    flag = F.when(F.col("k_").isNull(), "delete_images").otherwise("remain_images")
    by_state = images.join(kept.select("image", F.lit(True).alias("k_")), "image", "left").groupBy(flag.alias("metric"), "state").agg(F.count("*").alias("value"))
    count = lambda d, name: d.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("state"), "value")
    chunks = count(live, "remain_ref_chunks").unionByName(count(stored.join(live, "digest", "left_semi"), "remain_have_chunks")).unionByName(count(stored.join(live, "digest", "left_anti"), "delete_chunks"))
    return by_state.unionByName(chunks)


def root_is_valid(key: Column, now: Column, age_days: int) -> Column:
    """kind@time@release@commit with a readable time that isn't too old; others are not roots."""
    parts = F.split(key, "@")
    at = F.try_to_timestamp(F.try_element_at(parts, F.lit(2)), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return (F.size(parts) >= 4) & F.coalesce(at >= now - F.make_dt_interval(F.lit(age_days)), F.lit(False))


def reach(roots_: DataFrame, packages: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Everything that valid roots reach, by kind: package hashes, manifests, and chunks of manifests and of
    files. The depth is fixed, so it is a chain of joins; each node is traced once; missing objects are passed over.
    roots_(sphs array, manifest_keys array), packages(sph), manifests(key, digests array), files(key, digest)."""
    sph = roots_.select(F.explode("sphs").alias("sph")).distinct().join(packages.select("sph").distinct(), "sph", "left_semi")
    keys = roots_.select(F.explode("manifest_keys").alias("key")).distinct()
    found = manifests.join(keys, "key", "left_semi")
    own = found.select(F.explode("digests").alias("id"))
    chunks = files.join(found.select("key").distinct(), "key", "left_semi").select(F.col("digest").alias("id"))
    kinds = [("package", sph.select(F.col("sph").alias("id"))), ("manifest", found.select(F.col("key").alias("id"))), ("chunk", own.union(chunks))]
    out = None
    for kind, d in kinds:
        d = d.select(F.lit(kind).alias("kind"), "id").distinct()
        out = d if out is None else out.unionByName(d)
    return out


def object_class(key: Column) -> tuple[Column, Column]:
    """(class, id) of an object by its key's shape; always = kept in any case, unknown = never."""
    name = F.substring_index(key, "/", -1)
    rules = [
        (F.startswith(key, F.lit("cache/nar/")), "nar", F.substring(key, F.lit(11), F.length(key))),
        (F.startswith(key, F.lit("cache/")) & F.endswith(key, F.lit(".narinfo")), "narinfo", F.regexp_replace(name, r"\.narinfo$", "")),
        (key == "cache/cache-info", "always", F.lit("")),
        (F.startswith(key, F.lit("manifest/")), "manifest", name),
        (F.startswith(key, F.lit("chunk/")) & name.rlike("^[A-Za-z0-9_-]+$"), "chunk", name),
    ]
    kind, ident = F.lit("unknown"), F.lit("")
    for cond, k, i in reversed(rules):
        kind, ident = F.when(cond, k).otherwise(kind), F.when(cond, i).otherwise(ident)
    return kind, ident


def sweep(objects: DataFrame, good: DataFrame) -> DataFrame:
    """Each stored object with whether it stays: its (class, id) is reached, or it is always kept."""
    kind, ident = object_class(F.col("key"))
    d = objects.withColumns({"kind": kind, "id": ident})
    hit = good.select("kind", "id", F.lit(True).alias("good_")).distinct()
    return d.join(hit, ["kind", "id"], "left").withColumn("keep", (F.col("kind") == "always") | F.col("good_").isNotNull()).drop("good_", "id")


def local(slab: DataFrame, ends: DataFrame, refs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G16 from slab(digest, slab_id, addr), refs(digest, owner) and keep(owner): the slab's chunks with n_refs, n_kept, `dead` (no
    reference stays; a chunk without any is dead) and `rewrite` (some go, some stay), and the ranges to punch."""
    from .refs import kept_refs
    from .slab import freed_ranges

    chunks = slab.join(kept_refs(refs, keep).drop("rewrite"), "digest", "left").fillna(0, ["n_refs", "n_kept"])
    chunks = chunks.withColumns({"dead": F.col("n_kept") == 0, "rewrite": (F.col("n_kept") > 0) & (F.col("n_kept") < F.col("n_refs"))})
    return chunks, freed_ranges(chunks, ends)


def totals(swept: DataFrame) -> DataFrame:
    """Objects and bytes in all, removed and kept; each object counts once."""
    gone = ~F.col("keep")
    return swept.agg(
        F.count("*").alias("total_count"), F.sum("size").alias("total_bytes"), F.count_if(gone).alias("removed_count"),
        F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("removed_bytes"), F.count_if("keep").alias("kept_count"), F.coalesce(F.sum(F.when(F.col("keep"), F.col("size"))), F.lit(0)).alias("kept_bytes"),
    )


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All nodes that a start reaches over edges(src, dst): (start, node), starts included. Semi-naive:
    each round joins only what the last one found, until it finds nothing; rounds are checkpointed, and every few the whole."""
    found = new = starts.select(F.col("node").alias("start"), "node").distinct()
    for k in itertools.count(1):
        step = new.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = step.join(found, ["start", "node"], "left_anti").checkpoint()
        if new.isEmpty():
            return found
        found = found.union(new)
        if k % 8 == 0:  # else the plan grows by a branch a round
            found = found.checkpoint()
