"""Planning of differences: which base chunks stand beside which wanted chunks, in what requests."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import recompress_class
from .ordered import fold

MOST_CHUNKS, MOST_BYTES, MOST_OPS, MOST_SOURCES = 128, 12 << 20, 8, 3


def aligned(wanted: DataFrame, base: DataFrame) -> DataFrame:
    """Wanted and base chunks of a pair side by side: of the same path at the same index, else (the base
    lacks the path) by place among all chunks of the image. wanted/base: pair, path, idx, ordinal, digest, size."""
    b = base.select(F.col("pair").alias("b_pair"), F.col("path").alias("b_path"), F.col("idx").alias("b_idx"), F.col("ordinal").alias("b_ordinal"), F.col("digest").alias("base_digest"), F.col("size").alias("base_size"))
    paths = base.select("pair", "path", F.lit(True).alias("has_")).distinct()
    w = wanted.join(paths, ["pair", "path"], "left")
    same = w.filter("has_").join(b.drop("b_ordinal"), (F.col("pair") == F.col("b_pair")) & (F.col("path") == F.col("b_path")) & (F.col("idx") == F.col("b_idx")), "left").drop("b_pair", "b_path", "b_idx")
    other = w.filter("has_ is null").join(b.drop("b_idx", "b_path"), (F.col("pair") == F.col("b_pair")) & (F.col("ordinal") == F.col("b_ordinal")), "left").drop("b_pair", "b_ordinal")
    return same.withColumn("how", F.lit("path")).unionByName(other.withColumn("how", F.lit("ordinal"))).drop("has_")


def blank_component(path: Column, n: int = 3) -> Column:
    """A path with its nth component left out, so that versions of a directory compare equal."""
    return F.regexp_replace(path, "^((?:/[^/]+){%d})/[^/]+" % (n - 1), "$1/*")


def base_files(wanted: DataFrame, base: DataFrame, loose: Column | bool = True) -> DataFrame:
    """Adds to wanted(pair, path) the base_path of its pair's base(pair, path): the same path, or, for a compressed kernel
    module whose pair is `loose` (a pair of kernels), the first path that differs in the version's directory alone; else null.
    A pattern a file would be a nested loop; with the directory blanked it is an equi-join."""
    module = lambda path: path.startswith("/lib/modules/") & path.endswith(".ko.xz")
    blanked = lambda path: F.when(module(path), blank_component(path)).otherwise(path).alias("blank_")
    held = base.select("pair", "path", F.col("path").alias("same_")).distinct()
    other = base.filter(module(F.col("path"))).groupBy("pair", blanked(F.col("path"))).agg(F.min("path").alias("other_"))
    d = wanted.join(held, ["pair", "path"], "left").withColumn("blank_", blanked(F.col("path"))).join(other, ["pair", "blank_"], "left")
    swapped = F.when(module(F.col("path")) & (F.lit(loose) if isinstance(loose, bool) else loose), F.col("other_"))
    return d.withColumn("base_path", F.coalesce("same_", swapped)).drop("blank_", "same_", "other_")


def missing(wanted: DataFrame, *held: DataFrame) -> DataFrame:
    """Wanted digests, each once, that none of the others (present, on their way, planned) holds."""
    d = wanted.dropDuplicates(["digest"])
    for other in held:
        d = d.join(other.select("digest"), "digest", "left_anti")
    return d


def packed(rows: DataFrame, key: str, order: str, size: str, most_chunks: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of a key, in order, in requests of at most most_chunks; a request is closed before a row once
    it has most_bytes (so it may go over by one row): (key, order, request)."""

    def step(state: tuple, bytes_: int) -> tuple[tuple, int]:
        request, n, held = state
        if n >= most_chunks or held >= most_bytes:
            request, n, held = request + 1, 0, 0
        return (request, n + 1, held + bytes_), request

    return fold(rows, key, order, F.col(size), "int", (0, 0, 0), step, "request")


def newest(refs: DataFrame, key: str, order: str, most: int = MOST_SOURCES) -> DataFrame:
    """A key's latest references, at most `most`."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return refs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def choose(with_base: Column, n_missing: Column) -> Column:
    """A difference where there is a base, a batch of several without one, else a single read."""
    return F.when(n_missing == 0, "none").when(with_base, "diff").when(n_missing > 1, "batch").otherwise("single")


def plan(wanted: DataFrame, base: DataFrame, present: DataFrame, most_chunks: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """G12 with one base (extended_plan takes several and fills the base side): per pair the requests to send: aligned chunks (J10), less what is present (J13), packed (W07), each
    with the base chunks that stand beside its own and are present themselves, and how it is sent."""
    a = aligned(wanted, base)
    here = present.select(F.col("digest").alias("base_digest"), F.lit(True).alias("base_here")).distinct()
    need = a.join(present.select("digest").distinct(), "digest", "left_anti").dropDuplicates(["pair", "digest"])
    need = need.join(here, "base_digest", "left")
    ops = packed(need, "pair", "ordinal", "size", most_chunks, most_bytes)
    d = need.join(ops, ["pair", "ordinal"])
    out = d.groupBy("pair", "request").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.count("base_here").alias("base_chunks"), F.coalesce(F.sum(F.when(F.col("base_here"), F.col("base_size"))), F.lit(0)).alias("base_bytes"))
    return out.withColumn("how", choose(F.col("base_chunks") > 0, F.col("chunks")))


def extended(sources: list[tuple], target: object, most_chunks: int, most_bytes: int, most_sources: int, most_ops: int) -> list[tuple]:
    """G12 of one wanted chunk: (request, source, side, digest, size) in the order of picking. sources, newest first: (name,
    wanted, base), each side an image's chunks in order as (path, digest, size, present)."""
    out, using, left = [], set(), most_sources
    ops = [{"wanted": [0, 0], "base": [0, 0]}]  # chunks, bytes
    room = lambda side: ops[-1][side][0] < most_chunks and ops[-1][side][1] < most_bytes
    full = lambda side: len(ops) >= most_ops and not room(side)

    def add(side: str, source: object, digest: object, size: int) -> None:
        using.add(digest)
        ops[-1][side][0] += 1
        ops[-1][side][1] += size
        out.append((len(ops) - 1, source, side, digest, size))

    def extend(source: object, wanted: list[tuple], base: list[tuple]) -> bool:
        i = next((k for k, c in enumerate(wanted) if c[1] == target), None)
        if i is None:
            return False
        path, before = wanted[i][0], len(out)
        first = {side: next((k for k, c in enumerate(chunks) if c[0] == path), None) for side, chunks in (("wanted", wanted), ("base", base))}
        j = i if first["base"] is None else first["base"] + i - first["wanted"]
        while True:
            if i < len(wanted) and not full("wanted"):
                _, digest, size, present = wanted[i]
                if digest not in using and not present:
                    if not room("wanted"):
                        ops.append({"wanted": [0, 0], "base": [0, 0]})
                    add("wanted", source, digest, size)
            # the base only fills the current request
            if j < len(base) and room("base"):
                _, digest, size, present = base[j]
                if digest not in using and present:
                    add("base", source, digest, size)
            if (j >= len(base) or full("base")) and (i >= len(wanted) or full("wanted")):
                break
            i, j = i + 1, j + 1
            if i < len(wanted) and wanted[i][0] != path:
                path = wanted[i][0]
                if len(ops) > 1:  # more than one request is for a file that is read on
                    break
        return len(out) > before

    for source, wanted, base in sources:
        if base:
            left -= extend(source, wanted, base)
            if not left or full("base") and full("wanted"):
                break
    if not ops[-1]["wanted"][0] and sources:
        extend(sources[0][0], sources[0][1], [])
    return out


def extended_plan(chunks: DataFrame, targets: DataFrame, present: DataFrame, most_chunks: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES, most_sources: int = MOST_SOURCES, most_ops: int = 1) -> DataFrame:
    """G12 with several sources: key, request, source, side, digest, size of what is sent for the targets (key, digest), one a key.
    chunks: key, source (the greater the newer), side (wanted or base), ordinal, path, digest, size. Picks depend on one another, so a key's
    few images are gone through in one place; keys are independent. most_ops: as many as reads in succession ask for, up to MOST_OPS."""
    schema = chunks.schema
    kinds = {c: schema[c].dataType.simpleString() for c in ("key", "source", "digest")}
    most_ops = min(most_ops, MOST_OPS)

    def run(group: pa.Table) -> pa.Table:
        images: dict = defaultdict(lambda: {"wanted": [], "base": []})
        for r in group.sort_by("ordinal").to_pylist():
            images[r["source"]][r["side"]].append((r["path"], r["digest"], r["size"], r["here"]))
        sources = [(s, images[s]["wanted"], images[s]["base"]) for s in sorted(images, reverse=True)]
        key, target = group["key"][0].as_py(), group["target"][0].as_py()
        picked = extended(sources, target, most_chunks, most_bytes, most_sources, most_ops)
        columns = [[key] * len(picked), *([p[k] for p in picked] for k in range(5))]
        types = [group["key"].type, pa.int32(), group["source"].type, pa.string(), group["digest"].type, pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["key", "request", "source", "side", "digest", "size"])

    here = present.select("digest", F.lit(True).alias("here")).distinct()
    d = chunks.join(targets.select("key", F.col("digest").alias("target")), "key").join(here, "digest", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    d = d.select("key", "source", "side", "ordinal", "path", "digest", F.col("size").cast("long").alias("size"), "here", "target")
    return d.groupBy("key").applyInArrow(run, f"key {kinds['key']}, request int, source {kinds['source']}, side string, digest {kinds['digest']}, size long")


def prefetch(chunks: DataFrame, directory: Column, present: DataFrame, image: str = "package", order: str = "place", most_chunks: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Image, digest, order, request: what a subtree of each image still needs: the digests of the files under the
    directory, each once at its first place, less those present, in requests. chunks: image, path, order, digest, chunk_size."""
    from ..functions.text import under

    wanted = chunks.filter(under(F.col("path"), directory)).groupBy(image, "digest").agg(F.min(order).alias(order), F.max("chunk_size").alias("chunk_size"))
    wanted = wanted.join(present.select("digest").distinct(), "digest", "left_anti")
    return wanted.join(packed(wanted, image, order, "chunk_size", most_chunks, most_bytes), [image, order])


def recompressible(files: DataFrame, most_chunks: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Compressed files that are compared whole: both sides fit one request, and the base is all present.
    files: path, chunks, bytes, base_chunks, base_bytes, base_present."""
    fits = (F.greatest("chunks", "base_chunks") <= most_chunks) & (F.greatest("bytes", "base_bytes") <= most_bytes)
    return files.withColumn("codec", recompress_class(F.col("path"))).withColumn("whole", (F.col("codec") != "none") & fits & (F.col("base_present") == F.col("base_chunks")))


def fallback(outcomes: Column) -> Column:
    """The first attempt that worked, of those in the order diff, again after a new manifest, single."""
    return F.coalesce(outcomes["diff"], outcomes["again"], outcomes["single"])
