"""MinHash near-duplicates, whole: no link between different texts is lost to a bucket's size.

1. One pass makes, per document, its set of word shingles (hashed to 64 bits), a 128-bit digest of the set,
   the minima of 160 universal hashes, and 32 band keys of 5 minima each. At similarity 0.8 a pair shares no
   band with probability (1 - 0.8**5)**32 = 3e-6. Of each minimum one byte is kept for the verification.
2. Documents of equal sets are one class; only classes go on, so a group of copies costs one row a band.
3. Buckets are classes that share a band. In one of at most SMALL members all pairs' signatures are compared in a stream over
   sorted buckets, and only pairs that agree in `est_least` of their places (0.8 lies six deviations above) and
   whose sizes allow the similarity are written. A larger bucket makes no pairs: its members are tied to its least.
   The components of both kinds of ties are groups: a pair that shares a band and can be linked is in one group.
4. A group's whole sets are compared where they are together, in tasks of bounded size: a small group is one task; a
   large one is cut by size into classes of which only neighbours can reach the similarity, a class by hash into
   blocks of at most BLOCK_ROWS sets and BLOCK_ITEMS shingles, and each two blocks of equal or neighbouring classes are a task.
   A task compares signatures, counts the common shingles of the rest by matrix products, and writes links
   only from each of its own components' least member to the others: fewer than it has sets, never its pairs.
5. Components of the links come from alternating large-star and small-star.

Every pair that shares a band is compared, so tasks over a group grow with the square of its blocks; what is moved or
written of a pair does not. The set of a text is its distinct shingles of `width` words, A-Z lower-cased; with fewer words, the
whole sequence as one; without words (or null), empty: no links. Rows that repeat stay rows. A null id
never becomes a component's name unless all its ids are null. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, tidied

BANDS, ROWS = 32, 5
N_HASHES = BANDS * ROWS
SMALL = 33  # members of a bucket whose pairs are looked at one by one: 16 a member
BLOCK_ROWS, BLOCK_ITEMS = 512, 500_000
CHUNK = 4096  # shingles of one matrix product
_rng = np.random.default_rng(20240229)
MULTIPLIERS = (_rng.integers(0, 2**63, N_HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = h[:n].copy()
    for k in range(1, min(width, len(h))):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : k + n]
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """The signature: for each hash of the family (a x + b) >> 32 its least value on s."""
    best = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(best, (s[i : i + 512, None] * MULTIPLIERS + OFFSETS).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), sig (a byte of each minimum), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                n, nodes, sigs, bands = [], [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_py(), width)
                    n.append(len(s))
                    if not len(s):
                        nodes.append(None), sigs.append(None), bands.append([])
                        continue
                    m = minima(s)
                    nodes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(m.astype(np.uint8).tobytes())
                    bands.append([xxhash.xxh3_64_intdigest(m[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - 2**63 for k in range(BANDS)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_shingles long, node binary, sig binary, bands array<long>")


def _bytes(column: pa.Array) -> np.ndarray:
    """Rows of signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, N_HASHES)


def _sizes_fit(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, which stand together."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(key)
        if not batch.num_rows:
            continue
        codes = keys.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            k = keys[int(a)].as_py()
            if held and k != now:
                yield pa.Table.from_batches(held)
                held = []
            now = k
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _agreeing(members: DataFrame, percent: int, est_least: float) -> DataFrame:
    """Pairs (a, b) of each small bucket of members (band, node, n, sig) that can be linked by size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for bucket in _runs(batches, "band"):
            if len(bucket) < 2:
                continue
            nodes, n = bucket.column("node").to_pylist(), bucket.column("n").to_numpy()
            sigs = _bytes(bucket.column("sig"))
            i, j = np.triu_indices(len(nodes), 1)
            fit = _sizes_fit(n[i], n[j], percent)
            i, j = i[fit], j[fit]
            same = sigs[i] == sigs[j]
            keep = same.mean(axis=1) >= est_least
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                a, b = sorted((nodes[x], nodes[y]))
                left.append(a), right.append(b)
            if len(left) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    sorted_members = members.select("band", "node", "n", "sig").repartition("band").sortWithinPartitions("band")
    return sorted_members.mapInArrow(tidied(run), "a binary, b binary").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node has one parent (u -> v) or is one, but not both."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected edges (a, b): node, comp (the least node of its component), for
    every node with an edge. Large-star links a node's greater neighbours with its least neighbour,
    small-star its smaller ones; both keep components, and at their fixed point each node hangs on the least.
    Rounds go on until that is so (about the logarithm of the longest path); a round's tables go with it."""
    edges = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    while not _is_star_forest(edges):
        both = edges.union(edges.select("v", "u"))
        # a hub's rows meet their least neighbour in a join that can be split, not in one group
        least = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "cc-least")
        large = scratch.written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "cc-large")
        scratch.drop(edges, least)
        least = scratch.written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").filter("x <> m").union(least.select("u", "m"))
        edges = scratch.written(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        scratch.drop(large, least)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _tasks(grouped: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """grouped (node, n, comp, and others) with `tasks`: an array of (key, side) of the tasks that want the node's set."""
    # a class wider than the similarity by a hair, so that rounding parts no two that can be linked
    width = math.log(100 / percent) * (1 + 1e-9)
    grouped = grouped.withColumn("c_", F.floor(F.log("n") / width).cast("int"))
    sizes = grouped.groupBy("comp", "c_").agg(F.count("*").alias("rows_"), F.sum("n").alias("items_"))
    totals = sizes.groupBy("comp").agg(((F.sum("rows_") > BLOCK_ROWS) | (F.sum("items_") > BLOCK_ITEMS)).alias("big_"))
    k = F.greatest(F.ceil(F.col("rows_") / BLOCK_ROWS), F.ceil(F.col("items_") / BLOCK_ITEMS)).cast("int")
    blocks = scratch.written(sizes.join(totals, "comp").select("comp", "c_", "big_", F.when(F.col("big_"), k).otherwise(1).alias("k_")), "blocks")

    def beside(step: int, name: str) -> DataFrame:
        return blocks.filter("big_").select("comp", (F.col("c_") + step).alias("c_"), F.col("k_").alias(name))

    blocks = scratch.written(blocks.join(beside(-1, "above_"), ["comp", "c_"], "left").join(beside(1, "below_"), ["comp", "c_"], "left"), "beside")
    d = grouped.join(blocks, ["comp", "c_"]).withColumn("c_", F.when(F.col("big_"), F.col("c_")).otherwise(0)).withColumn("i_", F.pmod(F.xxhash64("node"), F.col("k_")).cast("int"))

    def with_blocks(count: str, key, side):
        n = F.coalesce(F.col(count), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: F.struct(key(j).alias("key"), side(j).cast("byte").alias("side")))).otherwise(F.array().cast("array<struct<key:string,side:tinyint>>"))

    def key(c, i, e, j):
        return F.concat_ws(":", F.hex("comp"), c, i, e, j)

    c, i = F.col("c_"), F.col("i_")
    same = with_blocks("k_", lambda j: key(c, F.least(i, j), c, F.greatest(i, j)), lambda j: F.when(j == i, 2).when(i < j, 0).otherwise(1))
    above = with_blocks("above_", lambda j: key(c, i, c + 1, j), lambda j: F.lit(0))
    below = with_blocks("below_", lambda j: key(c - 1, j, c, i), lambda j: F.lit(1))
    return d.withColumn("tasks", F.concat(same, above, below)).drop("c_", "k_", "i_", "big_", "above_", "below_")


def _with_sets(docs: DataFrame, tasks: DataFrame, width: int) -> DataFrame:
    """key, side, node, sig, items (the sorted hashes): the set of one document of each class, for each task that wants it. The
    digest is made anew, so another text under the same id does no harm; a repeated row counts once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                keep, items = [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(3)):
                    keep.append(node not in done and xxhash.xxh3_128_digest((s := shingle_set(text.as_py(), width)).tobytes()) == node)
                    if keep[-1]:
                        done.add(node)
                        items.append(s.tobytes())
                own = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(items, pa.large_binary()).cast(pa.binary())], ["node", "sig", "tasks", "items"])

    d = docs.select(F.col("doc_id").cast("long").alias("d_"), "text").join(tasks, F.col("d_").eqNullSafe(F.col("doc_id")))
    kind = "array<struct<key:string,side:tinyint>>"
    sets = d.select("node", "sig", F.col("tasks").cast(kind), "text").mapInArrow(tidied(run), f"node binary, sig binary, tasks {kind}, items binary")
    return sets.select("node", "sig", "items", F.explode("tasks").alias("t_")).select("t_.key", "t_.side", "node", "sig", "items")


def common_counts(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many items each set of x shares with each of y (None: of x itself)."""
    sets = x if y is None else x + y
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    _, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(counts), -1)
    place[shared] = np.arange(len(shared))
    column = place[where]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    m, total = len(x), np.zeros((len(x), len(sets) if y is None else len(y)), np.float32)
    for first in range(0, len(shared), CHUNK):
        a, b = np.searchsorted(column, [first, first + CHUNK])
        held = np.zeros((len(sets), min(CHUNK, len(shared) - first)), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        total += held[:m] @ (held if y is None else held[m:]).T
    return total.astype(np.int64)  # float32 counts exactly to 2**24, and linked() sends no larger sets here


def linked(x: list, y: list | None, percent: int, est_least: float) -> list[tuple[bytes, bytes]]:
    """Links of the task: (least, other) of each component of more than one node. x, y: (node, signature, items); y
    None: pairs inside x."""
    other = x if y is None else y
    if not x or not other:
        return []
    sx, sy = (np.stack([r[1] for r in z]) for z in (x, other))
    nx, ny = (np.array([len(r[2]) for r in z]) for z in (x, other))
    near = np.stack([(sy == s).mean(axis=1) >= est_least for s in sx]) & _sizes_fit(nx[:, None], ny, percent)
    if y is None:
        near &= np.arange(len(x))[:, None] < np.arange(len(x))
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    if len(rows) * len(columns) <= 4 or max(nx.max(), ny.max()) >= 1 << 24:
        found = [(i, j) for i, j in zip(*np.nonzero(near)) if 100 * (both := len(np.intersect1d(x[i][2], other[j][2], assume_unique=True))) >= percent * (nx[i] + ny[j] - both)]
    else:
        both = common_counts([x[i][2] for i in rows], [other[j][2] for j in columns])
        fits = near[np.ix_(rows, columns)] & (100 * both >= percent * (nx[rows][:, None] + ny[columns] - both))
        found = [(rows[i], columns[j]) for i, j in zip(*np.nonzero(fits))]
    up: dict[bytes, bytes] = {}

    def least(n: bytes) -> bytes:
        while (m := up.get(n, n)) != n:
            up[n] = up.get(m, m)
            n = m
        return n

    for i, j in found:
        a, b = sorted((least(x[i][0]), least(other[j][0])))
        if a != b:
            up[b] = a
    return [(least(n), n) for n in up if least(n) != n]


def _links(sets: DataFrame, percent: int, est_least: float) -> DataFrame:
    """Links (a, b) from all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _runs(batches, "key"):
            sides: dict[int, dict[bytes, tuple]] = {0: {}, 1: {}, 2: {}}
            for side, node, sig, items in zip(task.column("side").to_pylist(), task.column("node").to_pylist(), task.column("sig").to_pylist(), task.column("items")):
                sides[side][node] = (node, np.frombuffer(sig, np.uint8), np.frombuffer(items.as_buffer(), np.uint64))
            if sides[2]:
                links = linked(list(sides[2].values()), None, percent, est_least)
            else:
                links = linked(list(sides[0].values()), list(sides[1].values()), percent, est_least)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], ["a", "b"])

    return sets.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(run), "a binary, b binary")


def _linked(docs: DataFrame, classes: DataFrame, width: int, percent: int, est_least: float, scratch: Scratch) -> DataFrame | None:
    """node, comp of all nodes with a confirmed link (see the module's text); None if there is none."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    # written first: a join with it can then be split where a bucket is large
    counts = scratch.written(rows.groupBy("band").agg(F.count("*").alias("m"), F.min("node").alias("first")).filter("m > 1"), "bands")
    buckets = scratch.written(rows.join(counts, "band"), "buckets")
    scratch.drop(counts)
    crowded = buckets.filter(F.col("m") > SMALL).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    small = buckets.filter(F.col("m") <= SMALL).select("band", "node").join(classes.select("node", "n", "sig"), "node")
    ties = scratch.written(_agreeing(small, percent, est_least).union(crowded), "ties")
    scratch.drop(buckets)
    if ties.isEmpty():
        return None
    grouped = scratch.written(components(ties, scratch).join(classes.select("node", "n", "sig", "doc_id"), "node"), "grouped")
    scratch.drop(ties)
    links = scratch.written(_links(_with_sets(docs, _tasks(grouped, percent, scratch), width), percent, est_least), "links")
    scratch.drop(grouped)
    return None if links.isEmpty() else components(links, scratch)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, est_least: float = 0.6) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable), kept; one row per row of docs."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    sigs = scratch.written(signatures(docs, width), "minhash")
    with_set = sigs.filter("node is not null")
    # one row a class; equal sets have equal signatures, so any row's will do
    classes = with_set.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.written(classes, "classes")
    comp = _linked(docs, classes, width, percent, est_least, scratch)
    named = classes.select("node", F.col("least").alias("component_id"))
    if comp is not None:
        linked_ = scratch.written(comp.join(classes.select("node", "least"), "node"), "linked")
        least = scratch.written(linked_.groupBy("comp").agg(F.min("least").alias("least")), "least")
        names = linked_.drop("least").join(least, "comp").select("node", F.col("least").alias("name_"))
        named = named.join(names, "node", "left").select("node", F.coalesce("name_", "component_id").alias("component_id"))
    # written, so that the join with a class of very many copies can be split
    named = scratch.written(named, "names")
    out = sigs.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of other ids than the least of each group of near-duplicates; rows without an id stay."""
    gone = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("gone_")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    key = names[docs.columns.index("doc_id")]
    kept = flat.join(Scratch(docs.sparkSession).written(gone, "gone"), F.col(key) == F.col("gone_"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] WHEN len(ws) = 1 THEN ws ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, coalesce(len(sh), 0)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n_shingles + q.n_shingles - i)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT u.b, r.o FROM r JOIN u ON r.d = u.a WHERE r.o < u.b),
m AS (SELECT d, min(o) AS component_id FROM r GROUP BY d)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.d = n.doc_id
"""
