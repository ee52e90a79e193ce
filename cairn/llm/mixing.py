"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source s gets a target of t_s words. A document is expected in the mix lambda = t_s / size_s
times (times its propensity over the source's mean, if one is given; cap at most): floor(lambda) whole copies are certain, and the rest,
pi = lambda - floor(lambda), is its inclusion probability for one more. With u uniform from a hash of
the id, documents rank by (u / (1 - u)) / (pi / (1 - pi)), random odds over inclusion odds, and the
first of each source are taken until its target is met: a sample of fixed size in words. A document is
in if its middle word, counted along the ranking, is within the target, so a source misses its target
by half of one document at most.

No source is ranked in one task. Ranks are cut by histograms: each of three passes sums sizes by
source and 256 slices of the rank coordinate, finds the slice in which the target falls, and goes on in
that slice alone; about one row in 2**24 is left for an exact window. The result is a cut-off for each
source, a small table that documents are joined with, so texts are never shuffled for it.

Nulls: a null text has size 0, a null source is a source of its own (ranked last), a null id hashes as
the empty text. Rows of one source that repeat an id are taken or left together. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, written

SLICES, LEVELS = 256, 3
FULL = SLICES**LEVELS


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, column: str = "doc_id") -> Column:
    """In (0, 1), from 52 bits of md5(seed:id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources(source, source_size): adds target. Sources by code point, null last, weigh weights in
    turn and share `share` of all sizes; no target is over cap times its source's size, what is over
    goes to the others by weight. Sorted by cap over weight, the capped ones are a prefix, so prefix
    sums give the level in closed form. One row per source here, never one per document."""
    by_name, all_rows = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    d = (
        sources.withColumn("n", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("fill", F.col("most") / F.col("weight"))
    )
    by_fill = W.orderBy("fill", "n")
    d = (
        d.withColumn("capped", F.coalesce(F.sum("most").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("lighter", F.coalesce(F.sum("weight").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("heavier", F.sum("weight").over(all_rows) - F.col("lighter"))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("heavier"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("fill", "n", "level"))).over(all_rows)["level"])
    )
    return d.select("source", "source_size", F.coalesce(F.least("most", F.col("weight") * F.col("level")), F.col("most")).alias("target"))


def _ranked(sized: DataFrame, per_source: DataFrame, cap: float) -> DataFrame:
    """Adds whole (certain copies), key (Pareto rank) and x (slice of the rank, of FULL) to sized rows."""
    d = sized.join(per_source.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(0.0)
    lam = F.least(F.lit(float(cap)), mean * F.col("propensity") / F.col("mean_propensity")) if "propensity" in sized.columns else mean
    d = d.withColumn("mean_", mean - F.floor(mean)).withColumn("lam_", lam).withColumn("whole", F.floor("lam_")).withColumn("pi_", F.col("lam_") - F.col("whole"))
    odds, none = F.col("u") / (F.lit(1.0) - F.col("u")), F.lit(1e300)
    d = d.withColumn("key", F.when(F.col("pi_") > 0, odds / (F.col("pi_") / (F.lit(1.0) - F.col("pi_")))).otherwise(none))
    scaled = F.col("key") * F.when((F.col("mean_") > 0), F.col("mean_") / (F.lit(1.0) - F.col("mean_"))).otherwise(1.0)
    x = F.least(F.floor(scaled / (F.lit(1.0) + scaled) * FULL), F.lit(FULL - 1)).cast("long")
    return d.withColumn("x", F.when(F.col("key") < none, x).otherwise(F.lit(FULL).cast("long"))).drop("mean_", "lam_", "pi_")


def cut_offs(sized: DataFrame, per_source: DataFrame, cap: float = 2.0) -> DataFrame:
    """Per source: source_size, target, mean_propensity and the cut: x below x_cut is in; at x_cut,
    (key, doc_id) up to `last` is in."""
    ranked = _ranked(sized, per_source, cap).select("source", "doc_id", "size", "whole", "key", "x", "target")
    certain = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
    cuts = certain.withColumn("x_cut", F.lit(0).cast("long"))
    ranked = ranked.filter(F.col("x") < FULL)
    for level in range(LEVELS):
        step = SLICES ** (LEVELS - 1 - level)
        cuts = written(cuts, "mix-cuts")
        inside = ranked.join(cuts.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).filter((F.col("x_cut") >= 0) & (F.floor(F.col("x") / (step * SLICES)) * (step * SLICES) == F.col("x_cut")))
        sums = inside.groupBy("source", (F.floor(F.col("x") / step) * step).alias("at")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        upto = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("end", F.sum("size").over(upto)).withColumn("start", F.col("end") - F.col("size"))
        hit = sums.filter((F.col("start") <= F.col("left")) & (F.col("left") < F.col("end"))).select(F.col("source").alias("h_"), "at", (F.col("left") - F.col("start")).alias("rest"))
        # no slice is hit: all of them fit (x_cut -1 stands for "all in")
        cuts = cuts.join(hit, F.col("source").eqNullSafe(F.col("h_")), "left").select("source", F.coalesce("rest", "left").alias("left"), F.when(F.col("x_cut") < 0, -1).otherwise(F.coalesce("at", F.lit(-1))).cast("long").alias("x_cut"))
    cuts = written(cuts, "mix-cuts")
    last = ranked.join(cuts.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")) & (F.col("x") == F.col("x_cut")))
    last = last.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("mid", before + F.col("size") / 2).filter(F.col("mid") <= F.col("left"))
    last = last.groupBy(F.col("source").alias("l_")).agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))).alias("last"))
    out = per_source.join(cuts.select(F.col("source").alias("c_"), "x_cut"), F.col("source").eqNullSafe(F.col("c_")), "left").join(last, F.col("source").eqNullSafe(F.col("l_")), "left")
    return out.drop("c_", "l_").withColumn("x_cut", F.coalesce("x_cut", F.lit(0).cast("long")))


def copies(rows: DataFrame, cuts: DataFrame, cap: float = 2.0) -> DataFrame:
    """rows (source, doc_id, u, maybe propensity, any others): adds source_size, target and n_copies."""
    d = _ranked(rows, cuts, cap)
    at = F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))
    more = (F.col("x") < FULL) & ((F.col("x_cut") < 0) | (F.col("x") < F.col("x_cut")) | ((F.col("x") == F.col("x_cut")) & F.coalesce(at <= F.col("last"), F.lit(False))))
    return d.withColumn("n_copies", F.col("whole") + F.when(more, 1).otherwise(0)).drop("whole", "key", "x", "x_cut", "last", "mean_propensity")


def plan(docs: DataFrame, seed: str = "mix", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, propensity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, source, size, u; cut-offs per source). Both are written tables."""
    own = [F.col(propensity).cast("double").alias("propensity")] if propensity else []
    sized = written(docs.select("doc_id", "source", n_words().alias("size"), uniform(seed).alias("u"), *own), "mix-sized")
    mean = F.sum(F.col("propensity") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0)) if propensity else F.lit(1.0)
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), mean.alias("mean_propensity")), "mix-sources")
    goal = targets(sums.select("source", "source_size"), weights, share, cap)
    per_source = sums.select(F.col("source").alias("p_"), "mean_propensity").join(goal, F.col("p_").eqNullSafe(F.col("source"))).drop("p_")
    per_source = written(per_source.select("source", "source_size", "target", "mean_propensity"), "mix-targets")
    return sized, written(cut_offs(sized, per_source, cap), "mix-cut-offs")


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: docs' own columns, a document as many times as the mix takes it."""
    _, cuts = plan(docs, seed, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with ours
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    of = dict(zip(docs.columns, names))
    more = {"propensity": F.col(of[options["propensity"]]).cast("double")} if options.get("propensity") else {}
    flat = flat.withColumns({"doc_id": F.col(of["doc_id"]), "source": F.col(of["source"]), "u": uniform(seed, of["doc_id"])} | more)
    taken = copies(flat, cuts, options.get("cap", 2.0)).filter(F.col("n_copies") > 0)
    return taken.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy_")).select(*[F.col(n).alias(c) for c, n in of.items()])


def decisions(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted), source, n_copies."""
    sized, cuts = plan(docs, seed, **options)
    d = copies(sized, cuts, options.get("cap", 2.0))
    return d.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).cast("long").alias("taken"), "source", F.col("n_copies").cast("long").alias("n_copies"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, [5, 2, 1][n % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM r),
f AS (SELECT *, most / weight AS fill, coalesce(sum(most) OVER b, 0)::DOUBLE AS capped,
             (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS heavier
      FROM w WINDOW b AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - capped) / heavier AS level FROM f),
m AS (SELECT level FROM l WHERE level * weight <= most ORDER BY fill, n LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(most, weight * (SELECT level FROM m)), most)::DOUBLE AS target FROM l),
d AS (SELECT doc_id, sized.source, size, u, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS lam
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(lam) AS whole, CASE WHEN lam - floor(lam) > 0 THEN (u / (1 - u)) / ((lam - floor(lam)) / (1 - (lam - floor(lam)))) END AS key FROM d),
c AS (SELECT *, target - source_size * whole AS left_over,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS mid FROM k)
SELECT doc_id, size, source_size, target, source,
       (whole + CASE WHEN key IS NOT NULL AND mid <= left_over THEN 1 ELSE 0 END)::BIGINT AS n_copies,
       (size * (whole + CASE WHEN key IS NOT NULL AND mid <= left_over THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
