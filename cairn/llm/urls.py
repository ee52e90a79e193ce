"""URL filters: a sort-merge range join of addresses with rules (DataFrame functions only).

A rule is (host, path, verdict); it fits its host and all subdomains where the url's path starts with
its path, and the longest rule (host and path together, in code points; then the longer host) wins.

Canonical key of a rule: its host's labels reversed, then its path. All keys that it fits start with it,
so it is an interval of the sorted keys, and rules of one host are nested or apart. A url has such a key
at each level of its host; only levels at which some rule's host stands are kept. Rules and url keys
of a host are sorted together and swept once: each rule carries the stack of rules that hold its own
start (itself and those around it), the sweep carries the latest stack on to the url keys behind it,
and a url pops the rules whose interval ended before it. The deepest left is the rule of this level; the
longest of all levels is the url's.

A host with many urls is swept in several groups, each with all the host's rules and an even share of
its urls, so no group is larger than max(group_rows, 4 * the host's rules). Each (host, path) pair is
judged once, then joined back.

Nulls: without a url or `://`, host and path are empty and no rule fits; rules with a null host or path are
left out; of rules that repeat (host, path), the one with the greatest verdict counts. Empty tables: all
urls get the default verdict, or there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import written

#: host, path, verdict
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict"))]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), ADDRESS, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """Per rule: level (reversed host), path, and stack: the rules around its start, outermost first."""
    r = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.select(reversed_host(F.col("host")).alias("level"), "host", "path", "verdict", F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"))
    starts = r.select("level", F.col("path").alias("start"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k")).withColumn("path", F.substring("start", F.lit(1), F.col("k")))
    held = starts.join(r, ["level", "path"]).groupBy("level", F.col("start").alias("path"))
    return held.agg(F.array_sort(F.collect_list(F.struct("n", "h", "path", F.concat("host", "path").alias("rule"), "verdict"))).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", group_rows: int = 1024) -> DataFrame:
    """urls with host, path, rule (null if none fits) and verdict added; columns of these names are replaced."""
    spark = urls.sparkSession
    stacks = written(_stacks(rules), "url-rules")
    levels = stacks.groupBy("level").agg(F.count("*").alias("n_rules"))
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    flat = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]  # so that no column of urls clashes with ours
    base = urls.select(*flat, host_of(url).alias("host"), path_of(url).alias("path"))
    pairs = base.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, -i, i)), "."))
    probes = written(pairs.select("host", "path", F.explode(ends).alias("level")).join(levels.select("level"), "level", "left_semi"), "url-probes")
    groups = probes.groupBy("level").agg(F.count("*").alias("n")).join(levels, "level")
    groups = written(groups.select("level", F.ceil(F.col("n") / F.greatest(F.lit(group_rows), 4 * F.col("n_rules"))).cast("int").alias("n_groups")), "url-groups")
    starts = stacks.join(groups, "level").select("level", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)).alias("group"), "path", F.lit(0).alias("is_url"), F.lit(None).cast("string").alias("host"), "stack")
    dealt = probes.join(groups, "level").select("level", F.pmod(F.xxhash64("host", "path"), F.col("n_groups")).cast("int").alias("group"), "path", F.lit(1).alias("is_url"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    sweep = W.partitionBy("level", "group").orderBy("path", "is_url").rowsBetween(W.unboundedPreceding, 0)
    swept = starts.unionByName(dealt).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter((F.col("is_url") == 1) & F.col("stack").isNotNull())
    live = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    found = swept.select("host", "path", F.try_element_at(live, F.lit(-1)).alias("best")).filter("best is not null")
    found = found.groupBy("host", "path").agg(F.max(F.struct("best.n", "best.h", "best.rule", "best.verdict")).alias("best"))
    found = found.select(F.col("host").alias("h_"), F.col("path").alias("p_"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = base.join(found, (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")), "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE = rf"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{ADDRESS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
d AS (SELECT host, path, max(struct_pack(n := length(rhost || rpath), h := length(rhost), rule := rhost || rpath, verdict := verdict)) AS best
      FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN d ON p.host = d.host AND p.path = d.path
"""
