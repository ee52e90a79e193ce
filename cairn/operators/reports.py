"""Comparison and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import package_version

COUNTERS = ("manifest_cache_reqs", "manifest_cache_hits", "manifest_reqs", "manifest_errs", "slab_reads", "slab_read_errs", "single_reqs", "single_bytes", "single_errs", "batch_reqs", "batch_bytes", "batch_errs", "diff_reqs", "diff_bytes", "diff_errs", "recompress_reqs", "extra_reqs")


def versions(names: DataFrame, order: str) -> DataFrame:
    """Package and version of each name, the last by order where a package repeats; others drop out."""
    package, version = package_version(F.col("name"))
    d = names.select(package.alias("package"), version.alias("version"), order).filter("package <> ''")
    return d.groupBy("package").agg(F.max_by("version", order).alias("version"))


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Packages whose version changed, came or went."""
    d = before.select("package", F.col("version").alias("old")).join(after.select("package", F.col("version").alias("new")), "package", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return d.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", kind)


def report_line(diff: DataFrame) -> DataFrame:
    """A line per change."""
    return diff.select("package", F.format_string("%s: %s -> %s", "package", F.coalesce("old", F.lit("none")), F.coalesce("new", F.lit("none"))).alias("line"))


def reconcile(recorded: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """What is recorded but not there is unmarked, what is there but not recorded is marked."""
    d = recorded.select(key, F.lit(True).alias("r_")).join(found.select(key, F.lit(True).alias("f_")), key, "full")
    return d.withColumn("action", F.when(F.col("f_").isNull(), "unmark").when(F.col("r_").isNull(), "mark")).filter("action is not null").select(key, "action")


def counter_delta(before: DataFrame, after: DataFrame, names=COUNTERS) -> DataFrame:
    """A10: the difference of two snapshots (one row each) and all requests of it."""
    signed = after.select(*names).unionByName(before.select(*[(-F.col(n)).alias(n) for n in names]))
    out = signed.agg(*[F.sum(n).alias(n) for n in names])
    return out.withColumn("total_reqs", F.col("single_reqs") + F.col("batch_reqs") + F.col("diff_reqs"))


def rerequest(found: Column, if_found: Column, if_not: Column) -> Column:
    """whether to ask again, by whether the answer was there."""
    return F.when(found, if_found).otherwise(if_not)


def is_not_found(code: Column) -> Column:
    """F19."""
    return code.isin(403, 404)


def narinfo(row: dict[str, Column]) -> Column:
    """A text of `Key: value` lines."""
    return F.concat(*[F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\n")) for k, v in row.items()])
