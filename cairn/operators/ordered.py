"""Ordered operators that do not put all rows into one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def rank_bucket(df: DataFrame, column: str, n_buckets: int) -> Column:
    """Number of the range (by quantiles of a numeric column) that a value lies in; at most n_buckets ranges."""
    if n_buckets < 2:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(column, [i / n_buckets for i in range(1, n_buckets)], 20 * n_buckets)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    k, value = math.isqrt(len(cuts)) + 1, F.col(column)
    parts = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    count = lambda xs: F.size(F.filter(xs, lambda c: c <= value))
    part = count(F.array(*[F.lit(p[0]) for p in parts]))
    inside = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), F.greatest(part, F.lit(1)))
    return F.when(part == 0, 0).otherwise((part - 1) * k + count(inside))


def running_total(df: DataFrame, order: list[str], value: Column, name: str, n_buckets: int | None = None) -> DataFrame:
    """Adds the sum of value over all rows before, by a unique order whose first column is numeric: sums per
    range, a prefix sum over the ranges (one row each), and a window inside each range."""
    n = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("bucket_", rank_bucket(df, order[0], n)).withColumn("value_", value.cast("long"))
    sums = d.groupBy("bucket_").agg(F.sum("value_").alias("sum_"))
    before = W.orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("bucket_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("start_"))
    inside = W.partitionBy("bucket_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.join(F.broadcast(starts), "bucket_")  # n_buckets rows at most
    return d.withColumn(name, F.col("start_") + F.coalesce(F.sum("value_").over(inside), F.lit(0))).drop("bucket_", "value_", "sum_", "start_")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before it (columns named alike)."""
    marked = right.select(*keys, at, F.lit(0).alias("side_"), F.struct(*values, F.col(at).alias("at_")).alias("hit_"))
    own = [c for c in left.columns if c not in (*keys, at)]
    rows = left.select(*keys, at, F.lit(1).alias("side_"), F.lit(None).cast(marked.schema["hit_"].dataType).alias("hit_"), *own)
    both = marked.unionByName(rows, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(at, "side_").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("hit_", F.last("hit_", ignorenulls=True).over(order)).filter("side_ = 1")
    return found.select(*left.columns, *[F.col("hit_")[v].alias(v) for v in values], F.col("hit_")["at_"].alias(f"matched_{at}"))


def fold(df: DataFrame, key: str, order: str, value: Column, kind: str, start: tuple, step: Callable[[tuple, int], tuple[tuple, object]], name: str) -> DataFrame:
    """(key, order, name): a sequential rule along each key's rows, where every row's outcome depends on the ones
    before. Rows are sorted inside partitions and streamed; only the state of one key is held, so a key may be of any
    length (one task works on it, as the rule asks). step(state, value) gives (state, outcome); value is a long."""
    types = dict(df.dtypes)
    d = df.select(key, order, value.cast("long").alias("value_")).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: object = run
        state = start
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != held:
                    held, state = k, start
                state, outcome = step(state, v)
                out.append(outcome)
            kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kinds[kind])], [key, order, name])

    return d.mapInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, `{name}` {kind}")


def ranked(df: DataFrame, order: list[str], name: str, folder: str) -> DataFrame:
    """Adds each row's place (from 1) by a unique order of any types: rows are dealt to ranges, written to `folder`
    (so that ranges stay as they are), counted, and numbered inside their range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id())
    dealt.write.parquet(folder)
    d = df.sparkSession.read.parquet(folder)
    counts = d.groupBy("range_").agg(F.count("*").alias("n_"))
    starts = counts.select("range_", F.coalesce(F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    inside = F.row_number().over(W.partitionBy("range_").orderBy(*order))
    return d.join(F.broadcast(starts), "range_").withColumn(name, F.col("start_") + inside).drop("range_", "start_")  # a row per range
