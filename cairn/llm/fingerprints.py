"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Each paragraph hashes to a wide vector: EQUAL lanes of 64
bits drawn from the whole paragraph, and NEAR lanes of 32 bits, a signed sketch of its windows of GRAM bytes
(a shorter paragraph is one window; no text has so many windows that a lane of its own would wrap). A fingerprint is the sum of its
paragraphs' vectors, modulo 2**64 and 2**32: the order of paragraphs doesn't matter, a paragraph is inserted by adding its vector and deleted by
subtracting it, equal documents have equal fingerprints, and fingerprints of parts add up to that of the whole.
Equality is read off the first lanes. The likeness of two fingerprints is 2 a.b / (a.a + b.b) of the signed near
lanes, cut to 0..1 (1 if all lanes are equal): an estimate of the share of windows in common.

Neighbours by doc_id: documents are dealt to ranges of doc_id and sorted inside, and streamed, so that a
document meets the next one in its own range; the first document of each range is sent to the range before it
too. Nothing is gathered but one id per range. Texts are moved once.

Nulls: a null text counts as empty; a null doc_id sorts last. Rows that repeat a doc_id follow one another,
by text. One row alone is its own next. Empty table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, tidied

EQUAL, NEAR, GRAM = 4, 256, 16
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def vector(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the paragraphs' vectors: (EQUAL uint64 lanes, NEAR uint32 lanes)."""
    equal = np.zeros(EQUAL, np.uint64)
    near = np.zeros(NEAR, np.int64)
    if not paragraphs:
        return equal, near.astype(np.uint32)
    # A wide hash of each paragraph from two 64-bit ones; sums wrap by themselves.
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, paragraphs)), np.uint64).reshape(-1, 2)
    for k in range(EQUAL):
        x = (h[:, 0] ^ (h[:, 1] * (A + np.uint64(2 * k)))) * B
        equal[k] = ((x ^ (x >> np.uint64(31))) * C + h[:, k % 2]).sum(dtype=np.uint64)
    short = [p.ljust(GRAM, b"\0") for p in paragraphs if len(p) < GRAM]
    long = [p for p in paragraphs if len(p) >= GRAM] + short
    data = b"".join(long)
    lengths = np.fromiter(map(len, long), np.int64, len(long))
    ends = np.cumsum(lengths)
    # windows that lie in one paragraph: the last GRAM - 1 starts of each are left out
    ok = np.ones(len(data), np.bool_)
    for i in range(1, GRAM):
        ok[ends - i] = False
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    w = word[: len(data) - GRAM + 1] * A + (word[GRAM - 8 :] ^ B)
    w = (w ^ (w >> np.uint64(29))) * C
    w = (w >> np.uint64(64 - 9))[ok[: len(w)]].astype(np.int64)  # eight bits of lane and one of sign
    counts = np.bincount(w, minlength=2 * NEAR)
    near += counts[:NEAR] - counts[NEAR:]
    return equal, near.astype(np.uint32)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    return vector(_bytes(text).split(b"\n"))


def insert(mark: tuple[np.ndarray, np.ndarray], paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    e, n = vector(paragraphs)
    return mark[0] + e, mark[1] + n


def delete(mark: tuple[np.ndarray, np.ndarray], paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    e, n = vector(paragraphs)
    return mark[0] - e, mark[1] - n


def printed(mark: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(mark[0].tobytes() + mark[1].tobytes()).decode()


def parsed(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(text)
    return np.frombuffer(raw[: 8 * EQUAL], np.uint64), np.frombuffer(raw[8 * EQUAL :], np.uint32)


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    if (x[0] == y[0]).all() and (x[1] == y[1]).all():
        return 1.0
    a, b = x[1].astype(np.int32).astype(float), y[1].astype(np.int32).astype(float)
    norm = a @ a + b @ b
    return float(min(1.0, max(0.0, 2 * (a @ b) / norm))) if norm else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _over(cuts: list[int], value: Column) -> Column:
    """How many of the cuts (descending) are over the value, in about 2 * sqrt(len(cuts)) comparisons."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    parts = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    count = lambda xs: F.size(F.filter(xs, lambda c: c > value))
    part = count(F.array(*[F.lit(p[0]).cast("long") for p in parts]))
    inside = F.element_at(F.array(*[F.array(*[F.lit(c).cast("long") for c in p]) for p in parts]), F.greatest(part, F.lit(1)))
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * k + count(inside))


def with_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """docs' (doc_id, text) by ranges, in the order of descending doc_id, with the first row of the following
    range behind each (ahead = 1; behind the last range, the first row of all). Rows: range_, ahead, doc_id, text."""
    spark = docs.sparkSession
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cuts = d.agg(F.percentile_approx("doc_id", [i / n_ranges for i in range(1, n_ranges)] or [0.5], 20 * n_ranges)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)  # n_ranges - 1 ids at most
    d = d.withColumn("range_", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(_over(cuts, F.col("doc_id"))))
    heads = d.groupBy("range_").agg(F.max(F.coalesce("doc_id", F.lit(-(2**63)))).alias("head")).orderBy("range_").collect()  # a row per range
    if not heads:
        return d.select("range_", F.lit(0).alias("ahead"), "doc_id", "text")
    before = {h["range_"]: heads[i - 1]["range_"] for i, h in enumerate(heads)}
    known = F.create_map(*[F.lit(x) for h in heads for x in (h["range_"], h["head"])])
    previous = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    is_head = F.coalesce("doc_id", F.lit(-(2**63))) == known[F.col("range_")]
    places = F.when(is_head, F.array(F.struct(F.col("range_"), F.lit(0).alias("ahead")), F.struct(previous[F.col("range_")].alias("range_"), F.lit(1).alias("ahead")))).otherwise(F.array(F.struct(F.col("range_"), F.lit(0).alias("ahead"))))
    dealt = d.select(F.inline(places), "doc_id", "text")
    return dealt.repartitionByRange(n_ranges, "range_").sortWithinPartitions("range_", "ahead", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is yet to come
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for at, ahead, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    mark = fingerprint(text)
                    if held is not None and held[0] == at:
                        other = edited(held[2], text)
                        changed = fingerprint(other)
                        rows.append((held[1], len(held[2]), hashlib.sha256(_bytes(other)).hexdigest(), printed(held[3]), printed(changed), likeness(held[3], changed), likeness(held[3], mark)))
                    # of rows sent ahead only the first counts: it ends its range
                    held = None if ahead else (at, doc_id, text, mark)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, n_ranges).select("range_", "ahead", "doc_id", "text").mapInArrow(tidied(run), schema)
