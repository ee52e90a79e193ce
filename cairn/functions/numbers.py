"""Sizes, shifts, blocks, times and defaults as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_SHIFT, BLOCK = 12, 4096
INLINE_FILE, INLINE_MANIFEST = 224, 32 * 1024
SHARD_BYTES, MOST_SHARDS = 20 << 20, 40


def chunk_shift(size: Column) -> Column:
    """64 KiB chunks up to 16 MiB, 256 KiB up to 64 MiB, else 1 MiB."""
    return F.when(size <= 16 << 20, 16).when(size <= 64 << 20, 18).otherwise(20)


def is_inline(size: Column, cutoff: int = INLINE_FILE) -> Column:
    return size <= cutoff


def round_up(value: Column, shift: int) -> Column:
    mask = (1 << shift) - 1
    return (value + F.lit(mask)).bitwiseAND(F.lit(~mask))


def left_over(value: Column, shift: int) -> Column:
    return value.bitwiseAND(F.lit((1 << shift) - 1))


def n_pieces(size: Column, piece: int) -> Column:
    return F.floor((size + F.lit(piece - 1)) / F.lit(piece)).cast("long")


def piece_size(size: Column, index: Column, piece: int) -> Column:
    """Of piece `index` (from 0) of a file: the last has the rest, a whole piece where the size is a multiple."""
    return F.least(F.lit(piece).cast("long"), size - index * piece)


def block_list(size: Column, piece: int, block: int = BLOCK) -> Column:
    """Blocks of each piece of a file."""
    n = n_pieces(size, piece)
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: F.ceil(piece_size(size, i, piece) / block)))


def n_shards(size: Column, shard_bytes: int = SHARD_BYTES) -> Column:
    return F.least(F.greatest(n_pieces(size, shard_bytes), F.lit(1)), F.lit(MOST_SHARDS))


def narrowed(value: Column, kind: str = "smallint") -> Column:
    """Checked: null where the value doesn't fit (a plain cast raises instead in ANSI mode)."""
    return F.expr("1") * value.try_cast(kind)


def buffer_class(size: Column, most: int | None = None) -> Column:
    """Least power of two of at least 64 KiB that holds it, up to 2**62. With `most`, that is the class of all larger sizes and of unknown ones."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(size, F.lit(1 << 16)) - 1)))
    return F.when(size <= (most or 1 << 62), power).otherwise(F.lit(most)).cast("long")


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def or_default(value: Column, default: Column) -> Column:
    """Zero stands for the default."""
    return F.coalesce(F.nullif(value, F.lit(0)), default)


def file_mode(executable: Column) -> Column:
    return F.when(executable, 0o755).otherwise(0o644)


def read_ahead(image_reads: Column, file_reads: Column, first: int = 8, most: int = 128, most_ops: int = 8) -> tuple[Column, Column]:
    """(chunks per request, requests) after so many reads: chunks double up to the most, then requests do."""
    n = F.greatest(image_reads - 2, file_reads, F.lit(0))
    doublings = (most // first).bit_length() - 1
    size = F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), F.least(n, F.lit(doublings)))).cast("int")
    ops = F.least(F.lit(most_ops), F.pow(F.lit(2), F.least(F.greatest(n - doublings, F.lit(0)), F.lit(most_ops)))).cast("int")
    return size, ops


def retryable(code: Column) -> Column:
    """Asked again: no answer at all (null), or a server that is away for now."""
    return code.isNull() | code.isin(502, 503, 504)
