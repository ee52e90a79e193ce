"""Compression and patches (Arrow-batched Python: Spark has no built-in for these)."""

from __future__ import annotations

import gzip
import lzma
from collections.abc import Callable

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

COMPRESS: dict[str, Callable[[bytes], bytes]] = {
    "gz": lambda b: gzip.compress(b, 6, mtime=0),
    "xz": lambda b: lzma.compress(b, check=lzma.CHECK_CRC32),
    "zstd": lambda b: zstandard.ZstdCompressor(level=3).compress(b),
}
DECOMPRESS: dict[str, Callable[[bytes], bytes]] = {
    "gz": gzip.decompress,
    "xz": lzma.decompress,
    "zstd": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b),
}


def _each(table: dict[str, Callable[[bytes], bytes]], codec: str, data: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else table[codec](bytes(v)) for v in values], dtype=object)

    return F.pandas_udf(run, "binary")(data)


def compress(codec: str, data: Column) -> Column:
    return _each(COMPRESS, codec, data)


def decompress(codec: str, data: Column) -> Column:
    return _each(DECOMPRESS, codec, data)


def unpacked(codec: Column, data: Column) -> Column:
    """Data by a codec of its row; without one (null) as it is."""

    def run(codecs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else bytes(v) if c is None else DECOMPRESS[c](bytes(v)) for c, v in zip(codecs, values)], dtype=object)

    return F.pandas_udf(run, "binary")(codec, data)


def _dictionary(base: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(base) >= 8 else None


def diff(base: bytes, target: bytes, level: int = 3) -> bytes:
    """target compressed with base as its dictionary: what base already holds costs almost nothing."""
    log = max(10, min(27, (len(base) + len(target)).bit_length()))
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=log, enable_ldm=len(base) > 1 << 20)
    return zstandard.ZstdCompressor(dict_data=_dictionary(base), compression_params=params).compress(target)


def patched(base: bytes, patch: bytes) -> bytes:
    return zstandard.ZstdDecompressor(dict_data=_dictionary(base), max_window_size=1 << 27).decompress(patch)


def _pairs(f: Callable[[bytes, bytes], bytes], base: Column, other: Column) -> Column:
    def run(bases: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else f(bytes(b or b""), bytes(o)) for b, o in zip(bases, others)], dtype=object)

    return F.pandas_udf(run, "binary")(base, other)


def make_patch(base: Column, target: Column) -> Column:
    return _pairs(diff, base, target)


def apply_patch(base: Column, patch: Column) -> Column:
    return _pairs(patched, base, patch)
