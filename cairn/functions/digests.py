"""Digests, encodings and keys as Column expressions; binary packing is done on hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BASE32

DIGEST_HEX = 48


def digest(data: Column) -> Column:
    """First 24 bytes of SHA-256, as hex."""
    return F.substring(F.sha2(data, 256), 1, DIGEST_HEX)


def base64url(data: Column) -> Column:
    """base64 with - and _, without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def from_base64url(text: Column, n_bytes: int | None = None) -> Column:
    """Bytes; null if it isn't base64url or (if given) not n_bytes long."""
    pad = F.substring(F.lit("==="), F.lit(1), F.pmod(-F.length(text), F.lit(4)))
    fits = text.rlike("^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1)
    data = F.when(fits, F.try_to_binary(F.concat(F.translate(text, "-_", "+/"), pad), F.lit("base64")))
    return data if n_bytes is None else F.when(F.octet_length(data) == n_bytes, data)


def matches(data: Column, expected: Column) -> Column:
    return digest(data) == expected


def byte_at(hex_digits: Column, i: int) -> Column:
    return F.conv(F.substring(hex_digits, 2 * i + 1, 2), 16, 10).cast("int")


def base32(hex_digits: Column, n_bytes: int = 20) -> Column:
    """Store-hash letters of n_bytes: five bits a letter from the last bits to the first, bytes low to high."""
    letters = []
    for n in reversed(range((n_bytes * 8 + 4) // 5)):
        i, shift = divmod(n * 5, 8)
        low = F.shiftright(byte_at(hex_digits, i), shift)
        high = F.shiftleft(byte_at(hex_digits, i + 1), 8 - shift) if i + 1 < n_bytes and shift > 3 else F.lit(0)
        letters.append(F.substring(F.lit(BASE32), low.bitwiseOR(high).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def from_base32(text: Column, n_bytes: int = 20) -> Column:
    """Hex digits of store-hash letters; null if they aren't such."""
    size = (n_bytes * 8 + 4) // 5
    value = lambda n: F.instr(F.lit(BASE32), F.substring(text, size - n, 1)) - 1
    out = []
    for i in range(n_bytes):
        byte = F.lit(0)
        for n in range(size):
            at = n * 5 - 8 * i
            if -5 < at < 8:
                part = F.shiftleft(value(n), at) if at >= 0 else F.shiftright(value(n), -at)
                byte = byte.bitwiseOR(part.bitwiseAND(255))
        out.append(F.lpad(F.lower(F.hex(byte)), 2, "0"))
    return F.when(text.rlike(f"^[{BASE32}]{{{size}}}$"), F.concat(*out))


def flipped(hex_digits: Column) -> Column:
    """The hash of a package's own description: one bit of the first byte turned over. Its own inverse."""
    first = byte_at(hex_digits, 0).bitwiseXOR(F.lit(1))
    return F.concat(F.lpad(F.lower(F.hex(first)), 2, "0"), F.substring(hex_digits, F.lit(3), F.length(hex_digits)))


def folded(hex_digits: Column, n_from: int = 32, n_to: int = 20) -> Column:
    """n_from bytes folded by exclusive or to n_to."""
    out = []
    for i in range(n_to):
        byte = byte_at(hex_digits, i)
        for j in range(i + n_to, n_from, n_to):
            byte = byte.bitwiseXOR(byte_at(hex_digits, j))
        out.append(F.lpad(F.lower(F.hex(byte)), 2, "0"))
    return F.concat(*out)


def source_hash(content_sha256: Column, store_dir: str, name: Column) -> Column:
    """Store hash of a source archive by its content's hash and name."""
    text = F.concat(F.lit("source:sha256:"), content_sha256, F.lit(f":{store_dir}:"), name)
    return base32(folded(F.sha2(text.cast("binary"), 256)))


def cache_key(prefix: str, upstream: Column, store_hash: Column, etag: Column, algo: str = "sha256", bits: int = 192) -> Column:
    """Key of a request's stored answer: of a package by its hash, of an archive by its etag."""
    mode = F.when(store_hash.isNotNull(), F.concat(F.lit("h="), store_hash, F.lit("\n"))).otherwise(F.concat(F.lit("m=tarball\ne="), etag, F.lit("\n")))
    text = F.concat(F.lit(f"{prefix}\nu="), upstream, F.lit("\n"), mode, F.lit(f"p=16:{algo}:{bits}\n"))
    return F.concat(F.lit("v1-"), F.substring(base64url(F.unhex(F.sha2(text.cast("binary"), 256))), 1, 36))


def packed_location(slab: Column, addr: Column) -> Column:
    """Two bytes of slab and four of address, low bytes first, as hex."""
    little = lambda v, n: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(v.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)])
    return F.lower(F.concat(little(slab, 2), little(addr, 4)))


def unpacked_location(hex_digits: Column) -> Column:
    number = lambda a, n: sum((byte_at(hex_digits, a + i).cast("long") * 256**i for i in range(1, n)), byte_at(hex_digits, a).cast("long"))
    return F.struct(number(0, 2).alias("slab"), number(2, 4).alias("addr"))


def punch_key(slab: Column, addr: Column, end: Column) -> Column:
    """High bytes first, so that keys sort as numbers: a zero byte, slab, addr, end."""
    big = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    return F.lower(F.concat(F.lit("00"), big(slab, 2), big(addr, 4), big(end, 4)))


def split_digests(packed_hex: Column) -> Column:
    """Digests that stand one behind the other."""
    n = F.floor(F.length(packed_hex) / DIGEST_HEX).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(packed_hex, i * DIGEST_HEX + 1, F.lit(DIGEST_HEX))))


def split_by_lengths(data: Column, lengths: Column) -> Column:
    """A payload cut into pieces of the given lengths."""
    ends = F.transform(lengths, lambda x, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    return F.transform(F.arrays_zip(lengths.alias("n"), ends.alias("e")), lambda p: F.substring(data, (p["e"] - p["n"] + 1).cast("int"), p["n"].cast("int")))


def padded_stats(stats: Column, size: int = 256) -> Column:
    return F.rpad(F.to_json(stats), size, "\n")


MASK32 = 0xFFFFFFFF
# fixed values of the public 32-bit mix: two rotations, a factor, and the golden-ratio multiplier
WORD_TURNS, WORD_FACTOR, WORD_MULTIPLIER = (7, 20), 9, 0x61C88647


def word_hash(data: Column, salt: int = 0) -> Column:
    """A 32-bit mix over the bytes' little-endian words (zeros fill the last one), as a long."""
    digits = F.rpad(F.hex(data), (F.ceil(F.octet_length(data) / 4) * 8).cast("int"), F.lit("0"))

    def word(i: Column) -> Column:
        two = lambda k: F.substring(digits, i * 8 + k, F.lit(2))
        return F.conv(F.concat(two(7), two(5), two(3), two(1)), 16, 10).cast("long")

    def turned(v: Column, by: int) -> Column:
        return (F.shiftleft(v, by).bitwiseOR(F.shiftright(v, 32 - by))).bitwiseAND(F.lit(MASK32))

    def spread(v: Column) -> Column:
        return (v * WORD_MULTIPLIER).bitwiseAND(F.lit(MASK32))

    def mixed(acc: Column, i: Column) -> Column:
        x = acc["x"].bitwiseXOR(word(i))
        y = acc["y"].bitwiseXOR(x)
        return F.struct((turned(x, WORD_TURNS[0]) + y).bitwiseAND(F.lit(MASK32)).alias("x"), (turned(y, WORD_TURNS[1]) * WORD_FACTOR).bitwiseAND(F.lit(MASK32)).alias("y"))

    n = F.length(digits) / 8
    places = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(salt).cast("long").alias("y"))
    return F.aggregate(places, start, mixed, lambda acc: spread(acc["y"].bitwiseXOR(spread(acc["x"]))))
