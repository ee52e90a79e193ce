"""Archives as rows: reading (and, for tests and sinks, writing) archive bytes in Arrow batches.

A serialised archive is a tree of length-prefixed strings, each padded to eight bytes; numbers are 64 bits, low
byte first. A tar archive is read with the standard library; gzip and xz are recognised by their first bytes."""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_ROWS = "archive string, path string, type int, size long, executable boolean, data binary, error string"
MAGIC = "nix-archive-1"
REGULAR, DIRECTORY, SYMLINK = 1, 2, 3


def _string(b: bytes) -> bytes:
    return struct.pack("<Q", len(b)) + b + b"\0" * (-len(b) % 8)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def string(self) -> bytes:
        (n,) = struct.unpack_from("<Q", self.data, self.at)
        start = self.at + 8
        if start + n > len(self.data):
            raise ValueError("the archive ends inside a string")
        self.at = start + n + (-n % 8)
        return self.data[start : start + n]

    def expect(self, *words: str) -> None:
        for w in words:
            if (got := self.string()) != w.encode():
                raise ValueError(f"expected {w!r}, found {got[:20]!r}")


def read_tree(data: bytes) -> Iterator[tuple[str, int, int, bool, bytes]]:
    """(path, type, size, executable, data or link target), parents before children."""
    r = _Reader(data)
    r.expect(MAGIC)

    def node(path: str) -> Iterator[tuple[str, int, int, bool, bytes]]:
        r.expect("(", "type")
        kind = r.string()
        if kind == b"regular":
            word, executable, content = r.string(), False, b""
            if word == b"executable":
                r.expect("")
                word, executable = r.string(), True
            if word == b"contents":
                content, word = r.string(), r.string()
            if word != b")":
                raise ValueError("a file is not closed")
            yield path, REGULAR, len(content), executable, content
        elif kind == b"symlink":
            r.expect("target")
            target = r.string()
            r.expect(")")
            yield path, SYMLINK, len(target), False, target
        elif kind == b"directory":
            yield path, DIRECTORY, 0, False, b""
            while (word := r.string()) == b"entry":
                r.expect("(", "name")
                name = r.string().decode()
                r.expect("node")
                yield from node(f"{path.rstrip('/')}/{name}")
                r.expect(")")
            if word != b")":
                raise ValueError("a directory is not closed")
        else:
            raise ValueError(f"unknown type {kind!r}")

    yield from node("/")


def write_tree(entries: list[tuple[str, int, bool, bytes]]) -> bytes:
    """Archive bytes of (path, type, executable, data), / included; children in byte order of their names."""
    children: dict[str, list[tuple[str, int, bool, bytes]]] = {}
    by_path = {e[0]: e for e in entries}
    for e in entries:
        if e[0] != "/":
            children.setdefault(e[0].rpartition("/")[0] or "/", []).append(e)

    def node(e: tuple[str, int, bool, bytes]) -> bytes:
        path, kind, executable, data = e
        words = [b"(", b"type"]
        if kind == REGULAR:
            words += [b"regular", *([b"executable", b""] if executable else []), b"contents", data, b")"]
            return b"".join(map(_string, words))
        if kind == SYMLINK:
            return b"".join(map(_string, [*words, b"symlink", b"target", data, b")"]))
        out = b"".join(map(_string, [*words, b"directory"]))
        for c in sorted(children.get(path, []), key=lambda c: c[0].encode()):
            out += b"".join(map(_string, [b"entry", b"(", b"name", c[0].rpartition("/")[2].encode(), b"node"])) + node(c) + _string(b")")
        return out + _string(b")")

    return _string(MAGIC.encode()) + node(by_path["/"])


def read_tar(data: bytes) -> Iterator[tuple[str, int, int, bool, bytes]]:
    """As read_tree, of a tar archive: a root is put before it, global headers are passed over, hard links and
    devices are errors. A single top directory becomes the root."""
    rows: list[tuple[str, int, int, bool, bytes]] = []
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            path = "/" + "/".join(p for p in m.name.split("/") if p not in ("", "."))
            if m.isdir():
                if path != "/":
                    rows.append((path, DIRECTORY, 0, False, b""))
            elif m.issym():
                rows.append((path, SYMLINK, len(m.linkname.encode()), False, m.linkname.encode()))
            elif m.isreg():
                rows.append((path, REGULAR, m.size, bool(m.mode & 0o111), t.extractfile(m).read()))
            else:
                raise ValueError(f"{m.name}: entries of this type can't be taken in")
    rows.sort(key=lambda r: r[0].split("/"))
    if rows and rows[0][1] == DIRECTORY and all(r[0].startswith(rows[0][0] + "/") for r in rows[1:]):
        cut = len(rows[0][0])
        return iter([("/", DIRECTORY, 0, False, b""), *((r[0][cut:], *r[1:]) for r in rows[1:])])
    return iter([("/", DIRECTORY, 0, False, b""), *rows])


def plain(data: bytes) -> bytes:
    """Uncompressed bytes, by their first bytes."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def scan(archives: DataFrame, name: str = "name", content: str = "content", kind: str = "tree") -> DataFrame:
    """Entries of each archive. An archive that can't be read gives one row with an error."""
    read = {"tree": read_tree, "tar": read_tar}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["name"], batch["content"]):
                try:
                    rows = [(archive, *r, None) for r in read(plain(bytes(data)))]
                except (ValueError, tarfile.TarError, EOFError, OSError, struct.error, lzma.LZMAError, zlib.error, zstandard.ZstdError, RecursionError, MemoryError, OverflowError) as e:
                    rows = [(archive, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["archive", "path", "type", "size", "executable", "data", "error"]).astype({"type": "Int32", "size": "Int64", "executable": "boolean"})

    return archives.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(run, ENTRY_ROWS)


def pack(files: DataFrame, kind: str = "tree", codec: str = "none") -> DataFrame:
    """name, content: an archive per row of files(name, path, executable, data), with the path's directories
    and a link `latest` to the file."""

    def one(path: str, executable: bool, data: bytes) -> bytes:
        parts = path.strip("/").split("/")
        dirs = ["/", *("/" + "/".join(parts[:i]) for i in range(1, len(parts)))]
        entries = [*((d, DIRECTORY, False, b"") for d in dirs), (path, REGULAR, executable, data), ("/latest", SYMLINK, False, path.encode())]
        if kind == "tree":
            out = write_tree(entries)
        else:
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w", format=tarfile.PAX_FORMAT) as t:
                for p, k, x, d in entries:
                    info = tarfile.TarInfo("top" + ("" if p == "/" else p))
                    info.type, info.mode = {REGULAR: (tarfile.REGTYPE, 0o755 if x else 0o644), DIRECTORY: (tarfile.DIRTYPE, 0o755), SYMLINK: (tarfile.SYMTYPE, 0o777)}[k]
                    info.size, info.linkname = (len(d), "") if k == REGULAR else (0, d.decode() if k == SYMLINK else "")
                    t.addfile(info, io.BytesIO(d) if k == REGULAR else None)
            out = buffer.getvalue()
        return {"none": lambda b: b, "gz": lambda b: gzip.compress(b, mtime=0), "xz": lzma.compress, "zstd": lambda b: zstandard.ZstdCompressor(write_checksum=True).compress(b)}[codec](out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [one(p, bool(x), bytes(d)) for p, x, d in zip(batch["path"], batch["executable"], batch["data"])]})

    return files.select("name", "path", "executable", "data").mapInPandas(run, "name string, content binary")


def read_files(spark: SparkSession, folder: str, kind: str = "tree") -> DataFrame:
    """Archives under a folder, on any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return scan(files.select(F.col("path").alias("name"), "content"), kind=kind)
