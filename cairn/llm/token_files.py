"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds consecutive documents in ascending id order. Its frames (at least FRAME_IDS ids each but the last,
whole documents) are the ids as little-endian unsigned 32-bit integers, each frame compressed by itself.
Behind them stand two skippable frames, which any zstandard reader passes over: a directory (a zstandard-
compressed JSON list of doc_ids, frames, first places and counts), and a seek table in the layout of the public
"seekable format": per frame its compressed size, its size, and the low 32 bits of the xxHash64 of its content;
then the number of frames, a descriptor and a magic number. A reader finds the table from the file's end,
the documents in the directory, and decompresses only their frames, checking each.

Documents are dealt to files by ranges of doc_id and sorted inside; a file's name comes from its partition and its
place there, and it is moved to it when complete, so a task that runs again writes the same files again. `start` (ids before a document) is a file's
ids before it plus a prefix sum over files, one row per file.

Nulls: a null text counts as empty (just the end id); a null doc_id sorts first. Rows that repeat are
documents of their own. Empty table: no files, empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import fresh_path, give_back, slices, text_or_empty, tidied
from .units import MOST_UNITS, units

#: fixed values of the public formats: skippable frames' magic numbers and the seek table's own
DIRECTORY_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FRAME_IDS = 16_384
FILE_IDS = 8_000_000
END_ID = 2
FIRST, LINE, SIGNS = "\0", "\n", ".,!?;:#$%&*|"
BLANK, LINE_END = "\u0120", "\u010a"  # a blank and a line's end in the texts of byte-level vocabularies
_WHITE = r"[\s\v\x1c-\x1f\x85\p{Z}]"
#: texts that can't be cut at every blank: white space side by side or at an end, or the mark of first units
UNEVEN = rf"\x00|{_WHITE}{{2}}|^{_WHITE}|{_WHITE}$"
_encoders: dict = {}


class UnitEncoder:
    """A tokenizers file; texts are encoded unit by unit where that gives the same ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.bool_)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith((BLANK, LINE_END))]] = True
        self.clear()

    def clear(self) -> None:
        """names: the known units; of each, where its ids start, how many they are, and in how many slices it was used (two at most)."""
        self.names = pa.array([], pa.large_string())
        self.ids, self.starts, self.lengths, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)

    def keep_recurring(self) -> None:
        """Units of one slice only are forgotten; the others stay if they are used once more until the next time."""
        keep = np.flatnonzero(self.used > 1)
        names = self.names.take(pa.array(keep))
        lengths, ids = self._gather(keep)
        self.clear()
        self._add(names, lengths, ids)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, names: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the added units."""
        first = len(self.names)
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.ones(len(names), np.uint8)])
        return np.arange(first, len(self.names))

    def _known(self, names: pa.Array) -> np.ndarray:
        """Places of units; -1 for unknown ones."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int64)
        self.used[at[at >= 0]] = 2
        return at

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of known units, one behind the other."""
        n = self.lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, len(self.ids)) < 2**31 else np.int64
        where = np.repeat((self.starts[at] - ends + n).astype(small), n)
        where += np.arange(total, dtype=small)
        return n, self.ids[where]

    def _one_by_one(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of units."""
        got = self._plain([u[1:] if u[0] == FIRST else u if u[0] == LINE else " " + u for u in names.to_pylist()])
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return lengths, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))

    def _many_words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words: they are one text, and a word's ids start where an id's text starts with a blank or a line's end."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), names, pa.scalar(" ", pa.large_string()))
        led = pc.if_else(pc.starts_with(names, LINE), names, spaced)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(led)], pa.int32()), led), pa.scalar("", pa.large_string()))[0].as_py()
        ids = np.array(self._plain([text])[0], np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        return (np.diff(starts, append=len(ids)), ids) if len(starts) == len(names) else self._one_by_one(names)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Places of new units. A unit is known by its text, with the blank before it, if it doesn't begin with a line's end; a
        text's first unit with FIRST before it.
        Letters with signs behind them are two words to the vocabulary, so their ids are put together."""
        stems = pc.utf8_rtrim(new, characters=SIGNS)
        paired = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(new)), pc.utf8_is_alpha(pc.utf8_ltrim(stems, characters=LINE)))
        pairs, single, stems = new.filter(paired), new.filter(pc.invert(paired)), stems.filter(paired)
        tails = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), pc.replace_substring_regex(pairs, r"^\n?\p{L}+", ""), pa.scalar("", pa.large_string()))
        coded = pa.concat_arrays([single, stems, tails]).dictionary_encode()
        at = self._known(coded.dictionary)
        missing = np.flatnonzero(at < 0)
        plain = coded.dictionary.take(pa.array(missing))
        alpha = pc.utf8_is_alpha(pc.utf8_ltrim(plain, characters=LINE))
        words, rest = plain.filter(alpha), plain.filter(pc.invert(alpha))
        got = [self._many_words(words.slice(i, 4096)) for i in range(0, len(words), 4096)] + [self._one_by_one(rest)]
        alpha = alpha.to_numpy(zero_copy_only=False)
        at[np.concatenate([missing[alpha], missing[~alpha]])] = self._add(pa.concat_arrays([words, rest]), *map(np.concatenate, zip(*got)))
        at = at[coded.indices.to_numpy()]
        out, paired = np.empty(len(new), np.int64), paired.to_numpy(zero_copy_only=False)
        out[~paired] = at[: len(single)]
        n, ids = self._gather(at[len(single) :].reshape(2, -1).T.reshape(-1))
        out[paired] = self._add(pairs, n.reshape(-1, 2).sum(axis=1), ids)
        return out

    def _places(self, values: pa.Array) -> np.ndarray:
        """Where different units are known; all are in the end."""
        at = self._known(values)
        missing = at < 0
        if missing.any():
            if len(self.names) + int(missing.sum()) > MOST_UNITS:
                self.keep_recurring()
                at = self._known(values)
                missing = at < 0
            if len(self.names) + int(missing.sum()) > MOST_UNITS:
                self.clear()
                missing[:] = True
            at[missing] = self._learn(values.filter(pa.array(missing)))
        return at

    def _join(self, flat: pa.Array, n_units: np.ndarray) -> list[np.ndarray]:
        """Ids of texts given as their units, one behind the other (a unit at least for each)."""
        firsts = np.cumsum(n_units) - n_units
        first = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), flat.take(pa.array(firsts)), pa.scalar("", pa.large_string()))
        coded, first = flat.dictionary_encode(), first.dictionary_encode()
        # first units go in with the others (none is alike), so that a cleared memory learns all at once
        places = self._places(pa.concat_arrays([coded.dictionary, first.dictionary]))
        at = places[coded.indices.to_numpy()]
        at[firsts] = places[len(coded.dictionary) + first.indices.to_numpy()]
        n, ids = self._gather(at)
        ends = np.concatenate([[0], np.cumsum(n)])
        return np.split(ids, ends[np.cumsum(n_units)[:-1]])

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.by_unit:
            return [np.array(x, np.uint32) for x in self._plain(column.to_pylist())]
        whole = pc.or_(pc.equal(pc.binary_length(column), 0), pc.match_substring(column, FIRST))
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(column, a))
        uneven = pc.and_not(pc.match_substring_regex(column, UNEVEN), whole)
        out: list[np.ndarray] = [None] * len(column)
        even = np.flatnonzero(~pc.or_(whole, uneven).to_numpy(zero_copy_only=False))
        if len(even):
            # a line's end between two characters that are not white space is a token of its own
            parts = pc.split_pattern(pc.replace_substring(column.take(pa.array(even)), LINE, " " + LINE), " ")
            for i, ids in zip(even, self._join(parts.flatten(), pc.list_value_length(parts).to_numpy().astype(np.int64))):
                out[i] = ids
        odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        if len(odd):
            cut = [units(column[int(i)].as_py()) for i in odd]
            for i, ids in zip(odd, self._join(pa.array(chain.from_iterable(cut), pa.large_string()), np.array(list(map(len, cut))))):
                out[i] = ids
        rest = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, x in zip(rest, self._plain([column[int(i)].as_py() for i in rest])):
            out[i] = np.array(x, np.uint32)
        return out


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def forget() -> None:
    for e in _encoders.values():
        e.keep_recurring()


class FrameWriter:
    """Documents one after the other; blob() is the file."""

    def __init__(self, level: int = 1) -> None:
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int | None, int, int, int]] = []
        self.open: list[np.ndarray] = []
        self.open_ids = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.directory.append((doc_id, len(self.frames), self.open_ids, len(ids)))
        self.open.append(ids.astype("<u4", copy=False))
        self.open_ids += len(ids)
        self.n_ids += len(ids)
        if self.open_ids >= FRAME_IDS:
            self._close()

    def _close(self) -> None:
        if self.open:
            raw = np.concatenate(self.open).tobytes()
            self.frames.append(self.compress(raw))
            self.table.append((len(self.frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.open_ids = [], 0

    def blob(self) -> bytes:
        self._close()
        directory = self.compress(json.dumps([list(c) for c in zip(*self.directory)]).encode())
        entries = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", DIRECTORY_MAGIC, len(directory)), directory, struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)), entries, footer])


class FrameReader:
    """read(start, size) gives bytes of the file, of `size` bytes in all."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        n, descriptor, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        table = np.frombuffer(read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.read, self.table = read, table
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", read(at, 8))
        if magic != DIRECTORY_MAGIC:
            raise ValueError("no directory behind the frames")
        columns = json.loads(zstandard.ZstdDecompressor().decompress(read(at + 8, length)))
        self.directory = list(zip(*columns))
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def frame(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            size, full, check = (int(x) for x in self.table[k])
            raw = zstandard.ZstdDecompressor().decompress(self.read(int(self.offsets[k]), size), max_output_size=full)
            if len(raw) != full or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self._last = (k, np.frombuffer(raw, "<u4"))
        return self._last[1]

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the file's order; only the frames of wanted documents are decompressed."""
        keep = None if wanted is None else set(wanted)
        for doc_id, k, first, n in self.directory:
            if keep is None or doc_id in keep:
                yield doc_id, self.frame(k)[first : first + n]


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, n_files: int | None = None) -> DataFrame:
    """Writes docs' (doc_id, text) and returns one row per file: name, part, piece, n_docs, n_ids."""
    spark = docs.sparkSession
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, writer, rows = TaskContext.get().partitionId(), 0, FrameWriter(), []
        end, fs = np.array([end_id], np.uint32), pyarrow.fs.FileSystem.from_uri(folder)

        def close() -> None:
            nonlocal piece, writer
            if writer.directory:
                store, root = fs
                name = f"ids-{part:06d}-{piece:04d}.zst"
                store.create_dir(root, recursive=True)
                temporary = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(temporary, compression=None) as f:
                    f.write(writer.blob())
                store.move(temporary, f"{root}/{name}")
                rows.append((name, part, piece, len(writer.directory), writer.n_ids))
            piece, writer = piece + 1, FrameWriter()

        for batch in batches:
            for s in slices(batch, 1, 8192):
                for doc_id, ids in zip(s.column(0).to_pylist(), encoder(path).encode(s.column(1))):
                    writer.add(doc_id, np.concatenate([ids, end]))
                    if writer.n_ids >= FILE_IDS:
                        close()
                give_back()  # else what each slice took for a while adds up over a task
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["name", "part", "piece", "n_docs", "n_ids"])

    files = sorted_docs.mapInArrow(tidied(run, forget), "name string, part int, piece int, n_docs long, n_ids long")
    manifest = folder.rstrip("/") + "-manifest"
    files.write.parquet(manifest)
    return spark.read.parquet(manifest)


def _prefix_sums(rows: list) -> list[tuple[int, int]]:
    out, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in rows):
        out.append((part, total))
        total += n
    return out


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    # a partition's files are few; partitions before it are summed on their own
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids_"))
    sums = spark.createDataFrame(_prefix_sums(parts.collect()), "part int, before_ long")  # two numbers a partition
    inside = W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = manifest.join(F.broadcast(sums), "part").select("name", (F.col("before_") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    blobs = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/ids-*.zst")
    blobs = blobs.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(starts, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                blob = memoryview(content.as_buffer())
                rows, at = [], first
                for doc_id, ids in FrameReader(lambda s, n, b=blob: bytes(b[s : s + n]), len(blob)).documents():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blobs.select("first", "content").mapInArrow(tidied(run), schema)


def encode_and_read(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return read_files(docs.sparkSession, folder, write_files(docs, folder, path))
