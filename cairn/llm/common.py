"""What the corpus operators share: the shared folder, written tables, tables by name, white space."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of other characters than these six (Java, Python and RE2 read it alike).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a temporary one serves a session of one
    machine (tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one operator's intermediate results in the shared folder; drop() removes those no longer wanted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written once to the shared folder and read back: this cuts lineage, outlives a
        lost executor, and tells the planner the true size, so that only small tables are broadcast."""
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Nothing that is still to run may read them."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[1])
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same for a table that stays."""
    return Scratch(df.sparkSession).written(df, name)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Texts can be long: Python gets few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch: pa.RecordBatch, column: int, most_rows: int, most_bytes: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many rows and (but for a single row) so many bytes of a column's texts."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    first = 0
    while first < batch.num_rows:
        done = int(ends[first - 1]) if first else 0
        after = min(first + most_rows, max(first + 1, int(ends.searchsorted(done + most_bytes, "right"))))
        yield batch.slice(first, after - first)
        first = after


def give_back() -> None:
    """Memory that a worker's allocators keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker empties its module's caches (by functions of that module, which are sent by name) and gives
    back memory: workers live on and serve other stages."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            gc.collect()
            give_back()

    return whole


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
