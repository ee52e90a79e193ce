"""A log of work to do that outlives a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class WorkLog:
    """Rows of intended work, written before it is done, and rows of its success, written after. Both are tables of
    the shared folder, a folder for each kind and run, to which rows are only added: a run that crashed and runs again under its number
    adds the same rows once more, which changes nothing. Runs are numbered upward. Work that a later run intends once more is to be done once more."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        """schema: of the columns that name a piece of work."""
        self.spark, self.folder, self.schema = spark, folder, schema
        self.keys = spark.createDataFrame([], schema).columns

    def _write(self, rows: DataFrame, kind: str, run: int) -> None:
        rows.select(*self.keys).distinct().write.mode("append").parquet(f"{self.folder}/kind={kind}/run={run}")

    def intend(self, rows: DataFrame, run: int) -> None:
        self._write(rows, "intent", run)

    def succeeded(self, rows: DataFrame, run: int) -> None:
        self._write(rows, "success", run)

    def pending(self) -> DataFrame:
        """What no success has followed, of this run and of all before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        log = self.spark.read.schema(f"{self.schema}, kind string, run long").parquet(self.folder)
        last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("run")))
        d = log.groupBy(*self.keys).agg(last("intent").alias("intent_"), last("success").alias("success_"))
        return d.filter("intent_ > coalesce(success_, intent_ - 1)").select(*self.keys)
