"""Stateful operators over event streams. Each takes a streaming or a batch frame.

Time is event time: what a long-running service would time by its own clock is timed by the events here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: the state that an event announces; `states` takes the last one as it is, `gated` only what MOVES allows
TRANSITIONS = {"signup": "Requested", "view": "Mounted", "error": "MountError", "click": "UnmountRequested", "purchase": "Unmounted"}
STATES = ("Unknown", "Requested", "Mounted", "MountError", "UnmountRequested", "Unmounted")
#: from which states a state may be entered
MOVES = {"Requested": ("Unknown", "MountError", "Unmounted"), "Mounted": ("Requested",), "MountError": ("Requested",), "UnmountRequested": ("Mounted",), "Unmounted": ("UnmountRequested",)}


def sessions(events: DataFrame, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Reads of a key in sessions that a pause of `gap` ends: start, end, reads."""
    d = events.withWatermark("ts", watermark) if watermark else events
    out = d.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("reads"), F.min("ts").alias("first_read"), F.max("ts").alias("last_read"))
    return out.select(key, "reads", "first_read", "last_read")


def first_within(events: DataFrame, key: str, ttl: str, watermark: str | None = None) -> DataFrame:
    """Of a key's events only those that come later than ttl after the last one that passed. Streaming:
    Spark's own deduplication within the watermark; batch: a rule along each key's events."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark or ttl).dropDuplicatesWithinWatermark([key])
    from ..operators.ordered import fold

    limit = int(pd.Timedelta(ttl).total_seconds() * 1_000_000)

    def step(state: tuple, at: int) -> tuple[tuple, bool]:
        passes = state[0] is None or at - state[0] > limit
        return ((at,) if passes else state), passes

    return fold(events, key, "ts", F.unix_micros("ts"), "boolean", (None,), step, "passes").filter("passes").drop("passes")


def coalesced(events: DataFrame, key: str, width: str) -> DataFrame:
    """Many reads of a place in one interval are one operation."""
    return events.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("reads")).select(key, F.col("w.start").alias("start"), "reads")


def states(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """T06 (batch): the state each key is in after its last event."""
    last = events.groupBy(key).agg(F.max_by("event_type", F.struct(*order)).alias("event_type"), F.count("*").alias("events"))
    state = F.lit("Unknown")
    for kind, name in TRANSITIONS.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    return last.select(key, state.alias("state"), "events")


class Lifecycle(StatefulProcessor):
    """T06 (streaming): keeps the last event of a key by (time, id), and how many there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long, id long, kind string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else (-(2**62), -1, "", 0)
        ts, ident, kind, n = held
        for d in rows:
            n += len(d)
            at = d.assign(t=d["ts"].astype("int64")).sort_values(["t", "event_id"]).iloc[-1]
            if (int(at["t"]), int(at["event_id"])) > (ts, ident):
                ts, ident, kind = int(at["t"]), int(at["event_id"]), at["event_type"]
        self.last.update((ts, ident, kind, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [TRANSITIONS.get(kind, "Unknown")], "events": [n]})

    def close(self) -> None:
        pass


def live_states(events: DataFrame) -> DataFrame:
    """T06 on a stream: update mode; the latest row of a key is its state."""
    return events.groupBy("user_id").transformWithStateInPandas(Lifecycle(), "user_id long, state string, events long", "Update", "None")


def prior_reads(events: DataFrame, key: str, idle_seconds: int) -> DataFrame:
    """W06's input: how many reads of a key came before in the same session."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > idle_seconds * 1_000_000
    d = events.withColumn("session_", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("reads", F.row_number().over(W.partitionBy(key, "session_").orderBy("ts", "event_id")) - 1).drop("session_")


def upsert(spark: SparkSession, path: str, keys: list[str], version: str):
    """A foreachBatch sink that keeps the latest row of each key. Each batch writes a new snapshot
    beside the old one, named by the batch, so a batch that runs again writes the same snapshot again."""
    from ..operators.chunking import latest

    def write(batch: DataFrame, number: int) -> None:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = f"{path}/v{number - 1}"
        rows = batch
        if number and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)):
            rows = batch.unionByName(spark.read.parquet(before))
        latest(rows, keys, version).write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot that an upsert sink wrote."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return spark.read.parquet(f"{path}/v{max(int(n[1:]) for n in names if n[1:].isdigit())}")


def gated(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, state, accepted): a key's record is read, moved on if MOVES allows the event's state from its own,
    and written back; else the event is refused and the record stays. Streamed along sorted keys."""
    from ..operators.ordered import fold

    wanted = F.lit(0)
    for kind, state in TRANSITIONS.items():
        wanted = F.when(F.col("event_type") == kind, STATES.index(state)).otherwise(wanted)
    allowed = {(STATES.index(a), STATES.index(b)) for b, froms in MOVES.items() for a in froms}

    def step(state: tuple, value: int) -> tuple[tuple, int]:
        moved = (state[0], value) in allowed
        return ((value,) if moved else state), (value if moved else state[0]) * 2 + moved

    out = fold(events, key, order, wanted, "int", (0,), step, "code")
    names = F.array(*map(F.lit, STATES))
    return out.select(key, order, F.get(names, F.floor(F.col("code") / 2).cast("int")).alias("state"), (F.col("code") % 2 == 1).alias("accepted"))
