"""Diagnostics on a live log: loss runs and stall windows while lines come in, some of them late.

Lines are read as files of a folder appear. Their own time stamps are the event time; lines may be late by a stated delay,
after which the watermark passes them by. Loss runs keep, for each host, the samples that the watermark has not passed (at
most a delay's worth) and the run that is open; a run is told as soon as a sample that was not lost follows it for good, in
whichever batch that is. Stall windows are an interval join of two streams, markers and samples of the same host, whose
state is dropped by the same watermark. Both go on from their checkpoints after a loss of the driver or of executors;
state is kept by the RocksDB provider, so a host's waiting samples needn't fit in memory.

Odd lines. What is no sample or marker is passed over. Samples of one host and time count as the batch operator counts them
with the order (ts, lost). A host without a name is a host of its own. A run that no sample has ended yet is not told.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.diagnostics import STALL_SECONDS, micros, ping_lines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "host string, start timestamp, losses long"


def host_of_path() -> Column:
    """The target's name in ping-<target>-<day>-<time>.log."""
    return F.regexp_extract("_metadata.file_path", r"ping-([^/]+)-\d{8}-\d{6}\.log$", 1)


def live_samples(spark: SparkSession, folder: str, delay: str, host: Column | None = None, files_per_trigger: int = 100) -> DataFrame:
    """(ts, ms, lost, marker, note, host) of the lines of a folder's files, as they come; ts has a watermark."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(folder)
    return ping_lines(lines, host=F.coalesce(host if host is not None else host_of_path(), F.lit(""))).withWatermark("ts", delay)


class LossRuns(StatefulProcessor):
    """Runs of losses of one host, in the order of event time."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, lost boolean")  # not yet passed by the watermark; microseconds
        self.open = handle.getValueState("open", "start long, losses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["at", "lost"]] for r in rows])
        held = [(int(a), bool(x)) for a, x in self.waiting.get()] if self.waiting.exists() else []
        held += list(zip(new["at"].astype("int64").tolist(), new["lost"].tolist()))
        yield from self._passed(key, held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(int(a), bool(x)) for a, x in self.waiting.get()] if self.waiting.exists() else []
        yield from self._passed(key, held, timerValues)

    def _passed(self, key, held: list, timerValues) -> Iterator[pd.DataFrame]:
        """Take in what the watermark has passed, in order; keep the rest and come back when it has passed that."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        done, rest = sorted(x for x in held if x[0] < mark), [x for x in held if x[0] >= mark]
        start, losses = self.open.get() if self.open.exists() else (None, 0)
        told = []
        for at, lost in done:
            if lost:
                start, losses = (at if losses == 0 else start), losses + 1
            else:
                if losses >= self.least:
                    told.append((start, losses))
                losses = 0
        self.open.update((start, losses)) if losses else self.open.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(a for a, _ in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if told:
            yield pd.DataFrame({"host": key[0], "start": pd.to_datetime([s for s, _ in told], unit="us", utc=True), "losses": [n for _, n in told]})

    def close(self) -> None:
        pass


def loss_runs(samples: DataFrame, least: int = 2) -> DataFrame:
    """Columns of RUNS, appended as runs end. The session's state store provider must be RocksDB's."""
    own = samples.where("NOT marker").select("host", "ts", micros("ts").alias("at"), "lost")
    return own.groupBy("host").transformWithStateInPandas(LossRuns(least), RUNS, "Append", "EventTime", eventTimeColumnName="")


def stalls(markers: DataFrame, samples: DataFrame, seconds: int = STALL_SECONDS) -> DataFrame:
    """Pairs of a marker (host, marker_ts, note) and a sample of its host within some seconds, appended as they meet.

    Hosts are cut into stretches of time, so that the state of one is spread over tasks.
    """
    width = F.lit(seconds * 1_000_000)
    spread = markers.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(micros("marker_ts") / width) + k)))
    m, s = spread.alias("m"), samples.where("NOT marker").withColumn("bucket", F.floor(micros("ts") / width)).alias("s")
    apart = F.expr(f"INTERVAL {seconds} SECONDS")
    near = (F.col("m.host") == F.col("s.host")) & (F.col("m.bucket") == F.col("s.bucket")) & (F.col("s.ts") >= F.col("m.marker_ts") - apart) & (F.col("s.ts") <= F.col("m.marker_ts") + apart)
    return m.join(s, near).select("m.host", "m.marker_ts", "m.note", "s.ts", "s.ms", "s.lost")


def marker_stream(samples: DataFrame) -> DataFrame:
    return samples.where("marker").select("host", F.col("ts").alias("marker_ts"), "note")


def appended(stream: DataFrame, out: str, checkpoint: str):
    """Start writing a stream to a table, all that there is, and end."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_rocksdb(spark: SparkSession):
    """A session of the same application whose streams keep their state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own
