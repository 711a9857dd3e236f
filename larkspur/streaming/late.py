"""Windows of events that come out of order: closed by event time, late rows counted apart, state that expires."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from larkspur.session import ensure_checkpoint_dir

#: What a window holds until it is closed.
_SUMS = StructType([StructField("n", LongType()), StructField("total", DoubleType()), StructField("least", DoubleType()), StructField("greatest", DoubleType())])
OUT = "key string, late boolean, window_start timestamp, n long, total double, least double, greatest double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Windows(StatefulProcessor):
    """Open windows of one key by their start in microseconds, and the latest event; a window closes when the key's own events, or the stream's watermark, are past it."""

    def __init__(self, size_us: int, delay_us: int) -> None:
        self.size, self.delay = size_us, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", StructType([StructField("us", LongType())]))
        self.open = handle.getMapState("open", StructType([StructField("start", LongType())]), _SUMS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.latest.get()[0] if self.latest.exists() else None
        top, found = before, []
        # What is closed was so before this batch, so rows of one batch may come in any order.
        closed = None if before is None else before - self.delay
        for frame in rows:
            us = frame["at"].astype("datetime64[us]").astype("int64")
            top = int(us.max()) if top is None else max(top, int(us.max()))
            starts = us - us % self.size
            late = pd.Series(False, us.index) if closed is None else starts + self.size <= closed
            sums = frame.assign(start=starts, late=late).groupby(["late", "start"])["value"].agg(["size", "sum", "min", "max"])
            for (is_late, start), (n, total, least, greatest) in zip(sums.index, sums.itertuples(index=False)):
                row = (int(n), float(total), float(least), float(greatest))
                if is_late:
                    found.append((True, start, *row))
                else:
                    self._add((int(start),), row)
        if top is not None:
            self.latest.update((top,))
            yield self._rows(key, found + self._close(top - self.delay))
        # A key without further events is closed by the stream's watermark, and forgotten.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if top is not None:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, (top - top % self.size + self.size) // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self._close(None)
        self.latest.clear()
        yield self._rows(key, out)

    def _add(self, start: tuple, row: tuple) -> None:
        if self.open.containsKey(start):
            n, total, least, greatest = self.open.getValue(start)
            row = (n + row[0], total + row[1], min(least, row[2]), max(greatest, row[3]))
        self.open.updateValue(start, row)

    def _close(self, until: int | None) -> list[tuple]:
        """Windows that end at `until` or before (None: all), taken out of the state."""
        done = [(k[0], v) for k, v in self.open.iterator() if until is None or k[0] + self.size <= until]
        for start, _ in done:
            self.open.removeKey((start,))
        return [(False, start, *v) for start, v in done]

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["late", "window_start", "n", "total", "least", "greatest"])
        out["window_start"] = pd.to_datetime(out["window_start"].astype("int64"), unit="us")
        out.insert(0, "key", str(key[0]))
        return out.astype({"late": bool, "n": "int64", "total": float, "least": float, "greatest": float})

    def close(self) -> None:
        pass


def closed_windows(samples: DataFrame, key: str, at: str, value: str, size_us: int, delay_us: int, idle: str) -> DataFrame:
    """A stream of key, late, window_start, n, total, least, greatest: sums of each closed window, once, and of each batch's late rows by window.

    A key's window closes once the key has had an event `delay_us` past its end. A row is late if its window was closed
    before the batch it comes in; rows of the same batch never make one another late. The watermark of the whole stream,
    `idle` behind its latest event, closes what is left of keys that have gone quiet and drops their state; rows that are
    behind even that are left out by Spark (numRowsDroppedByWatermark in the progress). A null key is a key; rows without
    time or value are left out. State: the open windows of the keys that are not quiet.
    """
    rows = samples.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).where("at IS NOT NULL AND value IS NOT NULL")
    return rows.withWatermark("at", idle).groupBy("key").transformWithStateInPandas(_Windows(size_us, delay_us), OUT, "Append", "EventTime")


def run_apart(stream: DataFrame, checkpoint: str | None = None, **trigger) -> tuple[DataFrame, DataFrame]:
    """(closed, late): runs a closed_windows() stream over what is there and returns both outputs. A batch that is run again after a failure replaces its own files."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = checkpoint or f"{spark.sparkContext.getCheckpointDir()}/late-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/out/batch={number}")

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    schema = "late boolean, batch long, " + OUT.replace("late boolean, ", "")
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    return out.where("NOT late").drop("late", "batch"), out.where("late").drop("late")
