"""Telemetry streams: counters to rates, time windows under a watermark, and pushed messages."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.session import ensure_checkpoint_dir

RATES = "key string, at timestamp, rate double"


#: Samples of one frame that _rates gives out.
_FRAME = 100_000


def _rates(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rates of one counter; the state is its last sample. Its samples of a batch come in any order and in several frames: they are held as two numbers each until all are there."""
    parts = [(frame["at"].to_numpy("datetime64[us]"), frame["total"].to_numpy(float)) for frame in frames]
    at, total = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((total, at))
    at, total = at[order], total[order]
    if state.exists:
        last_at, last = state.get
        before, old = np.concatenate(([np.datetime64(last_at, "us")], at[:-1])), np.concatenate(([last], total[:-1]))
    else:
        before, old = np.concatenate((at[:1], at[:-1])), np.concatenate((total[:1], total[:-1]))
    passed = (at - before).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.nan_to_num(np.where(passed > 0, (total - old) / passed * 1e6, 0.0), nan=0.0, posinf=np.inf, neginf=-np.inf)
    for k in range(0, len(at), _FRAME):
        yield pd.DataFrame({"key": key[0], "at": at[k : k + _FRAME], "rate": rate[k : k + _FRAME]})
    state.update((int(at[-1].astype(np.int64)), float(total[-1])))


def counter_rates(samples: DataFrame, key: str, at: str, total: str) -> DataFrame:
    """key, at, rate: growth of a counter a second since the sample before it; 0 for the first one and where no time passed.

    The only state of a counter is its last sample, so it doesn't grow with the stream. A sample that comes after a later one
    of its counter gets 0.
    """
    rows = samples.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(total).cast("double").alias("total"))
    return rows.groupBy("key").applyInPandasWithState(_rates, RATES, "at_us long, total double", "append", GroupStateTimeout.NoTimeout)


def windowed(samples: DataFrame, at: str, window: Column, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Keys, window_start, window_end, n, total, least and greatest of `value`. late: watermark delay (streams only)."""
    rows = samples.withWatermark(at, late) if late else samples
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total", "least", "greatest")


def tumbling(at: str, size: str) -> Column:
    return F.window(at, size)


def sliding(at: str, size: str, step: str) -> Column:
    return F.window(at, size, step)


def session(at: str, gap: str) -> Column:
    return F.session_window(at, gap)


def distinct_events(samples: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first of events with equal keys, remembered for as long as the watermark allows."""
    return samples.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def messages(samples: DataFrame, kind: str) -> DataFrame:
    """message: a JSON envelope {"type", "data"} of each row."""
    return samples.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct("*").alias("data"))).alias("message"))


def heartbeats(spark: SparkSession, service: str, seconds: int = 30) -> DataFrame:
    """A stream of status, timestamp and service, a row every `seconds`."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.where(F.col("value") % seconds == 0).select(F.lit("ok").alias("status"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(service).alias("service"))


def fan_out(*sinks: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands each batch, computed once, to every sink. A sink that fails is logged and left out from then on."""
    alive = list(sinks)

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in list(alive):
            try:
                sink(batch)
            except Exception:
                logging.getLogger(__name__).exception("sink left out after batch %d", number)
                alive.remove(sink)
        batch.unpersist()

    return deliver


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, under a checkpoint in the shared folder, and returns what it has put out.

    mode "complete": each batch replaces the result; "append": each adds to it.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/none")
    # A batch that is run again after a failure replaces its own files.
    part = lambda number: "whole" if mode == "complete" else f"{number:09d}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/{part(number)}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out/*")
