"""Queries that run as streams over the events table, and calendar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import timeops
from larkspur.plans.documents import _SUMS
from larkspur.plans.registry import query
from larkspur.session import ensure_checkpoint_dir, table
from larkspur.streaming import late, telemetry


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, ts as a timestamp."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _windows(stream: DataFrame, window, key: str) -> DataFrame:
    out = telemetry.collected(telemetry.windowed(stream, "ts", window, [key], "value", late="1 hour"), "complete")
    return out.select(key, F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", F.round("total", 4).alias("total"), "least", "greatest")


@query(f"SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, {_SUMS} FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(event_stream(spark, sf_dir), telemetry.tumbling("ts", "1 day"), "event_type")


@query(f"WITH w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS a FROM events, range(2) t(i)) SELECT event_type, a AS window_start, a + INTERVAL 12 HOUR AS window_end, {_SUMS} FROM w GROUP BY 1, 2, 3")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(event_stream(spark, sf_dir), telemetry.sliding("ts", "12 hours", "6 hours"), "event_type")


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, {_SUMS} FROM s GROUP BY user_id, k"""
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(event_stream(spark, sf_dir), telemetry.session("ts", "2 hours"), "user_id")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive up to three times are passed on once."""
    often = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)))
    return telemetry.collected(telemetry.distinct_events(often, ["event_id"], "ts", "1 day").select("event_id", "user_id", "event_type"))


@query(
    """WITH p AS (SELECT user_id, ts, value, lag(ts) OVER w AS t0, lag(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
SELECT CAST(user_id AS VARCHAR) AS key, ts AS at, CASE WHEN t0 IS NULL OR ts <= t0 THEN 0.0 ELSE round((value - v0) / (epoch_us(ts) - epoch_us(t0)) * 1000000, 6) END AS rate FROM p"""
)
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.collected(telemetry.counter_rates(event_stream(spark, sf_dir), "user_id", "ts", "value"))
    return out.select("key", F.col("at").cast("timestamp_ntz").alias("at"), F.round("rate", 6).alias("rate"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, date_trunc('millisecond', ts) AS parsed, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS nearest, ts + INTERVAL 1 MONTH AS later,
CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS day_end, date_diff('day', TIMESTAMP '2024-01-01', ts) AS days FROM events""")
def time_iso_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, ntz = F.col("ts"), lambda c: c.cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    days = timeops.borders(F.lit("2024-01-01").cast("timestamp"), ts, "day")
    return e.select(
        "event_id", timeops.iso_format(ts).alias("iso"), ntz(timeops.iso_parse(timeops.iso_format(ts))).alias("parsed"), ntz(timeops.nearest(ts, "hour")).alias("nearest"),
        ntz(timeops.offset(ts, "month", 1)).alias("later"), ntz(timeops.ceiling(ts, "day")).alias("day_end"), days.alias("days"),
    )


@query("SELECT o_orderkey, date_trunc('second', o_orderdate) AS parsed FROM orders")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "on %d %B %Y at %H:%M:%S"
    text = timeops.strftime(F.col("o_orderdate"), pattern)
    return table(spark, sf_dir, "orders").select("o_orderkey", timeops.strptime(text, pattern).cast("timestamp_ntz").alias("parsed"))


@query("WITH e AS (SELECT min(ts) AS a, max(ts) AS b FROM events), d AS (SELECT unnest(generate_series(date_trunc('day', a), b, INTERVAL 1 DAY)) AS tick, a FROM e) SELECT tick FROM d WHERE (day(tick) - 1) % 2 = 0 AND tick >= a")
def time_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of events in about ten ticks: every second day."""
    return timeops.time_ticks(table(spark, sf_dir, "events"), "ts").select(F.col("tick").cast("timestamp_ntz").alias("tick"))


@query("""WITH e AS (SELECT event_type AS key, ts, value, time_bucket(INTERVAL 6 HOUR, ts) AS a, date_diff('day', TIMESTAMP '2024-01-01', ts) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS f FROM events),
m AS (SELECT key, f, max(max(ts)) OVER (PARTITION BY key ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(max(ts)) OVER (PARTITION BY key) AS latest FROM e GROUP BY key, f),
r AS (SELECT *, coalesce(a + INTERVAL 6 HOUR <= before - INTERVAL 12 HOUR, false) AS late, a + INTERVAL 6 HOUR <= latest - INTERVAL 12 HOUR AS closed FROM e JOIN m USING (key, f))
SELECT key, late, a AS window_start, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest FROM r WHERE late OR closed GROUP BY 1, 2, 3""")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in files of eight days, one in ten a file too late: closed windows, and the late rows by their window."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("f", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 8) + (F.col("event_id") % 10 == 0).cast("int"))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/late-in-{uuid.uuid4().hex}"
    for f in sorted(r.f for r in events.select("f").distinct().collect()):
        events.where(F.col("f") == f).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    hour = 3600 * 10**6
    done, missed = late.run_apart(late.closed_windows(arriving, "event_type", "ts", "value", 6 * hour, 12 * hour, "25 days"))
    missed = missed.groupBy("key", "window_start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    both = done.withColumn("late", F.lit(False)).unionByName(missed.withColumn("late", F.lit(True)))
    return both.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))
