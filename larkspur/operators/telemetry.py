"""Telemetry: device identity, one row per device, and rates of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions.formatting import percent

# Names of block devices. After a family's name comes a number, then each part in turn: one of its letters and a number; a part not needed may be missing.
DEVICES = {"disk": (("s", False), ("sp", False)), "nvme": (("n", True), ("p", False)), "mmcblk": (("p", True),)}


def _named(family: str, parts: tuple[tuple[str, bool], ...]) -> str:
    digits = "[0-9]+"
    return family + digits + "".join(f"(?:[{letters}]{digits})" + ("" if needed else "?") for letters, needed in parts)


def physical_id(device: Column) -> Column:
    """Name of the device below /dev, partition suffix kept, whatever follows; the device itself where it is of no known family."""
    below = F.when(device.startswith("/dev/"), F.substring(device, F.lit(6), F.length(device)))
    out = device
    for family, parts in DEVICES.items():
        name = F.regexp_extract(below, "^" + _named(family, parts), 0)
        out = F.when(below.startswith(family) & (name != ""), name).otherwise(out)
    return out


def busiest_partition(disks: DataFrame, order: str) -> DataFrame:
    """For each physical device the row of the highest percent, the first by `order` on ties. The limit is applied before the shuffle."""
    rows = disks.withColumn("percent", percent(F.col("used"), F.col("total"))).withColumn("physical_id", physical_id(F.col("device")))
    place = F.row_number().over(Window.partitionBy("physical_id").orderBy(F.desc("percent"), order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def disk_totals(disks: DataFrame, order: str) -> DataFrame:
    """total, used and percent over one row per device."""
    out = busiest_partition(disks, order).agg(F.sum("total").alias("total"), F.sum("used").alias("used"))
    return out.withColumn("percent", percent(F.col("used"), F.col("total")))


def uptime(now: Column, started: Column) -> Column:
    """Whole seconds since the start, cut off towards zero."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return (micros / 1000000).cast("long")


def counter_rate(samples: DataFrame, host: str, at: str, total: str, tie: str) -> DataFrame:
    """`samples` with rate: growth of a counter per second since the host's sample before; 0 for the first and where no time has passed."""
    w = Window.partitionBy(host).orderBy(at, tie)
    was, before = F.lag(total).over(w), F.lag(at).over(w)
    elapsed = F.col(at) - before
    return samples.withColumn("rate", F.when(was.isNull() | (elapsed <= 0), F.lit(0.0)).otherwise((F.col(total) - was) / elapsed))
