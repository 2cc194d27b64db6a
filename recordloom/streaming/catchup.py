"""Incremental catch-up: a file stream brings derived tables level with what arrived.

``Trigger.AvailableNow`` reads what is there and stops; the checkpoint is the
cursor, so a run that dies repeats its batch and nothing is counted twice: a
batch replaces its own output folder, named after the batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.session import is_file, path_exists


def drain(spark: SparkSession, source: str, schema: StructType, target: str, transform, files_per_batch: int = 1_000) -> int:
    """Run ``transform`` on everything new under ``source`` into ``target``; returns the number of batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, source):  # a stream reads folders
        folder, _, name = source.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(source)

    def put(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(1 for p in q.recentProgress if p["numInputRows"])


def caught_up(spark: SparkSession, target: str) -> DataFrame | None:
    return spark.read.parquet(f"{target}/rows").drop("batch") if path_exists(spark, f"{target}/rows") else None


def partial_counts(events: DataFrame) -> DataFrame:
    """A batch's share of the per-month, per-operation figures; ids stay so that late repeats can be told."""
    return events.select("id", F.date_format(F.timestamp_seconds("at"), "yyyy-MM").alias("month"), "operation", F.coalesce("duration", F.lit(0)).alias("duration"))


def merged_counts(spark: SparkSession, target: str) -> DataFrame:
    """month, operation, n, total_us over all batches, each id once."""
    rows = caught_up(spark, target)
    once = rows.groupBy("id").agg(F.min(F.struct("month", "operation", "duration")).alias("e")).select("e.*")
    return once.groupBy("month", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total_us"))


def windowed(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per window and type; on a stream, rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain_until_level(run_once, behind, most_passes: int = 64, most_seconds: float = 900.0) -> int:
    """Repeat passes while ``behind()`` says work is left; returns the passes made. A pass that fails ends the drain."""
    import time

    began, passes = time.monotonic(), 0
    while behind() and passes < most_passes and time.monotonic() - began < most_seconds:
        run_once()
        passes += 1
    return passes


def cooldown(failures: int) -> int:
    """Seconds to wait after so many failures in a row: 1, 2, 4 ... 32."""
    return 0 if failures <= 0 else 1 << (min(failures, 6) - 1)


class Position:
    """How far a derived index came: its version, row count and digest, and whether the settings it was made with still hold."""

    def __init__(self, version: int, rows: int, digest: str, settings: dict) -> None:
        self.version, self.rows, self.digest, self.settings = version, rows, digest, dict(settings)

    def freshness(self, version: int, settings: dict) -> str:
        if settings != self.settings:
            return "other settings"
        return "current" if version == self.version else "behind" if version > self.version else "ahead"
