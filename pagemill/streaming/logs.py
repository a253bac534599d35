"""Streaming forms of the log operators that need no order (see `ordered` for those that do).

Event time is the events' own; state is bounded by a watermark, after which late rows are
dropped (an extension: the batch forms see every row). Sinks are folders on shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import web
from pagemill.operators.logs import LOST_AFTER, merge_marks, worker_marks, worker_rollup
from pagemill.schemas import EVENTS
from pagemill.sources.versions import PARTS, RING, RingTable, VersionedTable

LATE = "10 minutes"


def event_stream(spark: SparkSession, pattern: str, *, files: int = 100) -> DataFrame:
    """Events of the Parquet files that match a pattern, ts as a time-zoned timestamp."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def heartbeats(pings: DataFrame, *, keys: list[str], ts: str, platform: str) -> DataFrame:
    """Running roll-up of each worker: one state row a worker (output mode complete or update)."""
    return worker_rollup(pings, keys=keys, ts=ts, platform=platform)


def upsert_workers(pings: DataFrame, folder: str, *, keys: list[str], ts: str, platform: str, parts: int = PARTS) -> VersionedTable:
    """Each worker's roll-up in a table that every batch upserts: only the parts of its workers are
    written anew. A batch that is replayed starts from the version before it, and leaves the same."""
    table = VersionedTable(pings.sparkSession, f"{folder}/workers", keys=keys, parts=parts)

    def merge(batch: DataFrame, n: int) -> None:
        table.upsert(worker_marks(batch, keys=keys, ts=ts, platform=platform), str(n), lambda old, new: merge_marks(old, new, keys=keys))
        table.retain(2)

    pings.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return table


def keep_ring(rows: DataFrame, folder: str, *, id: str, keep: int = RING) -> RingTable:
    """The newest rows of a stream, as a log that is compacted while it grows."""
    ring = RingTable(rows.sparkSession, f"{folder}/ring", id=id, keep=keep)
    rows.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(ring.append).start().awaitTermination()
    return ring


def _marked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events if late is None else events.withWatermark(ts, late)


def windowed_counts(events: DataFrame, *, ts: str, by: str, width: str = "1 day", late: str | None = LATE) -> DataFrame:
    """Events of each kind in tumbling windows (append once the watermark has passed a window; with late
    None no row is late and all windows are there in output mode complete)."""
    return _marked(events, ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def silent_spans(beats: DataFrame, *, ts: str, by: str, after: int = LOST_AFTER, late: str | None = LATE) -> DataFrame:
    """Sessions of heartbeats of each job; a session ends when none comes for `after` seconds, which is
    when the job counts as lost (append once the watermark has passed; with late None all sessions, in
    output mode complete)."""
    return _marked(beats, ts, late).groupBy(F.session_window(ts, f"{after} seconds"), by).agg(F.count("*").alias("beats"), F.max(ts).alias("last_beat")).select(by, "beats", "last_beat", F.col("session_window.end").alias("lost_at"))


def beacons(events: DataFrame, *, agent: Column, forwarded: Column, real: Column, peer: Column) -> DataFrame:
    """Access rows with system, browser, device, address and whether it is local. A map: no state."""
    ip = web.real_ip(forwarded, real, peer)
    return events.select("event_id", "ts", web.operating_system(agent).alias("os"), web.browser(agent).alias("browser"), web.device(agent).alias("device"), ip.alias("ip"), web.is_local(ip).alias("lan"))


def drain_files(spark: SparkSession, source: str, folder: str, work, *, every: int = 5) -> DataFrame:
    """Work through the text files below source that no earlier call has done, `every` at a time, and
    return all results. work gets (path, value) rows. The stream's checkpoint is the manifest of files
    that are done: after each batch it and the batch's results stand, and a batch that was cut off is
    done again and replaces what it left."""
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", every).text(source, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def batch_done(batch: DataFrame, n: int) -> None:
        work(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/done/version={n}")

    stream.writeStream.option("checkpointLocation", f"{folder}/manifest").trigger(availableNow=True).foreachBatch(batch_done).start().awaitTermination()
    return spark.read.parquet(f"{folder}/done").drop("version")


def drain(stream: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a folder, and read it. Append writes files as they
    come; complete keeps the version of the last batch."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    spark = stream.sparkSession
    if mode == "append":
        writer.format("parquet").start(f"{folder}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    last: list[int] = []

    def version(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/version={n}")
        last.append(n)

    writer.foreachBatch(version).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/version={max(last)}")
