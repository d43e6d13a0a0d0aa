"""Streaming forms of the telemetry log, of insert-or-ignore ingestion and of the incremental index.

Each gives the result that its batch form gives over the same rows, whatever the micro-batches; every sink is idempotent
by key, so that a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from lodequery.sources import store


def bucket_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """begin, operation and n of tumbling windows over a stream of events; rows later than `late` are dropped with their window closed.

    Null times and operations: rows without time belong to no window and are dropped; a null operation is a group of its own.
    """
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", length), "operation").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "operation", "n")


def first_seen(rows: DataFrame, by: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Rows of a stream whose key wasn't seen within `late` before: state stays bounded by the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(by)


def ingested(rows: DataFrame, path: str, by: list[str], checkpoint: str, order: tuple[str, ...] = ()) -> DataStreamWriter:
    """Adds rows of keys that the table at path doesn't have, batch by batch: the first write of a key wins, for ever; inside a batch the first by `order`."""
    like = rows.sparkSession.createDataFrame([], rows.schema)

    def put(batch: DataFrame, _: int) -> None:
        store.inserted_or_ignored(batch.select(*like.columns), path, by, order)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def kept_up(files: DataFrame, manifest: str, checkpoint: str, reconcile_every: int = 0, full=None) -> DataStreamWriter:
    """Brings the manifest at a path up with a stream of file states (path, mtime, content_hash, logic_version, gone).

    Of a path's rows in a batch the one of latest mtime counts, of equal ones that of the largest hash; a batch's states count after those of the batches before;
    gone paths leave the manifest. A batch writes its own paths alone, as a segment (sources/store.py), and reads nothing of the manifest; a batch that
    runs again writes the same rows once more, which changes nothing. Every `reconcile_every` batches (0: never) full(), the state of all files, takes the
    manifest's place, and between them compacted() may make its segments one.
    """
    columns = ["path", "mtime", "content_hash", "logic_version"]

    def put(batch: DataFrame, n: int) -> None:
        if full is not None and reconcile_every > 0 and (n + 1) % reconcile_every == 0:
            store.replaced(full().select(*columns), manifest)
            return
        own = F.struct("mtime", "content_hash", "logic_version", "gone")
        last = batch.groupBy("path").agg(F.max_by(own, F.struct("mtime", "content_hash", "gone")).alias("x")).select("path", "x.*").persist()
        store.changed(last.where("not gone").select(*columns), last.where("gone").select("path"), manifest, ["path"])
        last.unpersist()

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def finished(writer: DataStreamWriter) -> StreamingQuery:
    """Runs a stream over all that is there now and waits for its end."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return running
