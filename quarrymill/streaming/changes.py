"""Change feeds and events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.operators import changes
from quarrymill.sources import walk


def feed(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder, a bounded number in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_changes(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], key: str = "path") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: deletions first, then upserts, over the current points.

    ``write`` must replace the points of a batch id as a whole, so that a batch that runs again has the same effect.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        points = read()
        gone = batch.filter("change = 'deleted'")
        new = batch.filter("change <> 'deleted'").drop("change")
        if points is None:
            write(changes.upsert(new.limit(0), new, key), batch_id)
        else:
            write(changes.upsert(changes.delete_where(points, gone, key), new, key), batch_id)

    return one


def run_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """All that is there now, or for good at an interval such as ``15 seconds``; the checkpoint lets a new run go on."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watched(feed: DataFrame, extensions: list[str] | None = None, ignored_folders: list[str] = walk.EXCLUDED_FOLDERS, ignored_names: list[str] = (), path: str = "path") -> DataFrame:
    """Changes of files that a watch is about: none below an ignored folder or with a name like an ignored pattern."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    keep = ~F.exists(folders, lambda x: x.isin(*ignored_folders))
    if extensions:
        keep = keep & F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(F.col(path), e))
    for pattern in ignored_names:
        keep = keep & ~F.element_at(F.split(path, "/"), -1).rlike(pattern)
    return feed.filter(keep)


def settled(feed: DataFrame, path: str = "path", time: str = "at") -> DataFrame:
    """The last change of each path within a micro-batch or table, which is all that a burst of changes leaves to do."""
    return feed.groupBy(path).agg(F.max_by(F.struct(*[c for c in feed.columns if c != path]), time).alias("_last")).select(path, "_last.*")


def deduplicated(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; keys are remembered as long as late rows may come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, time: str, late: str, width: str, by: str, value: str) -> DataFrame:
    """Counts, totals and means by window and class, in batch or with a watermark."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), by, "n", "total", "mean")


def sessions(events: DataFrame, time: str, late: str, gap: str, by: str) -> DataFrame:
    """Sessions of each key: runs of events without a longer gap."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")
