"""Keeping the graph up to date from a stream of file changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlens.operators.snapshot import delete_files, snapshot_merge


def debounced(events: DataFrame, quiet: str = "200 milliseconds", late: str = "10 seconds", path: str = "path", at: str = "ts") -> DataFrame:
    """One row per burst of a path's events: path, first_at, last_at, n. Bounded by a watermark in a stream."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(path, F.session_window(at, quiet).alias("burst")).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n")).drop("burst")


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", key: str = "event_type", at: str = "ts") -> DataFrame:
    """Events per key and window; late ones beyond the watermark are left out in a stream. An addition to the reference's operators."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return e.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def apply_changes(stored_symbols: DataFrame, incoming: DataFrame, deleted_paths: DataFrame) -> DataFrame:
    """Symbols after one batch: deleted paths are out, re-read ones merged with ids kept."""
    left = stored_symbols.join(deleted_paths.select("path").distinct(), "path", "left_anti")
    return snapshot_merge(left, incoming.join(deleted_paths.select("path").distinct(), "path", "left_anti"))


def changed_paths(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) added or changed, (path) gone: a diff of two scans (path, hash), since a file stream tells of no deletions."""
    b = before.select("path", F.col("hash").alias("was"), F.lit(True).alias("known"))
    j = now.join(b, "path", "left")
    return j.where(F.col("known").isNull() | ~F.col("hash").eqNullSafe(F.col("was"))).select("path"), before.join(now.select("path"), "path", "left_anti").select("path")


def watch(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch of a change stream to handle; stop() ends it, and a restart goes on after the last finished batch."""
    w = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


__all__ = ["apply_changes", "changed_paths", "debounced", "delete_files", "watch", "windowed_counts"]
