"""Change and click events as streams: file source, de-duplication, snapshots by foreachBatch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import split_words
from ..operators.snapshot import ancestors, latest_events, without_subtrees
from ..schema import EVENTS

# What sets off a new learning of associations, and the times between full scans in seconds.
RELEARN_CHANGES, RELEARN_SECONDS, RESCAN_CHANGES = 30, 120, 200
RESCAN_WATCH_LIMIT, RESCAN_WHOLE_SYSTEM = 300, 900
CHANGES, REQUESTS = ("changed", "deleted", "renamed"), ("rescan", "rebuild")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON event files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def distinct_events(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Events once each within the watermark; works on streams and tables."""
    timed = events.withColumn("event_time", F.timestamp_seconds("ts"))
    if events.isStreaming:
        timed = timed.withWatermark("event_time", watermark)
    return timed.dropDuplicatesWithinWatermark(["kind", "path", "path2", "query", "ts", "seq"]) if events.isStreaming else timed.dropDuplicates(["kind", "path", "path2", "query", "ts", "seq"])


def batch_state(events: DataFrame) -> DataFrame:
    """(path, kind, seq): what a batch leaves of each path.

    The last change or deletion of a path counts; a rename deletes its old path and changes its new. Deleting a folder
    deletes what was changed below it before: such paths are deleted with the folder's seq.
    """
    moved = events.where(F.col("kind") == "renamed")
    each = events.where(F.col("kind").isin("changed", "deleted")).select("path", "kind", "seq")
    each = each.union(moved.select("path", F.lit("deleted"), "seq")).union(moved.select("path2", F.lit("changed"), "seq"))
    last = latest_events(each)
    gone = each.where(F.col("kind") == "deleted").groupBy(F.col("path").alias("above")).agg(F.max("seq").alias("gone"))
    asked = last.where(F.col("kind") == "changed").select("path", F.explode(ancestors(F.col("path"), itself=False)).alias("above"))
    hit = asked.join(gone, "above").groupBy("path").agg(F.max("gone").alias("gone"))
    below = F.coalesce((F.col("kind") == "changed") & (F.col("gone") > F.col("seq")), F.lit(False))
    out = last.join(hit, "path", "left")
    return out.select("path", F.when(below, "deleted").otherwise(F.col("kind")).alias("kind"), F.when(below, F.col("gone")).otherwise(F.col("seq")).alias("seq"))


def apply_state(files: DataFrame, state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The snapshot after a batch: deleted paths go with all below them, changed ones take their row of fresh.

    fresh has the columns of files, with rows for changed paths that are still there (and for what a changed folder
    holds, as a scan of it finds); a changed path without a row is gone.
    """
    kept = without_subtrees(files, state.where(F.col("kind") == "deleted"))
    stale = state.where(F.col("kind") == "changed").select("path").union(fresh.select("path")).distinct()
    return kept.join(stale, "path", "left_anti").select(*files.columns).unionByName(fresh.select(*files.columns))


def requests(events: DataFrame) -> set[str]:
    """Which of a batch's events ask for a whole scan: rescan, or rebuild, which drops the derived tables first."""
    return {r[0] for r in events.where(F.col("kind").isin(*REQUESTS)).select("kind").distinct().collect()}


def clicks(events: DataFrame) -> DataFrame:
    """(term, path, ts): a row for each distinct word of a click's query."""
    return events.where(F.col("kind") == "click").select(F.explode(F.array_distinct(split_words(F.col("query")))).alias("term"), "path", "ts")


def searches(events: DataFrame) -> DataFrame:
    """(query, ts): normalised searches that were clicked."""
    normal = F.array_join(split_words(F.col("query")), " ")
    return events.where(F.col("kind") == "click").select(normal.alias("query"), "ts").where("query <> ''")


@dataclass
class Throttle:
    """Whether to learn associations again: enough changes, and long enough since the last time."""

    changes: int = 0
    last: float = float("-inf")

    def due(self, new_changes: int, now: float) -> bool:
        self.changes += new_changes
        if self.changes < RELEARN_CHANGES or now - self.last < RELEARN_SECONDS:
            return False
        self.changes, self.last = 0, now
        return True


def learn_after_scan(changed: int, learned_before: bool) -> bool:
    """Whether a whole scan is followed by learning associations: many changes, or nothing learned yet."""
    return changed >= RESCAN_CHANGES or not learned_before


def follow(
    events: DataFrame, clicks_path: str, searches_path: str, checkpoint: str, apply: Callable[[DataFrame, int], None], available_now: bool = False,
    scan: Callable[[bool, int], None] | None = None, quarantine: str | None = None,
) -> StreamingQuery:
    """Append clicks and searches to their logs, hand each batch's changes to apply(state, batch id), and call
    scan(rebuild, batch id) where its events ask for a whole scan.

    Logs are written below a folder per batch and overwritten if a batch is repeated, so a restart adds nothing twice.
    With a quarantine folder, a step that fails leaves the batch's events and its error there and the stream goes on;
    without one the failure ends the stream.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates()
        batch.persist()

        def step(name: str, run: Callable[[], None]) -> None:
            try:
                run()
            except Exception as e:
                if quarantine is None:
                    raise
                batch.withColumn("step", F.lit(name)).withColumn("error", F.lit(str(e)[:1000])).write.mode("overwrite").parquet(f"{quarantine}/batch={number}/step={name}")

        def asked() -> None:
            if scan is not None and (found := requests(batch)):
                scan("rebuild" in found, number)

        try:
            step("clicks", lambda: clicks(batch).write.mode("overwrite").parquet(f"{clicks_path}/batch={number}"))
            step("searches", lambda: searches(batch).write.mode("overwrite").parquet(f"{searches_path}/batch={number}"))
            step("apply", lambda: apply(batch_state(batch), number))
            step("scan", asked)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")
    return writer.start()


def rescan_due(now: float, last: float, watch_limit: bool, whole_system: bool) -> bool:
    """Whether a full scan is due where live changes can't be followed everywhere."""
    spans = [s for s, on in ((RESCAN_WATCH_LIMIT, watch_limit), (RESCAN_WHOLE_SYSTEM, whole_system)) if on]
    return bool(spans) and now - last >= min(spans)


def windowed_counts(events: DataFrame, watermark: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows of ts; late events count within the watermark."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
