"""Structured Streaming: watched folders, idempotent upserts, query-log windows, backfill."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import MERGED_VERSION, PATTERN_VERSION, TARGET_VERSION
from ..operators import extract as X
from ..operators.components import materialise
from ..operators.filters import needs_backfill
from ..sources import ingest

DEBOUNCE = "300 milliseconds"


def watch(spark: SparkSession, path: str, enabled: tuple[str, ...] = ingest.ENABLED) -> DataFrame:
    """A stream of accepted files under a folder."""
    files = spark.readStream.format("binaryFile").schema(ingest.FILE_SCHEMA).option("recursiveFileLookup", "true").load(path)
    return files.where(ingest.accepted(F.col("path"), enabled))


def debounced(events: DataFrame, key: str = "path", ts: str = "ts", gap: str = DEBOUNCE) -> DataFrame:
    """The last event of each run of a key's events that follow one another within the debounce interval of event time."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("_last")
    return events.withWatermark(ts, gap).groupBy(F.session_window(ts, gap), key).agg(last).select(key, "_last.*")


def index_stream(files: DataFrame, table: str, schema: str, checkpoint: str) -> StreamingQuery:
    """Indexes arriving files; every batch appends `rows/batch=N` and the ids that it replaces as `gone/batch=N`.

    So a batch costs what it brings, not what is there, but for the paths and hashes that it is compared with.
    A batch that runs twice sees the same earlier batches and writes the same.
    """
    spark = files.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        known = read_index(spark, table, schema, number)
        fresh = materialise(ingest.index(ingest.parse(batch), known), "fresh")
        ingest.save_table(fresh.drop("old_id"), f"{table}/rows/batch={number}")
        ingest.save_table(fresh.where("old_id is not null").select(F.col("old_id").alias("doc_id")), f"{table}/gone/batch={number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, table: str, schema: str, before: int | None = None) -> DataFrame:
    """The indexed documents (of the batches before one): rows that no later batch replaced."""
    empty = spark.createDataFrame([], schema)
    if not ingest.path_exists(spark, f"{table}/rows"):
        return empty
    rows = spark.read.schema(empty.schema.add("batch", "long")).parquet(f"{table}/rows")
    gone = spark.read.schema("doc_id string, batch long").parquet(f"{table}/gone").withColumnsRenamed({"doc_id": "_gone", "batch": "_at"}) if ingest.path_exists(spark, f"{table}/gone") else None
    if before is not None:
        rows, gone = rows.where(F.col("batch") < before), gone.where(F.col("_at") < before) if gone is not None else None
    if gone is not None:
        rows = rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("batch") < F.col("_at")), "left_anti")
    return rows.select(*empty.columns)


def compact_index(spark: SparkSession, table: str, schema: str, to: str) -> None:
    """The index as one batch of a new table, without what was replaced.  A stream that goes on there starts a new checkpoint."""
    ingest.save_table(read_index(spark, table, schema), f"{to}/rows/batch=0")
    ingest.save_table(spark.createDataFrame([], "doc_id string"), f"{to}/gone/batch=0")


def query_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window and key, with a bound on lateness."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def changed_only(stream: DataFrame, key: str = "path", value: str = "content_hash") -> DataFrame:
    """Rows whose value differs from the last seen one of their key, kept in state."""
    import pandas as pd

    schema = f"{key} string, {value} string"

    def run(who, batches, state):
        last = state.get[0] if state.exists else None
        out = []
        for part in batches:
            for v in part[value]:
                if v != last:
                    out.append(v)
                    last = v
        state.update((last,))
        yield pd.DataFrame({key: [who[0]] * len(out), value: out})

    return stream.select(key, value).groupBy(key).applyInPandasWithState(run, schema, f"{value} string", "append", "NoTimeout")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is into Parquet and returns the rows."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class Watcher:
    """Add, pause, resume and remove folder streams by name."""

    def __init__(self, start: Callable[[str], StreamingQuery]):
        self.start, self.running, self.paths = start, {}, {}

    def add(self, name: str, path: str) -> None:
        self.paths[name] = path
        self.running[name] = self.start(path)

    def pause(self, name: str) -> None:
        if query := self.running.pop(name, None):
            query.stop()

    def resume(self, name: str) -> None:
        if name not in self.running:
            self.running[name] = self.start(self.paths[name])

    def remove(self, name: str) -> None:
        self.pause(name)
        self.paths.pop(name, None)

    def shutdown(self) -> None:
        for name in list(self.running):
            self.pause(name)


_BACKFILL = threading.Lock()


@dataclass(frozen=True)
class Progress:
    """How far a backfill is: documents below the target version, done, and failed so far."""

    total: int
    done: int
    failed: int


def backfill(
    docs: DataFrame, refine: Callable[[DataFrame], DataFrame] | None = None, parts: int = 1, progress: Callable[[Progress], None] | None = None, lock: str | None = None,
) -> DataFrame:
    """Documents below the target version extracted again; others as they are.

    Runs at once and holds the lock until its result is written, so that one backfill runs at a time in this
    driver and, with `lock` (a path), in all that share it; another one is an error.  Versions rise: a document
    with patterns is at least 2.5; `refine` (documents with their new entities in, the same rows out) may
    raise them to 3.0 and 3.5.  A document on which extraction fails keeps its row; `progress` is told after
    each of `parts` hashed parts.
    """
    if not _BACKFILL.acquire(blocking=False):
        raise RuntimeError("a backfill is running")
    spark, held = docs.sparkSession, False
    try:
        held = lock is not None and _take(spark, lock)
        if lock is not None and not held:
            raise RuntimeError("a backfill is running")
        old = docs.where(needs_backfill(F.col("entities_version")))
        total, done, failed, out = old.count(), 0, 0, docs.where(~needs_backfill(F.col("entities_version")))
        for n in range(parts):
            part = old.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == n) if parts > 1 else old
            found = materialise(_extracted(part, refine), "backfill")
            counts = found.agg(F.count("*").alias("n"), F.count_if("_failed").alias("f")).first()
            done, failed = done + counts["n"], failed + counts["f"]
            out = out.unionByName(found.drop("_failed"), allowMissingColumns=True)
            if progress:
                progress(Progress(total, done, failed))
        return materialise(out, "backfilled")
    finally:
        if held:
            _release(spark, lock)
        _BACKFILL.release()


def _extracted(part: DataFrame, refine: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Rows of a part after extraction, with `_failed`; failed ones as they were."""
    tried = X.extract(part.withColumnRenamed("extracted_entities", "_before"), failed="_failed")
    good = tried.where("not _failed").drop("_before", "_failed")
    good = refine(good) if refine else good.withColumn("entities_version", F.greatest(F.coalesce("entities_version", F.lit(0.0)), F.lit(PATTERN_VERSION)))
    bad = tried.where("_failed").drop("extracted_entities").withColumnRenamed("_before", "extracted_entities")
    return good.withColumn("_failed", F.lit(False)).unionByName(bad, allowMissingColumns=True)


def next_version(version: float | None, refined: bool, related: bool) -> float:
    """The version of a document after a backfill: patterns alone 2.5, a model's entities 3.0, its relations as well 3.5; never less than before."""
    reached = TARGET_VERSION if refined and related else MERGED_VERSION if refined else PATTERN_VERSION
    return max(version or 0.0, reached)


def _take(spark: SparkSession, path: str) -> bool:
    """Makes the lock file; false if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(at)


def _release(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)
