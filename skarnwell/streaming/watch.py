"""Continuous ingest of files, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skarnwell.ingest import index
from skarnwell.operators.embed import Embedder
from skarnwell.sources import files
from skarnwell.store import Catalog


def watch(spark: SparkSession, folder: str, catalog: Catalog, embedder: Embedder, checkpoint: str, source: str = "local", every: str | None = None, suffix: str = "*") -> StreamingQuery:
    """Indexes files as they come: every micro-batch is an idempotent upsert. With `every` ("60 seconds") it goes on; without, it takes what there is and ends.

    The file source never reports deletions; run sync() from time to time for those.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length", "content")
        rows = rows.filter(files.admitted(F.col("path"), F.col("length"), folder))
        index(catalog, files.extracted(rows), source, embedder, prune=False)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sync(spark: SparkSession, folder: str, catalog: Catalog, embedder: Embedder, source: str = "local") -> dict[str, int]:
    """One full pass over a folder, deletions included."""
    found = files.listing(spark, folder, content=True).filter(files.admitted(F.col("path"), F.col("length"), folder))
    return index(catalog, files.extracted(found), source, embedder)


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(window_start, keys, n, total): counts and sums per event-time window; on a stream give `late` for the watermark. Partial sums are made before the shuffle."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, session_start, n): sessions of a key that end after a gap."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("session_start"), "n")
