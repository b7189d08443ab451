"""The batch patterns on unbounded inputs: windows, sessions, deduplication and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesseral.operators.merge import When, merge_into
from tesseral.operators.patterns import latest_per_key
from tesseral.sources.versioned import Store


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows of event time; rows later than the watermark are left out, as streams must."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, as long as its copies come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(spark: SparkSession, store: Store, name: str, keys: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into a stored table: its latest row per key wins.

    Merging a batch again changes nothing, so a batch that is retried is harmless.
    """
    on = " AND ".join(f"t.`{k}` <=> s.`{k}`" for k in keys)

    def run(batch: DataFrame, _: int) -> None:
        # a micro-batch has a session of its own
        merge_into(Store(batch.sparkSession, store.folder), name, latest_per_key(batch, keys, order), on, [When("matched", "update", None, "*"), When("insert", "insert", None, "*")])

    return run


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there into an in-memory table, for tests."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
