"""Query patterns for data quality and time series, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total; null keys are one key. Spark limits each group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many; keys with nulls too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def fill_days(counts: DataFrame, day: str, first: Column | None = None, last: Column | None = None, value: str = "n") -> DataFrame:
    """A row for every day between the bounds (by default the first and last day present), 0 where there was none."""
    bounds = counts.agg(F.coalesce(first if first is not None else F.lit(None).cast("date"), F.min(day)).alias("a"), F.coalesce(last if last is not None else F.lit(None).cast("date"), F.max(day)).alias("b"))
    days = bounds.where("a <= b").select(F.explode(F.sequence("a", "b")).alias(day))
    return days.join(counts, day, "left").select(day, F.coalesce(value, F.lit(0)).alias(value))


def islands(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days: (keys, start_day, end_day, n_days). Days are made distinct before the window."""
    days = df.select(*keys, F.col(day).cast("date").alias("_d")).where("_d is not null").distinct()
    run = F.date_sub("_d", F.row_number().over(W.partitionBy(*keys).orderBy("_d")))
    return days.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("_d").alias("start_day"), F.max("_d").alias("end_day"), F.count(F.lit(1)).alias("n_days")).drop("_run")


def sessions(df: DataFrame, key: str, ts: str, tie: list[str], gap_seconds: int, shard_seconds: int = 7 * 86400) -> DataFrame:
    """Every row with session_no, counted from 1 per key; a session ends after more than ``gap_seconds`` without a row.

    Time is cut into shards, so a key with a third of all rows is spread over them; from the shards before come only
    their last time and their number of sessions, one row a shard. A row without time is a session of its own, the first ones.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_at", micros).withColumn("_shard", F.coalesce(F.floor(F.col("_at") / (shard_seconds * 1_000_000)), F.lit(-(2**62))))
    w, shards = W.partitionBy(key, "_shard").orderBy(ts, *tie), W.partitionBy("_k").orderBy("_s")
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_shard") == F.col("_s"))
    by_shard = lambda d, agg: d.groupBy(F.col(key).alias("_k"), F.col("_shard").alias("_s")).agg(agg.alias("_v"))
    last = by_shard(rows, F.max("_at")).select("_k", "_s", F.lag("_v").over(shards).alias("_before"))
    gap = F.col("_at") - F.coalesce(F.lag("_at").over(w), F.col("_before"))
    # the lag of a shard's first row is null, of a row after one without time too; then the shard before has no time either
    flagged = rows.join(last, same).drop("_k", "_s").withColumn("_new", (gap.isNull() | (gap > gap_seconds * 1_000_000)).cast("int")).drop("_before")
    count = by_shard(flagged, F.sum("_new")).select("_k", "_s", F.coalesce(F.sum("_v").over(shards.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_so_far"))
    running = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return flagged.join(count, same).withColumn("session_no", F.col("_so_far") + running).select(*df.columns, "session_no")


def cohorts(first: DataFrame, acts: DataFrame, key: str, joined: str, acted: str, within_days: int) -> DataFrame:
    """Per month of joining: members, and those who acted within so many days: (cohort, members, converted)."""
    hit = first.join(acts, key).where((F.datediff(acted, joined) >= 0) & (F.datediff(acted, joined) <= within_days)).select(key).distinct().withColumn("_hit", F.lit(1))
    return first.join(hit, key, "left").groupBy(F.date_format(joined, "yyyy-MM").alias("cohort")).agg(F.count(F.lit(1)).alias("members"), F.count("_hit").alias("converted"))


def above_watermark(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """The rows of ``source`` beyond the highest value that ``target`` holds; all of them while it is empty."""
    mark = target.agg(F.max(column).alias("_mark"))
    # the mark is one row
    return source.join(F.broadcast(mark), F.col("_mark").isNull() | (source[column] > F.col("_mark"))).drop("_mark")
