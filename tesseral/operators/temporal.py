"""Joins along an axis: the last row before each row, and points inside intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], shard_seconds: int = 30 * 86400) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same keys at or before ``ts``; null where there is none.

    Of several rows at one time the one with the largest columns counts. Rows with a null key or time match nothing.
    Time is cut into shards, so a key with a third of all rows is spread over them; what the shards before hold comes from
    one row a shard. Both steps shuffle by keys and shard once. Columns of ``right`` must not occur in ``left``.
    """
    shard = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (shard_seconds * 1_000_000))
    row = F.struct(*[F.col(c) for c in left.columns])
    has = F.col(ts).isNotNull()
    for k in keys:
        has = has & F.col(k).isNotNull()
    once = right.where(has).groupBy(*keys, ts).agg(F.max(F.struct(*columns)).alias("_new"))
    kind = once.schema["_new"].dataType
    rows = left.where(has).select(*keys, F.col(ts), row.alias("_row"), F.lit(None).cast(kind).alias("_new"))
    both = rows.unionByName(once.select(*keys, ts, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_new")).withColumn("_shard", shard)
    w = W.partitionBy(*keys, "_shard").orderBy(ts, F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    within = both.withColumn("_last", F.last("_new", ignorenulls=True).over(w)).where("_row is not null")
    ends = both.groupBy(*keys, "_shard").agg(F.max(F.when(F.col("_new").isNotNull(), F.struct(ts, "_new"))).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*keys, "_shard", F.last("_end._new", ignorenulls=True).over(before).alias("_carry"))
    found = within.join(carry, [*keys, "_shard"], "left").select("_row.*", F.coalesce("_last", "_carry").alias("_hit"))
    found = found.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in columns])
    types = {c: kind[c].dataType for c in columns}
    return found.unionByName(left.where(~has).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in columns]))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Every pair of a point and an interval with ``low`` <= ``at`` <= ``high``, all of them whole numbers; no cross join.

    An interval lies in at most two buckets of the smallest power of two that isn't shorter, its level; a point is
    repeated once for each level that occurs, at most 64. So the join is one of equal level and bucket, and long
    intervals cost no more than short ones. Rows with nulls, and intervals that end before they begin, match nothing.
    Column names of the two sides must differ.
    """
    level = F.greatest(F.ceil(F.log2(F.col(high) - F.col(low) + 1)), F.lit(0)).cast("int")
    sides = intervals.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    # at most 64 rows, one for each level
    levels = sides.select("_level").distinct()
    bucket = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    a = points.where(F.col(at).isNotNull()).join(F.broadcast(levels)).withColumn("_bucket", bucket(at))
    b = sides.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return a.join(b, ["_level", "_bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_bucket")
