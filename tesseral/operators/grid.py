"""Irregular readings onto a regular daily grid by monotone cubic interpolation (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a time shard.
SHARD_DAYS = 90
#: Gaps of more missing days than this stay marked, without a value.
LONG_GAP = 14


def daily_readings(readings: DataFrame, source: str, day: str, value: str) -> DataFrame:
    """One usable reading per source and day as (source, day, y): the lowest one of the day.

    Usable: source, day and value are not null and the value is not negative (nor NaN). The minimum is combined before
    the shuffle, so a source with many readings a day is at most one row per day afterwards.
    """
    usable = readings.where(F.col(source).isNotNull() & F.col(day).isNotNull() & (F.col(value) >= 0) & ~F.isnan(F.col(value).cast("double")))
    return usable.groupBy(F.col(source).alias("source"), F.col(day).cast("date").alias("day")).agg(F.min(F.col(value).cast("double")).alias("y"))


def _halo(points: DataFrame) -> DataFrame:
    """Each shard's rows plus the two readings before and after it (``_own`` false).

    A shard gives away its first and last two readings; among those alone, in time order, the neighbours of a shard's
    edge are its true neighbours. A source has at most four such rows per shard.
    """
    edges = points.groupBy("source", "shard").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("x", "y"))), 1, 2).alias("head"),
        F.slice(F.sort_array(F.collect_list(F.struct("x", "y")), asc=False), 1, 2).alias("tail"),
    )
    edges = edges.select("source", "shard", F.explode(F.array_distinct(F.concat("head", "tail"))).alias("p"))
    w = W.partitionBy("source").orderBy("p.x")
    sides = [F.lag("shard", k).over(w) for k in (1, 2)] + [F.lead("shard", k).over(w) for k in (1, 2)]
    near = edges.select("source", "shard", "p.x", "p.y", F.array_distinct(F.array(*sides)).alias("_to"))
    sent = near.select("source", F.explode("_to").alias("_to"), "shard", "x", "y", F.lit(False).alias("_own")).where("_to <> shard")
    sent = sent.select("source", F.col("_to").alias("shard"), "x", "y", "_own")
    return points.select("source", "shard", "x", "y", F.lit(True).alias("_own")).unionByName(sent)


def _edge_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """The one-sided three-point slope at an end, limited so that the curve keeps its shape."""
    d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return F.when(F.signum(d) != F.signum(m0), 0.0).when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0).otherwise(d)


def _inner_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """The weighted harmonic mean of the two secants; 0 at a local extremum."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(m0 * m1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / F.when(m0 != 0, m0) + w1 / F.when(m1 != 0, m1)))


def regular_grid(readings: DataFrame, source: str, day: str, value: str, shard_days: int = SHARD_DAYS, long_gap: int = LONG_GAP) -> DataFrame:
    """(source, day, value, status): one row per source and day from its first to its last usable reading.

    status is ``reading`` (the day's lowest usable reading), ``filled`` (monotone cubic through the neighbours: never
    above or below the two readings around it) or ``gap`` (a run of more than ``long_gap`` missing days: value null).
    A source with one usable reading has one row, with none it has no row. Work is split by (source, time shard); a
    shard gets the two readings on either side of it, all that the slopes need. Extra columns are dropped.
    """
    points = daily_readings(readings, source, day, value).withColumn("x", F.unix_date("day"))
    points = points.withColumn("shard", F.floor(F.col("x") / shard_days)).select("source", "shard", "x", "y")
    w = W.partitionBy("source", "shard").orderBy("x")
    at = lambda name, k: F.lag(name, -k).over(w) if k < 0 else F.lead(name, k).over(w)
    p = _halo(points).select(
        "source", "shard", "x", "y", "_own", *[at(c, k).alias(f"{c}{'m' if k < 0 else 'p'}{abs(k)}") for c in ("x", "y") for k in (-1, 1, 2)]
    ).where("_own")
    h = F.col("xp1") - F.col("x")
    m = (F.col("yp1") - F.col("y")) / h
    h_before, h_after = F.col("x") - F.col("xm1"), F.col("xp2") - F.col("xp1")
    m_before, m_after = (F.col("y") - F.col("ym1")) / h_before, (F.col("yp2") - F.col("yp1")) / h_after
    begin = F.when(F.col("xm1").isNotNull(), _inner_slope(h_before, h, m_before, m)).when(F.col("xp2").isNotNull(), _edge_slope(h, h_after, m, m_after)).otherwise(m)
    end = F.when(F.col("xp2").isNotNull(), _inner_slope(h, h_after, m, m_after)).when(F.col("xm1").isNotNull(), _edge_slope(h, h_before, m, m_before)).otherwise(m)
    rows = p.select("source", "x", "y", "yp1", h.alias("h"), begin.alias("d0"), end.alias("d1")).select(
        "*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("h") - 1, F.lit(0)))).alias("k")
    )
    t = F.col("k") / F.col("h")
    curve = (
        (1 + 2 * t) * (1 - t) * (1 - t) * F.col("y")
        + t * (1 - t) * (1 - t) * F.col("h") * F.col("d0")
        + t * t * (3 - 2 * t) * F.col("yp1")
        + t * t * (t - 1) * F.col("h") * F.col("d1")
    )
    # rounding errors must not leave the band between the two readings
    curve = F.least(F.greatest(curve, F.least("y", "yp1")), F.greatest("y", "yp1"))
    status = F.when(F.col("k") == 0, "reading").when(F.col("h") - 1 > long_gap, "gap").otherwise("filled")
    return rows.select(
        "source",
        F.date_from_unix_date((F.col("x") + F.col("k")).cast("int")).alias("day"),
        F.when(status == "reading", F.col("y")).when(status == "filled", curve).alias("value"),
        status.alias("status"),
    )
