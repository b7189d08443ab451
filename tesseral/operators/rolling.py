"""Totals over trailing periods by block decomposition (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _scan(entries: str, backwards: bool) -> Column:
    """Running sums of a block's entries (off, v), as (off, s) in the order of off: heads of the block, or ``backwards`` its tails."""
    way = F.reverse(entries) if backwards else F.col(entries)
    none = F.array().cast("array<struct<off:int,s:bigint>>")
    zero = F.lit(0).cast("long")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["off"].alias("off"), (x["v"] + F.coalesce(F.try_element_at(acc, F.lit(-1))["s"], zero)).alias("s"))))
    sums = F.aggregate(way, none, step)
    return F.reverse(sums) if backwards else sums


def trailing_totals(daily: DataFrame, n: int) -> DataFrame:
    """(entity, d, v, t, t_out): for each row of ``daily`` the trailing ``n``-day total t of its day, and t_out that of day d + n, when it has left the window.

    ``daily`` holds (entity, d, v): at most one row per entity and day, d the day's number, v a long that isn't negative.
    Days are cut into blocks of ``n``. A window is the tail of one block (a suffix sum) and the head of the next (a prefix
    sum), each from one scan of the block's entries, so nothing is subtracted and an empty window is exactly 0. Totals
    rise only on days with a row and fall only n days after one, so these days tell all that ``peak_days`` and
    ``falls_to_zero`` look for, and days without rows are never made. One row per block is shuffled by entity.
    """
    size = F.lit(n)
    blocks = daily.groupBy("entity", F.floor(F.col("d") / n).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.pmod(F.col("d"), size).cast("int").alias("off"), F.col("v").cast("long").alias("v")))).alias("_e")
    )
    w = W.partitionBy("entity").orderBy("block")
    rows = blocks.select("entity", "block", "_e", _scan("_e", False).alias("_head"), _scan("_e", True).alias("_tail")).select(
        "*",
        F.when(F.lag("block").over(w) == F.col("block") - 1, F.lag("_tail").over(w)).alias("_before"),
        F.when(F.lead("block").over(w) == F.col("block") + 1, F.lead("_head").over(w)).alias("_after"),
    )
    zero = F.lit(0).cast("long")

    def day(x: Column, i: Column) -> Column:
        # the window of its own day: the tail of the block before, after the same place, and the head of its block up to it
        t = F.get("_head", i)["s"] + F.coalesce(F.get(F.filter("_before", lambda y: y["off"] > x["off"]), F.lit(0))["s"], zero)
        # the window n days on: the tail of its block after it, and the head of the next one up to the same place
        out = F.coalesce(F.get("_tail", i + 1)["s"], zero) + F.coalesce(F.try_element_at(F.filter("_after", lambda y: y["off"] <= x["off"]), F.lit(-1))["s"], zero)
        return F.struct((F.col("block") * size + x["off"]).cast("int").alias("d"), x["v"].alias("v"), t.alias("t"), out.alias("t_out"))

    return rows.select("entity", F.inline(F.transform("_e", day)))


def peak_days(totals: DataFrame, last_day: Column) -> DataFrame:
    """(entity, d): the earliest day through ``last_day`` on which the trailing total is highest, where that is above 0; from ``trailing_totals``."""
    best = totals.where((F.col("t") > 0) & (F.col("d") <= last_day)).groupBy("entity").agg(F.max(F.struct("t", (-F.col("d")).alias("nd"))).alias("m"))
    return best.select("entity", (-F.col("m.nd")).cast("int").alias("d"))


def falls_to_zero(totals: DataFrame, n: int, last_day: Column) -> DataFrame:
    """(entity, d): the days through ``last_day`` with a total of 0 after one above 0 the day before; from ``trailing_totals``.

    Such a day is n days after a day of some worth that no other follows within the window.
    """
    gone = totals.where((F.col("v") > 0) & (F.col("t_out") == 0)).select("entity", (F.col("d") + n).alias("d"))
    return gone.where(F.col("d") <= last_day)


def daily_spending(orders: DataFrame, items: DataFrame) -> DataFrame:
    """(entity, d, v): each customer's spending by day in hundredths, from orders (once each) and lines (once each).

    Orders without id, customer or time count nothing; lines without price or quantity are worth nothing. A day with an
    order but no worth stays, with 0. Repeated rows and hot orders or customers are combined before each shuffle.
    """
    once = (
        orders.where("order_id is not null and customer_id is not null and order_ts is not null")
        .groupBy("order_id")
        .agg(F.min(F.struct(F.col("customer_id").alias("entity"), F.unix_date(F.to_date("order_ts")).alias("d"))).alias("o"))
        .select("order_id", "o.entity", "o.d")
    )
    worth = F.coalesce((F.round(F.col("unit_price") * 100).cast("long") * F.col("quantity")), F.lit(0).cast("long"))
    lines = items.where("order_id is not null").groupBy("order_id", "line_no").agg(F.max(worth).alias("v")).groupBy("order_id").agg(F.sum("v").alias("v"))
    return once.join(lines, "order_id", "left").groupBy("entity", "d").agg(F.sum(F.coalesce("v", F.lit(0).cast("long"))).alias("v"))


def rolling_totals(daily: DataFrame, last_day: Column, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, d, total_N, average_N ...): a row for each day from an entity's first day to ``last_day``, days without rows included.

    The average is over all N days of the window. An empty table gives no rows; rows after ``last_day`` are left out.
    Here the days themselves are the result, so the blocks are windows over them rather than arrays: the prefix and the
    suffix sum of each block of N days, the latter taken from N - 1 days back. All is partitioned by entity, which holds
    no more rows than the calendar has days; only the rows of ``daily`` are shuffled.
    """
    by_day = W.partitionBy("entity").orderBy("d")
    upto = F.coalesce(F.lead("d").over(by_day) - 1, last_day)
    days = daily.where(F.col("d") <= last_day).select("entity", F.col("d").alias("_d"), "v", upto.alias("_upto")).select("entity", "_d", "v", F.explode(F.sequence("_d", "_upto")).alias("d"))
    zero = F.lit(0).cast("long")
    rows = days.select("entity", "d", F.when(F.col("d") == F.col("_d"), F.col("v")).otherwise(zero).alias("v"))
    for n in windows:
        block = W.partitionBy("entity", f"_b{n}").orderBy("d")
        rows = rows.withColumn(f"_b{n}", F.floor(F.col("d") / n)).select(
            "*",
            F.sum("v").over(block.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(f"_p{n}"),
            F.sum("v").over(block.rowsBetween(W.currentRow, W.unboundedFollowing)).alias(f"_s{n}"),
        )
    so_far = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    # while the window reaches back beyond the first day, the block of the first day gives all it has
    first = lambda n: F.when(F.col(f"_b{n}") > F.first(f"_b{n}").over(so_far), F.first(f"_s{n}").over(so_far))
    whole = rows.select("*", *[F.coalesce(F.lag(f"_s{n}", n - 1).over(by_day), first(n)).alias(f"_o{n}") for n in windows])
    totals = []
    for n in windows:
        # on a block's last day the prefix is the whole window
        total = F.col(f"_p{n}") + F.when(F.pmod(F.col("d"), F.lit(n)) == n - 1, zero).otherwise(F.coalesce(f"_o{n}", zero))
        totals += [total.alias(f"total_{n}"), (total / n).alias(f"average_{n}")]
    return whole.select("entity", "d", *totals)
