"""References to records that do not exist (problem 2)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.operators.skew import salted_join


@dataclass(frozen=True)
class Child:
    """A table with references: its name, rows, row id, foreign key and the time that gives the period."""

    name: str
    df: DataFrame
    row_id: str
    key: str
    time: str


def parent_keys(parents: list[tuple[DataFrame, str]]) -> DataFrame:
    """The distinct non-null keys of all parent tables, as ``_key``."""
    keys = [df.select(F.col(c).alias("_key")).where(F.col("_key").isNotNull()) for df, c in parents]
    return reduce(DataFrame.union, keys).distinct()


def orphan_keys(children: list[Child], parents: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct (child_table, _key) without a parent.

    The foreign keys are made distinct before the shuffle, so a key that a third of the rows share is one row in the
    anti-join. Null keys are no references. Tables without rows give no orphans; without parents all keys are orphans.
    """
    refs = [c.df.select(F.lit(c.name).alias("child_table"), F.col(c.key).alias("_key")).where(F.col("_key").isNotNull()) for c in children]
    return reduce(DataFrame.union, refs).distinct().join(parent_keys(parents), "_key", "left_anti")


def _references(children: list[Child]) -> DataFrame:
    rows = [
        c.df.select(
            F.lit(c.name).alias("child_table"),
            F.col(c.row_id).alias("child_id"),
            F.col(c.key).alias("_key"),
            F.date_format(F.col(c.time), "yyyy-MM").alias("period"),
        ).where(F.col("_key").isNotNull())
        for c in children
    ]
    return reduce(DataFrame.union, rows)


def orphan_rows(children: list[Child], parents: list[tuple[DataFrame, str]]) -> DataFrame:
    """The referring rows themselves: (child_table, child_id, _key), without repeated rows.

    Repeated rows count once; rows that differ only in other columns are the same reference. Rows are spread by their
    id where one orphan key holds many of them.
    """
    rows = _references(children).select("child_table", "child_id", "_key").distinct()
    return salted_join(rows, orphan_keys(children, parents), ["child_table", "_key"], "left_semi", spread=["child_id"])


def orphan_report(children: list[Child], parents: list[tuple[DataFrame, str]]) -> DataFrame:
    """Per table and period (month; null where the time is missing): references, orphans, and distinct orphan keys.

    Counts are taken by (table, key, period) before the join, so a hot key is a few rows by then. Every row of the
    child counts, repeated or not.
    """
    counted = _references(children).groupBy("child_table", "_key", "period").agg(F.count(F.lit(1)).alias("n"))
    marked = counted.join(orphan_keys(children, parents).withColumn("_orphan", F.lit(True)), ["child_table", "_key"], "left")
    return marked.groupBy("child_table", "period").agg(
        F.sum("n").alias("n_references"),
        F.sum(F.when(F.col("_orphan"), F.col("n")).otherwise(0)).alias("n_orphans"),
        F.count(F.when(F.col("_orphan"), F.lit(1))).alias("n_orphan_keys"),
    )


def late_report(children: list[Child], parents: list[tuple[DataFrame, str]], late: list[tuple[DataFrame, str]]) -> DataFrame:
    """Per table and period: references whose parent only came with ``late``, and how many parents those are: (child_table, period, n_late, n_late_keys).

    Counted by (table, key, period) before the join, as in ``orphan_report``.
    """
    arrived = reduce(DataFrame.union, [df.select(F.col(key).alias("_key")) for df, key in late]).where("_key is not null").distinct()
    keys = orphan_keys(children, parents).join(arrived, "_key", "left_semi")
    counted = _references(children).groupBy("child_table", "_key", "period").agg(F.count(F.lit(1)).alias("n"))
    found = counted.join(keys, ["child_table", "_key"], "left_semi")
    return found.groupBy("child_table", "period").agg(F.sum("n").alias("n_late"), F.count(F.lit(1)).alias("n_late_keys"))
