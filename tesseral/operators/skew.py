"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds at least one row in this many; so there are never more heavy keys than this.
HEAVY_ONE_IN = 512
#: Pieces that a heavy key is split into.
SALTS = 64


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, combined before the shuffle; rows with a null in the key are left out."""
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def heavy_keys(df: DataFrame, keys: list[str], one_in: int = HEAVY_ONE_IN, counts: DataFrame | None = None) -> DataFrame:
    """The keys with at least 1/``one_in`` of the rows that have a key: at most ``one_in`` rows, so safe to broadcast.

    ``counts`` (the keys and _n), where the caller has them already, spares the pass over ``df``.
    """
    counts = key_counts(df, keys) if counts is None else counts
    total = counts.agg(F.sum("_n").alias("_total"))
    # the total is a single row
    return counts.join(F.broadcast(total), F.col("_n") * one_in >= F.col("_total")).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread: list[str | Column] | None = None, salts: int = SALTS, one_in: int = HEAVY_ONE_IN, counts: DataFrame | None = None) -> DataFrame:
    """Equi-join where ``left`` may be skewed and ``right`` has few rows for a key.

    Rows of heavy keys (found by a count that is combined before its shuffle) get one of ``salts`` salts from a hash of
    the ``spread`` columns, and the matching rows of ``right`` are repeated for each salt; all other rows have salt 0.
    ``how`` is one of inner, left, left_semi, left_anti. Null keys match nothing. The salt is a hash, not a random
    number, so a task that runs again places its rows as before. ``counts`` as in ``heavy_keys``. Columns of ``right`` other than the keys must not
    occur in ``left``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join can't do {how}")
    heavy = F.broadcast(heavy_keys(left, keys, one_in, counts).withColumn("_heavy", F.lit(True)))
    piece = F.pmod(F.xxhash64(*(spread or [c for c in left.columns])), F.lit(salts)).cast("int")
    a = left.join(heavy, keys, "left").withColumn("_salt", F.when(F.col("_heavy"), piece).otherwise(0)).drop("_heavy")
    every = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(heavy, keys, "left").withColumn("_salt", F.explode(every)).drop("_heavy")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
