"""Comparing results: as multisets, in order, and after running a change twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.session import cut_lineage

SAMPLES = 3


@dataclass
class Difference:
    equal: bool
    reason: str = ""
    missing: list = field(default_factory=list)
    extra: list = field(default_factory=list)


def _normal(f: T.StructField, col: Column, places: int) -> Column:
    if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.round(col.cast("double"), places)
    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("double")
    if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)):
        return F.to_json(col)
    return col.cast("string")


def normalised(df: DataFrame, places: int = 4) -> DataFrame:
    """Columns by position, numbers rounded, nested values and times as text, so that types that show alike are alike."""
    return df.select(*[_normal(f, F.col(f"`{f.name}`"), places).alias(f"c{i}") for i, f in enumerate(df.schema)])


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with _n, their place when read: by partition and place in it, so that no task sees them all."""
    once = cut_lineage(df.withColumn("_p", F.monotonically_increasing_id()))
    part, place = F.shiftright("_p", 33), F.col("_p").bitwiseAND(2**33 - 1)
    # one row for each partition
    sizes = once.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return once.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_n", F.col("_start") + place).drop("_p", "_part", "_start")


def compare(actual: DataFrame, expected: DataFrame, ordered: bool = False, places: int = 4) -> Difference:
    """Whether two results hold the same rows as often, and in the same order if ``ordered``; with a few samples of each side.

    Column names don't matter, their number does. Rows are counted before the shuffle, so many equal rows are one row
    of the join. Order is compared by the positions that the results have when read.
    """
    if len(actual.columns) != len(expected.columns):
        return Difference(False, f"{len(actual.columns)} columns instead of {len(expected.columns)}")
    a, b = normalised(actual, places), normalised(expected, places)
    keys = a.columns
    both = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a")).alias("a").join(
        b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b")).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full"
    )
    diff = both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b")).where("_a <> _b").persist()
    try:
        extra = [tuple(r)[:-2] for r in diff.where("_a > _b").orderBy(*keys).limit(SAMPLES).toLocalIterator()]
        missing = [tuple(r)[:-2] for r in diff.where("_b > _a").orderBy(*keys).limit(SAMPLES).toLocalIterator()]
        if extra or missing:
            twice = diff.where("_a > _b and _b > 0").limit(1).count()
            return Difference(False, "rows repeated too often" if twice else "rows differ", missing, extra)
    finally:
        diff.unpersist()
    if ordered:
        x, y = _numbered(a).alias("x"), _numbered(b).alias("y")
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        if x.join(y, "_n").where(~cond).limit(1).count():
            return Difference(False, "rows are in another order")
    return Difference(True)


def idempotent(run: Callable[[], None], state: Callable[[], DataFrame]) -> Difference:
    """Whether running a change a second time leaves the state as the first run did."""
    run()
    once = cut_lineage(state())
    run()
    return compare(state(), once)
