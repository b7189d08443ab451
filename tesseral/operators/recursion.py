"""Recursion that Spark's recursive CTEs can't express: deduplicating, or with aggregates and outer joins in the step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.plans.errors import DialectError
from tesseral.session import cut_lineage

#: The dialect's limit of steps.
MAX_STEPS = 1000
#: Rounds whose rows lie in files of their own; after so many they are written together.
COMPACT_EVERY = 16


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, max_steps: int = MAX_STEPS) -> DataFrame:
    """Semi-naive iteration: ``step`` sees the rows that the last round added; ends when a round adds none.

    With ``distinct`` rows seen before are dropped, nulls being equal, by an anti-join on the whole row, so cycles end.
    Each round's rows are written to the checkpoint folder once, and now and then all so far into one set of files, so the
    plan stays small. Past ``max_steps`` it raises; rows are never cut off.
    """
    columns = base.columns
    plain = [f"_k{i}" for i in range(len(columns))]
    rows = lambda df: df.toDF(*plain)
    parts = [cut_lineage(rows(base).distinct() if distinct else rows(base))]
    delta, old = parts[0], None

    def seen() -> DataFrame:
        every = [*([old] if old is not None else []), *parts]
        out = every[0]
        for p in every[1:]:
            out = out.unionByName(p)
        return out

    for _ in range(max_steps):
        if not delta.limit(1).count():
            return seen().toDF(*columns)
        new = rows(step(delta.toDF(*columns)))
        if distinct:
            # one hashed key for the shuffle, the columns themselves against clashes of the hash
            key = F.xxhash64(*plain)
            had = seen().select(key.alias("_h"), *[F.col(c).alias(f"_s{c}") for c in plain])
            same = F.col("_h") == F.col("_key")
            for c in plain:
                same = same & F.col(c).eqNullSafe(F.col(f"_s{c}"))
            new = new.distinct().withColumn("_key", key).join(had, same, "left_anti").drop("_key")
        delta = cut_lineage(new)
        parts.append(delta)
        if len(parts) >= COMPACT_EVERY:
            old, parts = cut_lineage(seen().coalesce(max(1, delta.sparkSession.sparkContext.defaultParallelism))), []
    if not delta.limit(1).count():
        return seen().toDF(*columns)
    raise DialectError("RECURSION_LEVEL_LIMIT_EXCEEDED", f"no end after {max_steps} steps")
