"""History of changing attributes in insert-only satellites (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tidy(text: str | Column) -> Column:
    """Lower case, trimmed, each inner run of white space one blank; any white space Unicode knows."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"(?U)\s+", " "), "^ | $", "")


def hash_diff(attributes: list[str]) -> Column:
    """A digest of the attributes; null and the empty string differ, and so do values that only join alike."""
    parts = [F.coalesce(F.concat(F.length(F.col(a).cast("string")), F.lit(":"), F.col(a).cast("string")), F.lit("-")) for a in attributes]
    return F.md5(F.concat_ws("|", *parts))


def change_rates(statements: DataFrame, key: str, time: str, attributes: list[str]) -> DataFrame:
    """By attribute: how often a statement changes it against the one before of the same key, from 0 to 1.

    One row per attribute. Rows without key or time say nothing; an attribute never restated has a null rate.
    """
    w = W.partitionBy(key).orderBy(time, *attributes)
    seen = statements.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, *attributes).distinct()
    flags = seen.select(
        F.row_number().over(w).alias("_n"),
        *[(~F.col(a).eqNullSafe(F.lag(a).over(w))).cast("int").alias(f"_c{i}") for i, a in enumerate(attributes)],
    ).where("_n > 1")
    sums = flags.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(attributes))])
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), (F.col(f"_c{i}") / F.when(F.col("_n") > 0, F.col("_n"))).alias("rate")) for i, a in enumerate(attributes)])
    return sums.select(F.inline(rows))


def split_by_rate(rates: DataFrame, bounds: tuple[float, ...] = (0.05, 0.5)) -> dict[str, list[str]]:
    """Groups of attributes of like change rate, one satellite each. Reads one row per attribute: the schema's size."""
    groups: dict[str, list[str]] = {}
    for row in rates.orderBy("attribute").toLocalIterator():
        rate = row["rate"] or 0.0
        groups.setdefault(f"rate_{sum(rate >= b for b in bounds)}", []).append(row["attribute"])
    return groups


def tracked(batch: DataFrame, key: str, time: str, attributes: list[str]) -> DataFrame:
    """The statements of a batch, each once, with their hash-diff: the rows of the tracking satellite.

    Rows with a null key or time say nothing; extra columns are dropped. A key keeps at most one row per time and value,
    and the ``distinct`` is combined before its shuffle, so later windows never see the copies of a hot key.
    """
    said = batch.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, *attributes).distinct()
    return said.withColumn("hash_diff", hash_diff(attributes))


def append(satellite: DataFrame | None, earlier: DataFrame | None, batch: DataFrame, key: str, time: str, attributes: list[str]) -> DataFrame:
    """The rows that ``batch`` adds to an insert-only satellite: (key, time, attributes, hash_diff).

    ``earlier`` is the tracking satellite so far, every statement ever loaded; ``batch`` comes from ``tracked``. A row is
    added where the hash-diff differs from that of the statement before it and the satellite lacks it. That may be a row
    of ``earlier`` that only restated its predecessor until a late row of the batch came between them. Stored rows are
    never changed; what a late row makes redundant is passed over by ``history``. Statements of one key and time are
    taken in the order of their attributes. Keys that the batch lacks are neither sorted nor shuffled again. ``satellite`` and ``earlier`` may be None.
    """
    if earlier is None:
        rows = batch
    else:
        # only keys that the batch speaks of can change
        rows = batch.unionByName(earlier.join(batch.select(key).distinct(), key, "left_semi").select(*batch.columns)).distinct()
    w = W.partitionBy(key).orderBy(time, *attributes)
    changed = rows.withColumn("_changed", ~F.lag("hash_diff").over(w).eqNullSafe(F.col("hash_diff"))).where("_changed").drop("_changed")
    return changed if satellite is None else changed.join(satellite, [key, time, "hash_diff"], "left_anti").select(*changed.columns)


def history(satellite: DataFrame, key: str, time: str, attributes: list[str], end: str = "valid_to") -> DataFrame:
    """The lead-based view: each version from ``time`` until the next one of the key begins (null while it lasts)."""
    w = W.partitionBy(key).orderBy(time, *attributes)
    versions = satellite.withColumn("_new", ~F.lag("hash_diff").over(w).eqNullSafe(F.col("hash_diff"))).where("_new")
    return versions.select(key, *attributes, time, F.lead(time).over(w).alias(end))


def load(batches: list[DataFrame], key: str, time: str, attributes: list[str], bounds: tuple[float, ...] = (0.05, 0.5)) -> dict[str, tuple[list[str], DataFrame]]:
    """Satellites by name, each with its attributes: attributes of like change rate, measured on the first batch, share one.

    The batches are appended in their order. With one attribute there is one satellite, whatever its rate.
    """
    groups = split_by_rate(change_rates(batches[0], key, time, attributes), bounds)
    out = {}
    for name, group in groups.items():
        stored, earlier = None, None
        for batch in batches:
            new = tracked(batch, key, time, group)
            more = append(stored, earlier, new, key, time, group)
            stored = more if stored is None else stored.unionByName(more)
            earlier = new if earlier is None else earlier.unionByName(new)
        out[name] = (group, stored)
    return out


def joined_history(satellites: dict[str, tuple[list[str], DataFrame]], key: str, time: str, end: str = "valid_to") -> DataFrame:
    """The lead-based view over all satellites: a version begins where any of them has a new row, the others keep their values.

    Of several rows of a satellite at one key and time the last in the order of its attributes holds.
    """
    if len(satellites) == 1:
        ((group, stored),) = satellites.values()
        return history(stored, key, time, group, end)
    parts = []
    for name, (group, stored) in satellites.items():
        rows = history(stored, key, time, group, end).groupBy(key, time).agg(F.max(F.struct(*group)).alias(f"_{name}"))
        parts.append(rows)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    once = every.groupBy(key, time).agg(*[F.max(f"_{n}").alias(f"_{n}") for n in satellites])
    w = W.partitionBy(key).orderBy(time)
    held = once.select(key, time, *[F.last(f"_{n}", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"_{n}") for n in satellites], F.lead(time).over(w).alias(end))
    return held.select(key, *[F.col(f"_{n}.{a}").alias(a) for n, (group, _) in satellites.items() for a in group], time, end)
