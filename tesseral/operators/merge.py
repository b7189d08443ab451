"""MERGE, UPDATE and DELETE as joins and projections; only the files that hold touched rows are written anew."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.plans.errors import DialectError
from tesseral.sources.versioned import Store


@dataclass(frozen=True)
class When:
    """A clause: kind is matched, by_source or insert; action is update, delete or insert; values maps columns to SQL ('*' for all)."""

    kind: str
    action: str
    condition: str | None = None
    values: dict[str, str] | str | None = None


def _quoted(name: str) -> str:
    return f"`{name}`"


@contextmanager
def views(**frames: DataFrame):
    """Temporary views under names that no other thread uses; they may go once a query over them is analysed."""
    names = {k: f"_{k}_{uuid.uuid4().hex}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(names[k])
    try:
        yield names
    finally:
        for k, df in frames.items():
            df.sparkSession.catalog.dropTempView(names[k])


def merge(spark: SparkSession, target: DataFrame, source: DataFrame, on: str, clauses: list[When], t: str = "t", s: str = "s") -> tuple[DataFrame, list[str]]:
    """(rows, columns): every target or source row with _action, one of u, d, i, k (keep) or n (nothing).

    ``target`` has a column _tid that tells its rows apart; the result's columns are the target's others plus _action.
    The first clause of a kind whose condition is true holds. No target row may match several source rows where there is
    a MATCHED clause (``merge_into`` sees to that). A source row that matched something is never inserted. ON and
    conditions that are NULL don't hold. The join is a full outer one, so equal keys in ON make it a shuffled join;
    without MATCHED and BY SOURCE clauses it is an anti-join and the rows are the new ones alone.
    """
    columns = [c for c in target.columns if c != "_tid"]
    have = {c.lower() for c in source.columns}
    by_kind: dict[str, list[When]] = {k: [c for c in clauses if c.kind == k] for k in ("matched", "by_source", "insert")}

    def values(c: When) -> dict[str, str]:
        if c.values == "*":
            missing = [x for x in columns if x.lower() not in have]
            if missing:
                raise DialectError("UNRESOLVED_COLUMN.WITH_SUGGESTION", f"the source lacks {missing[0]}")
            return {x.lower(): f"{s}.{_quoted(x)}" for x in columns}
        out = {k.lower(): v for k, v in (c.values or {}).items()}
        unknown = set(out) - {x.lower() for x in columns}
        if unknown:
            raise DialectError("UNRESOLVED_COLUMN.WITH_SUGGESTION", sorted(unknown)[0])
        return out

    def pick(kind: str, letter: dict[str, str], otherwise: str) -> tuple[str, dict[str, list[tuple[str, str]]]]:
        """The CASE that gives the action, numbered by clause, and each column's new values."""
        arms, new = [], {}
        for k, c in enumerate(by_kind[kind]):
            tag = f"{letter[c.action]}{kind[0]}{k}"
            arms.append(f"WHEN {c.condition or 'true'} THEN '{tag}'")
            if c.action != "delete":
                for col, v in values(c).items():
                    new.setdefault(col, []).append((tag, v))
        return f"CASE {' '.join(arms)} ELSE '{otherwise}' END" if arms else f"'{otherwise}'", new

    m, new_m = pick("matched", {"update": "u", "delete": "d"}, "k")
    b, new_b = pick("by_source", {"update": "u", "delete": "d"}, "k")
    i, new_i = pick("insert", {"insert": "i"}, "n")

    def column(f: T.StructField, own: str, *new: dict[str, list[tuple[str, str]]]) -> str:
        arms = [f"WHEN _action = '{tag}' THEN CAST({v} AS {f.dataType.simpleString()})" for n in new for tag, v in n.get(f.name.lower(), [])]
        return (f"CASE {' '.join(arms)} ELSE {own} END" if arms else own) + f" AS {_quoted(f.name)}"

    fields = [f for f in target.schema if f.name != "_tid"]
    with views(target=target, source=source) as v:
        right = f"(SELECT *, true AS _src FROM {v['source']}) AS {s}"
        if by_kind["matched"] or by_kind["by_source"]:
            cases = [column(f, f"{t}.{_quoted(f.name)}", new_m, new_b, new_i) for f in fields]
            action = f"CASE WHEN {t}._tid IS NOT NULL AND {s}._src THEN {m} WHEN {t}._tid IS NOT NULL THEN {b} ELSE {i} END"
            rows = spark.sql(f"SELECT {action} AS _action, {t}._tid AS _tid, {', '.join(cases)} FROM {v['target']} AS {t} FULL OUTER JOIN {right} ON {on}")
            if not by_kind["matched"]:
                # without a MATCHED clause a target row may match often: it is kept once
                rows = rows.where("_tid IS NULL").unionByName(rows.where("_tid IS NOT NULL").dropDuplicates(["_tid"]))
            return rows.drop("_tid"), columns
        made = [column(f, f"CAST(NULL AS {f.dataType.simpleString()})", new_i) for f in fields]
        return spark.sql(f"SELECT {i} AS _action, {', '.join(made)} FROM {right} LEFT ANTI JOIN {v['target']} AS {t} ON {on}"), columns


def touched(hits: DataFrame) -> tuple[dict[str, int], int]:
    """(rows by file, most source rows of one row) of the rows named by _tid; as many rows come back as files are hit."""
    by_row = hits.groupBy("_tid").agg(F.count(F.lit(1)).alias("n"))
    files = by_row.groupBy(F.col("_tid.f").alias("f")).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"))
    found = list(files.toLocalIterator())
    return {r["f"]: r["rows"] for r in found}, max((r["most"] for r in found), default=0)


def merge_into(store: Store, name: str, source: DataFrame, on: str, clauses: list[When], t: str = "t", s: str = "s", evolve: bool = False) -> dict[str, int]:
    """Merge into a stored table; the numbers of updated, deleted and inserted rows.

    A first join finds the files with matching rows, and target rows that several source rows match, which is an error as
    soon as there is a MATCHED clause, whatever its condition. Then these files alone are joined in full and written
    anew; a BY SOURCE clause concerns all files. Where only INSERT clauses stand, rows are appended. With ``evolve``
    columns that only the source has are added to the table.
    """
    spark, base = store.spark, store.meta(name)
    schema = base.schema
    if evolve:
        have = {f.name.lower() for f in schema}
        schema = T.StructType([*schema, *[T.StructField(f.name, f.dataType, True) for f in source.schema if f.name.lower() not in have]])
    wide = lambda df: df.select(*[c for c in df.columns if c != "_tid"], *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema[len(base.schema) :]], "_tid")
    matched, by_source = (any(c.kind == k for c in clauses) for k in ("matched", "by_source"))
    files = None
    if matched:
        with views(target=store.read(name, base.version, row_ids=True), source=source) as v:
            hits = spark.sql(f"SELECT {t}._tid AS _tid FROM {v['target']} AS {t} JOIN {v['source']} AS {s} ON {on}")
        counts, most = touched(hits)
        if most > 1:
            raise DialectError("DELTA_MULTIPLE_SOURCE_ROW_MATCHING_TARGET_ROW_IN_MERGE", "several source rows match one target row")
        files = list(counts)
    rewrites = matched or by_source
    if by_source:
        files = store.files(base)
    target = store.read(name, base.version, row_ids=True, files=files if rewrites else None)
    rows, columns = merge(spark, wide(target), source, on, clauses, t, s)
    seen = Observation()
    act = F.substring("_action", 1, 1)
    rows = rows.observe(seen, *[F.count_if(act == x).alias(x) for x in "udi"])
    store.replace_files(name, base, files or [], rows.where(~act.isin("d", "n")).select(*columns), schema)
    n = seen.get
    return {"updated": n["u"], "deleted": n["d"], "inserted": n["i"]}


def change_where(store: Store, name: str, where: str, alias: str, sets: dict[str, str] | None) -> int:
    """UPDATE (``sets``: column in lower case -> SQL) or DELETE (None) the rows that ``where`` holds for; how many there were.

    Files without such rows are not read a second time and stay. With subqueries in the condition rows are told apart
    by their place in the files.
    """
    spark, base = store.spark, store.meta(name)
    columns = base.schema.names

    def hits(df: DataFrame) -> DataFrame:
        with views(rows=df) as v:
            return spark.sql(f"SELECT * FROM {v['rows']} AS `{alias}` WHERE {where}")

    counts, _ = touched(hits(store.read(name, base.version, row_ids=True)).select("_tid"))
    if not counts:
        return 0
    rows = store.read(name, base.version, row_ids=True, files=counts)
    hit = hits(rows)
    if re.search(r"\bselect\b", where, re.I):
        rest = rows.join(hit.select("_tid"), "_tid", "left_anti").select(*columns)
    else:
        with views(rows=rows) as v:
            rest = spark.sql(f"SELECT * FROM {v['rows']} AS `{alias}` WHERE NOT coalesce({where}, false)").select(*columns)
    if sets is not None:
        cols = [f"CAST({sets[f.name.lower()]} AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name.lower() in sets else f"`{alias}`.`{f.name}`" for f in base.schema]
        with views(hit=hit) as v:
            rest = rest.unionByName(spark.sql(f"SELECT {', '.join(cols)} FROM {v['hit']} AS `{alias}`"))
    store.replace_files(name, base, counts, rest)
    return sum(counts.values())
