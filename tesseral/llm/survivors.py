"""One surviving record for each group of duplicates, built from consistent bundles (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.operators import skew

#: Letters of a status, best first; anything else or nothing comes last.
STATUS_ORDER = ("settled", "pending", "failed")
#: A time that stands for none.
DEFAULT_TIME = "1970-01-01 00:00:00"


def branch_and_bound(bundles: list[list[dict[str, Any]]]) -> tuple[list[dict[str, Any]], int]:
    """The consistent choice of one candidate per bundle with the highest trust, and the number of nodes looked at.

    A candidate has ``value``, ``trust`` (a tuple; bundles count in their order) and ``needs``: bundle index -> value
    that it determines there. Each bundle may also stay empty, with trust () below all others, but only where nothing
    is needed of it. Branches are tried best first; one is cut when even the best of every bundle still open could not
    beat the best whole choice so far.
    """
    empty = {"value": None, "trust": (), "needs": {}}
    order = [sorted(b, key=lambda c: c["trust"], reverse=True) + [empty] for b in bundles]
    bounds = [b[0]["trust"] for b in order]
    best: list[dict[str, Any]] | None = None
    looked = 0

    def score(chosen: list[dict[str, Any]]) -> list[tuple]:
        return [c["trust"] for c in chosen]

    def fits(chosen: list[dict[str, Any]], c: dict[str, Any]) -> bool:
        i = len(chosen)
        return all(i not in x["needs"] or x["needs"][i] == c["value"] for x in chosen) and all(k >= i or chosen[k]["value"] == v for k, v in c["needs"].items())

    def go(chosen: list[dict[str, Any]]) -> None:
        nonlocal best, looked
        looked += 1
        i = len(chosen)
        if best is not None and score(chosen) + bounds[i:] <= score(best):
            return
        if i == len(order):
            best = list(chosen)
            return
        for c in order[i]:
            if fits(chosen, c):
                go([*chosen, c])

    go([])
    return best or [empty] * len(order), looked


def status_letters(status: str = "status") -> Column:
    """Only the letters of a status, in lower case; null becomes the empty string."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(status), F.lit("")), r"\P{L}", ""))


def _status_rank() -> Column:
    rank = F.lit(0)
    for i, word in enumerate(STATUS_ORDER):
        rank = F.when(status_letters() == word, len(STATUS_ORDER) - i).otherwise(rank)
    return rank


_CHOICE = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("cents", T.LongType()), T.StructField("payment_id", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("time_us", T.LongType()), T.StructField("method", T.StringType()), T.StructField("n_rows", T.LongType()),
])


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The search for the charges whose best bundles contradict each other, over all candidates of each."""
    for pdf in batches:
        out = []
        for g in pdf.itertuples(index=False):
            head, needs, times, methods = g.head, {}, [], []
            if head["own_time"] is not None:
                needs[1] = head["own_time"]
            if head["own_method"] is not None:
                needs[2] = head["own_method"]
            for c in g.candidates:
                own, name = int(c["own"]), c["method"]
                for t in (c["t"], c["same"]):
                    if t is not None:
                        times.append({"value": t["time"], "trust": (own, t["rank"], t["time"]), "needs": {2: name} if name is not None else {}})
                if name is not None:
                    raw = c["m"]["raw_time"]
                    methods.append({"value": name, "trust": (own, c["m"]["rank"], () if raw is None else (raw,), name), "needs": {}})
            chosen, _ = branch_and_bound([[{"value": head["payment_id"], "trust": (1,), "needs": needs}], times, methods])
            out.append((g.order_id, g.cents, head["payment_id"], head["status"], chosen[1]["value"], chosen[2]["value"], head["n_rows"]))
        frame = pd.DataFrame(out, columns=_CHOICE.names, dtype=object)
        for c in ("order_id", "cents", "payment_id", "time_us", "n_rows"):
            frame[c] = frame[c].astype("Int64")
        yield frame


def charges(payments: DataFrame) -> DataFrame:
    """(order_id, cents, payment_id, status, paid_ts, method, n_rows): one record per charge.

    Rows with the same order_id and amount in cents are one charge; those where either is null belong nowhere and are
    left out. A record is put together from whole bundles: the charge (payment_id with its status) comes from the best
    row: by status, then later paid_ts, fewer nulls among paid_ts, method and status, larger payment_id; nulls last. The
    time and the method come from other rows only where the chosen payment has none. Dependencies: payment_id
    determines paid_ts and method; payment_id and paid_ts together determine method. A missing or default time is no
    time. status is given by its letters.

    Each bundle's best candidate, and the best among the rows of each payment_id, are maxima of structs, combined
    before each shuffle, so a charge that holds a third of all rows is a few rows when it is put together. As bundles
    count in order, the best charge row bounds all others away. Where the unconstrained maxima agree they are the
    solution; the others go through branch and bound. For these the rows are read again, as a maximum that is infeasible
    hides the next best: a charge has the best time and the best method by method, null among them, apart for the chosen
    payment and for all others, and those of its rows that have the chosen payment's own time.
    Repeated rows change nothing but n_rows. An empty table gives no rows; extra columns are dropped.
    """
    time = F.when(F.col("paid_ts") != F.lit(DEFAULT_TIME).cast("timestamp_ntz"), F.unix_micros(F.col("paid_ts").cast("timestamp")))
    rows = payments.select(
        F.col("order_id").cast("long").alias("order_id"),
        F.round(F.round("amount", 2) * 100).cast("long").alias("cents"),
        F.col("payment_id").cast("long").alias("payment_id"),
        F.unix_micros(F.col("paid_ts").cast("timestamp")).alias("raw_time"),
        time.alias("time"),
        F.col("method"),
        F.col("status"),
        _status_rank().alias("rank"),
    ).where("order_id is not null and cents is not null")
    full = -(F.col("raw_time").isNull().cast("int") + F.col("method").isNull().cast("int") + F.col("status").isNull().cast("int"))
    trust = F.struct(F.col("rank"), F.col("raw_time"), full.alias("full"), F.col("payment_id"), status_letters().alias("letters"))
    by_id = rows.groupBy("order_id", "cents", "payment_id").agg(
        F.max(trust).alias("charge"),
        F.max(F.when(F.col("time").isNotNull(), F.struct("rank", "time", "method"))).alias("t"),
        F.max(F.when(F.col("method").isNotNull(), F.struct("rank", "raw_time", "method"))).alias("m"),
        F.count(F.lit(1)).alias("n"),
    )
    best = by_id.groupBy("order_id", "cents").agg(
        F.max(F.struct("charge", "t", "m")).alias("c"), F.max("t").alias("bt"), F.max("m").alias("bm"), F.sum("n").alias("n_rows")
    )
    time, method = F.coalesce("c.t", "bt"), F.coalesce("c.m.method", "bm.method")
    flat = best.select(
        "order_id", "cents", F.col("c.charge.payment_id").alias("payment_id"), F.col("c.charge.letters").alias("status"),
        time["time"].alias("time_us"), time["method"].alias("time_method"), method.alias("method"),
        F.col("c.t.time").alias("own_time"), F.col("c.m.method").alias("own_method"), "n_rows",
    )
    easy = F.col("time_method").isNull() | (F.col("time_method") == F.col("method"))
    root = flat.where(easy).select(*_CHOICE.names)
    head = F.struct("payment_id", "status", "own_time", "own_method", "n_rows").alias("head")
    counts = flat.select("order_id", "cents", F.col("n_rows").alias("_n"))
    again = skew.salted_join(rows.where("time is not null or method is not null"), flat.where(~easy).select("order_id", "cents", head), ["order_id", "cents"], counts=counts)
    candidates = again.groupBy("order_id", "cents", F.col("payment_id").eqNullSafe(F.col("head.payment_id")).alias("own"), "method").agg(
        F.max(F.when(F.col("time").isNotNull(), F.struct("rank", "time"))).alias("t"),
        F.max(F.when(F.col("time") == F.col("head.own_time"), F.struct("rank", "time"))).alias("same"),
        F.max(F.struct("rank", "raw_time")).alias("m"),
        F.first("head").alias("head"),
    )
    hard = candidates.groupBy("order_id", "cents").agg(F.first("head").alias("head"), F.collect_list(F.struct("own", "method", "t", "same", "m")).alias("candidates"))
    found = root.unionByName(hard.mapInPandas(_search, _CHOICE))
    return found.select("order_id", "cents", "payment_id", "status", F.timestamp_micros("time_us").alias("paid_ts"), "method", "n_rows")
