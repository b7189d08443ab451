"""Filling containers of fixed capacity by sum-of-squares packing (problem 8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.session import cut_lineage

#: Documents of a shard, about. Shards are packed apart; each leaves a few containers that aren't full.
SHARD_DOCS = 50_000
#: Capacities at most; every document has a row for each, so their table is small by its purpose.
MAX_PACKS = 1_000

PLACED = T.StructType([
    T.StructField("pack_id", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("container", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.LongType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("at", T.LongType()),
])


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each size, all of them from 1 to ``capacity``, in their order.

    Level array: count[h] is the number of open containers filled to h. Each item goes where the sum of the squared
    counts of partly filled containers grows least; full ones don't count. Of equal places the fullest is taken.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_at: dict[int, list[int]] = {}
    placed = np.empty(len(sizes), dtype=np.int64)
    n = 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        low = count[: capacity - s + 1]
        # growth of the sum of squares: the level left loses 2c - 1, the level reached gains 2c + 1, full ones don't count
        gain = 2 * (count[s : capacity + 1] - low) + 2
        gain[-1] = 1 - 2 * low[-1]
        gain[low == 0] = never
        gain[0] = 2 * count[s] + 1 if s < capacity else 0
        h = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if h:
            count[h] -= 1
            c = open_at[h].pop()
        else:
            c, n = n, n + 1
        placed[k] = c
        if h + s < capacity:
            count[h + s] += 1
            open_at.setdefault(h + s, []).append(c)
    return placed


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
    pdf["container"] = pack_sizes(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
    pdf["at"] = pdf.groupby("container")["n_tokens"].cumsum() - pdf["n_tokens"]
    return pdf[PLACED.names]


def pack(sizes: DataFrame, capacities: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(pack_id, shard, container, doc_id, part, first_token, n_tokens, at): where each document lies.

    ``sizes`` holds (doc_id, n_tokens), ``capacities`` (pack_id, capacity_tokens) with a capacity of 1 or more; rows with
    nulls are left out. Only a document larger than the capacity is split, into full parts and a rest. A document without tokens
    has one row without container. A container's number is unique within its pack_id and shard; ``at`` is the offset in
    it. Shards are made by a hash of doc_id, so equal texts or customers don't gather. Extra columns are dropped.
    """
    # used three times: written once, two numbers a document
    sizes = cut_lineage(sizes)
    n = max(1, -(-sizes.count() // shard_docs))
    packs = F.broadcast(capacities.where("pack_id is not null and capacity_tokens > 0").select(F.col("pack_id").cast("long").alias("pack_id"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct())
    items = sizes.where("doc_id is not null and n_tokens is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("size"))
    if packs.limit(MAX_PACKS + 1).count() > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} capacities")
    # the rows grow by the number of capacities, which is checked
    parts = items.join(packs).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    last = F.floor((F.col("size") - 1) / F.col("capacity"))
    split = parts.where("size > 0").select(
        "pack_id", "capacity", "shard", "doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")
    )
    first = F.col("part") * F.col("capacity")
    split = split.select("pack_id", "capacity", "shard", "doc_id", "part", first.alias("first_token"), F.least(F.col("capacity"), F.col("size") - first).alias("n_tokens"))
    placed = split.groupBy("pack_id", "shard").applyInPandas(_pack, PLACED)
    nothing = F.lit(None).cast("long")
    none = parts.where("size = 0").select("pack_id", "shard", nothing.alias("container"), "doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"), nothing.alias("at"))
    return placed.unionByName(none)


def fill(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_id, capacity, n_containers, n_tokens, unused_share): how full the containers are."""
    packs = F.broadcast(capacities.select(F.col("pack_id").cast("long").alias("pack_id"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct())
    used = placed.where("container is not null").groupBy("pack_id", "shard", "container").agg(F.sum("n_tokens").alias("used"))
    sums = used.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"))
    return sums.join(packs, "pack_id").select(
        "pack_id", "capacity", "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share")
    )
