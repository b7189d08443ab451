"""Parent-child links to full hierarchies through hash splitters (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.session import cut_lineage

#: One node in this many is a splitter.
SPLITTER_ONE_IN = 32


def is_splitter(node: Column, one_in: int) -> Column:
    """Chosen by a hash of the id alone, so every task and every run agrees."""
    return F.pmod(F.xxhash64(node), F.lit(one_in)) == 0


def _links(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(id, up): one row per node, up its parent, null where that is missing or no node itself."""
    nodes = df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(parent).alias("up"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    return nodes.join(known, "up", "left").select("id", F.when(F.col("_known"), F.col("up")).alias("up"))


def _ahead(state: DataFrame) -> DataFrame:
    return state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("path").alias("_path"), F.col("done").alias("_done"))


def _whole(path: str, then: str) -> Column:
    """One way after another; a node met again is not named again."""
    return F.array_distinct(F.concat(path, then))


def _end(path: str, then: str) -> Column:
    """Of one way after another only the last node, for walks that ask for nothing else."""
    return F.when(F.size(then) > 0, F.col(then)).otherwise(F.col(path))


def _double(moving: DataFrame, state: DataFrame, both=_whole) -> DataFrame:
    """Append to each walk the walk of the node it has come to."""
    path = both("path", "_path")
    return moving.join(_ahead(state), "to").select("id", F.col("_to").alias("to"), path.alias("path"), F.col("_done").alias("done"), F.size("path").alias("_n"))


def _walk(state: DataFrame, both=_whole) -> tuple[DataFrame, DataFrame]:
    """Double the walks in ``state`` (id, to, path, done) until all are done or none gets further: (done, rest).

    path lists the nodes after id up to ``to``, each once. A walk that is done has reached its end. Finished walks are
    written once and only looked up afterwards. If a round finishes no walk, all that are left run into a loop: were
    there another, the ones nearest to their end would have finished.
    """
    done, moving = state.where("done"), state.where("not done")
    left = moving.count()
    while left:
        moved = cut_lineage(_double(moving, done.unionByName(moving), both).drop("_n"))
        done, moving, before = done.unionByName(moved.where("done")), moved.where("not done"), left
        left = moving.count()
        if left == before:
            break
    return done, moving


def _loops(rest: DataFrame) -> DataFrame:
    """Walks that never end, as (id, path): doubled until each has met all of its loop, so path names every node it meets, once."""
    while True:
        rest = cut_lineage(_double(rest, rest))
        if not rest.where(F.size("path") > F.col("_n")).limit(1).count():
            return rest.select("id", "path")
        rest = rest.drop("_n")


def _rooted(loops: DataFrame) -> DataFrame:
    """(id, root_id, path): path up to the root of each walk that never ends; the root is the loop's smallest node.

    A node is on a loop when its own path meets it again; the last node that a walk meets anew is on the loop.
    """
    whole = loops.where(F.array_contains("path", F.col("id"))).groupBy(F.array_min("path").alias("root_id")).agg(F.min_by("path", "id").alias("_nodes"))
    on_loop = whole.select("root_id", F.explode("_nodes").alias("_last"))
    walks = loops.withColumn("_last", F.element_at("path", -1)).join(on_loop, "_last")
    return walks.select("id", "root_id", _until_root("path").alias("path"))


def _until_root(path: str) -> Column:
    """The part of a path up to root_id; nothing when the node is the root itself."""
    at = F.array_position(path, F.col("root_id")).cast("int")
    return F.slice(path, F.lit(1), F.when(F.col("id") == F.col("root_id"), 0).otherwise(at))


def resolve(df: DataFrame, node: str, parent: str, one_in: int = SPLITTER_ONE_IN) -> DataFrame:
    """(id, root_id, up_path): every node's way to its root, [id, parent, ..., root_id].

    Repeated rows count once; of several parents the smallest holds; rows without id say nothing; a parent that is no
    node is not reached, so its child is a root. Where links go round, the root is the smallest id on the loop, for
    those on it and those leading into it, and the path ends there. A self-link is a loop of one. An empty table gives
    no rows; extra columns are dropped.

    1. Every node walks to its next splitter or root, by doubling: about log2 of the longest stretch without one.
    2. The splitters alone form a pointer graph of 1/``one_in`` the size, solved the same way.
    3. A node's path is its walk and its splitter's path. Walks into loops without a splitter are solved apart.
    A hot parent is a hot key on the left of a join whose right side has one row for it; adaptive execution splits it.
    """
    links = _links(df, node, parent)
    end, nothing = F.col("up").isNull(), F.slice(F.array("id"), 1, 0)
    first = links.select(
        "id", F.coalesce("up", "id").alias("to"), F.when(end, nothing).otherwise(F.array("up")).alias("path"), (end | is_splitter(F.coalesce("up", "id"), one_in)).alias("done")
    )
    done, rest = _walk(cut_lineage(first))
    splitter = is_splitter(F.col("id"), one_in)

    lost = cut_lineage(_rooted(_loops(rest))) if rest.limit(1).count() else None
    ended = ~is_splitter(F.col("to"), one_in) | (F.size("path") == 0)
    reduced = done.where(splitter).select("id", "to", "path", ended.alias("done"))
    if lost is not None:
        reduced = reduced.unionByName(lost.where(splitter).select("id", F.col("root_id").alias("to"), "path", F.lit(True).alias("done")))
    solved, circling = _walk(cut_lineage(reduced))
    ways = solved.select("id", F.col("to").alias("root_id"), "path")
    if circling.limit(1).count():
        ways = ways.unionByName(_rooted(_loops(circling)))
    ways = cut_lineage(ways)

    far = ways.select(F.col("id").alias("to"), F.col("root_id").alias("_root"), F.col("path").alias("_path"))
    nodes = done.where(~splitter).join(far, "to", "left")
    nodes = nodes.select("id", F.coalesce("_root", "to").alias("root_id"), F.when(F.col("_root").isNull(), F.col("path")).otherwise(F.array_distinct(F.concat("path", "_path"))).alias("path"))
    out = nodes.select("id", "root_id", _until_root("path").alias("path")).unionByName(ways)
    if lost is not None:
        out = out.unionByName(lost.where(~splitter))
    return out.select("id", "root_id", F.concat(F.array("id"), "path").alias("up_path"))


def roots(df: DataFrame, node: str, parent: str, one_in: int = SPLITTER_ONE_IN) -> DataFrame:
    """(id, root_id): the roots that ``resolve`` gives, by walks that carry their last node alone.

    So a chain costs its nodes times the rounds, not times its length. Only for nodes that lead into loops, whose root
    depends on all nodes of the loop, are the ways themselves walked, apart from all others.
    """
    links = cut_lineage(_links(df, node, parent))
    end, nothing = F.col("up").isNull(), F.slice(F.array("id"), 1, 0)
    first = links.select(
        "id", F.coalesce("up", "id").alias("to"), F.when(end, nothing).otherwise(F.array("up")).alias("path"), (end | is_splitter(F.coalesce("up", "id"), one_in)).alias("done")
    )
    done, rest = _walk(cut_lineage(first), _end)
    splitter = is_splitter(F.col("id"), one_in)
    ended = ~is_splitter(F.col("to"), one_in) | (F.size("path") == 0)
    # a splitter that leads into a loop without one leads nowhere here
    reduced = done.where(splitter).select("id", "to", "path", ended.alias("done")).unionByName(rest.where(splitter).select("id", F.lit(None).cast(links.schema["id"].dataType).alias("to"), "path", F.lit(True).alias("done")))
    solved, circling = _walk(cut_lineage(reduced), _end)
    ways = cut_lineage(solved.select(F.col("id").alias("to"), F.col("to").alias("_root")).unionByName(circling.select(F.col("id").alias("to"), F.lit(None).cast(links.schema["id"].dataType).alias("_root"))))
    found = done.where(~splitter).join(ways.withColumn("_met", F.lit(True)), "to", "left").select("id", F.when(F.col("_met"), F.col("_root")).otherwise(F.col("to")).alias("root_id"))
    found = cut_lineage(found.unionByName(ways.select(F.col("to").alias("id"), F.col("_root").alias("root_id"))))
    ending = found.where("root_id is not null")
    endless = links.join(ending.select("id"), "id", "left_anti")
    if not endless.limit(1).count():
        return ending
    return ending.unionByName(resolve(endless, "id", "up", one_in).select("id", "root_id"))


def hierarchy(df: DataFrame, node: str, parent: str, one_in: int = SPLITTER_ONE_IN) -> DataFrame:
    """(id, root_id, depth, path, in_loop, n_descendants): path from root to node as a list; depth counts its links.

    in_loop tells whether the node is itself on a loop. n_descendants counts the nodes whose path goes through it.
    """
    found = cut_lineage(resolve(df, node, parent, one_in))
    links = _links(df, node, parent)
    # the root of a loop is the only root that has a parent among the nodes; its loop is its parent's path
    closing = found.join(links.where("up is not null").select("id"), "id", "left_semi").where("id = root_id").select("root_id")
    first = links.join(closing.select(F.col("root_id").alias("id")), "id", "left_semi").select(F.col("id").alias("_root"), F.col("up").alias("id"))
    on_loop = found.join(first, "id").select(F.explode("up_path").alias("id")).distinct().withColumn("_in", F.lit(True))
    n = found.select(F.explode(F.slice("up_path", F.lit(2), F.size("up_path"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_descendants"))
    return (
        found.join(on_loop, "id", "left")
        .join(n, "id", "left")
        .select(
            "id", "root_id", (F.size("up_path") - 1).alias("depth"), F.reverse("up_path").alias("path"), F.coalesce("_in", F.lit(False)).alias("in_loop"), F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants")
        )
    )


def descendants(df: DataFrame, node: str, parent: str, one_in: int = SPLITTER_ONE_IN) -> DataFrame:
    """(id, descendant_id, distance): every node under every node, made from the paths without a join."""
    found = resolve(df, node, parent, one_in)
    return found.select(F.col("id").alias("descendant_id"), F.posexplode("up_path").alias("distance", "id")).where("distance > 0").select("id", "descendant_id", "distance")
