"""Paths through the graph: frontier loops over DataFrames, cut by reliable checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, small


#: Rounds after which the union of a search's frontiers, each cut off itself, is cut off as a whole.
ROUNDS = 8


def reachable(starts: DataFrame, edges: DataFrame, forward: bool = True) -> DataFrame:
    """(uid) of the nodes that can be reached from ``starts``, themselves included."""
    a, b = ("src_uid", "dst_uid") if forward else ("dst_uid", "src_uid")
    steps = small(cut(edges.select(F.col(a).alias("uid"), F.col(b).alias("_to")).distinct()))
    seen = frontier = cut(starts.select("uid").distinct())
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        frontier = cut(frontier.join(steps, "uid").select(F.col("_to").alias("uid")).distinct().join(seen, "uid", "left_anti"))
        seen = seen.unionByName(frontier)
        seen = cut(seen) if rounds % ROUNDS == 0 else seen
    return seen


def _expand(frontier: DataFrame, steps: DataFrame, backward: bool) -> DataFrame:
    """Every path one node longer; nodes already on the path are left out."""
    grown = frontier.join(steps, "_end").where(~F.array_contains("path", F.col("_to")))
    path = F.concat(F.array("_to"), F.col("path")) if backward else F.concat(F.col("path"), F.array("_to"))
    return grown.select("start", path.alias("path"), F.col("_to").alias("_end"))


def _enumerate(starts: DataFrame, edges: DataFrame, backward: bool, max_nodes: int | None, max_paths: int | None, stop: DataFrame | None) -> list[DataFrame]:
    a, b = ("dst_uid", "src_uid") if backward else ("src_uid", "dst_uid")
    steps = small(cut(edges.select(F.col(a).alias("_end"), F.col(b).alias("_to")).distinct()))
    frontier = starts.select(F.col("uid").alias("start"), F.array("uid").alias("path"), F.col("uid").alias("_end")).distinct()
    levels, total, size = [], 0, 1
    while max_nodes is None or size < max_nodes:
        frontier = cut(_expand(frontier, steps, backward))
        n = frontier.count()
        if not n:
            break
        total, size = total + n, size + 1
        if max_paths is not None and total > max_paths:
            raise ValueError(f"more than {max_paths} paths; set max_nodes or a higher max_paths")
        levels.append(frontier)
        if stop is not None:
            frontier = frontier.join(stop, F.col("_end") == F.col("uid"), "left_anti")
    return levels


def backward_paths(sinks: DataFrame, edges: DataFrame, heads: DataFrame | None = None, max_nodes: int | None = None, max_paths: int | None = None) -> DataFrame:
    """(sink, head, path) of all simple paths that end in a sink, callers first, of two nodes or more.

    Every beginning counts: a path's tails that have a caller are paths too. If ``heads`` is given only paths that
    begin in one are returned; then the edges are first reduced to what a head can reach, which loses no such path.
    """
    if heads is not None:
        live = reachable(heads, edges)
        edges = edges.join(live.withColumnRenamed("uid", "src_uid"), "src_uid", "left_semi")
    levels = _enumerate(sinks, edges, True, max_nodes, max_paths, None)
    empty = sinks.select(F.col("uid").alias("start"), F.array("uid").alias("path"), F.col("uid").alias("_end")).where("false")
    out = reduce(DataFrame.unionByName, levels, empty).select(F.col("start").alias("sink"), F.col("_end").alias("head"), "path")
    return out if heads is None else out.join(heads.select(F.col("uid").alias("head")).distinct(), "head", "left_semi").select("sink", "head", "path")


def forward_paths(starts: DataFrame, edges: DataFrame, sinks: DataFrame, max_nodes: int | None = 17, max_paths: int | None = None) -> DataFrame:
    """(head, sink, path) of simple paths from the starts to the first sink on the way, of up to ``max_nodes`` nodes.

    Edges are first reduced to those from which a sink can be reached.
    """
    live = reachable(sinks, edges, forward=False)
    edges = edges.join(live.withColumnRenamed("uid", "dst_uid"), "dst_uid", "left_semi")
    ends = sinks.select("uid").distinct()
    levels = _enumerate(starts, edges, False, max_nodes, max_paths, ends)
    empty = starts.select(F.col("uid").alias("start"), F.array("uid").alias("path"), F.col("uid").alias("_end")).where("false")
    out = reduce(DataFrame.unionByName, levels, empty).join(ends, F.col("_end") == F.col("uid"), "left_semi")
    return out.select(F.col("start").alias("head"), F.col("_end").alias("sink"), "path")


def edge_unique_paths(starts: DataFrame, edges: DataFrame, sinks: DataFrame, max_edges: int) -> DataFrame:
    """(head, sink, path) of paths of one to ``max_edges`` edges that use no edge twice; nodes may repeat."""
    steps = small(cut(edges.select(F.col("src_uid").alias("_end"), F.col("dst_uid").alias("_to")).distinct()))
    frontier = starts.select(F.col("uid").alias("start"), F.array("uid").alias("path"), F.array().cast("array<struct<a:string,b:string>>").alias("used"), F.col("uid").alias("_end")).distinct()
    ends, found = sinks.select(F.col("uid").alias("_end")).distinct(), []
    for _ in range(max_edges):
        step = F.struct(F.col("_end").alias("a"), F.col("_to").alias("b"))
        grown = frontier.join(steps, "_end").where(~F.array_contains("used", step))
        frontier = cut(grown.select("start", F.concat("path", F.array("_to")).alias("path"), F.concat("used", F.array(step)).alias("used"), F.col("_to").alias("_end")))
        found.append(frontier.join(ends, "_end", "left_semi"))
    return reduce(DataFrame.unionByName, found).select(F.col("start").alias("head"), F.col("_end").alias("sink"), "path")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, level): breadth-first from entries and from nodes that nothing calls; if there are none, from those with
    the fewest callers. Nodes that aren't reached get one more than the deepest level.
    """
    nodes = nodes.select("uid", "is_entry").distinct()
    called = edges.groupBy(F.col("dst_uid").alias("uid")).agg(F.count("*").alias("n"))
    degree = cut(nodes.join(called, "uid", "left").select("uid", "is_entry", F.coalesce("n", F.lit(0)).alias("n")))
    roots = degree.where("is_entry OR n = 0").select("uid")
    if roots.isEmpty():
        roots = degree.join(F.broadcast(degree.agg(F.min("n").alias("n"))), "n", "left_semi").select("uid")
    steps = small(cut(edges.select(F.col("src_uid").alias("uid"), "dst_uid").distinct()))
    seen = frontier = cut(roots.select("uid", F.lit(0).alias("level")))
    level = 0
    while not frontier.isEmpty():
        level += 1
        frontier = cut(frontier.join(steps, "uid").select(F.col("dst_uid").alias("uid")).distinct().join(seen, "uid", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
        seen = cut(seen) if level % ROUNDS == 0 else seen
    return nodes.select("uid").join(seen, "uid", "left").select("uid", F.coalesce("level", F.lit(level)).alias("level"))


def neighborhood(edges: DataFrame, centre: DataFrame, hops: int = 2) -> DataFrame:
    """(centre, uid, hop): nodes within ``hops`` steps, whatever the direction; hop is the fewest steps."""
    both = edges.select(F.col("src_uid").alias("uid"), F.col("dst_uid").alias("_to")).unionByName(edges.select(F.col("dst_uid").alias("uid"), F.col("src_uid").alias("_to"))).distinct()
    found = frontier = centre.select(F.col("uid").alias("centre"), "uid", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        frontier = frontier.join(both, "uid").select("centre", F.col("_to").alias("uid"), F.lit(hop).alias("hop")).distinct()
        found = found.unionByName(frontier)
    return found.groupBy("centre", "uid").agg(F.min("hop").alias("hop"))


def filter_by_property(nodes: DataFrame, edges: DataFrame, column: str, values: list, on: str = "node") -> DataFrame:
    """(uid) of the nodes whose property has one of the values, or of both ends of the edges whose property has."""
    if on == "node":
        return nodes.where(F.col(column).isin(values)).select("uid").distinct()
    return edges.where(F.col(column).isin(values)).select(F.explode(F.array("src_uid", "dst_uid")).alias("uid")).distinct()
