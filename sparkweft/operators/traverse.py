"""The frontier engine: one multi-source level loop that every traversal is a setting of.

Per level the frontier meets the edges, what was seen is dropped by an anti join, and the rest is written to the shared
folder: the plan stays flat and a lost executor costs one level. Only a level's emptiness reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import settled

#: Levels of a transitive closure, at most.
CLOSURE_DEPTH = 100
#: Levels of visited nodes that are kept apart before they are written as one.
KEPT_LEVELS = 16


def steps(edges: DataFrame, direction: str = "out", types: Iterable[str] = ()) -> DataFrame:
    """(src, dst) of the moves that a direction allows: out, in or both. Not made distinct: each level is."""
    types = list(types)
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    out, back = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction {direction!r}")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def levels(seeds: DataFrame, moves: DataFrame, max_depth: int, stop: Column | None = None, include_start: bool = True) -> Iterator[DataFrame]:
    """Level by level (origin, node, depth): each node once for each origin, at its least depth.

    seeds: (origin, node). Rows for which `stop` (over origin, node, depth) holds are emitted but not followed. Without
    include_start the origin itself comes only where a cycle leads back to it.
    """
    frontier = settled(seeds.select("origin", "node").distinct().withColumn("depth", F.lit(0)), "level")
    seen = [frontier] if include_start else []
    if include_start:
        yield frontier
    for depth in range(1, max_depth + 1):
        going = frontier if stop is None else frontier.where(~F.coalesce(stop, F.lit(False)))
        reached = going.join(moves, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        if seen:
            reached = reached.join(reduce(DataFrame.union, seen).select("origin", "node"), ["origin", "node"], "left_anti")
        frontier = settled(reached.withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            return
        seen.append(frontier)
        if len(seen) > KEPT_LEVELS:  # a long way must not mean a plan that grows with it
            seen = [settled(reduce(DataFrame.union, seen), "seen")]
        yield frontier


def reach(seeds: DataFrame, moves: DataFrame, max_depth: int, stop: Column | None = None, include_start: bool = True) -> DataFrame:
    """All levels as one DataFrame."""
    found = list(levels(seeds, moves, max_depth, stop, include_start))
    return reduce(DataFrame.union, found) if found else seeds.select("origin", "node", F.lit(0).alias("depth")).limit(0)


def _starts(g: Graph, starts: Iterable[str]) -> DataFrame:
    """One origin for all starts: the visited set is shared."""
    return g.spark.createDataFrame([(s,) for s in starts], "node string").select(F.lit("").alias("origin"), "node")


def bfs(g: Graph, starts: Iterable[str], max_depth: int, types: Iterable[str] = (), direction: str = "out") -> DataFrame:
    """(id, depth): the starts at depth 0 and everything within max_depth, each node once."""
    return reach(_starts(g, starts), steps(g.edges, direction, types), max_depth).select(F.col("node").alias("id"), "depth")


def dfs(g: Graph, starts: Iterable[str], max_depth: int, types: Iterable[str] = ()) -> DataFrame:
    """The set of nodes within max_depth: an order of visits means nothing on a distributed frame, so it is that of
    bfs, and no node is missed that is first met at the depth limit."""
    return bfs(g, starts, max_depth, types).select("id")


def reachability(g: Graph, start: str, max_depth: int, types: Iterable[str] = (), backward: bool = False) -> DataFrame:
    return bfs(g, [start], max_depth, types, "in" if backward else "out")


def is_reachable(g: Graph, start: str, goal: str, types: Iterable[str] = (), max_depth: int = 10) -> bool:
    """Whether goal lies within max_depth of start; ends at the level that meets it."""
    if start == goal:
        return True
    return any(not level.where(F.col("node") == goal).isEmpty() for level in levels(_starts(g, [start]), steps(g.edges, "out", types), max_depth))


def traverse(g: Graph, starts: list[str], max_depth: int = 5, direction: str = "out", types: Iterable[str] = (), cap: int = 10_000) -> tuple[DataFrame, bool]:
    """(id, depth, node_type, name, file) and whether the cap on results cut it short. Depth is 0 to 20; every start
    must exist."""
    if not starts or not 0 <= max_depth <= 20 or int(max_depth) != max_depth:
        raise ValueError("give some starts and a whole depth from 0 to 20")
    missing = set(starts) - {r["id"] for r in g.nodes.where(F.col("id").isin(*starts)).select("id").collect()}
    if missing:
        raise ValueError(f"no such nodes: {sorted(missing)}")
    found = bfs(g, starts, max_depth, types, direction)
    cut = not found.offset(cap).limit(1).isEmpty()
    kept = found.orderBy("depth", "id").limit(cap) if cut else found
    known = g.nodes.select("id", "node_type", "name", "file")
    return kept.join(known, "id", "left").withColumn("node_type", F.coalesce("node_type", F.lit("UNKNOWN"))), cut


def closure(seeds: DataFrame, edges: DataFrame, max_depth: int = CLOSURE_DEPTH) -> DataFrame:
    """(origin, node): what each seed reaches over one edge or more of any type; itself only over a cycle."""
    return reach(seeds, steps(edges), max_depth, include_start=False).select("origin", "node")


def upward(seeds: DataFrame, g: Graph, types: Iterable[str], goal: Column, stop: Column, max_depth: int = 20) -> DataFrame:
    """(origin, node, depth): the nearest node above each seed that meets `goal`, over incoming edges of some types.

    goal and stop are over node_type; neither a goal nor a stop is climbed past; of several as near, the least id.
    """
    up = steps(g.edges, "in", types)
    typed = g.nodes.select(F.col("id").alias("dst"), "node_type")
    moves = settled(up.join(typed, "dst").select("src", "dst", goal.alias("is_goal"), (goal | stop).alias("is_stop")), "moves")  # read in every level
    frontier = settled(seeds.select("origin", "node").distinct(), "up")
    found: list[DataFrame] = []
    seen = [frontier]
    for depth in range(1, max_depth + 1):
        met = frontier.join(moves, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), "is_goal", "is_stop").distinct()
        met = settled(met.join(reduce(DataFrame.union, seen), ["origin", "node"], "left_anti"), "up")
        if met.isEmpty():
            break
        hits = met.where("is_goal").groupBy("origin").agg(F.min("node").alias("node"))
        found.append(hits.withColumn("depth", F.lit(depth)))
        going = met.where(~F.col("is_stop")).select("origin", "node")
        frontier = settled(going.join(hits.select("origin"), "origin", "left_anti"), "up")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return reduce(DataFrame.union, found) if found else seeds.select("origin", "node", F.lit(0).alias("depth")).limit(0)


def chain(seeds: DataFrame, moves: DataFrame, most: int = 20) -> DataFrame:
    """(origin, node, depth, cycle): follow the least next node of each node; `cycle` marks a node met before, where
    the chain ends."""
    nexts = settled(moves.groupBy("src").agg(F.min("dst").alias("dst")), "nexts")  # read in every step
    rows = settled(seeds.select("origin", "node", F.lit(0).alias("depth"), F.lit(False).alias("cycle")), "chain")
    out = [rows]
    for depth in range(1, most + 1):
        step = rows.where("not cycle").join(nexts, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"))
        before = reduce(DataFrame.union, out).select("origin", "node", F.lit(True).alias("met")).distinct()
        rows = settled(step.join(before, ["origin", "node"], "left").select("origin", "node", F.lit(depth).alias("depth"), F.coalesce("met", F.lit(False)).alias("cycle")), "chain")
        if rows.isEmpty():
            break
        out.append(rows)
    return reduce(DataFrame.union, out)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """Semi-naive iteration: step(new rows) until nothing new comes; rows are a set."""
    fresh = settled(start.distinct(), "fix")
    known = [fresh]
    for _ in range(most):
        if fresh.isEmpty():
            return reduce(DataFrame.union, known)
        grown = step(fresh).distinct()
        fresh = settled(grown.join(reduce(DataFrame.union, known), grown.columns, "left_anti"), "fix")
        known.append(fresh)
        if len(known) > 8:  # few files to read again in each round
            known = [settled(reduce(DataFrame.union, known), "fix")]
    raise RuntimeError("the rules did not reach a fixpoint")
