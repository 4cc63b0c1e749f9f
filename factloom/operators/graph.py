"""Graph operators over edge tables (src, dst): each round is a join of the frontier with the edges, written durably.

What was visited is kept as one table that is rewritten every few rounds, so that no round reads a long union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.tables import durable

#: Rounds after which the visited table is written as one; edges up to which a job takes several steps, and how many.
COMPACT, FEW_EDGES, HOPS = 6, 1_000_000, 4


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges without self-loops, each once."""
    return edges.where("src is not null and dst is not null and src <> dst").distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def hops_of(edges: DataFrame) -> int:
    """Steps to take in one job: several where there are few edges, so that jobs, not rows, cost the time; one where every step has to leave out what was visited before it is joined again."""
    return HOPS if edges.count() <= FEW_EDGES else 1


def reach_levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None, first_level: int = 0) -> DataFrame:
    """(node, level): the least number of steps from a seed, up to max_depth steps (None: all). Seeds have first_level."""
    edges = durable(distinct_edges(edges), "edges")
    frontier = durable(seeds.select("node").where("node is not null").distinct().withColumn("level", F.lit(first_level)), "frontier")
    visited, step, rounds, hops = frontier, 0, 0, hops_of(edges)
    while max_depth is None or step < max_depth:
        at, found = frontier.select("node"), None
        for step in range(step + 1, (step + hops if max_depth is None else min(step + hops, max_depth)) + 1):  # noqa: B020
            at = at.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            level = at.withColumn("level", F.lit(first_level + step))
            found = level if found is None else found.unionByName(level)
        # What is found on an earlier step of the round was expanded by the later ones already.
        fresh = durable(found.groupBy("node").agg(F.min("level").alias("level")).join(visited, "node", "left_anti"), "frontier")
        frontier, visited, rounds = fresh.where(F.col("level") == first_level + step), visited.union(fresh), rounds + 1
        if frontier.isEmpty():
            break
        if rounds % COMPACT == 0:
            visited = durable(visited, "visited")
    return visited


def levels_max(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, level): one more than the largest level among a node's expanded predecessors, seeds at level 0 included when reached again."""
    levels = reach_levels(edges, seeds, max_depth)
    expanded = levels.where(F.col("level") < max_depth)
    return expanded.join(distinct_edges(edges), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("level"))


def shortest_ways(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, level, steps): one shortest way from any seed to every node reached; of several the one with the smallest predecessor."""
    one = seeds.select(F.lit("").alias("source"), "node")
    return _ways(edges, one, max_depth).drop("source")


def shortest_ways_by_source(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, node, level, steps): shortest_ways() from each seed on its own."""
    return _ways(edges, seeds.select(F.col("node").cast("string").alias("source"), "node"), max_depth)


def _ways(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    edges = durable(distinct_edges(edges), "edges")
    frontier = durable(seeds.distinct().select("source", "node", F.lit(0).alias("level"), F.array(F.col("node").cast("string")).alias("steps")), "ways")
    visited, step = frontier, 0
    while max_depth is None or step < max_depth:
        step += 1
        found = frontier.join(edges, F.col("node") == F.col("src")).join(visited.select("source", F.col("node").alias("dst")), ["source", "dst"], "left_anti")
        found = found.groupBy("source", F.col("dst").alias("node")).agg(F.min_by("steps", "src").alias("steps"))
        frontier = durable(found.select("source", "node", F.lit(step).alias("level"), F.concat("steps", F.array(F.col("node").cast("string"))).alias("steps")), "ways")
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if step % COMPACT == 0:
            visited = durable(visited, "visited")
    return visited


def simple_paths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, level, path): every cycle-free path of at most max_depth steps from a seed, joined with arrows. Their number grows with the degree to the power of the depth: for few steps; shortest_ways() gives one each."""
    edges = durable(distinct_edges(edges), "edges")
    frontier = seeds.select("node", F.array(F.col("node").cast("string")).alias("steps"))
    every = None
    for level in range(1, max_depth + 1):
        frontier = frontier.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("steps", F.col("dst").cast("string")))
        frontier = durable(frontier.select(F.col("dst").alias("node"), F.concat("steps", F.array(F.col("dst").cast("string"))).alias("steps")), "paths")
        rows = frontier.select("node", F.lit(level).alias("level"), F.array_join("steps", " → ").alias("path"))
        every = rows if every is None else every.union(rows)
        if frontier.isEmpty():
            break
    return every


def spread(edges: DataFrame, seeds: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """Labels spread along edges inside a scope until nothing is new: edges (*keys, src, dst), seeds (*keys, node)."""
    edges = durable(edges.select(*keys, "src", "dst").distinct(), "flow")
    frontier = durable(seeds.select(*keys, "node").distinct(), "labels")
    seen, k, n, hops = frontier, 0, 0, hops_of(edges)
    while rounds is None or k < rounds:
        at, found, last = frontier, None, min(k + hops, rounds) if rounds is not None else k + hops
        for k in range(k + 1, last + 1):  # noqa: B020
            at = at.withColumnRenamed("node", "src").join(edges, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
            step = at.withColumn("_step", F.lit(k))
            found = step if found is None else found.unionByName(step)
        fresh = durable(found.groupBy(*keys, "node").agg(F.min("_step").alias("_step")).join(seen, [*keys, "node"], "left_anti"), "labels")
        frontier, seen, n = fresh.where(F.col("_step") == k).drop("_step"), seen.union(fresh.drop("_step")), n + 1
        if frontier.isEmpty():
            break
        if n % COMPACT == 0:
            seen = durable(seen, "seen")
    return seen


def follow_origin(origins: DataFrame, inherits: DataFrame, rounds: int) -> DataFrame:
    """(node, origin, hops): origins (node) are their own; others take over from `parent` of inherits (node, parent)."""
    found = durable(origins.select("node", F.col("node").alias("origin"), F.lit(0).alias("hops")), "origins")
    frontier, inherits = found, durable(inherits.select("node", "parent"), "inherits")
    for hop in range(1, rounds + 1):
        step = inherits.join(frontier.select(F.col("node").alias("parent"), "origin"), "parent").select("node", "origin", F.lit(hop).alias("hops"))
        frontier = durable(step.join(found, "node", "left_anti").groupBy("node").agg(F.min("origin").alias("origin"), F.min("hops").alias("hops")), "origins")
        if frontier.isEmpty():
            break
        found = found.union(frontier)
        if hop % COMPACT == 0:
            found = durable(found, "origins")
    return found
