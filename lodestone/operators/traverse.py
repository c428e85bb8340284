"""Graph queries on (source_id, target_id, type) edges: neighbourhoods, shortest paths, subgraphs, cycles.

Breadth-first search is a loop of equi-joins; a visited set is kept by anti-join, and each level is written in the
shared folder so that the plan does not grow with the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import first_filled
from lodestone.operators.checks import one_of, positive
from lodestone.storage import importable, materialize

DIRECTIONS = ("out", "in", "both")


def projected(edges: DataFrame, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
    """Distinct (u, v) steps of a direction over the edges of the given types; parallel edges collapse."""
    one_of("direction", direction, DIRECTIONS)
    if edge_types:
        edges = edges.where(F.col("type").isin(*edge_types))
    out = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    back = edges.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def _balls(steps: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, distance) of all nodes within ``hops`` of each seed, the seed itself at 0."""
    steps = materialize(steps, "steps") if hops > 1 else steps
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, hops + 1):
        reached = frontier.join(steps, frontier.id == steps.u).select("seed", F.col("v").alias("id")).distinct()
        frontier = reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(d))
        if d < hops:
            frontier = materialize(frontier, "frontier")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame, id_: str, hops: int = 1, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
    """id, distance and score = 1 / distance of the nodes within ``hops``, nearest first; empty for an unknown node."""
    positive("hops", hops)
    seeds = nodes.where(F.col("id") == id_).select("id")
    found = _balls(projected(edges, direction, edge_types), seeds, hops).where("distance > 0")
    known = found.join(nodes.select("id"), "id", "left_semi")
    return known.select("id", "distance", F.try_divide(F.lit(1.0), F.col("distance")).alias("score")).orderBy("distance", "id")


def induced(edges: DataFrame, ids: DataFrame, edge_types: list[str] | None = None) -> DataFrame:
    """The edges between the given nodes."""
    keep = ids.select(F.col("id").alias("_id")).distinct()
    if edge_types:
        edges = edges.where(F.col("type").isin(*edge_types))
    return edges.join(keep, edges.source_id == keep._id, "left_semi").join(keep, F.col("target_id") == keep._id, "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: list[str], hops: int = 1, direction: str = "both", edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the union of the seeds' neighbourhoods, and a summary row (score, text)."""
    positive("hops", hops, 0)
    seeds = nodes.where(F.col("id").isin(*ids)).select("id")
    ball = _balls(projected(edges, direction, edge_types), seeds, hops).select("id").distinct()
    inside = nodes.join(ball, "id", "left_semi")
    between = induced(edges, ball, edge_types)
    counted = inside.agg(F.count(F.lit(1)).alias("n")).crossJoin(between.agg(F.count(F.lit(1)).alias("m")))  # one row each
    return inside, between, counted.select(F.col("n").cast("double").alias("score"), F.concat("n", F.lit(" nodes, "), "m", F.lit(" edges")).alias("text"))


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, edge_types: list[str] | None = None) -> DataFrame:
    """path, path_length and score of a shortest directed path (the smallest among equals); no row if there is none."""
    spark = nodes.sparkSession
    steps = projected(edges, "out", edge_types)
    level = nodes.where(F.col("id") == source).select("id", F.array("id").alias("path"))
    done = lambda df: df.select("path", (F.size("path") - 1).alias("path_length"), (1.0 / F.greatest(F.size("path") - 1, F.lit(1))).alias("score"))
    if source == target or nodes.where(F.col("id") == target).isEmpty():
        return done(level.where(F.col("id") == target))
    steps = materialize(steps, "steps")
    seen = level = materialize(level, "level")
    while not level.isEmpty():
        hit = level.where(F.col("id") == target)
        if not hit.isEmpty():
            return done(hit)
        reached = level.join(steps, level.id == steps.u).select(F.col("v").alias("id"), F.concat("path", F.array("v")).alias("path"))
        reached = reached.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        level = materialize(reached, "level")
        seen = seen.unionByName(level)
    return done(spark.createDataFrame([], level.schema))


#: Graphs up to this number of edges are searched for cycles by one task per start node, each with all edges.
SMALL_EDGES = 100_000


def _cycles_from(first: str, after: dict[str, list[str]], before: dict[str, list[str]]) -> Iterator[list[str]]:
    """The simple cycles whose smallest node is ``first``, depth first: only nodes above it that lead back to it are
    entered."""
    back, waiting = {first}, [first]
    while waiting:
        for u in before.get(waiting.pop(), ()):
            if u > first and u not in back:
                back.add(u)
                waiting.append(u)
    path, on_path, choices = [first], {first}, [iter(after.get(first, ()))]
    while choices:
        v = next(choices[-1], None)
        if v is None:
            choices.pop()
            on_path.discard(path.pop())
        elif v == first:
            yield [*path, first]
        elif v in back and v not in on_path:
            path.append(v)
            on_path.add(v)
            choices.append(iter(after.get(v, ())))


def simple_cycles(edges: DataFrame) -> DataFrame:
    """Each directed simple cycle once, as ``chain`` from its smallest node back to it; a self edge is [a, a].

    A cycle is found from its smallest node only, over larger nodes.  Small graphs travel whole to a task per start node;
    in others, paths grow by joins, a step each.  Paths are simple, so either search ends.
    """
    spark = edges.sparkSession
    steps = materialize(edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).distinct(), "steps")
    small = steps.limit(SMALL_EDGES + 1).collect()
    if len(small) <= SMALL_EDGES:
        importable(spark)
        after: dict[str, list[str]] = {}
        before: dict[str, list[str]] = {}
        for u, v in sorted(small):
            after.setdefault(u, []).append(v)
            before.setdefault(v, []).append(u)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[str]] = []
            for b in batches:
                for first in b.column(0).to_pylist():
                    for chain in _cycles_from(first, after, before):
                        held.append(chain)
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["chain"])
                            held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["chain"])

        starts = steps.select("u").distinct()
        return starts.repartition(spark.sparkContext.defaultParallelism, "u").mapInArrow(run, "chain array<string>")
    found = [steps.where("u = v").select(F.array("u", "v").alias("chain"))]
    paths = steps.where("v > u").select(F.col("u").alias("first"), F.col("v").alias("last"), F.array("u", "v").alias("path"))
    while True:
        paths = materialize(paths, "paths")
        if paths.isEmpty():
            break
        more = paths.join(steps, paths.last == steps.u)
        found.append(more.where("v = first").select(F.concat("path", F.array("v")).alias("chain")))
        paths = more.where((F.col("v") > F.col("first")) & ~F.array_contains("path", F.col("v"))).select("first", F.col("v").alias("last"), F.concat("path", F.array("v")).alias("path"))
    return reduce(DataFrame.unionByName, found)


def as_results(nodes: DataFrame) -> DataFrame:
    """Node rows as retrieval results: symbol, symbol_type and text with their fallbacks."""
    return nodes.withColumns({
        "symbol": first_filled(F.col("qualified_name"), F.col("name"), F.col("id")),
        "symbol_type": first_filled(F.col("type"), F.col("label")),
        "text": F.coalesce(first_filled(F.col("signature"), F.col("qualified_name"), F.col("name")), F.lit("")),
    })


def filtered_graph(nodes: DataFrame, edges: DataFrame, module: str | None = None, needle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a module whose name or id holds a substring (case ignored), and the edges between them."""
    if module:
        nodes = nodes.where(F.col("module") == module)
    if needle:
        low = needle.lower()
        nodes = nodes.where(F.lower("name").contains(low) | F.lower("id").contains(low))
    return nodes, induced(edges, nodes.select("id"))


def module_layout(nodes: DataFrame, radius: float = 300.0, inner: float = 80.0) -> DataFrame:
    """x and y of each node: modules on a circle, a module's nodes on a circle around it, both in name order."""
    from math import pi

    from pyspark.sql import Window

    modules = nodes.groupBy("module").agg(F.count(F.lit(1)).alias("members"))
    place = Window.orderBy("module")  # modules, not nodes
    modules = modules.withColumn("_m", F.row_number().over(place) - 1).crossJoin(F.broadcast(modules.agg(F.count(F.lit(1)).alias("_of"))))
    own = Window.partitionBy("module").orderBy("id")
    placed = nodes.join(modules, "module").withColumn("_n", F.row_number().over(own) - 1)
    a, b = 2 * pi * F.col("_m") / F.col("_of"), 2 * pi * F.col("_n") / F.col("members")
    return placed.select("id", "module", (radius * F.cos(a) + inner * F.cos(b)).alias("x"), (radius * F.sin(a) + inner * F.sin(b)).alias("y"))
