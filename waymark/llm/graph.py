"""Connected components by contraction, with every round's tables in the shared folder."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Steps that a round follows its hooks for.
STEPS = 4
#: So many edges, 16 MB, are no more than one task can join at once.
SMALL = 1_000_000


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the nodes a and b pairwise; a label is the smallest place of its component."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        la, lb = la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _at_once(table: pa.Table) -> pa.Table:
    """(node, up) of the edges (a, b): the smallest node reachable, for all that are not it."""
    nodes, places = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    up = hook(np.arange(len(nodes)), places[: table.num_rows], places[table.num_rows :])
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return pa.table({"node": nodes[moved], "up": nodes[up[moved]]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component: the smallest node reachable.

    In each round every node hooks to its first neighbour in some order, if that
    comes before it; nodes without a hook are roots.  Nodes that reach a root in
    STEPS are replaced by it, the others wait.  The first round orders nodes by
    themselves, as a group's smallest member is often its hub, later ones by a
    hash, which keeps paths of hooks short whatever the graph.  A node is replaced
    once, so the rounds' replacements are one forest, as deep as there were
    rounds.  Only minima meet at a hub; no list of its neighbours is ever
    gathered.  Once there are no more than SMALL edges, one task joins them.
    Edges with a null end or from a node to itself link nothing.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", few=True)
    rounds: list[DataFrame] = []
    while n := e.count():
        if n <= SMALL:
            rounds.append(written(e.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_at_once, "node long, up long"), "moved", few=True))
            break
        key = lambda c: F.struct((F.xxhash64(c, F.lit(len(rounds))) if rounds else F.col(c)).alias("k"), F.col(c).alias("node"))  # noqa: E731, B023
        ends = e.select(F.least(key("a"), key("b")).alias("lo"), F.greatest(key("a"), key("b")).alias("hi"))
        moved = ends.groupBy(F.col("hi.node").alias("node")).agg(F.min("lo")["node"].alias("up"))
        above = moved.select(F.col("node").alias("up"), F.col("up").alias("top"))
        for _ in range(STEPS - 1):
            moved = moved.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        moved = written(moved.join(above, "up", "left_anti").select("node", "up"), "moved", few=True)
        rounds.append(moved)
        to = lambda c: moved.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: E731, B023
        rest = e.join(to("a"), "a", "left").join(to("b"), "b", "left")
        rest = rest.select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b")).where("a <> b")
        e = written(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", few=True)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    forest, depth = reduce(DataFrame.unionByName, rounds), len(rounds)
    while depth > 1:
        above = forest.select(F.col("node").alias("up"), F.col("up").alias("top"))
        forest = written(forest.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "forest", few=True)
        depth = -(-depth // 2)
    all_ = forest.unionByName(forest.select(F.col("up").alias("node"), "up").distinct())
    return all_.join(all_.groupBy("up").agg(F.min("node").alias("component")), "up").select("node", "component")
