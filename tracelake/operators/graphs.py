"""Graphs as tables of edges: following pointers by doubling, and strongly connected components.

Every round is a stored table, so plans stay short and nothing depends on one executor. No path and no closure is ever
held: each node has one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import stage, stage_counted


def _doubled(steps: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(key, s, t) followed until a ``t`` that is no ``s``: the rows that got there, and those that never do.

    After each round a row has gone twice as far. A round that ends nobody's way shows that the rest runs in circles;
    they have then gone far enough to be on a circle when that is as many steps as there are of them.
    """
    done: list[DataFrame] = []
    table, left = stage_counted(steps.select(*key, "s", "t", F.lit(False).alias("done")), "steps")
    rest, gone = table, 1
    while left:
        further = table.select(*key, F.col("s").alias("t"), F.col("t").alias("_t"), F.col("done").alias("_done"))
        moved = rest.join(further, [*key, "t"], "left").select(
            *key, "s", F.coalesce("_t", "t").alias("t"), F.coalesce("_done", F.lit(True)).alias("done"))
        moved = stage(moved, "followed")
        done.append(moved.where("done"))
        before, gone = left, 2 * gone
        rest, left = stage_counted(moved.where("not done"), "following")
        table = reduce(DataFrame.unionByName, done, rest)
        if left == before and gone >= left:
            break
    ended = reduce(DataFrame.unionByName, done) if done else table
    return ended.select(*key, "s", "t"), rest.select(*key, "s", "t"), left


def followed(steps: DataFrame, key: list[str], source: str, target: str) -> DataFrame:
    """Where each source leads: (key, source, end), for at most one target of each source.

    A way ends at a name that leads nowhere, or with the last name before one would come again. The number of rounds is
    the logarithm of the longest way.
    """
    steps = stage(steps.select(*key, F.col(source).alias("s"), F.col(target).alias("t")), "steps")
    ended, circling, left = _doubled(steps, key)
    if left:
        # Gone that far, the circling rows stand on circles, and on every place of them.
        on_circle = stage(circling.select(*key, F.col("t").alias("s")).distinct(), "circles")
        inside = steps.join(on_circle, [*key, "s"], "left_semi")
        outside = circling.select(*key, "s").join(on_circle, [*key, "s"], "left_anti")
        entered, _, _ = _doubled(steps.join(outside, [*key, "s"], "left_semi"), key)
        entry = entered.unionByName(on_circle.withColumn("t", F.col("s")))
        last = inside.select(*key, "t", F.col("s").alias("end"))
        ended = ended.unionByName(entry.join(last, [*key, "t"]).select(*key, "s", F.col("end").alias("t")))
    return ended.select(*key, F.col("s").alias(source), F.col("t").alias("end"))


def _trimmed(edges: DataFrame, key: list[str], n: int) -> tuple[DataFrame, int]:
    """Edges without those that no circle can use: at a node that nothing leads to, or that leads nowhere."""
    while n:
        entered = edges.select(*key, F.col("b").alias("a")).distinct()
        left = edges.select(*key, F.col("a").alias("b")).distinct()
        edges, m = stage_counted(edges.join(entered, [*key, "a"], "left_semi").join(left, [*key, "b"], "left_semi"), "cycle-edges")
        if m == n:
            break
        n = m
    return edges, n


def _coloured(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, colour): the greatest name from which each node can be reached, itself included."""
    names = edges.select(*key, F.col("a").alias("name")).unionByName(edges.select(*key, F.col("b").alias("name"))).distinct()
    colours = stage(names.withColumn("colour", F.col("name")), "colours")
    fresh = colours
    while True:
        offers = (fresh.withColumnRenamed("name", "a").join(edges, [*key, "a"])
                  .groupBy(*key, F.col("b").alias("name")).agg(F.max("colour").alias("offer")))
        judged = stage(colours.join(offers, [*key, "name"], "left").select(
            *key, "name", F.greatest("colour", "offer").alias("colour"),
            F.coalesce(F.col("offer") > F.col("colour"), F.lit(False)).alias("changed")), "colours")
        colours, fresh = judged.drop("changed"), judged.where("changed").drop("changed")
        if fresh.isEmpty():
            return colours


def _backward(edges: DataFrame, colours: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, component): what leads to the node a colour is named after, inside the colour."""
    fresh = colours.where("colour = name").select(*key, "name", F.col("colour").alias("component"))
    met = fresh
    while True:
        step = fresh.withColumnRenamed("name", "b").join(edges, [*key, "b"]).select(*key, F.col("a").alias("name"), "component")
        step = step.distinct().join(colours.withColumnRenamed("colour", "component"), [*key, "name", "component"], "left_semi")
        fresh, n = stage_counted(step.join(met, [*key, "name"], "left_anti"), "component")
        if not n:
            return met
        met = met.unionByName(fresh)


def cyclic_groups(links: DataFrame, key: list[str], source: str, target: str) -> DataFrame:
    """(key, name, component) of every node that lies on a circle, without any closure.

    Two nodes have one component if and only if each leads to the other. Components are named after one of their nodes.
    Nodes on no circle are taken off first; then, again and again, the greatest name is spread forward and the nodes
    of a colour that lead back to the name make one component.
    """
    ends = links.select(*key, F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    ends = stage(ends.distinct(), "cycle-edges")
    edges, n = stage_counted(ends.where("a <> b"), "cycle-edges")
    found = ends.where("a = b").select(*key, F.col("a").alias("name"), F.col("a").alias("component"))
    while n:
        edges, n = _trimmed(edges, key, n)
        if not n:
            break
        groups = stage(_backward(edges, _coloured(edges, key), key), "components")
        # A node that only points to itself may lie on a greater circle too.
        found = groups.unionByName(found.join(groups, [*key, "name"], "left_anti"))
        done = groups.select(*key, "name")
        edges, n = stage_counted(edges.join(done.withColumnRenamed("name", "a"), [*key, "a"], "left_anti").join(
            done.withColumnRenamed("name", "b"), [*key, "b"], "left_anti"), "cycle-edges")
    return found
