"""Connected components by contraction, as joins and aggregates over the links.

Each round maps every node to the smallest of itself and its neighbours, follows
that map once more, and rewrites the links with it; links inside a node vanish.
A component's smallest node always maps to itself, so it is what is left.
Rounds shrink paths at least by half, and stars vanish in one.  Hubs are safe:
minima are combined where the links are read, and joins on a hub may be split
at run time.  Only the number of links that are left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component being the smallest node that links lead to.

    Links may repeat, come in either direction or lead from a node to itself; an
    empty table gives an empty result.
    """
    edges = written(links.select("a", "b").filter("a != b").distinct(), "links")
    steps: list[DataFrame] = []
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        first = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "step")
        then = first.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = written(first.join(then, "to").select("node", F.col("next").alias("to")), "steps")
        drop_written(first)
        steps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        fewer = written(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop_written(edges)
        edges = fewer
        if edges.isEmpty():
            break
    found = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(found, "components")
