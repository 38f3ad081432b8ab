"""Connected components of a link table, as joins and aggregates over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

#: Links that one task writes, and the least number of tasks.
LINKS_IN_TASK, LEAST_TASKS = 50_000, 4


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (``a``, ``b``): the smallest node reachable.

    In a round each node goes to its smallest neighbour's smallest neighbour if that is smaller, and
    links are redrawn between the groups so made, until none is left. Labels only sink, so the
    last one is the smallest node. A node with many links is a hot key of joins between stored
    tables, which adaptive execution splits, and of minima, which combine before the shuffle.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = first = None
    # The work shrinks with the links, and so do the tasks that write it.
    while count := edges.count():
        tasks = max(LEAST_TASKS, count // LINKS_IN_TASK)
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "node"), "parents", tasks)
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = stored(parents.join(above, "up").select("node", F.col("top").alias("up")), "jumped", tasks)
        if labels is None:
            labels = jumped.withColumnRenamed("up", "component")
        else:
            moved = jumped.select(F.col("node").alias("component"), "up")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        first = first or tasks
        labels = stored(labels, "labels", first)
        a, b = (jumped.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        redrawn = edges.join(a, "a").join(b, "b").where("a_up <> b_up")
        edges = stored(redrawn.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links", tasks)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return labels
