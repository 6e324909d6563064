"""Connected components over links, by repeated contraction.

Every node points at the smallest neighbour, pointers are doubled, and links
are rewritten to what their ends point at.  Links within one tree vanish, so
the number of linked nodes at least halves a round.  All tables of a round are
written to the shared folder; nothing but a row count reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``.

    ``root`` is one node of the component, the same for all of it.  Links may
    repeat, point either way or lead to themselves; a link with a null end is
    no link.  No links: no rows.  A node with very many links is met by
    map-side minima and by joins that adaptive execution can split.
    """
    whole = links.where("a is not null and b is not null")  # least and greatest would skip a null
    edges = written(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    maps: list[DataFrame] = []
    live = edges.where("a <> b")
    while not live.isEmpty():
        both = live.select(F.col("b").alias("node"), F.col("a").alias("to")).union(live.select(F.col("a").alias("node"), F.col("a").alias("to")))
        up = written(both.groupBy("node").agg(F.min("to").alias("to")), "hooks")
        for _ in range(JUMPS):
            far = up.select(F.col("node").alias("to"), F.col("to").alias("far"))
            up = written(up.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "jumps")
        maps.append(up)
        for end in ("a", "b"):
            new = up.select(F.col("node").alias(end), F.col("to").alias(f"new_{end}"))
            live = live.join(new, end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).drop(f"new_{end}")
        live = written(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "contracted")

    def through(found: DataFrame, up: DataFrame) -> DataFrame:
        step = up.select(F.col("node").alias("root"), "to")
        return found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))

    return written(reduce(through, maps, nodes.select("node", F.col("node").alias("root"))), "components")
