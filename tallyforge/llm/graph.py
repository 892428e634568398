"""Connected components by contraction, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, forget


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links (a, b).

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by doubling, and
    contracts the links; a round at least halves what is left of a component. Only links and hooks move, the
    smallest neighbour comes from partial minima, and every round is cut in the shared folder.
    """
    left = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hooks = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            after = cut(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "hooks")
            moved = not after.where("moved").isEmpty()
            forget(hooks)
            hooks = after.drop("moved")
            if not moved:
                break
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = cut(roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        ends = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        other = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = cut(
            left.join(ends, "a").join(other, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links",
        )
    return links.sparkSession.createDataFrame([], links.select(F.col("a").alias("node"), F.col("b").alias("root")).schema) if roots is None else roots.select("node", "root")
