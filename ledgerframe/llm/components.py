"""Connected components of a link table, by contraction.

Each round every node hooks onto its least neighbour (or stays), links are
rewritten to the hooks and loops dropped, until no link is left; the node ->
label table follows along.  Everything is a partial aggregate or a join on a
node id; a round's tables are written to the shared folder.  With random ids
the number of rounds grows with the logarithm of the longest path; the label
of a component is its least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import saved

MAX_ROUNDS = 60


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least id."""
    links = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .distinct(), f"{name}-links")
    labels = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = saved(both.groupBy("a").agg(F.min("b").alias("m"))
                      .select(F.col("a").alias("node"), F.least("a", "m").alias("hook")), f"{name}-hooks")
        if labels is None:
            labels = hooks.select("node", F.col("hook").alias("root"))
        else:
            moved = hooks.select(F.col("node").alias("root"), "hook")
            labels = saved(labels.join(moved, "root", "left")
                           .select("node", F.coalesce("hook", "root").alias("root")), f"{name}-labels")
        links = (links.join(hooks.select(F.col("node").alias("a"), F.col("hook").alias("x")), "a")
                 .join(hooks.select(F.col("node").alias("b"), F.col("hook").alias("y")), "b")
                 .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        links = saved(links, f"{name}-links")
        if links.isEmpty():
            return labels
    raise RuntimeError("components did not settle")
