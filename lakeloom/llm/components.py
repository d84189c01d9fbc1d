"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node that the columns src, dst name.

    Each round hooks every node to its smallest neighbour, shortens the hooks,
    and contracts the links; rounds grow with the logarithm of a component's
    diameter. Rounds end at tables in the shared folder. Only whether links
    are left reaches the driver. A null end drops its link; a link to itself
    makes a component of one; repeated links count once.
    """
    links = stored(links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("dst", "src"))
        hooks = both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("to"))
        hooks = stored(hooks, "hooks")
        next_hook = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
        hooks = stored(hooks.join(next_hook, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "hooks")
        maps.append(hooks)
        ends = links.join(hooks.withColumnRenamed("to", "a"), links.src == hooks.node).select("a", "dst")
        ends = ends.join(hooks.withColumnRenamed("to", "b"), ends.dst == hooks.node).select("a", "b")
        links = stored(ends.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
    if not maps:
        return links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    labels = maps[0].select("node", F.col("to").alias("component"))
    for hooks in maps[1:]:
        step = hooks.select(F.col("node").alias("component"), F.col("to").alias("further"))
        labels = labels.join(step, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return stored(labels, "components")
