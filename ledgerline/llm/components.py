"""Connected components of links by hooking to the least neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _changed(pairs: DataFrame) -> bool:
    return not pairs.filter("old <> new").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in links(a, b): component is the least id reachable.

    Each round hooks every id to its least neighbour, follows the hooks to their roots and
    contracts the links to links between roots; the number of ids in a component at least halves,
    so the rounds grow with the logarithm of the longest chain. Hooks are minima, combined before
    their shuffle; nothing is gathered per id. Loops and repeated links are allowed; an id that
    has only loops is its own component. No links give no rows.
    """
    links = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long"))
                   .filter("a is not null and b is not null").distinct())
    labels = None
    while True:
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
            "id", F.least("id", "m").alias("root"))
        jumped = hooks.withColumn("old", F.lit(None).cast("long"))
        while True:
            hooks = stored(jumped.select("id", "root"))
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("above"))
            stepped = hooks.join(up, "root").select(
                "id", F.col("root").alias("old"), F.col("above").alias("new"))
            if not _changed(stepped):
                break
            jumped = stepped.select("id", F.col("new").alias("root"))
        if labels is None:
            labels = hooks.select("id", F.col("root").alias("component"))
        else:
            labels = stored(labels.join(
                hooks.select(F.col("id").alias("component"), "root"), "component", "left").select(
                "id", F.coalesce("root", "component").alias("component")))
        at_a = hooks.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        at_b = hooks.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        links = stored(links.join(at_a, "a").join(at_b, "b").filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if links.isEmpty():
            return labels
