"""Connected components of a link table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.plans.lineage import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """`node, component` of all nodes of `links` (`a, b`, both long); the component is its least node.

    Alternates two steps that keep components: link every larger neighbour of a node to its least
    neighbour, then every smaller one. Both only aggregate and join by node; links end as stars.
    """
    links = links.filter("a != b").distinct()
    while True:
        links = _to_least(_both_ways(links), F.col("b") > F.col("a"))
        smaller = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        links = cut_lineage(_to_least(smaller, F.col("b") <= F.col("a"), with_own=True))
        # Stars: every leaf has one link, and no node that others are linked to is linked itself.
        chained = links.join(links.select(F.col("a").alias("b")), "b", "left_semi")
        twice = links.groupBy("a").count().filter("count > 1")
        if chained.select("b").union(twice.select("a")).isEmpty():
            break
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return leaves.union(roots).distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _to_least(links: DataFrame, moved: Column, with_own: bool = False) -> DataFrame:
    """Link the neighbours `b` of each `a` that are `moved`, and `a` itself if wanted, to the least one."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    out = links.join(least, "a").filter(moved).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if with_own:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.filter("a != b").distinct()
