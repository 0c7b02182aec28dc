"""Connected components of a link table by repeated contraction, on Spark throughout."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import WorkFolder


def connected_components(links: DataFrame, work: WorkFolder, name: str = "round") -> DataFrame:
    """(node, component) of every node of `links` (a, b, both long); `component` is one of its nodes.

    In each round every node moves to the neighbour, or itself, with the smallest hash, and the links
    are rewritten between the nodes moved to. Hashes follow no order of the ids, so that chains
    shrink by a constant share in each round. Smallest neighbours are found by partial aggregation;
    moves are joins of two plainly exchanged tables, in which large groups can be split.
    """
    both = links.where("a <> b").select("a", "b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = work.write(both, f"{name}-links-0")
    steps, k = [], 0
    while not both.isEmpty():
        nearest = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id")))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        moves = (
            both.groupBy("a").agg(nearest.alias("near"))
            .select("a", F.least(F.col("near"), own)["id"].alias("to"))
        )
        moves = work.write(moves, f"{name}-moves-{k}")
        steps.append(moves)
        at_a = moves.select("a", F.col("to").alias("to_a")).hint("merge")
        at_b = moves.select(F.col("a").alias("b"), F.col("to").alias("to_b")).hint("merge")
        half = work.write(
            both.join(at_a, "a").select(F.col("to_a").alias("a"), "b"), f"{name}-half-{k}"
        )
        moved = (
            half.join(at_b, "b").where("a <> to_b").select("a", F.col("to_b").alias("b")).distinct()
        )
        k += 1
        both = work.write(moved, f"{name}-links-{k}")
        work.drop(f"{name}-half-{k - 1}", f"{name}-links-{k - 1}")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    # Follow the moves: nodes that go on in the next round are those that it moves.
    members = steps[0].select(F.col("a").alias("node"), F.col("to").alias("component"))
    for k, moves in enumerate(steps[1:]):
        onward = moves.select(F.col("a").alias("component"), "to").hint("merge")
        members = work.write(
            members.join(onward, "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")),
            f"{name}-members-{k}",
        )
    return members
