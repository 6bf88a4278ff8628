"""Connected components of links, by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


# The least neighbours are written out before they are joined back: then both sides of the join have an exchange of
# their own, and Spark can split the partition of a node with very many neighbours.


def large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links-least")
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = materialise(links.groupBy("b").agg(F.min("a").alias("m")), "links-least")
    handed = links.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return handed.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of the links (`a` < `b`): root is the smallest node of its component.

    Each round is two grouped joins over the links, written to the shared folder; rounds grow with the logarithm of
    the number of nodes. It ends when the links are stars that no step changes.
    """
    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first())

    links = materialise(links, "links")
    seen = mark(links)
    while seen[0]:
        links = materialise(small_star(materialise(large_star(links), "links-large")), "links")
        now = mark(links)
        if now == seen:
            break
        seen = now
    leaves = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
