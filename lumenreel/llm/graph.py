"""Connected components of a link table, as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import cut, few_tasks, salted_join


#: Links up to which all of them are one task's work anyway; a hot node's links are spread only beyond.
ONE_TASK = 1_000_000
#: Links up to which the smallest neighbours (16 bytes each) are broadcast, so that links stay where they are.
BROADCAST_LINKS = 100_000


def _join(links: DataFrame, low: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """``n``: number of links, at most."""
    if n > ONE_TASK:
        return salted_join(links, low, [key], F.col(by))
    return links.join(F.broadcast(low) if n <= BROADCAST_LINKS else low, key)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Each link's larger end at the smallest neighbour of its smaller one; as many rows, some of them equal."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _join(e, low, "a", "b", n).select(F.col("m").alias("a"), F.col("b"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = F.array(*(F.struct(F.col("m").alias("a"), F.col(c).alias("b")) for c in "ab"))
    return _join(e, low, "b", "a", n).select(F.explode(moved).alias("e")).select("e.*").filter("a <> b").distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether every node is either a centre or the leaf of a single one: then no round changes a link."""
    ends = e.select(F.col("a").alias("node"), F.lit(0).alias("leaf")).union(e.select(F.col("b").alias("node"), F.lit(1).alias("leaf")))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least")).filter("leaf > 1 or leaf > least").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link to another.

    Alternating large-star and small-star rounds: each moves links to the smallest neighbour, needs two partial
    aggregations and joins, keeps no neighbour list, and the number of links never grows.  Only a count, and neighbours
    that are broadcast, reach the driver.  Links of a hot node meet in many tasks.
    """
    e = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    e = cut(e)
    n = e.count()
    e, done = few_tasks(e, n), not n
    while not done:
        e = cut(few_tasks(_small_star(_large_star(e, n), n), n))
        done = _are_stars(e)
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
