"""Connected components of links between rows, by alternating large and small stars.

Every round replaces the links of a node by links to its smallest neighbour; after a logarithmic number of rounds each
node links to the smallest of its component only. A round is two aggregations and two joins on nodes, so a node with
very many links is summed up before it is shuffled, and its rows are split by adaptive joins. Rounds are cut by
checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), v < u, after one star step."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    moved = joined.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = joined.where("m < u").select("u", F.col("m").alias("v")) if not large else moved.limit(0)
    return moved.unionByName(kept).where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` has the bigint columns a and b; repeated links, links to oneself and nulls are allowed and add nothing."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = checkpointed(links)
    before = None
    for _ in range(most_rounds):
        links = checkpointed(_star(_star(links, large=True), large=False))
        # equal sums of the links' hashes: nothing has changed
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
