"""Connected components of a table of links, as Spark joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored
from docloom.operators.skew import add_salt, hot_keys, hot_threshold, repeat_for_salts

#: Neighbours of a node, the larger ones, that one task may be handed; 1/10,000 of all links if that is more.
HUB_ROWS = 256


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is named after its
    least node.

    Large-star and small-star steps in turn: each node hangs its larger, then its smaller
    neighbours on the least node it knows. The links never grow in number, and their count of
    rounds follows the logarithm of the longest path. Every round is written to the shared folder,
    so a lost executor never sends the job back to its start. A node with very many links is
    aggregated in its tasks first: only least neighbours are gathered, and its links are spread over
    salts when they are hung on them.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = (edges.count(), None)
    while True:
        edges = stored(_small_star(_large_star(edges, state[0])), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbours and itself."""
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.unionByName(larger).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    counts = larger.groupBy("u").agg(F.count(F.lit(1)).alias("rows"))
    hubs = hot_keys(counts, ["u"], "rows", hot_threshold(rows, HUB_ROWS))
    spread = add_salt(larger, hubs, ["u"], "v").join(repeat_for_salts(least, hubs, ["u"]), ["u", "salt"])
    return spread.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
