"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import durable

#: A graph of n nodes needs about log2(n)**2 rounds at worst; this is far beyond any input.
MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Each round rewires edges towards the least neighbour and keeps their number bounded by the
    number at the start; a hot node's edges stay separate rows, combined map-side into a minimum.
    Rounds are written, so a lost executor costs nothing that was written. Edges with a null end
    are ignored, loops give a component of their own.
    """
    clean = edges.select("a", "b").filter("a is not null and b is not null")
    links = durable(
        clean.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of a node is tied to the least of its neighbourhood.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.filter("a <> b").distinct())
        # Small star: a node and its smaller neighbours are tied to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m"
        ).select(F.col("s.x").alias("a"), F.col("m").alias("b"))
        links = durable(small.filter("a <> b").distinct())
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("digest")
        ).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    named = links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    loops = clean.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return named.unionByName(loops.join(named, "node", "left_anti"))
