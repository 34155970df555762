"""Connected components by distributed union-find (alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import durable


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a stored table, their number and an order-free checksum, both observed by the write itself."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    table = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), checksum), "edges")
    return table, (seen.get["n"], seen.get["s"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    return (
        tied.select("u", F.col("m").alias("v"))
        .union(tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that occurs in a link; the root is the smallest node reachable.

    ``links`` has two columns of one orderable type; direction, repeats, self-links and links with a null
    are of no account. No links give no rows. Only a count and a checksum reach the driver in
    each round; the edges of a round are a table in the shared folder. A node with very many
    neighbours is pre-aggregated by the partial minimum, and its rows in the joins can be split.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    (edges, now), last = _stored(edges), None
    while now != last:
        last = now
        edges, now = _stored(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
