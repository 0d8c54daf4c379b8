"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bizmetrics.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two columns of one type, whose rows link two nodes. Returns ``node`` and
    ``root`` (the smallest node of its component), one row for each node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of rounds
    grows with the logarithm of the longest chain, and no step holds a component in one place.
    Each step takes a minimum per node, which combines before the shuffle, and joins it back;
    the adaptive skew join splits the rows of a node with many links. Every round is stored in
    the shared folder. Rows with a null are no links; no edges give no rows.
    """
    a, b = edges.columns
    now = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    seen = _fingerprint(now)
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        before, seen = seen, _fingerprint(now)
        if seen == before:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
