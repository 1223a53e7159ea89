"""Connected components by alternating large-star and small-star rounds.

A round needs a minimum for each node (combined before the shuffle) and an
equi-join, which AQE can split where one node has very many links; no neighbour
list is ever collected.  Each round's links are written to the shared folder, which ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.rows import materialize, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: a > b.  Every node's minimum becomes the partner of its larger (or of its smaller) neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long).  Returns node, component (the component's smallest node) for each node that has an edge to another."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    seen = _print(links)
    while seen[0]:
        before, links = links, materialize(_star(_star(links, large=True), large=False), "links")
        release(before)
        now = _print(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
