"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import discard, stored


#: Parts in which the links of one node are joined, so that a node with very many is no hot key.
PARTS = 8


def _lowest(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the smallest node that u touches, itself included."""
    low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return links.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(low, ["u", "part"]).drop("part")


def components(edges: DataFrame, a: str = "a", b: str = "b", made: list[str] | None = None) -> DataFrame:
    """(node, root) for every node of an edge table; the root is the component's smallest node.

    Edges with a null end and loops say nothing, repeated edges count once. Each
    round is written to the shared folder, so lineage stays short, and the round
    before is deleted; the driver sees one count and one checksum a round. The
    last table's folder is added to ``made``.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    folders: list[str] = []
    links = stored(links, "links", folders)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large)
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        links = stored(small, "links", folders)
        discard(edges.sparkSession, folders[:-1])
        del folders[:-1]
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    if made is not None:
        made += folders
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
