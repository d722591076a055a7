"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and an aggregate over edges; labels never reach the driver, only a checksum per round does.
A node's least neighbour is joined with its edges by (node, salt), so a node with very many edges is dealt to SALTS
tasks, and those partitions can be split again. Edges are written to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.tables import written

SALTS = 4


def salted_join(rows: DataFrame, looked_up: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` inner joined with ``looked_up`` (few rows per key), a hot key's rows dealt to SALTS tasks by ``by``."""
    copies = looked_up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(copies.hint("merge"), [key, "salt"]).drop("salt")


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node m among u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    return salted_join(edges, least.select("u", F.least("u", "w").alias("m")), "u", "v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down)
    return (found.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the least node it can reach."""
    edges = written(edges.where("u <> v"))
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
