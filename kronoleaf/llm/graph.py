"""Connected components by alternating large and small stars, over checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _edge(u: Column, v: Column) -> Column:
    return F.struct(u.alias("u"), v.alias("v"))


def all_stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour and no greater one, or only greater ones; edges are distinct with u > v."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not roles.agg(F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.lit(False))).first()[0]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every linked node but the roots, with the least node reachable; links has long columns a and b.

    Each half-round is an aggregate and a join on the centre's key, so a node with
    very many links is combined before its shuffle and its join can be split. Rounds
    end when each component is a star around its least node, which one aggregate tells.
    No links give no rows; links of a node with itself and repeated links are ignored.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    for _ in range(rounds):
        if all_stars(edges):
            return edges.select(u.alias("node"), v.alias("root"))
        both = edges.select(F.inline(F.array(_edge(u, v), _edge(v, u))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(v.alias("u"), m.alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(least, "u").select(F.inline(F.array(_edge(u, m), _edge(v, m)))).where("u != v").distinct().checkpoint()
    raise RuntimeError(f"components are still open after {rounds} rounds")
