"""Connected components of a table of links, by alternating stars; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or smaller) neighbour of a node to the least node among its neighbours and itself. The least is a sum by key, so a node with very many neighbours isn't gathered."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        # one row for each link at most; the star of the smaller neighbours that follows makes them distinct
        return joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
    out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, comp) for every node of links (a, b): comp is the least node that can be reached."""
    edges = common.stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    digest = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).alias("d")
    last = edges.agg(digest).first().d
    for _ in range(rounds):
        if not last.n:
            break
        new = common.stash(_star(_star(edges, True), False), "edges")
        common.drop(edges)
        edges, before, last = new, last, new.agg(digest).first().d
        if last == before:
            break
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("b").alias("fp"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("fp"), F.col("a").alias("comp")).distinct())
