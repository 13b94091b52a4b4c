"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pubweave.llm.common import lookup, saved

#: Up to so many links are handled in one partition, which spares their shuffles.
FEW_LINKS = 100_000


def _least_neighbour(pairs: DataFrame, few: bool) -> DataFrame:
    """(u, v) with m, the least v of u; a hub with many links is no bottleneck."""
    if few:
        return pairs.withColumn("m", F.min("v").over(W.partitionBy("u")))
    least = saved(
        pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least"
    )
    return lookup(pairs, least, "u", "n")


def _each(df: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    """Several (u, v) from every row."""
    items = F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in pairs])
    return df.select(F.inline(items))


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest reachable id) of every id that ``links`` names.

    ``links`` has columns a and b, in any direction and repeated at will.  Large
    and small stars alternate: every node hangs its larger neighbours, then its
    smaller ones, below the smallest, until the forest has become stars.
    """
    edges = saved(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").distinct(),
        "links",
    )
    few = edges.count() <= FEW_LINKS
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    before = None
    while True:
        if few:
            edges = edges.coalesce(1)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = _each(edges, (u, v), (v, u))
        large = _least_neighbour(both, few).filter("v > u").select(
            v.alias("u"), F.least("u", "m").alias("v")
        ).distinct()
        if not few:
            large = saved(large, "large-star")
        small = _each(_least_neighbour(large, few), (u, m), (v, m)).filter("u <> v")
        edges = saved(small.distinct(), "small-star")
    roots = edges.select(v.alias("id"), v.alias("component")).distinct()
    return edges.toDF("id", "component").unionByName(roots)
