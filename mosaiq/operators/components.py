"""Connected components of an undirected graph given as an edge table, by alternating large-star and small-star steps.

Nothing but two counters per round reaches the driver. Each round shuffles the edges on their ends; minima are combined
map-side, and AQE splits the join of a vertex with very many edges. Rounds are cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.runtime import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), v < u. Large: every larger neighbour of a vertex is linked to its least one; small: every smaller."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 64) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is the least vertex of its component.

    Edges may repeat, stand in either direction or be loops; a vertex with loops only is its own component. Null ends
    are ignored. No edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    clean = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    clean = cut_lineage(clean.distinct())
    state, known = clean.where(F.col("u") != F.col("v")), None
    for _ in range(max_rounds):
        state = cut_lineage(_star(_star(state, True), False))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    labelled = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "vertex")
    roots = state.select(F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    alone = clean.where(F.col("u") == F.col("v")).select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    return labelled.unionAll(roots).unionAll(alone).groupBy("vertex").agg(F.min("component").alias("component"))
