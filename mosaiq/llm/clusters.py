"""Similarity clusters by density peaks.

Blocked neighbour joins (operators.blocks) give each vector's local density, the number of points within the link radius:
a pair of vectors counts in one of the blocks where it meets, weighted by the copies of each vector, and the counts of all
blocks are added up. Each block also names, for every vector, the nearest vector in reach with more neighbours there; of
these, the nearest one that is denser by the whole densities is the vector's pointer, and its distance the vector's delta.
A vector without one has no denser record within the radius: it is a peak. Following the pointers, halving the way each
time, labels each vector with its peak.

Clusters are to be joined wherever a link leads across, so peaks whose regions touch in a block are one cluster: the
components of the (peak, group of a block) graph, which has a few edges a peak, are exactly the sets joined by the links
found. No pairs leave a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mosaiq.operators import blocks as V
from mosaiq.operators.components import connected_components
from mosaiq.runtime import cut_lineage

MIN_COSINE = 0.86
MIN_POINTS = 8
PROBES = 7
WIDTH = 2
FOUND = "id long, grp long, near long, target long, cosine float"


def block_groups(block: V.Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, group, near, target, cosine) of the vectors of one block that have a link.

    group is the least id of those joined by links; near the weight of the linked vectors not met in an earlier block;
    target the nearest vector that has more links here, of equally many the one of lesser id first; -1 for none.
    """
    ids, unit, side, size = block.ids, block.unit, block.side, len(block.ids)
    plain = not block.earlier.shape[1] and (block.weight == 1).all()
    links, near, tile = np.zeros(size, np.int64), np.zeros(size, np.int64), V.tile_rows(size)
    for s in range(0, size, tile):  # each pair once: rows with those after them
        e = min(s + tile, size)
        close = unit[s:e] @ unit[s:].T >= least
        close[:, : e - s] = np.triu(close[:, : e - s], 1)
        if side is not None:
            close &= side[s:e, None] != side[None, s:]
        if plain:
            links[s:e] += np.count_nonzero(close, axis=1)
            links[s:] += np.count_nonzero(close, axis=0)
            continue
        r, c = V.places(close)
        r, c = r + s, c + s
        links += np.bincount(r, minlength=size) + np.bincount(c, minlength=size)
        first = block.first_met(r, c)
        r, c = r[first], c[first]
        near += np.bincount(r, block.weight[c], size).astype(np.int64) + np.bincount(c, block.weight[r], size).astype(np.int64)
    near = links if plain else near
    linked = np.nonzero(links)[0]
    if not len(linked):
        return ids[:0], ids[:0], near[:0], ids[:0], np.empty(0, np.float32)
    order = linked[np.lexsort((ids[linked], -links[linked]))]  # most links first
    ids, unit, near, side = ids[order], unit[order], near[order], None if side is None else side[order]
    size = len(ids)
    pointer, peak, nearness, touching, tile = np.arange(size), np.arange(size), np.zeros(size, np.float32), [], V.tile_rows(size)
    for s in range(0, size, tile):
        e = min(s + tile, size)
        cos = unit[s:e] @ unit[:e].T
        cos[np.arange(e) >= np.arange(s, e)[:, None]] = -2
        if side is not None:
            cos[side[s:e, None] == side[None, :e]] = -2
        best = cos.argmax(1)
        nearness[s:e] = cos[np.arange(e - s), best]
        found = nearness[s:e] >= least
        pointer[s:e][found] = best[found]
        peak[s:e] = pointer[s:e]
        while (peak[peak[s:e]] != peak[s:e]).any():  # those of earlier tiles are known
            peak[s:e] = peak[peak[s:e]]
        r, c = V.places((cos >= least) & (peak[s:e, None] != peak[None, :e]))
        if len(r):
            touching.append(np.unique(peak[s + r] * size + peak[c]))
    group = np.arange(size)
    if touching:
        codes = np.unique(np.concatenate(touching))
        a, b = codes // size, codes % size
        while True:
            low = np.minimum(group[a], group[b])
            np.minimum.at(group, group[a], low)
            np.minimum.at(group, group[b], low)
            group = group[group]
            if (group[a] == group[b]).all():
                break
        while (group[group] != group).any():
            group = group[group]
    label = group[peak]
    least_id = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least_id, label, ids)
    return ids, least_id[label], near, np.where(pointer == np.arange(size), -1, ids[pointer]), nearness


def _with_weights(vectors: DataFrame, copies: DataFrame | None) -> DataFrame:
    """(rep, vec, weight): the number of points that carry each vector."""
    if copies is None:
        return vectors.select("rep", "vec", F.lit(1).alias("weight"))
    alone = vectors.where(F.col("top") == F.col("rep")).select("rep", "vec", F.lit(1).cast("long").alias("weight"))
    return alone.unionAll(vectors.join(copies.groupBy("rep").agg(F.count(F.lit(1)).alias("weight")), "rep").select("rep", "vec", "weight"))


def follow_pointers(pointers: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, peak) from (id, up), where a peak points to itself: every round doubles the steps taken."""
    state = cut_lineage(pointers)
    for _ in range(max_rounds):
        further = state.toDF("up", "next")
        state = cut_lineage(state.join(further, "up").select("id", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        if not state.where("moved").limit(1).count():
            return state.select("id", F.col("up").alias("peak"))
        state = state.select("id", "up")
    raise RuntimeError(f"pointers didn't end in {max_rounds} rounds")


def density_peaks(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, density, up, delta) and (id, peak) from what block_groups() gives for all blocks.

    up is the nearest denser vector and delta its distance (1 - cosine); a peak has itself and no delta.
    """
    options = F.collect_set(F.when(F.col("target").isNotNull(), F.struct("cosine", "target")))  # at most one a block of the vector
    one = cut_lineage(found.groupBy("id").agg(F.sum("near").alias("density"), options.alias("options")))
    asked = one.select("id", "density", F.explode("options").alias("x")).select("id", "density", "x.cosine", "x.target")
    whole = one.select(F.col("id").alias("target"), F.col("density").alias("other"))
    denser = (F.col("other") > F.col("density")) | ((F.col("other") == F.col("density")) & (F.col("target") < F.col("id")))
    up = asked.join(whole, "target").where(denser).groupBy("id").agg(F.max(F.struct("cosine", (-F.col("target")).alias("minus"))).alias("best"))
    peaks = cut_lineage(one.select("id", "density").join(up, "id", "left").select("id", "density", F.coalesce(-F.col("best.minus"), "id").alias("up"), (1 - F.col("best.cosine")).alias("delta")))
    return peaks, follow_pointers(peaks.select("id", "up"))


def similarity_clusters(points: DataFrame, key: str = "point_id", vector: str = "image_vec", min_cosine: float = MIN_COSINE, min_points: int = MIN_POINTS, probes: int = PROBES) -> DataFrame:
    """(cluster_key, point_id, density): one row per member of a cluster of at least min_points points.

    Points whose cosine is at least min_cosine are linked; a cluster is a component of that graph, its key the least id.
    density is the number of other points linked to the member. Points without a comparable vector and null ids belong
    to no cluster; repeated rows count once; an empty table gives none.
    """
    packed = V.packed_points(points, key, vector, width=WIDTH)
    vectors = V.distinct_vectors(packed)
    copies = V.copies_of(packed, vectors)

    def work(block: V.Block) -> pa.RecordBatch:
        ids, group, near, target, cosine = block_groups(block, min_cosine)
        alone = target < 0
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(group), pa.array(near), pa.array(target, mask=alone), pa.array(cosine, mask=alone)], names=["id", "grp", "near", "target", "cosine"])

    blocks = V.in_blocks(_with_weights(vectors, copies), probes, with_cells=True)
    found = cut_lineage(V.per_block(blocks, work, FOUND, probes, V.DIM * WIDTH))
    peaks, labels = density_peaks(found)
    regions = found.select("id", "grp").join(labels, "id").select("peak", "grp").distinct()
    component = connected_components(regions, "peak", "grp").toDF("peak", "component")
    labelled = labels.join(component, "peak").join(peaks.select("id", "density"), "id").select("id", "component", "density")
    if copies is not None:
        more = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
        every = copies.select(F.col("id").alias("point"), F.col("rep").alias("id")).join(more.withColumnRenamed("rep", "id"), "id")
        labelled = (
            labelled.join(every, "id", "full")
            .select(F.coalesce("point", "id").alias("id"), F.coalesce("component", "id").alias("component"), (F.coalesce("density", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("density"))
        )
    labelled = cut_lineage(labelled)
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("cluster_key")).where(F.col("n") >= min_points)
    return labelled.join(sizes, "component").select("cluster_key", F.col("id").alias("point_id"), "density")


def describe_clusters(members: DataFrame, posts: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_key, n_points, typical_posts): each cluster's size and its densest members, ties by point_id.

    typical_posts is written 'post_id:point_id density', comma-separated; posts gives the post_id of each point. Only
    `typical` members per partition and cluster are ranked, so a cluster of a third of all points isn't sorted in one task.
    """
    order = [F.desc("density"), F.asc("point_id")]
    part = Window.partitionBy("cluster_key", F.pmod(F.xxhash64("point_id"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("cluster_key").orderBy(*order)
    best = members.withColumn("r", F.row_number().over(part)).where(F.col("r") <= typical).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= typical)
    names = posts.select("point_id", "post_id").groupBy("point_id").agg(F.min("post_id").alias("post_id"))
    text = F.concat("post_id", F.lit(":"), "point_id", F.lit(" "), "density")
    shown = best.join(names, "point_id").groupBy("cluster_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda x: x.t), ",").alias("typical_posts"))
    return members.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n_points")).join(shown, "cluster_key")
