"""Most similar vectors of every vector: adaptive dimension scan.

Vectors are randomly rotated (blocks.pack), so any block of columns is a fair sample of a difference. In each probed
list (blocks.in_blocks) the squared distances to all members are built up column block by column block; after each, a
hypothesis test abandons the pairs whose partial distance is too large for a full one within the bound: with d of D
columns, partial > bound * d/D * (1 + SIGMA/sqrt(d))^2. Rows that keep many candidates, as in dense groups, finish them
by one matrix product; the others pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mosaiq.operators import blocks as V

K = 5
MIN_COSINE = 0.90
PROBES = 5
SIGMA = 3.0
COLUMNS = 16
MANY = 48
WIDTH = 3


def scan_list(ids: np.ndarray, unit: np.ndarray, k: int, least: float, sigma: float = SIGMA, columns: int = COLUMNS, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine): for each vector of a list its k most similar others of at least `least`, ties by id.

    Ids are distinct and in order. If side is given, only vectors of different sides are compared.
    """
    size, dim = unit.shape
    bound = 2 - 2 * least
    limit = lambda d: bound * d / dim * (1 + sigma / np.sqrt(d)) ** 2 if d < dim else bound
    head = np.ascontiguousarray(unit[:, :columns])
    length = (head * head).sum(1)
    # |x|^2 + |y|^2 - 2xy <= limit as one product of rows with two columns more: xy - |y|^2/2 - (|x|^2 - limit)/2 >= 0
    one = np.ones(size, np.float32)
    left = np.column_stack([head, one, (min(limit(columns), bound) - length) / 2]).astype(np.float32)
    right = np.ascontiguousarray(np.column_stack([head, -length / 2, one]).astype(np.float32).T)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    tile = V.tile_rows(size)
    for s in range(0, size, tile):
        e = min(s + tile, size)
        kept = left[s:e] @ right >= 0
        kept[np.arange(e - s), np.arange(s, e)] = False
        if side is not None:
            kept &= side[s:e, None] != side[None, :]
        count = np.count_nonzero(kept, axis=1)
        many = np.nonzero(count > MANY)[0]
        if len(many):
            into = np.nonzero(kept[many].any(0))[0]
            cos = unit[s + many] @ unit[into].T
            cos[into[None, :] == (s + many)[:, None]] = -2
            if side is not None:
                cos[side[s + many][:, None] == side[into][None, :]] = -2
            if len(into) > k:
                # all that tie with the k-th best are kept for the choice by id
                edge = np.partition(cos, len(into) - k, axis=1)[:, len(into) - k]
            else:
                edge = np.full(len(many), -1.0, cos.dtype)
            r, c = V.places(cos >= np.maximum(edge, np.float32(least))[:, None])
            out.append((s + many[r], into[c], cos[r, c]))
            kept[many] = False
        r, c = V.places(kept)
        if len(r):
            r = r + s
            done, partial = columns, np.zeros(len(r), np.float32)
            partial = ((head[r] - head[c]) ** 2).sum(1)
            while done < dim and len(r):
                upto = min(done + columns, dim)
                partial += ((unit[r, done:upto] - unit[c, done:upto]) ** 2).sum(1)
                done = upto
                stay = partial <= (min(limit(done), bound) if done < dim else bound)
                r, c, partial = r[stay], c[stay], partial[stay]
            out.append((r, c, 1 - partial / 2))
    if not out:
        return ids[:0], ids[:0], np.empty(0)
    r, c, cos = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((ids[c], -cos, r))
    r, c, cos = r[order], c[order], cos[order]
    start = np.concatenate([[True], r[1:] != r[:-1]])
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0))
    r, c = r[place < k], c[place < k]
    # the same sum for a pair in every list, so that it counts once
    return ids[r], ids[c], np.einsum("ij,ij->i", unit[r], unit[c], dtype=np.float64)


def _first_members(copies: DataFrame, count: int) -> DataFrame:
    """(rep, firsts): the `count` least ids of each group of copies, found in salted parts first."""
    part = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("rep").orderBy("id")
    least = copies.withColumn("r", F.row_number().over(part)).where(F.col("r") <= count).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= count)
    return least.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("firsts"))


def most_similar(posts: DataFrame, key: str = "point_id", vector: str = "image_vec", k: int = K, min_cosine: float = MIN_COSINE, probes: int = PROBES) -> DataFrame:
    """(point, other, cosine, place): the k other points of highest cosine of every point, of those at least min_cosine.

    Ties go to the lesser id. Points without a comparable vector, null ids and repeated rows give nothing of their own;
    copies of one vector are each other's neighbours with cosine 1.
    """
    packed = V.packed_points(posts, key, vector, width=WIDTH)
    vectors = V.distinct_vectors(packed)

    def work(block: V.Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, scan_list(block.ids, block.unit, k, min_cosine, side=block.side))], names=["a", "b", "cosine"])

    found = V.per_block(V.in_blocks(vectors, probes), work, "a long, b long, cosine double", probes, V.DIM * WIDTH)
    # at most k candidates a vector and block
    near = found.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "b"))), 1, k).alias("best"))
    copies = V.copies_of(packed, vectors)
    if copies is None:
        return near.select(F.col("a").alias("point"), F.posexplode("best").alias("place", "x")).select("point", F.col("x.b").alias("other"), (-F.col("x.far")).alias("cosine"), (F.col("place") + 1).alias("place"))
    firsts = _first_members(copies, k + 1)
    others = near.select("a", F.explode("best").alias("x")).select("a", "x.far", F.col("x.b").alias("rep")).join(firsts, "rep", "left")
    others = others.select("a", F.explode(F.transform(F.coalesce("firsts", F.array("rep")), lambda y: F.struct(F.col("far").alias("far"), y.alias("b")))).alias("x"))
    others = others.groupBy("a").agg(F.array_sort(F.collect_set("x")).alias("best"))
    ids = vectors.where(F.col("top") == F.col("rep")).select(F.col("rep").alias("id"), "rep").unionAll(copies)
    own = ids.join(others.withColumnRenamed("a", "rep"), "rep", "left").join(firsts, "rep", "left")
    mine = F.transform(F.filter(F.coalesce("firsts", F.array().cast("array<bigint>")), lambda y: y != F.col("id")), lambda y: F.struct(F.lit(-1.0).alias("far"), y.alias("b")))
    best = F.slice(F.array_sort(F.concat(mine, F.coalesce("best", F.array().cast("array<struct<far:double,b:bigint>>")))), 1, k)
    return own.select(F.col("id").alias("point"), F.posexplode(best).alias("place", "x")).select("point", F.col("x.b").alias("other"), (-F.col("x.far")).alias("cosine"), (F.col("place") + 1).alias("place"))


def neighbour_pairs(similar: DataFrame) -> DataFrame:
    """(point_a, point_b), point_a < point_b: pairs of which at least one takes the other."""
    return similar.select(F.least("point", "other").alias("point_a"), F.greatest("point", "other").alias("point_b")).distinct()
