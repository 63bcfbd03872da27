"""Graph-based density clustering: projection, approximate kNN, mutual reachability, components, dendrogram selection.

Neighbours of a point are sought in the blocks of its nearest pivots (operators.blocks), whose size and number don't grow
with the points; a pair of points is told apart by one of the blocks where it meets, and points with the same vector are
scored once. The reference's rule, 64 pivots and a cap on a point's candidates that leaves out the points of high index,
is kept as an option (DensityParams.capped). Everything else is equi-joins and aggregates, but for the dendrogram of a
component, which is made in one task from that component's minimum spanning tree; each task first reduces the edges it
has to such a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from mosaiq.operators import blocks as B
from mosaiq.operators.components import connected_components
from mosaiq.operators.vector import _matrix, dot
from mosaiq.runtime import cut_lineage

# fixed values: the seeds and masks of the reference's sampling
PROJECTION_SEED = 1215765097
PIVOT_MASK = 0xA5A5A5A5A5A5A5A5
_MASK = (1 << 64) - 1
PROBES = 7  # nearest pivots whose blocks a point joins; recall: README
EDGES_HELD = 1_000_000


@dataclass(frozen=True)
class DensityParams:
    """min_samples None means min_cluster_size.

    pivots, top_pivots and max_candidates count only if capped is set: then there are just `pivots` pivots, and a point's
    candidates are cut to the first max_candidates by index, as in the reference.
    """

    min_cluster_size: int = 10
    min_samples: int | None = None
    neighbours: int = 32
    pivots: int = 64
    top_pivots: int = 3
    max_candidates: int = 512
    epsilon: float = 0.05
    seed: int = PROJECTION_SEED
    capped: bool = False
    probes: int = PROBES

    @property
    def k(self) -> int:
        return max(self.neighbours, self.min_samples or self.min_cluster_size)

    def __post_init__(self) -> None:
        if min(self.min_cluster_size, self.neighbours, self.pivots, self.top_pivots, self.max_candidates, self.probes) < 1 or self.epsilon < 0:
            raise ValueError("clustering parameters must be positive")


def splitmix64(x: int) -> int:
    """The public function of that name: a fixed hash of a 64-bit number."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def projection_matrix(source: int, target: int, nnz: int = 2, seed: int = PROJECTION_SEED) -> np.ndarray:
    """Sparse random projection: nnz entries of +-1/sqrt(nnz) a source dimension; place and sign from one hashed word."""
    out = np.zeros((source, target))
    for dim in range(source):
        word = splitmix64(seed ^ dim)
        for slot in range(nnz):
            word = splitmix64(word ^ slot)
            out[dim, word % target] += (1 if word % 2 == 0 else -1) / np.sqrt(nnz)
    return out


def project(points: DataFrame, target: int, vector: str = "image_vec", dim: int = 64, seed: int = PROJECTION_SEED) -> DataFrame:
    """The vectors projected to `target` dimensions and brought to unit length; unchanged if that is their dimension.

    Rows whose vector isn't comparable are left out.
    """
    if target == dim:
        return points
    matrix = projection_matrix(dim, target, seed=seed)
    names = [c for c in points.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _matrix(batch.column(len(names)), dim)
            small = unit @ matrix
            length = np.linalg.norm(small, axis=1, keepdims=True)
            small = (small / np.where(length > 0, length, 1)).astype(np.float32)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * target)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(names))), pa.ListArray.from_arrays(offsets, pa.array(small.ravel()))], names=[*names, vector])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*names).schema.fields)
    return points.select(*names, vector).mapInArrow(run, f"{schema}, `{vector}` array<float>")


def index_points(points: DataFrame, key: str = "point_id", vector: str = "image_vec", dim: int = 64, max_points: int | None = None) -> DataFrame:
    """(idx, id, vec): points with a comparable vector, numbered by id from 0, repeated ids once; vec as its bytes.

    Numbered per range partition, with the partitions' counts added, so no window runs over the whole table.
    max_points, the reading cap of a clustering run, keeps the first by id; by default there is none.
    """
    found = B.packed_points(points, key, vector, dim, _width(points, vector)).groupBy("id").agg(F.min("vec").alias("vec"))
    if max_points is not None:
        found = found.orderBy("id").limit(max_points)
    ranged = cut_lineage(found.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())  # one number a task
    start = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    names = points.sparkSession.createDataFrame(list(zip([p for p, _ in sizes], start)), "part int, first long")
    numbered = ranged.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).join(F.broadcast(names), "part")  # one row a task
    return cut_lineage(numbered.select((F.col("first") + F.col("row")).alias("idx"), "id", "vec"))


def _width(points: DataFrame, vector: str) -> int:
    return 4 if points.schema[vector].dataType.elementType.typeName() == "float" else 8


def _distance_of(dim: int):
    """1 - cosine of two columns of packed vectors, at least 0."""

    @arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.maximum(0, 1 - np.einsum("ij,ij->i", B.unpack(a, dim), B.unpack(b, dim))))

    return distance


def choose_pivots(count: int, pivots: int, seed: int) -> list[int]:
    if pivots >= count:
        return list(range(count))
    chosen: set[int] = set()
    word = splitmix64(seed ^ PIVOT_MASK)
    while len(chosen) < pivots:
        word = splitmix64(word)
        chosen.add(word % count)
    return sorted(chosen)


def approximate_knn(points: DataFrame, params: DensityParams, dim: int = 64) -> DataFrame:
    """(src, dst, rank, dist) of each indexed point's k nearest candidates; dist is 1 - cosine, at least 0.

    A point of fewer than k candidates is given the points that follow by index besides.
    """
    n = points.count()
    k = min(params.k, n - 1)
    if k < 1:
        return points.select(F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(1).alias("rank"), F.lit(0.0).alias("dist")).limit(0)
    rows = points.select(F.col("idx").alias("id"), "vec")
    found = cut_lineage(_capped_neighbours(points.select("idx", "vec"), params, n, k, dim) if params.capped else block_neighbours(rows, k, params.probes, dim))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for x, known in zip(*(c.to_pylist() for c in batch.columns)):
                known, more, step = {x, *(known or ())}, [], 1
                while len(known) + len(more) <= k and step < n:
                    if (y := (x + step) % n) not in known:
                        more.append(y)
                    step += 1
                src += [x] * len(more)
                dst += more
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    enough = found.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("src").alias("id"))
    short = cut_lineage(rows.select("id").join(enough, "id", "left_anti").withColumnRenamed("id", "src"))
    every = found
    if not short.isEmpty():
        known = short.join(found.select("src", "dst"), "src", "left").groupBy("src").agg(F.collect_list("dst").alias("known"))  # fewer than k each
        a, b = rows.toDF("src", "a"), rows.toDF("dst", "b")
        near = _distance_of(dim)
        every = found.unionByName(known.mapInArrow(follow, "src long, dst long").join(a, "src").join(b, "dst").select("src", "dst", near("a", "b").alias("dist")))
    return _nearest_first(every, k)


def nearest_neighbours(df: DataFrame, k: int, key: str = "point_id", vector: str = "image_vec", dim: int = 64, probes: int = PROBES) -> DataFrame:
    """(src, dst, rank, dist): the k nearest others of every row with a key and a comparable vector, ties by key.

    Exact while there are no more pivots than `probes` (some 7,000 vectors); beyond, as far as blocks find them. Of
    repeated keys the least vector counts.
    """
    rows = B.packed_points(df, key, vector, dim, _width(df, vector)).groupBy("id").agg(F.min("vec").alias("vec"))
    return _nearest_first(block_neighbours(cut_lineage(rows), k, probes, dim), k)


def _nearest_first(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("rank") <= k).select("src", "dst", "rank", "dist")


def block_neighbours(rows: DataFrame, k: int, probes: int = PROBES, dim: int = 64) -> DataFrame:
    """(src, dst, dist): the k nearest of all members of the blocks of each (id, vec), or all of them if they are fewer.

    Of rows with the same vector the one of least id stands for all in the blocks.
    """
    classes = cut_lineage(rows.groupBy("vec").agg(F.min("id").alias("rep"), F.max("id").alias("top")))
    near = _nearest_first(_scored_blocks(classes, k, probes, dim), k).drop("rank")
    shared = classes.where(F.col("top") != F.col("rep")).select("vec", "rep")
    if shared.isEmpty():
        return near
    members = cut_lineage(rows.join(shared, "vec").select("id", "rep"))
    part = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("rep").orderBy("id")
    firsts = members.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    firsts = cut_lineage(firsts.groupBy("rep").agg(F.collect_list("id").alias("firsts")))  # k + 1 each
    near = near.join(firsts.withColumnRenamed("rep", "dst"), "dst", "left").select("src", F.explode(F.coalesce("firsts", F.array("dst"))).alias("dst"), "dist")
    near = cut_lineage(_nearest_first(near, k).drop("rank"))
    alone = near.join(firsts.select(F.col("rep").alias("src")), "src", "left_anti")
    others = members.join(near.withColumnRenamed("src", "rep"), "rep").select(F.col("id").alias("src"), "dst", "dist")
    own = members.join(firsts, "rep").select(F.col("id").alias("src"), F.explode("firsts").alias("dst"), F.lit(0.0).alias("dist")).where(F.col("src") != F.col("dst"))
    return alone.unionByName(_nearest_first(others.unionByName(own), k).drop("rank"))


def _scored_blocks(classes: DataFrame, k: int, probes: int, dim: int) -> DataFrame:
    """(src, dst, dist): the k nearest in each block of each of the different vectors, each pair in one block only.

    One of a vector's k nearest is among the k nearest of every block that holds both.
    """

    def score(block: B.Block) -> pa.RecordBatch:
        ids, unit, size, out = block.ids, block.unit, len(block.ids), []
        tile = max(1, B.tile_rows(size) // 2)
        for s in range(0, size, tile):
            e = min(s + tile, size)
            far = np.maximum(0, 1 - unit[s:e] @ unit.T)
            far[np.arange(e - s), np.arange(s, e)] = np.inf
            if block.side is not None:
                far[block.side[s:e, None] == block.side[None, :]] = np.inf
            most = min(k, size - 1)
            edge = np.partition(far, most - 1, axis=1)[:, most - 1, None]
            r, c = np.divmod(np.flatnonzero((far <= edge) & (far < np.inf)), size)  # more than k where some tie
            dist = far[r, c]
            order = np.lexsort((ids[c], dist, r))
            first = np.searchsorted(r, np.arange(e - s))
            keep = order[np.arange(len(r)) - first[r] < most]
            out.append((s + r[keep], c[keep], dist[keep]))
        r, c, dist = (np.concatenate(x) for x in zip(*out))
        first = block.first_met(r, c)
        return pa.RecordBatch.from_arrays([pa.array(ids[r[first]]), pa.array(ids[c[first]]), pa.array(dist[first])], names=["src", "dst", "dist"])

    def code_bytes() -> int:
        found = classes.select(F.length("vec")).first()  # all are of one length
        return found[0] if found else 0

    return B.per_block(B.in_blocks(classes, probes, dim, with_cells=True), score, "src long, dst long, dist double", probes, code_bytes(), dim)


def _capped_neighbours(rows: DataFrame, params: DensityParams, n: int, k: int, dim: int) -> DataFrame:
    """(src, dst, dist): as _bucket_neighbours, of the first max_candidates members by index only.

    No bucket is needed beyond its first max_candidates + 1 members, so these are broadcast.
    """
    chosen = rows.sparkSession.createDataFrame([(x,) for x in choose_pivots(n, min(params.pivots, n), params.seed)], "idx long")
    pivots = B.unpack(rows.join(F.broadcast(chosen), "idx").orderBy("idx").select("vec").toArrow().column(0), dim)  # `pivots` rows
    tops, cap = min(params.top_pivots, len(pivots)), params.max_candidates

    def nearest(unit: np.ndarray) -> np.ndarray:
        far = np.maximum(0, 1 - unit @ pivots.T)
        return np.argsort(far, axis=1, kind="stable")[:, :tops]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, unit = batch.column(0).to_numpy(), B.unpack(batch.column(1), dim)
            slots = nearest(unit)
            yield pa.RecordBatch.from_arrays([pa.array(slots.ravel().astype(np.int32)), pa.array(np.repeat(idx, tops))], names=["slot", "idx"])

    slots = rows.mapInArrow(assign, "slot int, idx long")
    part = Window.partitionBy("slot", F.pmod("idx", F.lit(64))).orderBy("idx")
    whole = Window.partitionBy("slot").orderBy("idx")
    heads = slots.withColumn("r", F.row_number().over(part)).where(F.col("r") <= cap + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= cap + 1).select("slot", "idx")
    table = heads.join(rows, "idx").orderBy("slot", "idx").toArrow()  # at most pivots * (cap + 1) rows
    slot, head = table["slot"].to_numpy(), table["idx"].to_numpy()
    unit = B.unpack(table["vec"], dim)
    cuts = np.searchsorted(slot, np.arange(len(pivots) + 1))
    shared = rows.sparkSession.sparkContext.broadcast((head, unit, cuts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, unit, cuts = shared.value
        for batch in batches:
            idx, own = batch.column(0).to_numpy(), B.unpack(batch.column(1), dim)
            src, dst, dist = [], [], []
            for x, v, mine in zip(idx.tolist(), own, nearest(own)):
                rows = np.concatenate([np.arange(cuts[s], cuts[s + 1]) for s in mine])
                members = head[rows]
                _, first = np.unique(members, return_index=True)
                keep = np.sort(first[members[first] != x])[:cap]
                found = members[keep]
                far = np.maximum(0, 1 - unit[rows[keep]] @ v)
                best = np.lexsort((found, far))[:k]
                src += [x] * len(best)
                dst.append(found[best])
                dist.append(far[best])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(np.concatenate(dst)), pa.array(np.concatenate(dist))], names=["src", "dst", "dist"])

    return rows.mapInArrow(score, "src long, dst long, dist double")


def core_distances(knn: DataFrame) -> DataFrame:
    """(idx, core): the distance to the last of each point's neighbours."""
    return knn.groupBy(F.col("src").alias("idx")).agg(F.max("dist").alias("core"))


def mutual_reachability(knn: DataFrame, core: DataFrame, epsilon: float) -> DataFrame:
    """(u, v, weight), u < v: max(core u, core v, distance + epsilon), the least of repeated edges."""
    a, b = core.toDF("src", "core_a"), core.toDF("dst", "core_b")
    edges = knn.join(a, "src").join(b, "dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.greatest("core_a", "core_b", F.col("dist") + epsilon).alias("weight"))
    return dedupe_edges(edges)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").agg(F.min("weight").alias("weight"))


class _Sets:
    """Disjoint sets of row numbers."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root


def spanning_tree(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Row numbers of the minimum spanning forest, by (weight, u, v): in each round every tree takes its least edge out."""
    ends, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.lexsort((v, u, weight))
    a, b = codes[: len(u)][order], codes[len(u) :][order]  # from here on edges are numbered by rank
    tree, at, kept, none = np.arange(len(ends)), np.arange(len(order)), [], len(order)
    while True:
        x, y = tree[a[at]], tree[b[at]]
        across = x != y
        at, x, y = at[across], x[across], y[across]
        if not len(at):
            return np.sort(order[np.unique(np.concatenate(kept))]) if kept else order[:0]
        least = np.full(len(ends), none)
        np.minimum.at(least, x, at)
        np.minimum.at(least, y, at)
        roots = np.nonzero(least < none)[0]
        taken = least[roots]
        kept.append(taken)
        parent = np.arange(len(ends))
        p, q = tree[a[taken]], tree[b[taken]]
        parent[roots] = np.where(p == roots, q, p)
        both = parent[parent[roots]] == roots  # two trees that take the same edge
        parent[roots] = np.where(both & (roots < parent[roots]), roots, parent[roots])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        tree = parent[tree]


def select_clusters(u: np.ndarray, v: np.ndarray, weight: np.ndarray, min_size: int) -> list[np.ndarray]:
    """Members of the clusters of one connected component, from its edges.

    Merging by (weight, u, v) gives a binary tree. A node's score is its size times the distance between its own merge
    and its parent's; from the leaves up, a node of at least min_size members is taken over its descendants if it scores
    no less than they do together. The root is never taken.
    """
    rows = spanning_tree(u, v, weight)
    rows = rows[np.lexsort((v[rows], u[rows], weight[rows]))]
    ends, codes = np.unique(np.concatenate([u[rows], v[rows]]), return_inverse=True)
    n = len(ends)
    if n < min_size or not len(rows):
        return []
    a, b, w = codes[: len(rows)].tolist(), codes[len(rows) :].tolist(), weight[rows].tolist()
    sets, node_of = _Sets(n), list(range(n))
    size, height, children = [1] * n, [0.0] * n, [None] * n
    for x, y, far in zip(a, b, w):
        x, y = sets.find(x), sets.find(y)
        left, right = node_of[x], node_of[y]
        sets.parent[y] = x
        node_of[x] = len(size)
        size.append(size[left] + size[right])
        height.append(far)
        children.append((left, right))
    root = len(size) - 1
    above = [0.0] * len(size)
    for node in range(root, n - 1, -1):  # parents have greater numbers
        for child in children[node]:
            above[child] = height[node]
    taken, score = [False] * len(size), [0.0] * len(size)
    for node in range(len(size)):
        if size[node] < min_size:
            continue
        below = sum(score[c] for c in children[node] or ())
        own = max(above[node] - height[node], 0.0) * size[node] if node != root else -np.inf
        taken[node] = own >= below
        score[node] = max(own, 0.0) if taken[node] else below
    out, todo = [], [(root, False)]
    while todo:
        node, _ = todo.pop()
        if taken[node]:
            leaves, inner = [], [node]
            while inner:
                x = inner.pop()
                inner.extend(children[x] or ())
                if children[x] is None:
                    leaves.append(x)
            if len(leaves) >= min_size:
                out.append(ends[leaves])
        elif children[node]:
            todo += [(c, False) for c in children[node]]
    return out


def cluster_labels(points: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """(idx, id, label) of all indexed points; label is a dense rank of clusters by least member, -1 for noise."""
    schema = edges.select("u", "v", "weight").schema

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def smaller() -> list[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            return whole.take(pa.array(spanning_tree(*(whole[c].to_numpy() for c in ("u", "v", "weight"))))).to_batches()

        limit = EDGES_HELD
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > limit:
                held = smaller()
                limit = EDGES_HELD + 2 * sum(x.num_rows for x in held)
        if held:
            yield from smaller()

    fewer = cut_lineage(edges.select("u", "v", "weight").mapInArrow(reduce, schema))
    component = connected_components(fewer)

    def clusters(rows: pd.DataFrame) -> pd.DataFrame:
        found = select_clusters(rows.u.to_numpy(), rows.v.to_numpy(), rows.weight.to_numpy(), min_size)
        return pd.DataFrame({"idx": np.concatenate(found) if found else np.empty(0, np.int64), "least": np.concatenate([np.full(len(c), c.min()) for c in found]) if found else np.empty(0, np.int64)})

    grouped = fewer.join(component.withColumnRenamed("vertex", "u"), "u").groupBy("component").applyInPandas(clusters, "idx long, least long")
    grouped = cut_lineage(grouped)
    names = grouped.select("least").distinct().withColumn("label", (F.row_number().over(Window.orderBy("least")) - 1).cast("int"))  # one row a cluster
    return points.select("idx", "id").join(grouped.join(names, "least").select("idx", "label"), "idx", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


class TooFewPoints(ValueError):
    """Fewer points than the least cluster size."""


def density_clusters(points: DataFrame, params: DensityParams = DensityParams(), key: str = "point_id", vector: str = "image_vec", dim: int = 64, target_dim: int | None = None, max_points: int | None = None) -> DataFrame:
    """(idx, id, label) of all points with a comparable vector. None of them gives none; fewer than min_cluster_size raise."""
    if target_dim and target_dim != dim:
        points, dim = project(points.select(key, vector), target_dim, vector, dim, params.seed), target_dim
    indexed = index_points(points, key, vector, dim, max_points)
    n = indexed.count()
    if 0 < n < params.min_cluster_size:
        raise TooFewPoints(f"{n} points, {params.min_cluster_size} needed")
    knn = cut_lineage(approximate_knn(indexed, params, dim))
    return cluster_labels(indexed, mutual_reachability(knn, core_distances(knn), params.epsilon), params.min_cluster_size)


def _unit_sum(vectors: DataFrame, label: Column, vector: Column) -> DataFrame:
    """(label, centroid, n): unit vector of the sum of each label's vectors, added up per dimension with partial sums."""
    cells = vectors.select(label.alias("label"), F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("pos", "x"))
    sums = cells.groupBy("label", "pos").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("s"))  # one entry a dimension
    size = F.sqrt(dot(F.col("s"), F.col("s")))
    return whole.select("label", F.when(size > 0, F.transform("s", lambda x: x / size)).otherwise(F.col("s")).alias("centroid"))


def member_similarity(members: DataFrame, key: str = "id", label: str = "label", vector: str = "image_vec") -> DataFrame:
    """(label, key, similarity) of every member to its cluster's centroid; noise (label -1) is left out."""
    rows = members.where(F.col(label) >= 0)
    centroids = _unit_sum(rows, F.col(label), F.col(vector))
    return rows.select(F.col(label).alias("label"), key, vector).join(centroids, "label").select("label", key, dot(F.col(vector), F.col("centroid")).alias("similarity"))


def cluster_summary(members: DataFrame, key: str = "id", label: str = "label", vector: str = "image_vec") -> DataFrame:
    """(label, size, cohesion, representative): mean similarity to the centroid, and the most similar member.

    Rows with equal similarity are told apart by the key.
    """
    near = member_similarity(members, key, label, vector)
    return near.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("similarity").alias("cohesion"), F.max_by(key, F.struct(F.col("similarity"), -F.col(key))).alias("representative"))


def cluster_preview(members: DataFrame, key: str = "id", label: str = "label", vector: str = "image_vec", preview: int = 5) -> DataFrame:
    """(label, rank, key, similarity): the representative and the next `preview` members of each cluster.

    Ranked in 64 parts of each cluster first, so that no task sorts a whole large cluster.
    """
    near = member_similarity(members, key, label, vector)
    order = [F.desc("similarity"), F.asc(key)]
    part, whole = Window.partitionBy("label", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(*order), Window.partitionBy("label").orderBy(*order)
    kept = near.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= preview + 1).withColumn("rank", F.row_number().over(whole))
    return kept.where(F.col("rank") <= preview + 1)


def rank_clusters(summary: DataFrame, top: int) -> DataFrame:
    return summary.orderBy(F.desc("cohesion"), F.desc("size"), "label").limit(top)


def all_loose(summary: DataFrame, least: float = 0.75) -> DataFrame:
    """One row: whether every cluster's cohesion is below `least`; null without clusters."""
    return summary.agg(F.bool_and(F.col("cohesion") < least).alias("all_loose"))
