"""Vector functions and search over a points table with a `image_vec` column of unit or arbitrary length.

Scores are cosines in double precision. A query vector is a small constant of the plan; scoring is one Arrow-batched
matrix product per batch, filters and column pruning reach the scan, and top-k is a partial top-k per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import arrow_udf

LEAST_NORM = 1e-9
LEAST_SQUARED_QUERY = 1e-6


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns in double precision, summed in order; for few rows or two columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector, or the vector itself if its length is at most LEAST_NORM."""
    size = norm(a)
    return F.when(size > LEAST_NORM, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def blend(text: Column, image: Column, weight: float) -> Column:
    """Unit vector of (1 - weight) * text + weight * image."""
    return l2_normalize(F.zip_with(text, image, lambda t, i: F.lit(1.0 - weight) * t.cast("double") + F.lit(weight) * i.cast("double")))


def effective_weight(has_text: bool, has_image: bool, asked: float) -> float:
    """The image's weight: 0 with text only, 1 with an image only, else as asked."""
    if not has_text and not has_image:
        raise ValueError("a search needs a text or an image")
    return asked if has_text and has_image else float(has_image)


def check_query(vector: Sequence[float], dim: int | None = None) -> list[float]:
    """The query as a list of doubles; raises if it isn't finite, nearly zero or of the wrong length."""
    out = [float(x) for x in vector]
    if dim is not None and len(out) != dim:
        raise ValueError(f"query has {len(out)} dimensions, not {dim}")
    if not all(map(math.isfinite, out)):
        raise ValueError("query isn't finite")
    if sum(x * x for x in out) <= LEAST_SQUARED_QUERY:
        raise ValueError("query is nearly zero")
    return out


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with `dim` finite numbers, not all zero, and those vectors, of unit length."""
    offsets = column.offsets.to_numpy()
    rows = np.nonzero((np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False))[0]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    found = values[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    length = np.sqrt((found * found).sum(1))
    good = np.isfinite(length) & (length > 0)
    return rows[good], found[good] / length[good, None]


def cosine_to(query: Sequence[float], vector: Column) -> Column:
    """Cosine to a constant vector; null where the vector isn't comparable."""
    unit = np.array(check_query(query))
    unit = unit / np.linalg.norm(unit)

    @arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        rows, found = _matrix(vectors, len(unit))
        out[rows] = found @ unit
        return pa.array(out, mask=np.isnan(out))

    return score(vector)


def cosine_between(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two vector columns row by row; null where either isn't comparable or the lengths differ."""
    out = np.full(len(a), np.nan)
    sizes = [np.where(x.is_valid().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy()), -1) for x in (a, b)]
    for dim in np.unique(sizes[0][(sizes[0] == sizes[1]) & (sizes[0] > 0)]).tolist():
        (rows_a, unit_a), (rows_b, unit_b) = _matrix(a, dim), _matrix(b, dim)
        both, at, other = np.intersect1d(rows_a, rows_b, assume_unique=True, return_indices=True)
        out[both] = np.einsum("ij,ij->i", unit_a[at], unit_b[other])
    return pa.array(out, mask=np.isnan(out))


def register_sql(spark: SparkSession) -> None:
    """Makes cosine_similarity(a, b) a function of the session's SQL."""
    spark.udf.register("cosine_similarity", arrow_udf(cosine_between, "double"))


def best_scored(scored: DataFrame, limit: int) -> DataFrame:
    """The `limit` rows of highest score, ties by point_id; rows without a score are left out."""
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "point_id").limit(max(limit, 0))


def search(points: DataFrame, query: Sequence[float], limit: int = 10, sites: Sequence[str] = ()) -> DataFrame:
    """The `limit` points of highest cosine, of the given sites if any, ties by point_id. Limit 0 gives none."""
    found = points.where(F.col("site").isin(list(sites))) if sites else points
    return best_scored(found.withColumn("score", cosine_to(query, F.col("image_vec"))).drop("image_vec"), limit)


class NotFound(LookupError):
    """A post asked for isn't there."""


def search_similar(points: DataFrame, site: str, post_id: int, limit: int = 10) -> DataFrame:
    """The posts of the same site most similar to a post, without itself; raises NotFound if it has no vector here."""
    own = points.where((F.col("site") == site) & (F.col("post_id") == post_id)).select("image_vec").limit(1).collect()
    if not own or own[0][0] is None:
        raise NotFound(f"{site} {post_id} not found")
    return search(points.where(F.col("post_id") != post_id), own[0][0], limit, [site])


def batch_knn(queries: DataFrame, points: DataFrame, k: int, key: str = "point_id", vector: str = "image_vec", dim: int = 64, block: int = 4096) -> DataFrame:
    """(query, rank, other, cosine): the k points of highest cosine of each query row, without itself, ties by id.

    Both sides are packed into blocks of up to `block` unit vectors; each pair of blocks is one matrix product, after
    which only k rows a query and block are left. The query set must be stated, as all blocks meet. Rows without a
    comparable vector or a null key give nothing; a repeated key counts once in each block.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list[np.ndarray] = []
            units: list[np.ndarray] = []

            def take() -> pa.RecordBatch:
                i, u = np.concatenate(ids), np.concatenate(units).astype("<f8")
                ids.clear()
                units.clear()
                return pa.RecordBatch.from_arrays([pa.array([i.tobytes()], pa.binary()), pa.array([u.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_units"])

            for batch in batches:
                rows, unit = _matrix(batch.column(1), dim)
                for s in range(0, len(rows), block):
                    ids.append(batch.column(0).to_numpy()[rows[s : s + block]])
                    units.append(unit[s : s + block])
                    if sum(map(len, ids)) >= block:
                        yield take()
            if ids:
                yield take()

        source = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
        return source.mapInArrow(run, f"{name}_ids binary, {name}_units binary")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_ids, a_units, b_ids, b_units in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a_ids, np.int64), np.frombuffer(b_ids, np.int64)
                cos = np.frombuffer(a_units).reshape(-1, dim) @ np.frombuffer(b_units).reshape(-1, dim).T
                cos[a[:, None] == b[None, :]] = -2
                if len(b) > k:
                    edge = np.partition(cos, len(b) - k, axis=1)[:, len(b) - k, None]
                    r, c = np.nonzero((cos >= edge) & (cos > -2))
                else:
                    r, c = np.nonzero(cos > -2)
                score, order = cos[r, c], np.lexsort((b[c], -cos[r, c], r))
                r, c, score = r[order], c[order], score[order]
                first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.empty(0, bool)
                place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else r
                keep = place < k
                yield pa.RecordBatch.from_arrays([pa.array(a[r[keep]]), pa.array(b[c[keep]]), pa.array(score[keep])], names=["query", "other", "cosine"])

    met = packed(queries, "a").crossJoin(packed(points, "b"))
    found = met.mapInArrow(best, "query long, other long, cosine double").dropDuplicates(["query", "other"])
    rank = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def quantize_int8(vector: Column, dim: int = 64) -> Column:
    """array<tinyint>: the vector scaled to its largest coordinate and rounded to 8 bits; null if it isn't comparable."""

    @arrow_udf("array<tinyint>")
    def quantize(vectors: pa.Array) -> pa.Array:
        rows, unit = _matrix(vectors, dim)
        codes = np.rint(unit * (127 / np.abs(unit).max(1, keepdims=True, initial=1e-300))).astype(np.int8)
        missing = np.ones(len(vectors), bool)
        missing[rows] = False
        offsets = np.concatenate([[0], np.cumsum(~missing) * dim]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()), mask=pa.array(missing))

    return quantize(vector)


def _code_error(code: Column) -> Column:
    """The most that the cosine to a code of quantize_int8 may differ from the one to its vector.

    Rounding moves each coordinate by 1/2 at most, so the sine r of the angle between both is at most half the root of the
    dimensions over the code's length, and their unit vectors are at most r / cos(angle / 2) apart, below r + r^3 up to 1/2.
    """

    @arrow_udf("double")
    def error(codes: pa.Array) -> pa.Array:
        sizes, values = np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy().astype(np.float64)
        sums = np.concatenate([[0], np.cumsum(values * values)])
        ends = np.cumsum(np.where(codes.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        r = np.sqrt((ends - starts) / 4 / np.maximum(sums[ends] - sums[starts], 1e-300))
        return pa.array(np.where(r <= 0.5, r + r**3, 2.0) + 1e-9)

    return error(code)


def search_quantized(points: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """Two-stage search, as exact as search(): by 8-bit codes (`code`, of quantize_int8), rescored on `image_vec`.

    Rescored is every row whose score may reach the limit-th best, given the error of the codes.
    """
    coarse = points.withColumn("__coarse", cosine_to(query, F.col("code"))).where(F.col("__coarse").isNotNull()).withColumn("__error", _code_error(F.col("code")))
    low, high = F.col("__coarse") - F.col("__error"), F.col("__coarse") + F.col("__error")
    least = coarse.select(low.alias("__least")).orderBy(F.desc("__least")).limit(max(limit, 0)).agg(F.min("__least").alias("__least"))  # one row
    near = coarse.crossJoin(F.broadcast(least)).where(high >= F.col("__least"))
    return search(near.drop("__coarse", "__error", "__least", "code"), query, limit)
