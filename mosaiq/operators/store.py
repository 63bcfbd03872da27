"""The points table: Parquet, partitioned by site namespace, one row per point.

What an upsert writes becomes visible by one atomic rename of a manifest; a lost executor or driver leaves the old state
whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mosaiq.functions.columns import shown_image
from mosaiq.runtime import read_text, replace_text, ship_package

MANIFEST = "_current.json"
ORDER = "batch_order"
COMPACT_AFTER = 8


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last by `order`. Rows with a null in the key are left out."""
    kept = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    last = Window.partitionBy(*key).orderBy(*order)
    return kept.withColumn("__n", F.row_number().over(last)).where(F.col("__n") == 1).drop("__n")


def latest_by_aggregate(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """As latest() by one ascending number, but combined map-side, so that a key of a third of all rows does no harm."""
    others = [c for c in rows.columns if c != key]
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__row"))
    return found.select(key, "__row.*")


def latest_values(rows: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """key and, for each name, the value in the key's row of the greatest order.

    Only what is asked for is read and shuffled; numbers are combined by a hash aggregate, without a sort.
    """
    names = [f"__{k}" for k in range(len(values))]
    narrow = rows.where(F.col(key).isNotNull()).select(key, F.col(order).alias("__order"), *(v.alias(n) for n, v in zip(names, values.values())))
    return narrow.groupBy(key).agg(*(F.max_by(n, "__order").alias(name) for n, name in zip(names, values))) if values else narrow.select(key).distinct()


class PointStore:
    """upsert(), points() and lookups over one table. The folder is on storage that all executors share.

    The manifest names, for each site namespace, a base and the deltas after it. An upsert only adds a delta of the
    batch's own rows; a reader resolves the last row per point where there are deltas. After COMPACT_AFTER deltas a
    namespace is written anew as one base, so a batch rewrites old rows once in that many times.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.folder, self.compact_after = spark, folder, compact_after
        ship_package(spark)

    def _manifest(self) -> dict[str, list[str]]:
        return json.loads(read_text(self.spark, f"{self.folder}/{MANIFEST}") or "{}")

    def _commit(self, manifest: dict[str, list[str]]) -> None:
        replace_text(self.spark, f"{self.folder}/{MANIFEST}", json.dumps(manifest, sort_keys=True, indent=1))

    def _resolved(self, chains: list[list[str]]) -> DataFrame:
        """Last row per point over bases and their deltas; `order` first, then the later delta."""
        rows = None
        for step in range(max(map(len, chains))):
            paths = [f"{self.folder}/{c[step]}" for c in chains if len(c) > step]
            part = self.spark.read.parquet(*paths).withColumn("__step", F.lit(step))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return latest_by_aggregate(rows, "point_id", F.struct(ORDER, "__step")).drop("__step")  # a null comes first

    def points(self) -> DataFrame | None:
        """All current points; None before the first upsert."""
        manifest = self._manifest()
        plain = [f"{self.folder}/{c[0]}" for _, c in sorted(manifest.items()) if len(c) == 1]
        found = [self.spark.read.parquet(*plain)] if plain else []
        chains = [c for c in manifest.values() if len(c) > 1]
        found += [self._resolved(chains)] if chains else []
        if not found:
            return None
        return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)

    def _write(self, rows: DataFrame) -> str:
        version = f"v={uuid.uuid4().hex}"
        spread = rows.withColumn("part", F.col("site_namespace")).repartition("part", F.pmod(F.xxhash64("point_id"), F.lit(16)))
        spread.sortWithinPartitions("ingestion_date").write.partitionBy("part").option("parquet.bloom.filter.enabled#post_id", "true").parquet(f"{self.folder}/{version}")
        return version

    def upsert(self, batch: DataFrame) -> int:
        """Adds or replaces points by point_id; of rows with equal ids the one with the greatest `batch_order` stays.

        Returns the number of namespaces touched; an empty batch is no operation.
        """
        rows = batch.where(F.col("point_id").isNotNull() & F.col("site_namespace").isNotNull())
        touched = [str(r[0]) for r in rows.select("site_namespace").distinct().collect()]  # one a site
        if not touched:
            return 0
        manifest = self._manifest()
        version = self._write(latest_by_aggregate(rows, "point_id", F.struct(ORDER)))
        manifest |= {n: [*manifest.get(n, []), f"{version}/part={n}"] for n in touched}
        self._commit(manifest)
        full = [n for n in touched if len(manifest[n]) > self.compact_after]
        if full:
            version = self._write(self._resolved([manifest[n] for n in full]))
            self._commit(manifest | {n: [f"{version}/part={n}"] for n in full})
        return len(touched)


def lookup(points: DataFrame, site: str, post_id: int) -> DataFrame:
    return points.where((F.col("site") == site) & (F.col("post_id") == post_id)).limit(1)


def as_result(points: DataFrame, score: Column | None = None) -> DataFrame:
    """The ten fields of a result and its score: nulls as '' or 0, the direct image falling back to the thumbnail."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return points.select(
        "point_id", number("post_id"), text("site"), text("post_url"), text("thumbnail_url"), F.coalesce(shown_image(F.col("direct_image_url"), F.col("thumbnail_url")), F.lit("")).alias("direct_image_url"),
        text("tags"), number("width"), number("height"), number("ingestion_date"), text("rating"), (F.lit(0.0) if score is None else score).alias("score"),
    )


def recent_page(points: DataFrame, limit: int = 20, offset: int = 0, sites: Sequence[str] = ()) -> DataFrame:
    """The posts of one page, newest first, ties by point_id, and one row more if there are further ones."""
    found = points.where(F.col("site").isin(list(sites))) if sites else points
    return found.orderBy(F.desc("ingestion_date"), "point_id").offset(offset).limit(limit + 1)
