"""One façade over the engine: each method returns a DataFrame, or JSON text in the common envelope."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.functions.media import Embedder, HashEmbedder, is_valid_image
from mosaiq.operators import density, stats, store, vector
from mosaiq.sources.feed import FetchError, fetch

PAGE_LIMIT = 100
MOST_IMAGE_BYTES = 20 << 20


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def parse_sites(value: str | Sequence[str] | None) -> list[str]:
    """Site names from a string, a comma-separated string or several of them; trimmed, blanks dropped."""
    parts = [value] if isinstance(value, str) else list(value or ())
    return [name.strip() for part in parts for name in part.split(",") if name.strip()]


class Engine:
    """points: the points table (one row per point). Embedders serve text and image queries."""

    def __init__(self, points: DataFrame, make_embedder: Callable[[], Embedder] = HashEmbedder, dim: int = 64):
        self.points, self.dim, self._make, self._model = points, dim, make_embedder, None

    def _embed(self, value: str | bytes) -> list[float]:
        if self._model is None:
            self._model = self._make()
        return self._model.embed([value])[0].tolist()

    def search(self, text: str | None = None, image: bytes | None = None, vector_query: Sequence[float] | None = None, sites: str | Sequence[str] | None = None, limit: int = 10, image_weight: float = 0.5, image_url: str | None = None) -> DataFrame:
        """Text, image or blended search; results as store.as_result() has them.

        limit is capped at PAGE_LIMIT and may be 0; the weight is held in [0, 1]. An image may be given as bytes or by its
        URL; it must be valid as for media.is_valid_image(), and MOST_IMAGE_BYTES at most.
        """
        text = (text or "").strip() or None
        if image is None and image_url:
            try:
                image = fetch(image_url, retries=1, first_wait=0.5, most=MOST_IMAGE_BYTES)
            except FetchError as error:
                raise ValueError(f"no image at that address: {error}") from error
            if not is_valid_image(image):
                raise ValueError("no image at that address")
        if vector_query is None:
            weight = vector.effective_weight(text is not None, image is not None, min(1.0, max(0.0, image_weight)))
            parts = [(1 - weight, self._embed(text) if text else None), (weight, self._embed(image) if image is not None else None)]
            mixed = [sum(w * v[d] for w, v in parts if v is not None) for d in range(self.dim)]
            length = sum(x * x for x in mixed) ** 0.5
            vector_query = [x / length for x in mixed] if length > vector.LEAST_NORM else mixed
        query = vector.check_query(vector_query, self.dim)
        return self._results(vector.search(self.points, query, min(limit, PAGE_LIMIT), parse_sites(sites)))

    def _results(self, found: DataFrame) -> DataFrame:
        return store.as_result(found, F.col("score")).orderBy(F.desc("score"), "point_id")

    def similar(self, site: str, post_id: int, limit: int = 10) -> DataFrame:
        return self._results(vector.search_similar(self.points, site, post_id, clamp(limit, 1, PAGE_LIMIT)))

    def recent(self, limit: int = 20, offset: int = 0, sites: str | Sequence[str] | None = None) -> tuple[list[dict], int | None]:
        """The rows of one page and the next offset, None on the last page."""
        limit = clamp(limit, 1, PAGE_LIMIT)
        rows = [r.asDict() for r in store.recent_page(store.as_result(self.points), limit, max(offset, 0), parse_sites(sites)).collect()]  # one page
        return rows[:limit], offset + limit if len(rows) > limit else None

    def post(self, site: str, post_id: int) -> dict:
        rows = store.as_result(store.lookup(self.points, site, post_id)).collect()
        if not rows:
            raise vector.NotFound(f"{site} {post_id} not found")
        return rows[0].asDict()

    def activity(self, days: int = 90, now: int = 0, sites: str | Sequence[str] | None = None) -> DataFrame:
        days = clamp(days, 1, 365)
        return stats.activity_rollup(stats.activity_calendar(self.points, days, now, parse_sites(sites)), days)

    def sites(self) -> DataFrame:
        return stats.sites_metadata(self.points)

    def stats(self, width: int = 48) -> DataFrame:
        return stats.site_share_report(self.points, width)

    def cluster(self, params: density.DensityParams = density.DensityParams(), target_dim: int | None = None, max_points: int | None = None, site: str | None = None) -> DataFrame:
        """(idx, id, label) of the points, or of those of one site."""
        points = self.points.where(F.col("site") == site) if site else self.points
        return density.density_clusters(points, params, dim=self.dim, target_dim=target_dim, max_points=max_points)

    def cluster_members(self, labels: DataFrame, top: int = 10, preview: int = 5) -> DataFrame:
        """(label, size, cohesion, rank, member, similarity): the most typical members of the `top` most coherent clusters.

        member is the post's URL, or # and its id if it has none.
        """
        members = labels.join(self.points.select(F.col("point_id").alias("id"), "image_vec"), "id")
        best = density.rank_clusters(density.cluster_summary(members), top).select("label", "size", "cohesion")
        shown = density.cluster_preview(members, preview=preview).join(F.broadcast(best), "label")  # `top` rows
        names = self.points.select(F.col("point_id").alias("id"), member_label(F.col("post_url"), F.col("post_id")).alias("member"))
        return shown.join(names, "id").select("label", "size", "cohesion", "rank", "member", "similarity").orderBy(F.desc("cohesion"), F.desc("size"), "label", "rank")


def member_label(post_url: Column, post_id: Column) -> Column:
    return F.when(F.coalesce(post_url, F.lit("")) == "", F.concat(F.lit("#"), post_id.cast("string"))).otherwise(post_url)


def blend_label(image_weight: float) -> str | None:
    """How text and image were mixed, if they were."""
    return f"blend image={image_weight:.1f} text={1 - image_weight:.1f}" if 0 < image_weight < 1 else None


def envelope(rows: list[dict], next_offset: int | None = None) -> str:
    """JSON of a page: empty tags and ratings and null fields are left out of each row."""
    shown = [{k: v for k, v in row.items() if v is not None and not (k in ("tags", "rating") and v == "")} for row in rows]
    return json.dumps({"data": shown, "meta": {"count": len(shown), "next_offset": next_offset}}, sort_keys=True)


def contract(frames: dict[str, DataFrame]) -> str:
    """Key-sorted JSON of the schemas of results, to be compared with a stored one."""
    return json.dumps({name: json.loads(df.schema.json()) for name, df in frames.items()}, sort_keys=True, indent=2)
