"""Queries of the retrieval, analytics, clustering and ingest operators, each with its SQL where it can be given.

They run over the whole tables. `points` is the current state of post_embeddings: the last delivery of each point, its
site named by the registry, its stamp in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mosaiq import registry, schema
from mosaiq.functions import columns as C
from mosaiq.functions.media import HashEmbedder, embed_with
from mosaiq.operators import components, density, stats, store, vector
from mosaiq.plans.training import SECONDS_SQL, epoch_seconds
from mosaiq.runtime import scratch_folder, table
from mosaiq.sources.adapters import KEMONO_BASE, TAG_GROUPS, first_by_id, normalize_items, without_ratings
from mosaiq.streaming import ingest

NOW, DAYS = 1_719_792_000, 30
SITES = ["danbooru", "gelbooru"]
K = 10
WEIGHT = 0.3


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "site_registry").select("site_namespace", F.col("site").alias("name"))  # 12 rows at any scale


def points(spark: SparkSession, sf: str, *columns: str, sites: list[str] | None = None, **made: Column) -> DataFrame:
    """The current points with point_id, post_id, site_namespace, site and the columns asked for, of the given sites.

    Namespace and post_id are those of the point id; a filter on sites reaches the scan. The expressions `made` are
    evaluated on the scan, so that a vector that is only to be scored isn't shuffled.
    """
    rows, names = table(spark, sf, "post_embeddings"), _registry(spark, sf)
    if sites is not None:
        kept = [r.site_namespace for r in names.where(F.col("name").isin(sites)).collect()]  # at most 12
        rows = rows.where(F.col("site_namespace").isin(kept))
    found = store.latest_values(rows, "point_id", "row_id", {c: F.col(c) for c in columns} | made)
    if "ingestion_date" in columns:
        found = found.withColumn("ingestion_date", F.coalesce(epoch_seconds(F.col("ingestion_date")), F.lit(0)))
    found = found.withColumn("site_namespace", schema.decode_namespace(F.col("point_id"))).withColumn("post_id", schema.decode_post_id(F.col("point_id")))
    return found.join(F.broadcast(names), "site_namespace", "left").withColumnRenamed("name", "site")


POINTS = f"""
pts AS (
  SELECT p.* REPLACE (coalesce({SECONDS_SQL}, 0) AS ingestion_date), r.name AS site
  FROM (SELECT * EXCLUDE (site), row_number() OVER (PARTITION BY point_id ORDER BY row_id DESC) AS n FROM post_embeddings) p
  LEFT JOIN (SELECT site_namespace, site AS name FROM site_registry) r USING (site_namespace) WHERE n = 1
)"""
UNITS = (
    POINTS
    + """,
fit AS (SELECT *, CAST(image_vec AS DOUBLE[]) AS d FROM pts WHERE len(image_vec) = 64 AND len(list_filter(image_vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(image_vec, lambda x: x <> 0)) > 0),
units AS (SELECT *, list_transform(d, lambda x: x / sqrt(list_inner_product(d, d))) AS u FROM fit)"""
)


def _query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _scored(found: DataFrame) -> DataFrame:
    return found.select("point_id", "post_id", "site", F.round("score", 6).alias("score"))


def _against(spark: SparkSession, sf: str, query: list[float], sites: list[str] | None = None) -> DataFrame:
    """The current points with their score against a query vector."""
    return points(spark, sf, sites=sites, score=vector.cosine_to(query, F.col("image_vec")))


def _probe(spark: SparkSession, sf: str) -> int:
    """The first point of a site with a comparable vector."""
    found = _against(spark, sf, _query_vector(spark, sf), SITES[:1]).where(F.col("score").isNotNull())
    return found.agg(F.min("point_id")).first()[0]


_PROBE = f"probe AS (SELECT * FROM units WHERE site = '{SITES[0]}' ORDER BY post_id LIMIT 1)"
_QUERY = "query AS (SELECT list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS q FROM embeddings WHERE vec_id = 0)"


def similar_topk(spark, sf):
    own = _probe(spark, sf)
    row = table(spark, sf, "post_embeddings").where(F.col("point_id") == own).orderBy(F.desc("row_id")).select("image_vec").first()
    return _scored(vector.best_scored(_against(spark, sf, row[0], SITES[:1]).where(F.col("point_id") != own), K))


def search_topk_all_sites(spark, sf):
    return _scored(vector.best_scored(_against(spark, sf, _query_vector(spark, sf)), K))


def search_topk_site_list(spark, sf):
    return _scored(vector.best_scored(_against(spark, sf, _query_vector(spark, sf), SITES), K))


def hybrid_blend_topk(spark, sf):
    text, image = F.array(*map(F.lit, _query_vector(spark, sf, 1))), F.array(*map(F.lit, _query_vector(spark, sf, 2)))
    mixed = spark.range(1).select(vector.blend(vector.l2_normalize(text), vector.l2_normalize(image), WEIGHT).alias("v")).first().v
    return _scored(vector.best_scored(_against(spark, sf, mixed), K))


def batch_knn(spark, sf):
    rows = points(spark, sf, "image_vec")
    found = vector.batch_knn(rows.where(F.col("point_id") % 100 == 0), rows, 5)
    return found.select(F.col("query").alias("point_id"), "rank", F.col("other").alias("neighbour"), F.round("cosine", 6).alias("cosine"))


def quantized_search(spark, sf):
    coded = points(spark, sf, "image_vec").withColumn("code", vector.quantize_int8(F.col("image_vec")))
    return _scored(vector.search_quantized(coded, _query_vector(spark, sf), K))


def post_lookup(spark, sf):
    rows = table(spark, sf, "post_embeddings").where(F.col("point_id") == _probe(spark, sf))
    last = rows.orderBy(F.desc("row_id")).limit(1).drop("site").join(F.broadcast(_registry(spark, sf)), "site_namespace", "left").withColumnRenamed("name", "site")
    shown = store.as_result(last.withColumn("ingestion_date", F.coalesce(epoch_seconds(F.col("ingestion_date")), F.lit(0))))
    return shown.select("point_id", "post_id", "site", "post_url", "thumbnail_url", "direct_image_url", "tags", "width", "height", "ingestion_date", "rating", "score")


def recent_page(spark, sf):
    return store.recent_page(points(spark, sf, "ingestion_date"), 20, 40).select("point_id", "site", "ingestion_date")


def recent_page_sites(spark, sf):
    return store.recent_page(points(spark, sf, "ingestion_date", sites=SITES), 20, 0).select("point_id", "site", "ingestion_date")


def site_counts(spark, sf):
    return stats.site_counts(table(spark, sf, "post_embeddings"))


def site_share_report(spark, sf):
    return stats.site_share_report(points(spark, sf)).withColumn("percent", F.round("percent", 6))


def sites_metadata(spark, sf):
    return stats.sites_metadata(points(spark, sf, "ingestion_date"))


def activity_calendar(spark, sf):
    return stats.activity_calendar(points(spark, sf, "ingestion_date"), DAYS, NOW)


def activity_rollup(spark, sf):
    return stats.activity_rollup(stats.activity_calendar(points(spark, sf, "ingestion_date", sites=SITES), DAYS, NOW), DAYS).withColumn("intensity", F.round("intensity", 6)).withColumn("average", F.round("average", 6))


def point_id_roundtrip(spark, sf):
    p = F.col("point_id")
    rows = table(spark, sf, "post_embeddings").select("row_id", "site_namespace", "post_id", schema.encode_point_id(F.col("site_namespace"), F.col("post_id")).alias("point_id"))
    return rows.select("row_id", "point_id", schema.decode_namespace(p).alias("namespace"), schema.decode_post_id(p).alias("post_id"))


def payload_coercion(spark, sf):
    """Coercions of the values of raw items' ids, widths and ratings, as JSON text."""
    raw = table(spark, sf, "raw_posts").where(F.try_parse_json("body").isNotNull())
    value = lambda k: F.regexp_extract("body", rf'"{k}": ("[^"]*"|-?[0-9.eE+]+|true|false|null)', 1)
    rows = raw.select("raw_id", F.explode(F.array(*(F.nullif(value(k), F.lit("")) for k in ("id", "width", "rating", "nsfw")))).alias("v"))
    return rows.select("raw_id", "v", schema.payload_string(F.col("v")).alias("as_string"), schema.payload_u32(F.col("v")).alias("as_u32"), schema.payload_i64(F.col("v")).alias("as_i64"))


def preflight_filter(spark, sf):
    rows = table(spark, sf, "post_embeddings")
    return rows.where(C.preflight(F.col("thumbnail_url"), F.col("width"), F.col("height"))).select("row_id", F.round(C.aspect_ratio(F.col("width"), F.col("height")), 6).alias("aspect"))


def post_urls(spark, sf):
    return points(spark, sf, "post_url").select("point_id", registry.page_url(F.col("site"), F.col("post_id"), C.blank_to_null(F.col("post_url"))).alias("url"), registry.page_url(F.col("site"), F.col("post_id")).alias("page"), registry.namespace(F.col("site")).alias("namespace"))


def first_url_fallback(spark, sf):
    d, t, p = F.col("direct_image_url"), F.col("thumbnail_url"), F.col("post_url")
    return table(spark, sf, "post_embeddings").select("row_id", C.first_url(d, t, p).alias("first_url"), C.shown_image(d, t).alias("shown"), C.stored_image(d, t).alias("stored"))


def html_strip(spark, sf):
    plain = C.strip_html(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(plain).alias("digest"), F.length(plain).cast("long").alias("n"))


def unique_tags(spark, sf):
    return table(spark, sf, "post_embeddings").select("row_id", C.unique_tags(F.split("tags", "[,;|]")).alias("tags"))


def site_list_parse(spark, sf):
    return table(spark, sf, "post_embeddings").select("row_id", F.array_join(C.site_list(F.col("tags")), "/").alias("names"))


def utc_dates(spark, sf):
    return table(spark, sf, "post_embeddings").select("row_id", C.utc_date(epoch_seconds(F.col("ingestion_date"))).alias("day"))


def normalized_posts(spark, sf):
    return normalize_items(table(spark, sf, "raw_posts"), keep=("raw_id",))


def first_posts(spark, sf):
    return first_by_id(normalized_posts(spark, sf), "raw_id").select("site", "post_id", "raw_id")


def source_counts(spark, sf):
    """Items per site and family from one scan of all sources."""
    return normalized_posts(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("items"), F.count_if(C.preflight(F.col("thumbnail_url"), F.col("width"), F.col("height"))).alias("fit"), F.max("post_id").alias("last_id"))


def incremental_new_rows(spark, sf):
    marks = ingest.checkpoint_max(table(spark, sf, "ingest_log"))
    return ingest.new_posts(table(spark, sf, "raw_posts"), marks).select("raw_id", "site", "post_id")


def checkpoint_max(spark, sf):
    return ingest.checkpoint_max(table(spark, sf, "ingest_log"))


def status_fold(spark, sf):
    return ingest.status_fold(table(spark, sf, "ingest_log")).withColumn("active_sites", F.array_join("active_sites", ","))


def cycle_metrics(spark, sf):
    return ingest.cycle_metrics(table(spark, sf, "ingest_log"))


def daily_window_counts(spark, sf):
    return ingest.daily_events(table(spark, sf, "ingest_log"))


def upsert_latest(spark, sf):
    rows = table(spark, sf, "post_embeddings").select("point_id", "row_id", "tags", "rating", "width", "height")
    return store.latest_by_aggregate(rows, "point_id", F.col("row_id")).select("point_id", "row_id", "tags", "rating", "width", "height")


def _knn(spark, sf):
    return density.nearest_neighbours(table(spark, sf, "embeddings"), 8, "vec_id", "embedding")


def knn_graph(spark, sf):
    return _knn(spark, sf).withColumn("dist", F.round("dist", 6))


def core_distance(spark, sf):
    return density.core_distances(_knn(spark, sf)).select("idx", F.round("core", 6).alias("core"))


def mutual_reachability_edges(spark, sf):
    knn = _knn(spark, sf)
    return density.mutual_reachability(knn, density.core_distances(knn), 0.05).select("u", "v", F.round("weight", 6).alias("weight"))


def edge_dedupe(spark, sf):
    """Repeated links between orders' customers and suppliers' line items, cut to the least price."""
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_extendedprice").alias("weight"))
    return density.dedupe_edges(items)


def connected_components(spark, sf):
    knn = _knn(spark, sf).where(F.col("rank") <= 1)
    return components.connected_components(knn, "src", "dst")


def knn_components(spark, sf):
    """Components of the whole graph of 8 neighbours; no SQL, as a recursive one takes the square of a component."""
    return components.connected_components(_knn(spark, sf), "src", "dst")


def cluster_summary(spark, sf):
    return density.cluster_summary(table(spark, sf, "embeddings"), "vec_id", "label", "embedding").withColumn("cohesion", F.round("cohesion", 6))


def cluster_preview(spark, sf):
    return density.cluster_preview(table(spark, sf, "embeddings"), "vec_id", "label", "embedding").withColumn("similarity", F.round("similarity", 6))


def cluster_ranking(spark, sf):
    return density.rank_clusters(density.cluster_summary(table(spark, sf, "embeddings"), "vec_id", "label", "embedding"), 10).select("label", "size", F.round("cohesion", 6).alias("cohesion"))


def loose_clusters(spark, sf):
    return density.all_loose(density.cluster_summary(table(spark, sf, "embeddings"), "vec_id", "label", "embedding"))


def random_projection(spark, sf):
    return density.project(table(spark, sf, "cluster_points").select("point_id", "image_vec"), 32)


def graph_density_labels(spark, sf):
    return density.density_clusters(table(spark, sf, "cluster_points")).select(F.col("id").alias("point_id"), "label")


def found_clusters(spark, sf):
    """(label, size, cohesion, representative) of the clusters that graph_density_labels finds."""
    return density.cluster_summary(_members(spark, sf)).withColumn("cohesion", F.round("cohesion", 6))


def found_members(spark, sf):
    """(label, rank, id, similarity): the most typical members of the clusters that graph_density_labels finds."""
    return density.cluster_preview(_members(spark, sf)).withColumn("similarity", F.round("similarity", 6))


def _members(spark, sf):
    labels = density.density_clusters(table(spark, sf, "cluster_points")).select("id", "label").where(F.col("label") >= 0)
    vectors = table(spark, sf, "cluster_points").where(F.size("image_vec") == 64).groupBy(F.col("point_id").alias("id")).agg(F.any_value("image_vec").alias("image_vec"))  # all rows of a point carry the same
    return labels.join(vectors, "id")


def cluster_membership(spark, sf):
    """Size of each label, noise (-1) included, with its share of all points."""
    sizes = graph_density_labels(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # one row a cluster


def embedded_tags(spark, sf):
    return points(spark, sf, "tags").select("point_id", embed_with(HashEmbedder, F.col("tags")).alias("vector"))


def _streamed(spark: SparkSession, sf: str, files: int, files_per_batch: int) -> DataFrame:
    folder = scratch_folder(spark, "ingest")
    # in an order of its own, so that a batch holds ids from all over
    table(spark, sf, "raw_posts").repartition(files, F.xxhash64("raw_id")).sortWithinPartitions(F.desc("raw_id")).write.parquet(f"{folder}/landing")
    kept = store.PointStore(spark, f"{folder}/points")
    ingest.Ingest(spark, kept, f"{folder}/marks.json", clock=lambda: NOW).stream(f"{folder}/landing", f"{folder}/state", files_per_batch).awaitTermination()
    found = kept.points()
    return found.select("point_id", "post_id", "site", "site_namespace", "post_url", "thumbnail_url", "direct_image_url", "tags", "width", "height", "ingestion_date", "rating")


def streaming_ingest(spark, sf):
    """The raw items taken as a stream of 8 files into a points table, 4 files a batch, and that table."""
    return _streamed(spark, sf, 8, 4)


def streaming_micro_batches(spark, sf):
    """As streaming_ingest, in 10 batches of one file."""
    return _streamed(spark, sf, 10, 1)


def rating_exclusion(spark, sf):
    return without_ratings(normalized_posts(spark, sf)).select("raw_id", "site", "post_id", "rating")


QUERIES = {
    f.__name__: f
    for f in (
        similar_topk, search_topk_all_sites, search_topk_site_list, hybrid_blend_topk, batch_knn, quantized_search, post_lookup, recent_page, recent_page_sites, site_counts, site_share_report, sites_metadata,
        activity_calendar, activity_rollup, point_id_roundtrip, payload_coercion, preflight_filter, post_urls, first_url_fallback, html_strip, unique_tags, site_list_parse, utc_dates, normalized_posts, first_posts, source_counts,
        incremental_new_rows, checkpoint_max, status_fold, cycle_metrics, daily_window_counts, upsert_latest, knn_graph, core_distance, mutual_reachability_edges, edge_dedupe, connected_components, knn_components, cluster_summary,
        cluster_preview, cluster_ranking, loose_clusters, random_projection, graph_density_labels, found_clusters, found_members, cluster_membership, embedded_tags, streaming_ingest, streaming_micro_batches, rating_exclusion,
    )
}


def _ranked(where: str, query: str) -> str:
    return f"SELECT point_id, post_id, site, round(s, 6) AS score FROM (SELECT point_id, post_id, site, list_inner_product(u, {query}) AS s FROM units WHERE {where}) ORDER BY s DESC, point_id LIMIT {K}"


_SITE_LIST = ", ".join(f"'{s}'" for s in SITES)
_RESULT = "point_id, coalesce(post_id, 0) AS post_id, coalesce(site, '') AS site, coalesce(post_url, '') AS post_url, coalesce(thumbnail_url, '') AS thumbnail_url, coalesce(nullif(direct_image_url, ''), thumbnail_url, '') AS direct_image_url, coalesce(tags, '') AS tags, coalesce(width, 0) AS width, coalesce(height, 0) AS height, coalesce(ingestion_date, 0) AS ingestion_date, coalesce(rating, '') AS rating, 0.0::DOUBLE AS score"
_ASPECT = "CASE WHEN width <> 0 OR height <> 0 THEN greatest(greatest(width, 1), greatest(height, 1)) / least(greatest(width, 1), greatest(height, 1)) END"
_PAGE = "CASE site " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, _, _, t in registry.SITES) + f" ELSE '{registry.UNKNOWN_TEMPLATE}' END"


def _activity(where: str) -> str:
    return f"""calendar AS (SELECT strftime(make_date(CAST(d AS INTEGER)), '%Y-%m-%d') AS date FROM (SELECT unnest(range({NOW} // 86400 - {DAYS - 1}, {NOW} // 86400 + 1)) AS d)),
counted AS (SELECT strftime(make_date(CAST(ingestion_date // 86400 AS INTEGER)), '%Y-%m-%d') AS date, count(*) AS n FROM pts WHERE ingestion_date >= {NOW - DAYS * 86400} AND {where} GROUP BY 1),
activity AS (SELECT date, coalesce(n, 0) AS count FROM calendar FULL JOIN counted USING (date))"""


_FIRST = "coalesce(" + ", ".join(["nullif(trim({}), '')"] * 3) + ", '')"
_KNN = """
pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
knn AS (SELECT src, dst, rank, greatest(0.0, 1 - c) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS INTEGER) AS rank FROM pairs) WHERE rank <= 8),
core AS (SELECT src AS idx, max(dist) AS core FROM knn GROUP BY 1)"""
_SIMILARITY = """
cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
sums AS (SELECT label, pos, sum(x) AS x FROM cells GROUP BY 1, 2),
centroids AS (SELECT label, list(x ORDER BY pos) AS s FROM sums GROUP BY 1),
near AS (SELECT e.label, vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), s) / sqrt(list_inner_product(s, s)) AS similarity FROM embeddings e JOIN centroids USING (label)),
summary AS (SELECT label, count(*) AS size, round(avg(similarity), 6) AS cohesion, arg_max(vec_id, similarity) AS representative FROM near GROUP BY 1)"""


def _j(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


def _number(text: str) -> str:
    return f"coalesce(CASE WHEN regexp_full_match({text}, '[0-9]{{1,10}}') AND CAST({text} AS BIGINT) < 4294967296 THEN CAST({text} AS BIGINT) END, 0)"


def _first_of(*parts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({p}), '')" for p in parts) + ", '')"


def _image(path: str) -> str:
    return rf"regexp_matches(lower({path}), '\.(jpg|jpeg|png|webp|gif|bmp)$')"


def _media(path: str) -> str:
    base = KEMONO_BASE
    return f"""CASE WHEN {path} IS NULL THEN NULL WHEN {path} LIKE 'http://%' OR {path} LIKE 'https://%' THEN {path} WHEN trim({path}) LIKE 'data/%' THEN '{base}/' || trim({path}) WHEN trim({path}) LIKE '/data/%' THEN '{base}' || trim({path})
      WHEN trim({path}) LIKE '/%' THEN '{base}/data' || trim({path}) ELSE '{base}/data/' || trim({path}) END"""


_GROUPS = ", ".join(f"coalesce(CAST(json_extract(j, '$.tags.{g}') AS VARCHAR[]), [])" for g in TAG_GROUPS)
_STRIPPED = "replace(regexp_replace({}, '<[^>]*(>|$)', '', 'g'), '>', '')"
_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_TAGS_LIST = "list_transform({}, lambda x: trim(regexp_replace(x, '" + _SPACE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g')))"
_GENERATED_TAGS = _TAGS_LIST.format(f"list_concat([{_j('username')}, {_j('baseModel')}, {_j('meta.Model')}, {_j('meta.sampler')}], coalesce(CAST(json_extract(j, '$.meta.resources[*].name') AS VARCHAR[]), []), [{_j('meta.prompt')}, {_j('meta.negativePrompt')}])")
_PATH = rf"regexp_extract({_j('url')}, '^[a-z]+://[^/]+/([^?#]*)', 1)"


def _family_sql(kind: str, tags: str, thumbnail: str, direct: str, width: str, height: str, rating: str, page: str = "NULL", where: str = "true") -> str:
    names = ", ".join(f"'{n}'" for n, _, f, _ in registry.SITES if f == kind)
    return f"""SELECT raw_id, site, TRY_CAST({_j('id')} AS BIGINT) AS post_id, coalesce({tags}, '') AS tags, {thumbnail} AS thumbnail_url, {direct} AS direct_image_url, {width} AS width, {height} AS height, coalesce({rating}, '') AS rating, CAST({page} AS VARCHAR) AS canonical_post_url
      FROM items WHERE site IN ({names}) AND {where}"""


_OWN = f"CASE WHEN {_image(_j('file.path'))} THEN {_j('file.path')} END"
_ORIGINAL = f"coalesce({_OWN}, list_filter(CAST(json_extract(j, '$.attachments[*].path') AS VARCHAR[]), lambda p: {_image('p')})[1])"
_PREVIEW = f"coalesce(CASE WHEN {_image(_j('file.thumbnail.path'))} THEN {_j('file.thumbnail.path')} END, {_ORIGINAL})"
_SEGMENTS = f"string_split({_PATH}, '/')"
_AT = f"list_position(list_transform({_SEGMENTS}, lambda x: CASE WHEN x IN ('original', 'original=true') THEN 1 ELSE 0 END), 1)"
_CACHED = f"CASE WHEN {_AT} > 1 AND trim({_SEGMENTS}[{_AT} - 1]) <> '' THEN 'https://image-b2.civitai.com/file/civitai-media-cache/' || trim({_SEGMENTS}[{_AT} - 1]) || '/450x%3Cauto%3E_so' END"
_LEVEL = f"lower(coalesce({_j('nsfwLevel')}, ''))"

POSTS = f"""
items AS (SELECT raw_id, site, CAST(body AS JSON) AS j FROM raw_posts WHERE json_valid(body) AND ltrim(body) NOT LIKE '<%'),
parsed AS (
  {_family_sql('flat', _j('tags'), _first_of(_j('preview_url'), _j('sample_url'), _j('file_url')), f"coalesce({_j('file_url')}, {_j('sample_url')})", _number(_j('width')), _number(_j('height')), _j('rating'))}
  UNION ALL {_family_sql('tagged', _j('tag_string'), _first_of(_j('preview_file_url'), _j('large_file_url'), _j('file_url')), f"coalesce({_j('file_url')}, {_j('large_file_url')})", _number(_j('image_width')), _number(_j('image_height')), _j('rating'))}
  UNION ALL {_family_sql('board', _j('tags'), _first_of(_j('preview_url'), _j('sample_url'), _j('jpeg_url'), _j('file_url')), f"coalesce({_j('file_url')}, {_j('jpeg_url')})", _number(_j('width')), _number(_j('height')), _j('rating'))}
  UNION ALL {_family_sql('grouped', f"array_to_string(flatten([{_GROUPS}]), ' ')", _first_of(_j('preview.url'), _j('sample.url'), _j('file.url')), f"coalesce({_j('file.url')}, {_j('sample.url')})", _number(_j('file.width')), _number(_j('file.height')), _j('rating'))}
  UNION ALL {_family_sql('attached', f"concat_ws(' ', nullif(trim({_j('title')}), ''), nullif(trim(replace({_STRIPPED.format(_j('substring'))}, chr(10), ' ')), ''), nullif(trim({_j('service')}), ''))", f"coalesce({_media(_PREVIEW)}, '')", _media(_ORIGINAL), '0', '0', "''", f"'{KEMONO_BASE}/' || nullif(trim({_j('service')}), '') || '/user/' || nullif(trim({_j('user')}), '') || '/post/' || {_j('id')}")}
  UNION ALL {_family_sql('generated', f"array_to_string(list_filter({_GENERATED_TAGS}, lambda x, i: x IS NOT NULL AND x <> '' AND list_position({_GENERATED_TAGS}, x) = i), ' ')", f"coalesce({_CACHED}, {_first_of(_j('url'), f"'https://civitai.com/images/' || {_j('id')}")})", f"nullif(trim({_j('url')}), '')", _number(_j('width')), _number(_j('height')), f"CASE {_LEVEL} WHEN 'none' THEN 's' WHEN 'soft' THEN 'q' WHEN 'mature' THEN 'e' WHEN 'x' THEN 'e' ELSE CASE WHEN {_j('nsfw')} = 'true' THEN 'e' ELSE 's' END END", f"'https://civitai.com/images/' || {_j('id')}", rf"({_j('type')} IS NULL OR lower({_j('type')}) = 'image') AND NOT coalesce(regexp_matches(lower({_j('url')}), '\.(mp4|webm)($|\?)'), false)")}
),
posts AS (SELECT * FROM parsed WHERE post_id IS NOT NULL),
marks AS (SELECT site, max(last_id) AS last_id FROM ingest_log WHERE event_type = 'CheckpointUpdated' AND site IS NOT NULL GROUP BY 1)"""

_BARE = "CASE WHEN v LIKE '\"%' THEN substr(v, 2, length(v) - 2) END"
_KEPT = "NOT (site = 'civitai' AND rating = 's')"
_FIT = f"thumbnail_url <> '' AND coalesce({_ASPECT} <= 2.0, true)"

ORACLES = {
    "similar_topk": f"WITH {UNITS}, {_PROBE} " + _ranked(f"site = '{SITES[0]}' AND post_id <> (SELECT post_id FROM probe)", "(SELECT u FROM probe)"),
    "search_topk_all_sites": f"WITH {UNITS}, {_QUERY} " + _ranked("true", "(SELECT q FROM query)"),
    "search_topk_site_list": f"WITH {UNITS}, {_QUERY} " + _ranked(f"site IN ({_SITE_LIST})", "(SELECT q FROM query)"),
    "hybrid_blend_topk": f"""WITH {UNITS},
unit_of AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (1, 2))),
mixed AS (SELECT list_transform(list_zip(a.e, b.e), lambda z: {1 - WEIGHT} * z[1] + {WEIGHT} * z[2]) AS m FROM unit_of a, unit_of b WHERE a.vec_id = 1 AND b.vec_id = 2),
query AS (SELECT list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS q FROM mixed) """
    + _ranked("true", "(SELECT q FROM query)"),
    "batch_knn": f"""WITH {UNITS},
near AS (SELECT a.point_id, b.point_id AS neighbour, list_inner_product(a.u, b.u) AS c FROM units a JOIN units b ON a.point_id <> b.point_id WHERE a.point_id % 100 = 0)
SELECT point_id, CAST(r AS INTEGER) AS rank, neighbour, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY c DESC, neighbour) AS r FROM near) WHERE r <= 5""",
    "quantized_search": f"WITH {UNITS}, {_QUERY} " + _ranked("true", "(SELECT q FROM query)"),
    "post_lookup": f"WITH {UNITS}, {_PROBE} SELECT {_RESULT} FROM probe",
    "recent_page": f"WITH {POINTS} SELECT point_id, site, ingestion_date FROM pts ORDER BY ingestion_date DESC, point_id LIMIT 21 OFFSET 40",
    "recent_page_sites": f"WITH {POINTS} SELECT point_id, site, ingestion_date FROM pts WHERE site IN ({_SITE_LIST}) ORDER BY ingestion_date DESC, point_id LIMIT 21",
    "site_counts": "SELECT nullif(site, '') AS site, count(*) AS count FROM post_embeddings GROUP BY 1",
    "site_share_report": f"""WITH {POINTS}, c AS (SELECT nullif(site, '') AS site, count(*) AS count FROM pts GROUP BY 1),
s AS (SELECT site, count, count * 100.0::DOUBLE / (SELECT sum(count) FROM c) AS percent FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, site) AS rank, count(*) OVER () AS n FROM s WHERE site IS NOT NULL)
SELECT CAST(rank AS INTEGER) AS rank, site, count, round(percent, 6) AS percent, repeat('#', greatest(1, CAST(round(percent / 100 * 48) AS INTEGER))) AS bar, rank = 1 AS leader, rank = n AND n > 1 AS trailing FROM r""",
    "sites_metadata": f"WITH {POINTS} SELECT site AS name, site_namespace AS namespace, count(*) AS count, min(ingestion_date) AS earliest, max(ingestion_date) AS latest FROM pts WHERE site <> '' GROUP BY 1, 2",
    "activity_calendar": f"WITH {POINTS}, {_activity('true')} SELECT date, count FROM activity",
    "activity_rollup": f"""WITH {POINTS}, {_activity(f'site IN ({_SITE_LIST})')}
SELECT date, count, round(CASE WHEN max(count) OVER () > 0 THEN count / max(count) OVER () ELSE 0 END, 6) AS intensity, CAST(sum(count) OVER () AS BIGINT) AS total, max(count) OVER () AS peak, round(CAST(sum(count) OVER () AS BIGINT) / {DAYS}, 6) AS average FROM activity""",
    "point_id_roundtrip": "SELECT row_id, site_namespace * 1000000000000 + post_id AS point_id, site_namespace AS namespace, post_id FROM post_embeddings",
    "payload_coercion": f"""WITH v AS (SELECT raw_id, unnest([nullif(regexp_extract(body, '"' || k || '": ("[^"]*"|-?[0-9.eE+]+|true|false|null)', 1), '') FOR k IN ['id', 'width', 'rating', 'nsfw']]) AS v FROM raw_posts WHERE json_valid(body))
SELECT raw_id, v, CASE WHEN v IS NULL OR v = 'null' THEN '' WHEN v LIKE '"%' THEN {_BARE} ELSE regexp_replace(v, '^(-?[0-9]+)\\.0+$', '\\1') END AS as_string,
  CAST(coalesce(CASE WHEN coalesce({_BARE}, v) SIMILAR TO '[0-9]+' THEN CASE WHEN TRY_CAST(coalesce({_BARE}, v) AS HUGEINT) <= 4294967295 THEN TRY_CAST(coalesce({_BARE}, v) AS BIGINT) END END, 0) AS BIGINT) AS as_u32,
  CAST(coalesce(TRY_CAST(coalesce({_BARE}, v) AS BIGINT), 0) AS BIGINT) AS as_i64 FROM v""",
    "preflight_filter": f"SELECT row_id, round({_ASPECT}, 6) AS aspect FROM post_embeddings WHERE {_FIT}",
    "post_urls": f"WITH {POINTS} SELECT point_id, coalesce(nullif(trim(post_url), ''), replace({_PAGE}, '{{id}}', CAST(post_id AS VARCHAR))) AS url, replace({_PAGE}, '{{id}}', CAST(post_id AS VARCHAR)) AS page, site_namespace AS namespace FROM pts",
    "first_url_fallback": f"SELECT row_id, {_FIRST.format('direct_image_url', 'thumbnail_url', 'post_url')} AS first_url, coalesce(nullif(direct_image_url, ''), thumbnail_url) AS shown, coalesce(direct_image_url, thumbnail_url) AS stored FROM post_embeddings",
    "html_strip": f"SELECT doc_id, md5({_STRIPPED.format('text')}) AS digest, length({_STRIPPED.format('text')}) AS n FROM documents",
    "unique_tags": f"""SELECT row_id, array_to_string(list_filter(t, lambda x, i: x <> '' AND list_position(t, x) = i), ' ') AS tags FROM (SELECT row_id, {_TAGS_LIST.format("regexp_split_to_array(tags, '[,;|]')")} AS t FROM post_embeddings)""",
    "site_list_parse": "SELECT row_id, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> ''), '/') AS names FROM post_embeddings",
    "utc_dates": f"SELECT row_id, strftime(make_date(CAST(coalesce({SECONDS_SQL}, 0) // 86400 AS INTEGER)), '%Y-%m-%d') AS day FROM post_embeddings",
    "normalized_posts": f"WITH {POSTS} SELECT * FROM posts",
    "first_posts": f"WITH {POSTS} SELECT site, post_id, min(raw_id) AS raw_id FROM posts GROUP BY 1, 2",
    "source_counts": f"WITH {POSTS} SELECT site, count(*) AS items, CAST(count(*) FILTER ({_FIT}) AS BIGINT) AS fit, max(post_id) AS last_id FROM posts GROUP BY 1",
    "incremental_new_rows": f"WITH {POSTS} SELECT raw_id, site, post_id FROM posts LEFT JOIN marks USING (site) WHERE post_id > coalesce(last_id, 0) AND {_KEPT}",
    "rating_exclusion": f"WITH {POSTS} SELECT raw_id, site, post_id, rating FROM posts WHERE {_KEPT}",
    "checkpoint_max": "SELECT site, max(last_id) AS last_id FROM ingest_log WHERE event_type = 'CheckpointUpdated' AND site IS NOT NULL GROUP BY 1",
    "status_fold": """WITH e AS (SELECT DISTINCT * FROM ingest_log), m AS (SELECT site, max(last_id) AS last_id FROM e WHERE event_type = 'CheckpointUpdated' AND site IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM m) > 0 AS is_running, (SELECT string_agg(DISTINCT site, ',' ORDER BY site) FROM e WHERE event_type IN ('CycleComplete', 'CheckpointUpdated')) AS active_sites,
  (SELECT '{' || string_agg('"' || site || '":' || last_id, ',' ORDER BY site) || '}' FROM m) AS last_checkpoint, (SELECT count(*) FROM e) AS n_events""",
    "cycle_metrics": """WITH e AS (SELECT DISTINCT * FROM ingest_log WHERE event_type IN ('CycleComplete', 'CycleFailed')),
s AS (SELECT site, count(*) FILTER (event_type = 'CycleComplete') AS cycles, count(*) FILTER (event_type = 'CycleFailed') AS failures, CAST(coalesce(sum(fetched) FILTER (event_type = 'CycleComplete'), 0) AS BIGINT) AS fetched,
  CAST(coalesce(sum(upserted) FILTER (event_type = 'CycleComplete'), 0) AS BIGINT) AS upserted, coalesce(sum(elapsed_secs) FILTER (event_type = 'CycleComplete'), 0) AS secs FROM e GROUP BY 1)
SELECT site, cycles, failures, fetched, upserted, fetched - upserted AS skipped, CASE WHEN upserted > 0 AND secs > 0 THEN round(upserted / secs, 6) ELSE 0 END AS posts_per_second, CASE WHEN upserted > 0 AND secs > 0 THEN round(secs / upserted, 6) ELSE 0 END AS seconds_per_post FROM s""",
    "streaming_ingest": f"""WITH {POSTS}, fit AS (SELECT *, row_number() OVER (PARTITION BY site, post_id ORDER BY raw_id DESC) AS n FROM posts WHERE {_FIT} AND {_KEPT})
SELECT r.site_namespace * 1000000000000 + post_id AS point_id, post_id, site, r.site_namespace, coalesce(canonical_post_url, replace({_PAGE}, '{{id}}', CAST(post_id AS VARCHAR))) AS post_url, thumbnail_url,
  coalesce(direct_image_url, thumbnail_url) AS direct_image_url, tags, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST({NOW} AS BIGINT) AS ingestion_date, rating FROM fit JOIN site_registry r USING (site) WHERE n = 1""",
    "daily_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM ingest_log WHERE ts IS NOT NULL GROUP BY 1, 2",
    "upsert_latest": f"WITH {POINTS} SELECT point_id, row_id, tags, rating, width, height FROM pts",
    "knn_graph": f"WITH {_KNN} SELECT src, dst, rank, round(dist, 6) AS dist FROM knn",
    "core_distance": f"WITH {_KNN} SELECT idx, round(core, 6) AS core FROM core",
    "mutual_reachability_edges": f"""WITH {_KNN} SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(min(greatest(a.core, b.core, dist + 0.05)), 6) AS weight
FROM knn JOIN core a ON a.idx = src JOIN core b ON b.idx = dst GROUP BY 1, 2""",
    "edge_dedupe": "SELECT l_partkey AS u, l_suppkey AS v, min(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2",
    "connected_components": f"""WITH RECURSIVE {_KNN},
links AS (SELECT src AS a, dst AS b FROM knn WHERE rank <= 1 UNION SELECT dst, src FROM knn WHERE rank <= 1),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS vertex, min(b) AS component FROM reach GROUP BY 1""",
    "cluster_summary": f"WITH {_SIMILARITY} SELECT CAST(label AS INTEGER) AS label, size, cohesion, representative FROM summary",
    "cluster_preview": f"WITH {_SIMILARITY} SELECT CAST(label AS INTEGER) AS label, vec_id, round(similarity, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS r FROM near) WHERE r <= 6",
    "cluster_ranking": f"WITH {_SIMILARITY} SELECT CAST(label AS INTEGER) AS label, size, cohesion FROM summary ORDER BY cohesion DESC, size DESC, label LIMIT 10",
    "loose_clusters": f"WITH {_SIMILARITY} SELECT bool_and(cohesion < 0.75) AS all_loose FROM summary",
}


def _trim_all_space(sql: str) -> str:
    """trim(x) written out as a trim of white space of any kind."""
    at = 0
    while (at := sql.find("trim(", at)) >= 0:
        if sql[at - 1].isalpha():  # ltrim
            at += 5
            continue
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 5 : end - 1]
        sql = f"{sql[:at]}regexp_replace({inner}, '^{_SPACE}+|{_SPACE}+$', '', 'g'){sql[end:]}"
        at += 15
    return sql


ORACLES["streaming_micro_batches"] = ORACLES["streaming_ingest"]
ORACLES = {name: _trim_all_space(sql) for name, sql in ORACLES.items()}
