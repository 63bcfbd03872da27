"""Queries of the training-data operators (p1, p2, p4-p6, p8-p10) and their SQL where it can be given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaiq.llm import clusters, containers, cooccurrence, duplicates, frequency, neighbours, pieces, tokens
from mosaiq.plans.training import TERMS_SQL, normal_sql
from mosaiq.runtime import cut_lineage, table


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "post_embeddings")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    posts = _posts(spark, sf)
    # kept, as the range partitioning reads its input twice
    return frequency.mark_terms(frequency.term_frequencies(cut_lineage(frequency.term_pairs(posts))), frequency.count_points(posts))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf)


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.items_together(_posts(spark, sf)).withColumn("lift", F.round("lift", 6))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.items_together(_posts(spark, sf)).select("term_a", "term_b")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, sf, "cluster_points")).select("cluster_key", "point_id")


def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "cluster_points")
    return clusters.describe_clusters(clusters.similarity_clusters(points), points)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.near_duplicates(_posts(spark, sf))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.linked_groups(_posts(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.most_similar(_posts(spark, sf)))


def p6_similar(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.most_similar(_posts(spark, sf)).withColumn("cosine", F.round("cosine", 4))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers.fill_containers(table(spark, sf, "documents"))


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_documents(table(spark, sf, "documents"))


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, those of which all parts are there, containers beyond the capacity, documents parted needlessly."""
    parts = cut_lineage(p9_containers(spark, sf))
    over = parts.groupBy("container").agg(F.sum("n_tokens").alias("fill")).agg(F.count_if(F.col("fill") > containers.CAPACITY).alias("over_capacity"))
    each = parts.groupBy("doc_id").agg(F.count_distinct("part").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("n_parts").alias("n_parts"), F.sum("n_tokens").alias("size"))
    whole = each.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") == F.col("n_parts")) & (F.col("rows") == F.col("n"))).alias("whole"),
        F.count_if((F.col("n_parts") > 1) & (F.col("size") <= containers.CAPACITY)).alias("parted_needlessly"),
    )
    return whole.crossJoin(over)  # one row each


def p10_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, digest, fine): each text put together from its pieces' own parts, or as it is where it has none; fine if its
    pieces are within the limit, follow each other and share text."""
    found = pieces.split_documents(table(spark, sf, "documents"))
    own = F.expr("substring(text, CAST(own_start - start + 1 AS int))")
    # a document's pieces come to its text
    row = F.array_sort(F.collect_list(F.struct("piece", "start", "own_start", "stop", "n_tokens", own.alias("own"))))
    each = found.groupBy("doc_id").agg(row.alias("p"))
    follow = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda k: (F.get("p", k)["own_start"] == F.get("p", k - 1)["stop"]) & (F.get("p", k)["start"] < F.get("p", k)["own_start"]) & (F.get("p", k)["piece"] == k + 1))
    fine = follow & F.forall("p", lambda x: x.n_tokens <= pieces.LIMIT)
    rebuilt = each.select("doc_id", F.array_join(F.transform("p", lambda x: x.own), "").alias("rebuilt"), fine.alias("fine"))
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return texts.join(rebuilt, "doc_id", "left").select("doc_id", F.md5(F.coalesce("rebuilt", "text")).alias("digest"), F.coalesce("fine", F.lit(True)).alias("fine"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_pairs, p4_found, p4_clusters, p5_found, p5_groups, p6_found, p6_similar, p8_ids, p9_containers, p9_checked, p10_pieces, p10_rebuilt)}

_COUNTED = f"""
WITH {TERMS_SQL},
both_fields AS (
  SELECT 'tags' AS field_name, term, point_id FROM terms
  UNION ALL SELECT 'rating', {normal_sql('rating')}, point_id FROM post_embeddings WHERE {normal_sql('rating')} IS NOT NULL
),
counted AS (SELECT field_name, term, CAST(count(*) AS BIGINT) AS occurrences, count(DISTINCT point_id) AS n_points FROM both_fields GROUP BY 1, 2),
marked AS (
  SELECT *, CASE WHEN n_points <= 3 THEN 'rare' WHEN n_points > 0.15 * (SELECT count(DISTINCT point_id) FROM post_embeddings) THEN 'common' END AS mark FROM counted
)
"""

_PAIRED = f"""
WITH {TERMS_SQL},
has AS (SELECT DISTINCT point_id, term FROM terms),
n_of AS (SELECT term, count(*) AS n FROM has GROUP BY 1),
everything AS (SELECT count(DISTINCT point_id) AS n FROM post_embeddings),
paired AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n_ab FROM has a JOIN has b ON a.point_id = b.point_id AND a.term < b.term GROUP BY 1, 2),
scored AS (
  SELECT term_a, term_b, n_ab, a.n AS n_a, b.n AS n_b, round(n_ab * CAST(e.n AS DOUBLE) / (a.n * b.n), 6) AS lift
  FROM paired JOIN n_of a ON a.term = term_a JOIN n_of b ON b.term = term_b, everything e
  WHERE n_ab >= 5 AND 1000 * n_ab >= e.n AND n_ab * e.n >= 4 * a.n * b.n
)
"""


def _units(name: str) -> str:
    """units(point_id, v): unit vectors in double precision of the points of a table."""
    return f"""
raw_vectors AS (SELECT point_id, any_value(CAST(image_vec AS DOUBLE[])) AS v FROM {name}
  WHERE len(image_vec) = 64 AND len(list_filter(image_vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(image_vec, lambda x: x <> 0)) > 0 GROUP BY point_id),
units AS (SELECT point_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM raw_vectors)
"""


_NEAR_DUPLICATES = f"""
{_units('post_embeddings')}, {TERMS_SQL},
sets AS (SELECT point_id, list_sort(list(DISTINCT term)) AS t FROM terms GROUP BY 1),
u AS (SELECT point_id, v, t FROM units JOIN sets USING (point_id)),
near AS (SELECT a.point_id AS point_a, b.point_id AS point_b, len(list_intersect(a.t, b.t)) AS k, len(a.t) + len(b.t) AS s
  FROM u a JOIN u b ON a.point_id < b.point_id AND list_inner_product(a.v, b.v) >= 0.965),
pairs AS (SELECT point_a, point_b FROM near WHERE k > 0 AND k >= 0.5 * (s - k))
"""

_CLUSTERS = f"""
WITH RECURSIVE {_units('cluster_points')},
links AS (SELECT a.point_id AS a, b.point_id AS b FROM units a JOIN units b ON list_inner_product(a.v, b.v) >= 0.86),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
labelled AS (SELECT a AS point_id, min(b) AS cluster_key FROM reach GROUP BY a),
members AS (SELECT cluster_key, point_id FROM labelled WHERE cluster_key IN (SELECT cluster_key FROM labelled GROUP BY 1 HAVING count(*) >= 8))
"""

ORACLES = {
    "p1_found": _COUNTED + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": _COUNTED + "SELECT * FROM marked",
    "p2_found": _PAIRED + "SELECT term_a, term_b FROM scored",
    "p2_pairs": _PAIRED + "SELECT * FROM scored",
    "p4_found": _CLUSTERS + "SELECT cluster_key, point_id FROM members",
    "p4_clusters": _CLUSTERS.rstrip() + """,
dense AS (SELECT a AS point_id, count(*) - 1 AS density FROM links GROUP BY 1),
names AS (SELECT point_id, min(post_id) AS post_id FROM cluster_points GROUP BY 1),
ranked AS (SELECT cluster_key, point_id, post_id, density, row_number() OVER (PARTITION BY cluster_key ORDER BY density DESC, point_id) AS r FROM members JOIN dense USING (point_id) JOIN names USING (point_id))
SELECT cluster_key, count(*) AS n_points, string_agg(post_id || ':' || point_id || ' ' || density, ',' ORDER BY r) FILTER (r <= 5) AS typical_posts FROM ranked GROUP BY 1""",
    "p9_checked": "SELECT count(*) AS documents, count(*) AS whole, 0 AS parted_needlessly, 0 AS over_capacity FROM documents",
    "p10_rebuilt": "SELECT doc_id, md5(text) AS digest, true AS fine FROM documents",
    "p5_groups": f"""
WITH RECURSIVE {_NEAR_DUPLICATES},
links AS (SELECT point_a AS a, point_b AS b FROM pairs UNION ALL SELECT point_b, point_a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grouped AS (SELECT a, min(b) AS g FROM reach GROUP BY a)
SELECT a AS point_id, least(a, g) AS group_id, n_links FROM grouped JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) USING (a)""",
    "p6_similar": f"""
WITH {_units('post_embeddings')},
near AS (SELECT a.point_id AS point, b.point_id AS other, list_inner_product(a.v, b.v) AS c FROM units a JOIN units b ON a.point_id <> b.point_id AND list_inner_product(a.v, b.v) >= 0.9)
SELECT point, other, round(c, 4) AS cosine, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY c DESC, other) AS r FROM near) WHERE r <= 5""",
    "p6_found": f"""
WITH {_units('post_embeddings')},
near AS (SELECT a.point_id AS a, b.point_id AS b, row_number() OVER (PARTITION BY a.point_id ORDER BY list_inner_product(a.v, b.v) DESC, b.point_id) AS r
  FROM units a JOIN units b ON a.point_id <> b.point_id AND list_inner_product(a.v, b.v) >= 0.9)
SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM near WHERE r <= 5""",
    "p5_found": f"WITH {_NEAR_DUPLICATES} SELECT point_a, point_b FROM pairs",
}
