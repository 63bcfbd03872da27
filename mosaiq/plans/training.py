"""Queries of the two general problems: hot keys (p3) and packed fields (p7), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mosaiq.functions.text import normal_form_col
from mosaiq.operators.hotkeys import counted_keys, heavy_keys, per_key
from mosaiq.operators.packed import split_packed
from mosaiq.runtime import table

SITE_SHARE = 0.07

# fixed values: full-width forms FF01-FF5E and the ASCII they stand for; white space beyond ASCII
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANK = " 　       \u0085"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkc_sql(column: str) -> str:
    """The part of NFKC that occurs in the data, in lower case."""
    return f"lower(nfc_normalize(translate({column}, {_quote(_FULL + _BLANK)}, {_quote(_HALF + ' ' * len(_BLANK))})))"


def normal_sql(column: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace({nfkc_sql(column)}, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), '')"


#: terms(row_id, point_id, pos, term) of post_embeddings.tags
TERMS_SQL = rf"""
folded AS (SELECT row_id, point_id, regexp_replace({nfkc_sql('tags')}, '^\s+|\s+$', '', 'g') AS s FROM post_embeddings WHERE tags IS NOT NULL),
written AS (
  SELECT row_id, point_id, unnest(v) AS v, generate_subscripts(v, 1) AS k
  FROM (SELECT row_id, point_id, regexp_extract_all(CASE WHEN s LIKE '[%]' THEN substr(s, 2, length(s) - 2) ELSE s END, '"(?:[^"\\]|\\.|"")*"|[^\s,;|、]+') AS v FROM folded)
),
valued AS (
  SELECT row_id, point_id, k, regexp_replace(regexp_replace(CASE WHEN v LIKE '"%"' AND length(v) > 1 THEN regexp_replace(substr(v, 2, length(v) - 2), '\\"|""', '"', 'g') ELSE v END, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g') AS term
  FROM written
),
terms AS (SELECT row_id, point_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY k) AS INTEGER) AS pos, term FROM valued WHERE term <> '')
"""


def epoch_seconds(stamp: Column) -> Column:
    """Epoch seconds of a stamp in seconds, milli-, micro- or nanoseconds, told apart by size; null for 0 and below."""
    scaled = F.when(stamp < 10**11, stamp)
    for digits in (3, 6):
        scaled = scaled.when(stamp < 10 ** (11 + digits), F.floor(stamp / F.lit(10**digits)))
    return F.when(stamp > 0, scaled.otherwise(F.floor(stamp / F.lit(10**9)))).cast("long")


SECONDS_SQL = (
    "CASE WHEN ingestion_date <= 0 THEN NULL WHEN ingestion_date < 100000000000 THEN ingestion_date WHEN ingestion_date < 100000000000000 THEN ingestion_date // 1000 "
    "WHEN ingestion_date < 100000000000000000 THEN ingestion_date // 1000000 ELSE ingestion_date // 1000000000 END"
)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(counted_keys(table(spark, sf, "post_embeddings"), "site", normal_form_col), SITE_SHARE).select(F.col("key").alias("site"))


def p3_sites(spark: SparkSession, sf: str) -> DataFrame:
    found = per_key(table(spark, sf, "post_embeddings"), "site", normal_form_col, "point_id", epoch_seconds(F.col("ingestion_date")))
    return found.select(F.col("key").alias("site"), "n_rows", F.col("n_items").alias("n_points"), F.col("first_value").alias("first_ingestion"), F.col("last_value").alias("last_ingestion"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_packed(table(spark, sf, "post_embeddings"), "tags", ["row_id"])


QUERIES = {"p3_found": p3_found, "p3_sites": p3_sites, "p7_found": p7_found}

ORACLES = {
    "p3_found": f"""
        WITH s AS (SELECT {normal_sql('site')} AS site FROM post_embeddings)
        SELECT site FROM s WHERE site IS NOT NULL GROUP BY site HAVING count(*) >= 0.07 * (SELECT count(*) FROM post_embeddings)""",
    "p3_sites": f"""
        SELECT {normal_sql('site')} AS site, count(*) AS n_rows, count(DISTINCT point_id) AS n_points, min({SECONDS_SQL}) AS first_ingestion, max({SECONDS_SQL}) AS last_ingestion
        FROM post_embeddings GROUP BY 1""",
    "p7_found": f"WITH {TERMS_SQL} SELECT row_id, pos, term FROM terms",
}
