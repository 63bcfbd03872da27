"""Counts and calendars over a points table. Every report is one column-pruned scan with partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.functions.columns import utc_date
from mosaiq.registry import namespace

MOST_DAYS = 3650


def _of_sites(points: DataFrame, sites: Sequence[str]) -> DataFrame:
    return points.where(F.col("site").isin(list(sites))) if sites else points


def site_counts(points: DataFrame) -> DataFrame:
    """(site, count) of rows with a site; null and '' form the row with site null."""
    return points.groupBy(F.nullif("site", F.lit("")).alias("site")).agg(F.count(F.lit(1)).alias("count"))


def site_share_report(points: DataFrame, width: int = 48) -> DataFrame:
    """Ranked shares: percent of all rows, missing sites counting in the total, and a bar of at least one mark.

    leader and trailing mark the first and, if there are several, the last site. The windows run over one row per site.
    """
    counts = site_counts(points)
    whole = Window.partitionBy(F.lit(0))
    ranked = whole.orderBy(F.desc("count"), "site")
    shares = counts.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(whole)).where(F.col("site").isNotNull())
    return shares.select(
        F.row_number().over(ranked).alias("rank"), "site", "count", "percent", F.repeat(F.lit("#"), F.greatest(F.lit(1), F.round(F.col("percent") / 100 * width).cast("int"))).alias("bar"),
        (F.row_number().over(ranked) == 1).alias("leader"), ((F.row_number().over(ranked) == F.count("site").over(whole)) & (F.count("site").over(whole) > 1)).alias("trailing"),
    )


def sites_metadata(points: DataFrame) -> DataFrame:
    """(name, namespace, count, earliest, latest) per site; a missing ingestion date counts as 0."""
    stamp = F.coalesce("ingestion_date", F.lit(0))
    found = points.where(F.coalesce(F.col("site"), F.lit("")) != "").groupBy(F.col("site").alias("name")).agg(F.count(F.lit(1)).alias("count"), F.min(stamp).alias("earliest"), F.max(stamp).alias("latest"))
    return found.withColumn("namespace", namespace(F.col("name")))


def activity_calendar(points: DataFrame, days: int, now: int, sites: Sequence[str] = ()) -> DataFrame:
    """(date, count) for the last `days` UTC days, zeros included, and for any other counted day.

    Rows from now - days * 86400 on are counted, so the cut day comes out too, in part. days outside 1..3650 give none.
    """
    spark = points.sparkSession
    if not 1 <= days <= MOST_DAYS:
        return spark.createDataFrame([], "date string, count long")
    first, last = now // 86400 - (days - 1), now // 86400
    calendar = spark.range(first, last + 1, 1, 1).select(utc_date(F.col("id") * 86400).alias("date"))
    counted = _of_sites(points, sites).where(F.col("ingestion_date") >= now - days * 86400).groupBy(utc_date(F.col("ingestion_date")).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "date", "full").select("date", F.coalesce("n", F.lit(0)).alias("count"))


def activity_rollup(calendar: DataFrame, days: int) -> DataFrame:
    """calendar with intensity (count by peak), and total, peak and average (total by `days`) on each row."""
    whole = Window.partitionBy(F.lit(0))  # at most some days' rows
    peak = F.max("count").over(whole)
    return calendar.select(
        "date", "count", F.when(peak > 0, F.col("count") / peak).otherwise(0.0).alias("intensity"), F.sum("count").over(whole).alias("total"), peak.alias("peak"), (F.sum("count").over(whole) / F.lit(days)).alias("average"),
    )


def daily_windows(points: DataFrame, stamp: Column) -> DataFrame:
    """(day, site, count) by tumbling one-day windows of a timestamp."""
    return points.groupBy(F.window(stamp, "1 day").alias("w"), "site").agg(F.count(F.lit(1)).alias("count")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "site", "count")
