"""Scalar functions on posts, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_ASPECT = 2.0


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(strip(text), F.lit(""))


def first_url(*urls: Column) -> Column:
    """The first that isn't blank, trimmed, or ''."""
    return F.coalesce(*map(blank_to_null, urls), F.lit(""))


def shown_image(direct: Column, thumbnail: Column) -> Column:
    """On reading: the direct image, or the thumbnail where that is null or empty."""
    return F.coalesce(F.nullif(direct, F.lit("")), thumbnail)


def stored_image(direct: Column, thumbnail: Column) -> Column:
    """On writing: the direct image, or the thumbnail where that is null."""
    return F.coalesce(direct, thumbnail)


def strip_html(html: Column) -> Column:
    """Without tags: what stands between < and the next >, or to the end, and any > left over."""
    return F.replace(F.regexp_replace(html, "<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def synthesized_tags(title: Column, summary: Column, service: Column) -> Column:
    """Title, summary without HTML and service in one string, blanks left out."""
    plain = F.replace(strip_html(summary), F.lit("\n"), F.lit(" "))
    return F.concat_ws(" ", *map(blank_to_null, (title, plain, service)))


def unique_tags(values: Column) -> Column:
    """The entries of an array with inner white space collapsed, blanks and repetitions dropped, joined by spaces."""
    clean = F.transform(values, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))), " ")


def joined_groups(*groups: Column) -> Column:
    """Arrays of tags one after another, joined by spaces; a null array is empty."""
    return F.array_join(F.concat(*(F.coalesce(g, F.array().cast("array<string>")) for g in groups)), " ")


def nsfw_rating(nsfw: Column, level: Column) -> Column:
    level = F.lower(F.coalesce(level, F.lit("")))
    return F.when(level == "none", "s").when(level == "soft", "q").when(level.isin("mature", "x"), "e").otherwise(F.when(F.coalesce(nsfw, F.lit(False)), "e").otherwise("s"))


def _segments(url: Column) -> Column:
    return F.split(F.ltrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/")), "/")


def cached_thumbnail(url: Column) -> Column:
    """URL of the cached thumbnail of an original image's URL: its asset is the segment before 'original'; else null."""
    parts = _segments(url)
    at = F.array_position(F.transform(parts, lambda x: F.when(x.isin("original", "original=true"), F.lit(1)).otherwise(F.lit(0))), 1)
    asset = strip(F.get(parts, (at - 2).cast("int")))
    return F.when((at > 1) & (asset != ""), F.concat(F.lit("https://image-b2.civitai.com/file/civitai-media-cache/"), asset, F.lit("/450x%3Cauto%3E_so")))


def original_of_cached(url: Column) -> Column:
    """The inverse of cached_thumbnail."""
    parts = _segments(url)
    variant = F.lower(strip(F.get(parts, F.size(parts) - 1)))
    at = F.array_position(parts, "civitai-media-cache")
    asset = strip(F.get(parts, at.cast("int")))
    return F.when(variant.isin("450x%3cauto%3e_so", "450x<auto>_so") & (at > 0) & (asset != ""), F.concat(F.lit("https://image-b2.civitai.com/file/civitai-media-cache/"), asset, F.lit("/original")))


def is_image_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(r"\.(jpg|jpeg|png|webp|gif|bmp)$"), F.lit(False))


def is_image_item(kind: Column, url: Column) -> Column:
    """The type is image or null, and the URL isn't that of a video."""
    return (kind.isNull() | (F.lower(kind) == "image")) & ~F.coalesce(F.lower(url).rlike(r"\.(mp4|webm)($|\?)"), F.lit(False))


def media_url(base: Column, path: Column) -> Column:
    """path under base, with /data before it unless it is there or the path is a URL."""
    root, clean = F.rtrim(base, F.lit("/")), strip(path)
    return (
        F.when(path.rlike("^https?://"), path)
        .when(clean.startswith("data/"), F.concat(root, F.lit("/"), clean))
        .when(clean.startswith("/data/"), F.concat(root, clean))
        .when(clean.startswith("/"), F.concat(root, F.lit("/data"), clean))
        .otherwise(F.concat(root, F.lit("/data/"), clean))
    )


def service_page(base: Column, service: Column, user: Column, post_id: Column) -> Column:
    """base/service/user/U/post/P, null if the service or user is blank."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), blank_to_null(service), F.lit("/user/"), blank_to_null(user), F.lit("/post/"), post_id.cast("string"))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Longer edge by shorter one; null if both are 0; a single 0 counts as 1."""
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    return F.when((width != 0) | (height != 0), F.greatest(w, h) / F.least(w, h))


def preflight(thumbnail: Column, width: Column, height: Column) -> Column:
    """Whether a post has a thumbnail and, as far as known, an aspect ratio of at most MAX_ASPECT."""
    return F.coalesce(thumbnail != "", F.lit(False)) & F.coalesce(aspect_ratio(width, height) <= MAX_ASPECT, F.lit(True))


def utc_date(epoch: Column) -> Column:
    """YYYY-MM-DD of epoch seconds; negative ones clamp to the epoch."""
    return F.date_format(F.date_from_unix_date(F.floor(F.greatest(epoch, F.lit(0)) / 86400).cast("int")), "yyyy-MM-dd")


def site_list(text: Column) -> Column:
    """Array of the names in a comma-separated list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
