"""Raw source items to posts: one JSON schema per source family, all in one scan.

A body may be a single item, a list of items or the family's envelope. Empty bodies, HTML pages and JSON that doesn't
parse give no rows; an item without a usable id is dropped; null nested objects count as absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.functions import columns as C
from mosaiq.registry import family

#: fixed values: item fields of each family, and the key of its envelope
FAMILIES = {
    "flat": ("id STRING, tags STRING, preview_url STRING, sample_url STRING, file_url STRING, width STRING, height STRING, rating STRING", "post"),
    "tagged": ("id STRING, tag_string STRING, preview_file_url STRING, large_file_url STRING, file_url STRING, image_width STRING, image_height STRING, rating STRING", None),
    "board": ("id STRING, tags STRING, preview_url STRING, sample_url STRING, jpeg_url STRING, file_url STRING, width STRING, height STRING, rating STRING", None),
    "grouped": (
        "id STRING, tags STRUCT<general: ARRAY<STRING>, artist: ARRAY<STRING>, contributor: ARRAY<STRING>, copyright: ARRAY<STRING>, character: ARRAY<STRING>, species: ARRAY<STRING>, invalid: ARRAY<STRING>, meta: ARRAY<STRING>, lore: ARRAY<STRING>>, "
        "preview STRUCT<url: STRING>, sample STRUCT<url: STRING>, file STRUCT<width: STRING, height: STRING, url: STRING>, rating STRING",
        "posts",
    ),
    "attached": ("id STRING, user STRING, title STRING, substring STRING, service STRING, file STRUCT<path: STRING, thumbnail: STRUCT<path: STRING>>, attachments ARRAY<STRUCT<path: STRING>>", "posts"),
    "generated": (
        "id STRING, url STRING, type STRING, width STRING, height STRING, nsfwLevel STRING, nsfw BOOLEAN, username STRING, baseModel STRING, "
        "meta STRUCT<prompt: STRING, negativePrompt: STRING, Model: STRING, sampler: STRING, resources: ARRAY<STRUCT<name: STRING>>>",
        "items",
    ),
}
KEMONO_BASE = "https://kemono.cr"
TAG_GROUPS = ("general", "artist", "contributor", "copyright", "character", "species", "invalid", "meta", "lore")


def _items(body: Column, kind: str) -> Column:
    """Array of the items of a body."""
    item, envelope = FAMILIES[kind]
    plain = F.from_json(body, f"ARRAY<STRUCT<{item}>>")
    if envelope is None:
        return plain
    wrapped = F.from_json(body, f"STRUCT<{envelope}: ARRAY<STRUCT<{item}>>>")[envelope]
    return F.coalesce(wrapped, plain)


def _number(text: Column) -> Column:
    """A width or height: a whole number below 2^32, else 0."""
    found = F.when(text.rlike(r"^\d{1,10}$"), text.try_cast("bigint"))
    return F.coalesce(F.when(found < 2**32, found), F.lit(0))


def post_fields(tags: Column, thumbnail: Column, direct: Column, width: Column, height: Column, rating: Column, page: Column | None, post_id: Column) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.when(post_id.rlike(r"^\d{1,18}$"), post_id.try_cast("bigint")).alias("post_id"), F.coalesce(tags, F.lit("")).alias("tags"), thumbnail.alias("thumbnail_url"), direct.alias("direct_image_url"),
        width.alias("width"), height.alias("height"), F.coalesce(rating, F.lit("")).alias("rating"), (text if page is None else page).alias("canonical_post_url"),
    )


def _flat(x: Column) -> Column:
    return post_fields(x.tags, C.first_url(x.preview_url, x.sample_url, x.file_url), F.coalesce(x.file_url, x.sample_url), _number(x.width), _number(x.height), x.rating, None, x.id)


def _tagged(x: Column) -> Column:
    return post_fields(x.tag_string, C.first_url(x.preview_file_url, x.large_file_url, x.file_url), F.coalesce(x.file_url, x.large_file_url), _number(x.image_width), _number(x.image_height), x.rating, None, x.id)


def _board(x: Column) -> Column:
    return post_fields(x.tags, C.first_url(x.preview_url, x.sample_url, x.jpeg_url, x.file_url), F.coalesce(x.file_url, x.jpeg_url), _number(x.width), _number(x.height), x.rating, None, x.id)


def _grouped(x: Column) -> Column:
    file = x["file"]
    return post_fields(C.joined_groups(*(x.tags[g] for g in TAG_GROUPS)), C.first_url(x.preview.url, x["sample"].url, file.url), F.coalesce(file.url, x["sample"].url), _number(file.width), _number(file.height), x.rating, None, x.id)


def _attached(x: Column) -> Column:
    base = F.lit(KEMONO_BASE)
    own = F.when(C.is_image_path(x["file"].path), x["file"].path)
    original = F.coalesce(own, F.get(F.filter(F.transform(F.coalesce(x.attachments, F.array().cast("array<struct<path:string>>")), lambda a: a.path), C.is_image_path), F.lit(0)))
    thumb = x["file"].thumbnail.path
    preview = F.coalesce(F.when(C.is_image_path(thumb), thumb), original)
    return post_fields(
        C.synthesized_tags(x.title, x.substring, x.service), C.first_url(C.media_url(base, preview), C.media_url(base, original)), C.media_url(base, original), F.lit(0).cast("long"), F.lit(0).cast("long"),
        F.lit(""), C.service_page(base, x.service, x.user, x.id), x.id,
    )


def _generated(x: Column) -> Column:
    page, url = F.concat(F.lit("https://civitai.com/images/"), x.id), C.blank_to_null(x.url)
    meta = x.meta
    names = F.coalesce(F.transform(meta.resources, lambda r: r["name"]), F.array().cast("array<string>"))
    tags = C.unique_tags(F.concat(F.array(x.username, x.baseModel, meta.Model, meta.sampler), names, F.array(meta.prompt, meta.negativePrompt)))
    return post_fields(tags, C.first_url(C.cached_thumbnail(url), url, page), url, _number(x.width), _number(x.height), C.nsfw_rating(x.nsfw, x.nsfwLevel), page, x.id)


_ADAPTERS = {"flat": _flat, "tagged": _tagged, "board": _board, "grouped": _grouped, "attached": _attached, "generated": _generated}


def register_family(name: str, item_schema: str, adapt: Callable[[Column], Column], envelope: str | None = None) -> None:
    """Adds a source family: its item's fields, its envelope's key and a function from an item to post_fields().

    Sites are mapped to families by registry.SITES.
    """
    FAMILIES[name] = (item_schema, envelope)
    _ADAPTERS[name] = adapt


def normalize_items(raw: DataFrame, site: str = "site", body: str = "body", keep: tuple[str, ...] = (), place: str | None = None) -> DataFrame:
    """Posts of all items in raw (a site name and a JSON body a row): the `keep` columns, site and the post's fields.

    Items of the family 'generated' that aren't images are left out; sites without an adapter give no rows. If `place` is
    given, a column of that name tells an item's place in its body, from 0.
    """
    name, text = F.col(site), F.col(body)
    fine = F.when(~F.ltrim(text).startswith("<") & F.try_parse_json(text).isNotNull(), text)
    kind, posts = family(name), None
    for key, adapt in _ADAPTERS.items():
        items = _items(fine, key)
        if key == "generated":
            items = F.filter(items, lambda x: C.is_image_item(x.type, x.url))
        found = F.transform(items, adapt)
        posts = F.when(kind == key, found) if posts is None else posts.when(kind == key, found)
    if place:
        found = raw.select(*keep, name.alias("site"), F.posexplode(posts).alias(place, "p")).select(*keep, "site", place, "p.*")
    else:
        found = raw.select(*keep, name.alias("site"), F.explode(posts).alias("p")).select(*keep, "site", "p.*")
    return found.where(F.col("post_id").isNotNull())


#: fixed values: ratings that aren't ingested, by site
EXCLUDED_RATINGS = {"civitai": ("s",)}


def without_ratings(posts: DataFrame, excluded: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Posts but those of the ratings excluded for their site."""
    for site, ratings in (EXCLUDED_RATINGS if excluded is None else excluded).items():
        posts = posts.where(~((F.col("site") == site) & F.col("rating").isin(list(ratings))))
    return posts


def first_by_id(posts: DataFrame, order: str) -> DataFrame:
    """The first of the posts with the same site and id, by the column `order`."""
    seen = Window.partitionBy("site", "post_id").orderBy(order)
    return posts.withColumn("__n", F.row_number().over(seen)).where(F.col("__n") == 1).drop("__n")


def after_mark(posts: DataFrame, marks: DataFrame) -> DataFrame:
    """Posts above their site's high-water mark; marks: (site, last_id), one row a site. No mark counts as 0."""
    return posts.join(marks.select("site", "last_id"), "site", "left").where(F.col("post_id") > F.coalesce("last_id", F.lit(0))).drop("last_id")
