"""The site dimension: names, namespaces, source families and page templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: fixed values: site, namespace, family of its items, template of a post's page
SITES = [
    ("rule34", 1, "flat", "https://rule34.xxx/index.php?page=post&s=view&id={id}"),
    ("e621", 2, "grouped", "https://e621.net/posts/{id}"),
    ("safebooru", 3, "flat", "https://safebooru.org/index.php?page=post&s=view&id={id}"),
    ("gelbooru", 4, "flat", "https://gelbooru.com/index.php?page=post&s=view&id={id}"),
    ("danbooru", 5, "tagged", "https://danbooru.donmai.us/posts/{id}"),
    ("xbooru", 6, "flat", "https://xbooru.com/index.php?page=post&s=view&id={id}"),
    ("kemono", 7, "attached", "https://kemono.cr/posts/{id}"),
    ("aibooru", 8, "tagged", "https://aibooru.online/posts/{id}"),
    ("e6ai", 9, "grouped", "https://e6ai.net/posts/{id}"),
    ("konachan", 10, "board", "https://konachan.com/post/show/{id}"),
    ("yandere", 11, "board", "https://yande.re/post/show/{id}"),
    ("civitai", 12, "generated", "https://civitai.com/images/{id}"),
]
UNKNOWN_TEMPLATE = "https://unknown/?id={id}"


def _lookup(site: Column, place: int, default: object) -> Column:
    pairs = [F.lit(x) for row in SITES for x in (row[0], row[place])]
    return F.coalesce(F.element_at(F.create_map(*pairs), site), F.lit(default))


def namespace(site: Column) -> Column:
    """Namespace of a site, 0 for an unknown or null one."""
    return _lookup(F.coalesce(site, F.lit("")), 1, 0).cast("long")


def family(site: Column) -> Column:
    return _lookup(F.coalesce(site, F.lit("")), 2, "")


def page_url(site: Column, post_id: Column, canonical: Column | None = None) -> Column:
    """The canonical URL if given, else the site's page template filled with the id."""
    filled = F.replace(_lookup(F.coalesce(site, F.lit("")), 3, UNKNOWN_TEMPLATE), F.lit("{id}"), post_id.cast("string"))
    return filled if canonical is None else F.coalesce(canonical, filled)
