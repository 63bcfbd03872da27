import json
import struct

import pytest
from pyspark.sql import functions as F

from mosaiq import api, registry, schema
from mosaiq.functions import columns as C
from mosaiq.functions.media import HashEmbedder, embed_with, image_size, valid_image
from mosaiq.sources.adapters import after_mark, first_by_id, normalize_items


def values(spark, rows, kind, column):
    return [r[0] for r in spark.createDataFrame(rows, kind).select(column).collect()]


def test_html(spark):
    cases = {"a<b<c>d": "ad", "a>b": "ab", "<x": "", "x<": "x", "<<a>>b": "b", "a<b\nc>d": "ad", "": "", None: None}
    assert values(spark, [(k,) for k in cases], "h string", C.strip_html(F.col("h"))) == list(cases.values())


def test_aspect_and_preflight(spark):
    rows = [("t", 0, 0, True), ("t", 0, 2, True), ("t", 0, 3, False), ("t", 200, 100, True), ("t", 201, 100, False), ("", 1, 1, False), (None, 1, 1, False), ("t", None, 5, False), ("t", None, 0, True)]
    got = values(spark, rows, "t string, w long, h long, e boolean", C.preflight(F.col("t"), F.col("w"), F.col("h")))
    assert got == [r[3] for r in rows]


def test_point_ids(spark):
    rows = [(2, 123456), (3, 123456), (1, 10**12), (1, -1), (None, 1)]
    df = spark.createDataFrame(rows, "n long, p long").select(schema.encode_point_id(F.col("n"), F.col("p")).alias("i"))
    assert [r.i for r in df.collect()] == [2000000123456, 3000000123456, None, None, None]
    back = df.where("i is not null").select(schema.decode_namespace(F.col("i")), schema.decode_post_id(F.col("i"))).collect()
    assert [tuple(r) for r in back] == [(2, 123456), (3, 123456)]


def test_coercion(spark):
    rows = {'"x"': ("x", 0, 0), "5": ("5", 5, 5), "-3": ("-3", 0, -3), "1.0": ("1", 1, 1), "2.9": ("2.9", 2, 2), "1e12": ("1e12", 0, 10**12), "true": ("true", 0, 0), "null": ("", 0, 0), '"12x"': ("12x", 0, 0), '"12"': ("12", 12, 12), "1e300": ("1e300", 0, 2**63 - 1), None: ("", 0, 0)}
    v = F.col("v")
    got = spark.createDataFrame([(k,) for k in rows], "v string").select(schema.payload_string(v), schema.payload_u32(v), schema.payload_i64(v)).collect()
    assert [tuple(r) for r in got] == list(rows.values())


def test_urls(spark):
    base = F.lit("https://h.example/")
    cases = {"http://x/y": "http://x/y", "data/a": "https://h.example/data/a", "/data/a": "https://h.example/data/a", "/a": "https://h.example/data/a", "a": "https://h.example/data/a"}
    assert values(spark, [(k,) for k in cases], "p string", C.media_url(base, F.col("p"))) == list(cases.values())
    cached = "https://image-b2.civitai.com/file/civitai-media-cache/ABC/450x%3Cauto%3E_so"
    assert values(spark, [("https://i.example/k/ABC/original=true/n.jpeg",), ("https://i.example/original/n.jpeg",), ("nonsense",), (None,)], "u string", C.cached_thumbnail(F.col("u"))) == [cached, None, None, None]
    assert values(spark, [(cached,), ("https://h/x",)], "u string", C.original_of_cached(F.col("u"))) == [cached.rsplit("/", 1)[0] + "/original", None]
    assert values(spark, [("kemono", 5), ("nowhere", 5), (None, 5)], "s string, i long", registry.page_url(F.col("s"), F.col("i"))) == ["https://kemono.cr/posts/5", "https://unknown/?id=5", "https://unknown/?id=5"]


def test_tags_and_ratings(spark):
    assert values(spark, [(["a  b", None, " ", "a b", "c"],), (None,)], "t array<string>", C.unique_tags(F.col("t"))) == ["a b c", None]
    assert values(spark, [(None, "Soft"), (True, "odd"), (False, None), (None, "X")], "n boolean, l string", C.nsfw_rating(F.col("n"), F.col("l"))) == ["q", "e", "s", "e"]
    assert values(spark, [(-5,), (0,), (86400 * 59,)], "e long", C.utc_date(F.col("e"))) == ["1970-01-01", "1970-01-01", "1970-03-01"]


RAW = [
    (1, "rule34", '[{"id": 7, "tags": "a", "file_url": "f"}, {"id": "8", "preview_url": " ", "sample_url": "s"}]'),
    (2, "gelbooru", '{"post": [{"id": "9", "width": "10", "height": 20}, {"id": "x"}]}'),
    (3, "danbooru", '[{"id": 1, "tag_string": "t", "large_file_url": "l", "image_width": 5}]'),
    (4, "e621", '{"posts": [{"id": 2, "tags": {"general": ["g"], "lore": ["l"], "artist": null}, "preview": null, "sample": {"url": "s"}, "file": {"url": null, "width": 3}}]}'),
    (5, "kemono", '{"posts": [{"id": "3", "user": "u", "service": "v", "title": " T ", "substring": "<p>x</p>\\ny", "file": {"path": "/a.mp4"}, "attachments": [{"path": "z.zip"}, {"path": "b.PNG"}]}, {"id": 4, "file": null}]}'),
    (6, "civitai", '{"items": [{"id": 5, "url": "https://i.example/A/original=true/x.jpeg", "nsfwLevel": "Mature", "username": "u", "meta": {"Model": "m", "resources": [{"name": "u"}]}}, {"id": 6, "url": "v.mp4"}, {"id": 7, "type": "video"}]}'),
    (7, "rule34", "<html>"), (8, "rule34", ""), (9, "rule34", None), (10, "rule34", '[{"id": 1'), (11, "other", '[{"id": 1}]'), (12, None, '[{"id": 1}]'), (13, "konachan", '{"id": 12, "jpeg_url": "j", "tags": "k"}'),
]


def test_adapters(spark):
    raw = spark.createDataFrame(RAW, "raw_id long, site string, body string").withColumn("post_id", F.lit("clash"))
    got = {(r.site, r.post_id): r for r in normalize_items(raw).collect()}
    assert set(got) == {("rule34", 7), ("rule34", 8), ("gelbooru", 9), ("danbooru", 1), ("e621", 2), ("kemono", 3), ("kemono", 4), ("civitai", 5), ("konachan", 12)}
    assert (got["rule34", 7].thumbnail_url, got["rule34", 8].thumbnail_url, got["rule34", 8].direct_image_url) == ("f", "s", "s")
    assert (got["gelbooru", 9].width, got["gelbooru", 9].height) == (10, 20)
    assert got["danbooru", 1].thumbnail_url == "l" and got["e621", 2].tags == "g l" and got["e621", 2].thumbnail_url == "s"
    k = got["kemono", 3]
    assert (k.tags, k.thumbnail_url, k.canonical_post_url) == ("T x y v", "https://kemono.cr/data/b.PNG", "https://kemono.cr/v/user/u/post/3")
    assert got["kemono", 4].thumbnail_url == "" and got["kemono", 4].canonical_post_url is None
    assert got["civitai", 5].tags == "u m" and got["civitai", 5].rating == "e" and "/A/450x" in got["civitai", 5].thumbnail_url
    assert normalize_items(raw.limit(0)).count() == 0


def test_first_and_marks(spark):
    df = spark.createDataFrame([(2, "a", 5), (1, "a", 5), (3, "a", 6), (4, "b", 1)], "raw_id long, site string, post_id long")
    assert {(r.raw_id, r.post_id) for r in first_by_id(df, "raw_id").collect()} == {(1, 5), (3, 6), (4, 1)}
    marks = spark.createDataFrame([("a", 5)], "site string, last_id long")
    assert {r.raw_id for r in after_mark(df, marks).collect()} == {3, 4}


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 50) + b"\0" * 600
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 60, 31) + b"\0" * 600
    assert image_size(png) == (40, 50) and image_size(jpeg) == (31, 60) and image_size(b"\xff\xd8") is None and image_size(b"GIF89a") is None
    df = spark.createDataFrame([(bytearray(png),), (bytearray(png[:100]),), (bytearray(jpeg),), (None,), (bytearray(b""),)], "b binary")
    assert [r[0] for r in df.select(valid_image("b")).collect()] == [True, False, False, False, False]


def test_embedder(spark):
    df = spark.createDataFrame([("a b",), ("b a",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(embed_with(HashEmbedder, "t")).collect()]
    assert got[0] == got[1] and got[2] == got[3] and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got)


def test_sites_and_envelope():
    assert api.parse_sites("a, b,,") == ["a", "b"] and api.parse_sites(["a,b", " c "]) == ["a", "b", "c"] and api.parse_sites(None) == []
    assert json.loads(api.envelope([{"post_id": 1, "tags": "", "score": None}], 20)) == {"data": [{"post_id": 1}], "meta": {"count": 1, "next_offset": 20}}


def test_parser():
    from mosaiq.cli import parser

    args = parser().parse_args(["search", "--points", "p", "cat"])
    assert (args.limit, args.image_weight, args.text) == (10, 1.0, "cat")
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])


def test_new_family(spark, monkeypatch):
    from mosaiq.sources import adapters

    monkeypatch.setattr(registry, "SITES", [*registry.SITES, ("newsite", 13, "plain", "https://new.example/{id}")])
    monkeypatch.setattr(adapters, "FAMILIES", dict(adapters.FAMILIES))
    monkeypatch.setattr(adapters, "_ADAPTERS", dict(adapters._ADAPTERS))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    adapters.register_family("plain", "number STRING, words STRING", lambda x: adapters.post_fields(x.words, F.lit("t"), none, zero, zero, none, None, x.number), "rows")
    raw = spark.createDataFrame([("newsite", '{"rows": [{"number": 4, "words": "w"}]}'), ("rule34", '[{"id": 1}]')], "site string, body string")
    assert {(r.site, r.post_id, r.tags) for r in normalize_items(raw).collect()} == {("newsite", 4, "w"), ("rule34", 1, "")}
