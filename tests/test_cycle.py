"""The whole ingest cycle against a local server: pages, credentials, failing sites, thumbnails with fallback, images, marks."""

import base64
import json
import struct
import threading
import zlib
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from mosaiq.operators.store import PointStore
from mosaiq.sources import feed
from mosaiq.streaming import checkpoint
from mosaiq.streaming.ingest import Ingest, with_images


def png(edge, shade=7):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes((shade * x * y + x) % 251 for x in range(edge * 3)) for y in range(edge))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", edge, edge, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def web():
    posts = {"rule34": [{"id": k, "tags": f"t{k}", "width": 40, "height": 40, "rating": "s"} for k in range(1, 8)]}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            parts = urlsplit(self.path)
            query = {k: v[0] for k, v in parse_qs(parts.query).items()}
            asked.append((parts.path, query, self.headers.get("Authorization")))
            status, body = 200, b""
            if parts.path == "/rule34":
                found = [p | {"preview_url": f"{base}/image/{p['id']}"} for p in posts["rule34"] if p["id"] > int(query["after"])][::-1]
                at = int(query["offset"])
                body = json.dumps({"post": found[at : at + 3]}).encode()
            elif parts.path == "/e621":
                if self.headers.get("Authorization") != "Basic " + base64.b64encode(b"me:secret").decode():
                    status = 401
                body = json.dumps({"posts": [{"id": 5, "preview": {"url": f"{base}/image/50"}, "file": {"width": 1, "height": 1}, "rating": "s"}]}).encode()
            elif parts.path.startswith("/image/"):
                number = int(parts.path.split("/")[-1])
                status, body = {2: (404, b""), 3: (200, b"no image"), 4: (200, png(8))}.get(number, (200, png(40, number)))
            else:
                status = 404
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    base = f"http://127.0.0.1:{made.server_port}"
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield base, posts, asked
    made.shutdown()


def test_cycles(spark, tmp_path, web):
    base, posts, asked = web
    store = PointStore(spark, str(tmp_path / "points"))
    run = Ingest(spark, store, str(tmp_path / "marks.json"), clock=lambda: 50, images=partial(with_images, retries=0))
    urls = {"rule34": f"{base}/rule34?after={{last_id}}&offset={{offset}}", "e621": f"{base}/e621", "xbooru": [f"{base}/gone", f"{base}/gone2"], "danbooru": f"{base}/e621?user={{user}}&key={{key}}"}
    credentials = {"e621": ("me", "secret"), "danbooru": ("a b", "k&y")}
    pauses = []

    def sleep(seconds):
        pauses.append(seconds)
        if len(pauses) == 1:
            posts["rule34"] += [{"id": k, "tags": "new", "width": 40, "height": 40, "rating": "s"} for k in (9, 8)]

    first, second, third = run.poll(urls, credentials, cycles=3, seconds=60, busy_seconds=2, sleep=sleep, retries=0, pageSize=3)
    # images 2, 3 and 4 are missing, no image and too small
    assert (first.fetched, first.valid) == (8, 5) and (second.fetched, second.valid) == (2, 2) and third.fetched == 0 and pauses == [2, 2]
    got = {(r.site, r.post_id): r for r in store.points().collect()}
    assert set(got) == {("rule34", k) for k in (1, 5, 6, 7, 8, 9)} | {("e621", 5)}
    assert len({tuple(r.image_vec) for r in got.values()}) == 7  # of the images, not of the tags
    assert checkpoint.load(spark, run.mark_file) == {"rule34": 9, "e621": 5}
    failed = {e["data"]["site"]: e["data"]["error"] for e in run.log.events if e["type"] == "CycleFailed"}
    assert "404" in failed["xbooru"] and "credentials" in failed["danbooru"]
    assert ("/e621", {"user": "a b", "key": "k&y"}, None) in asked and not any(p == "/gone" and q for p, q, _ in asked)
    assert run.log.status()["active_sites"] == ["e621", "rule34"]


def test_marks_of_a_file_move(spark, tmp_path, web):
    base, _, asked = web
    (tmp_path / "m.json").write_text('{"rule34": 6}')
    spark.dataSource.register(feed.FeedSource)
    options = feed.feed_options({"rule34": f"{base}/rule34?after={{last_id}}&offset={{offset}}"}, markFile=str(tmp_path / "m.json"), pageSize=3)
    rows = spark.read.format("posts_feed").options(**options).load().collect()
    assert [p["id"] for r in rows for p in json.loads(r.body)["post"]] == [9, 8, 7] or [p["id"] for r in rows for p in json.loads(r.body)["post"]] == [8, 9, 7]
    assert rows[0].error is None


def test_half_given_credentials():
    with pytest.raises(ValueError):
        feed.feed_options({"e621": "x"}, {"e621": ("me", None)})
    assert json.loads(feed.feed_options({"e621": "x"}, {"e621": (None, None)})["urls"]) == {}
