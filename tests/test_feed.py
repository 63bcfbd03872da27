import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from mosaiq import serve
from mosaiq.api import Engine
from mosaiq.sources import feed
from mosaiq.sources.adapters import normalize_items


@pytest.fixture(scope="module")
def web():
    hits = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            hits[self.path] = hits.get(self.path, 0) + 1
            status, body = 200, b"data"
            if self.path.startswith("/flaky"):
                status = 503 if hits[self.path] < 3 else 200
            elif self.path.startswith("/missing"):
                status = 404
            elif self.path.startswith("/down"):
                status = 500
            elif self.path.startswith("/posts"):
                body = json.dumps([{"id": 6, "tags": self.path, "preview_url": "p"}]).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", hits
    made.shutdown()


def test_retries(web):
    base, hits = web
    waits = []
    assert feed.fetch(f"{base}/flaky", sleep=waits.append) == b"data" and waits == [5.0, 10.0]
    with pytest.raises(feed.FetchError) as missing:
        feed.fetch(f"{base}/missing", sleep=waits.append)
    assert missing.value.status == 404 and hits["/missing"] == 1
    waits.clear()
    with pytest.raises(feed.FetchError):
        feed.fetch(f"{base}/down", sleep=waits.append)
    assert waits == [5, 10, 20, 40, 80, 160]
    assert feed.fetch_first([f"{base}/missing2", f"{base}/ok"]) == b"data"


def test_credentials():
    assert feed.check_credentials({"e621": ("a", "b"), "rule34": (None, None)})[:2] == ["e621", "safebooru"]
    with pytest.raises(ValueError):
        feed.check_credentials({"e621": ("a", None)})


def test_source(spark, web, tmp_path):
    base, _ = web
    spark.dataSource.register(feed.FeedSource)
    urls = {"rule34": f"{base}/posts?after={{last_id}}", "xbooru": f"{base}/missing3"}
    read = spark.read.format("posts_feed").option("urls", json.dumps(urls)).option("marks", '{"rule34": 4}').option("retries", "0").load()
    assert [(r.site, r.post_id, r.tags) for r in normalize_items(read).collect()] == [("rule34", 6, "/posts?after=4")]
    seen = []
    stream = spark.readStream.format("posts_feed").option("urls", json.dumps(urls)).option("retries", "0").load()
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path)).trigger(once=True).start()
    query.awaitTermination(60)
    assert [(r.site, r.body is None, "404" in (r.error or "")) for r in seen] == [("rule34", False, False), ("xbooru", True, True)]


def test_downloads(spark, web):
    base, _ = web
    rows = [(1, f"{base}/a", None), (2, f"{base}/missing4", f"{base}/b"), (3, f"{base}/missing4", None), (4, None, f"{base}/b")]
    df = spark.createDataFrame(rows, "k long, u string, f string")
    got = {r.k: r.content and bytes(r.content) for r in feed.download(df, "u", "f", retries=0).collect()}
    assert got == {1: b"data", 2: b"data", 3: None, 4: None}


def test_routes(spark):
    rows = [("s", k, k, f"t{k}", "", "", "", 1, 1, 86400 * k, "", [float(k), 1.0] + [0.0] * 62) for k in range(1, 30)]
    engine = Engine(spark.createDataFrame(rows, "site string, post_id long, point_id long, tags string, post_url string, thumbnail_url string, direct_image_url string, width long, height long, ingestion_date long, rating string, image_vec array<float>"))
    status, text = serve.answer(engine, "/api/recent?limit=5&offset=2")
    page = json.loads(text)
    assert status == 200 and page["meta"] == {"count": 5, "next_offset": 7} and "rating" not in page["data"][0] and page["data"][0]["post_id"] == 27
    assert serve.answer(engine, "/api/post/s/3")[0] == 200
    assert serve.answer(engine, "/api/post/s/99")[0] == serve.answer(engine, "/api/search/similar/s/99")[0] == serve.answer(engine, "/api/none")[0] == 404
    assert serve.answer(engine, "/api/search")[0] == serve.answer(engine, "/api/recent?limit=x")[0] == 400
    assert json.loads(serve.answer(engine, "/api/search?q=word&limit=3")[1])["meta"]["count"] == 3
    assert json.loads(serve.answer(engine, "/api/activity?days=2&now=864000")[1])["meta"]["count"] >= 2
    assert json.loads(serve.answer(engine, "/api/sites")[1])["data"][0]["count"] == 29


@pytest.fixture
def paged():
    """A site of 23 items in pages of 5 under /posts; /short fails from its third page on."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            offset = int(self.path.rpartition("=")[2])
            self.send_response(500 if self.path.startswith("/short") and offset >= 10 else 200)
            self.end_headers()
            self.wfile.write(json.dumps([{"id": 100 - k, "tags": "t", "preview_url": "p"} for k in range(offset, min(offset + 5, 23))]).encode())

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_pages_and_mirrors(spark, paged):
    spark.dataSource.register(feed.FeedSource)
    whole, short = f"{paged}/posts?o={{offset}}", f"{paged}/short?o={{offset}}"

    def ids(urls, **options):
        read = spark.read.format("posts_feed").option("urls", json.dumps({"rule34": urls})).option("retries", "0").option("pageSize", "5").options(**options).load()
        return sorted(r.post_id for r in normalize_items(read).collect())

    assert ids(whole) == ids([short, whole]) == list(range(78, 101))
    assert ids(whole, pages="2") == list(range(91, 101))
    assert ids(short) == []
