import base64
import hashlib
import json
import os
import socket
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from test_cycle import png

from mosaiq import api, serve
from mosaiq.cli import parser, run
from mosaiq.functions.media import HashEmbedder
from mosaiq.operators.density import DensityParams
from mosaiq.streaming.ingest import EventLog


@pytest.fixture(scope="module")
def front(spark):
    embed = HashEmbedder()
    images = [png(40, k) for k in range(1, 5)]
    vectors = embed.embed(images).tolist() + embed.embed(["red car", "blue car"]).tolist()
    rows = [("rule34" if k % 2 else "e621", k, 1000 + k, "http://x/1" if k else "", None, "thumb", None, 1, 2, 3, None, v) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "site string, post_id long, point_id long, post_url string, tags string, thumbnail_url string, direct_image_url string, width long, height long, ingestion_date long, rating string, image_vec array<double>")
    log = EventLog()
    made = serve.server(api.Engine(df.cache()), "127.0.0.1", 0, log)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", images, log, df
    made.shutdown()


def post(url, fields, image=None):
    edge = "xyz"
    body = b"".join(f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items())
    if image is not None:
        body += f'--{edge}\r\nContent-Disposition: form-data; name="image"; filename="a.png"\r\nContent-Type: image/png\r\n\r\n'.encode() + image + b"\r\n"
    body += f"--{edge}--\r\n".encode()
    request = urllib.request.Request(url, body, {"Content-Type": f"multipart/form-data; boundary={edge}"})
    try:
        with urllib.request.urlopen(request) as got:
            return got.status, json.loads(got.read())
    except urllib.error.HTTPError as error:
        return error.code, json.loads(error.read())


def test_upload(front):
    base, images, _, _ = front
    status, found = post(f"{base}/api/search/upload", {"limit": "1"}, images[2])
    assert status == 200 and found["data"][0]["post_id"] == 2 and found["data"][0]["direct_image_url"] == "thumb" and "label" not in found
    status, found = post(f"{base}/api/search/upload", {"q": "red car", "image_weight": "0.4", "limit": "500"}, images[1])
    assert found["label"] == "blend image=0.4 text=0.6" and found["meta"]["count"] == 6
    assert post(f"{base}/api/search/upload", {}, b"no image")[0] == 400 and post(f"{base}/api/search/upload", {})[0] == 400 and post(f"{base}/api/other", {})[0] == 404


def test_image_by_address(front):
    base, images, _, _ = front

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(images[3] if self.path == "/a" else b"x")

        def log_message(self, *_):
            pass

    other = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=other.serve_forever, daemon=True).start()
    there = f"http://127.0.0.1:{other.server_port}"
    with urllib.request.urlopen(f"{base}/api/search?limit=1&image_url={there}/a") as got:
        assert json.loads(got.read())["data"][0]["post_id"] == 3
    for bad in (f"{there}/b", "file:///etc/hosts"):
        with pytest.raises(urllib.error.HTTPError) as error:
            urllib.request.urlopen(f"{base}/api/search?image_url={bad}")
        assert error.value.code == 400
    other.shutdown()


def test_socket_and_status(front):
    base, _, log, _ = front
    log.add("CheckpointUpdated", site="rule34", last_id=8)
    host, port = base.rpartition("/")[2].split(":")
    key = base64.b64encode(os.urandom(16)).decode()
    with socket.create_connection((host, int(port)), 10) as conn:
        conn.sendall(f"GET /api/ws/ingest HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Version: 13\r\nSec-WebSocket-Key: {key}\r\n\r\n".encode())
        stream = conn.makefile("rb")
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            head += stream.readline()
        assert b" 101 " in head and base64.b64encode(hashlib.sha1((key + serve.WEBSOCKET_GUID).encode()).digest()) in head

        def read():
            kind, size = stream.read(2)
            size = int.from_bytes(stream.read(2), "big") if size == 126 else size
            assert kind == 0x81
            return json.loads(stream.read(size))

        assert [read()["type"] for _ in range(3)] == ["Connected", "StatusSnapshot", "CheckpointUpdated"]
        log.add("Sleeping", sleep_secs=1)
        assert read() == {"type": "Sleeping", "data": {"sleep_secs": 1}, "number": 2}
    with urllib.request.urlopen(f"{base}/api/ingest/status") as got:
        assert json.loads(got.read())["data"]["last_checkpoint"] == {"rule34": 8}
    out, small = [], EventLog(kept=2)
    for k in range(4):
        small.add("Sleeping", sleep_secs=k)
    serve.tell_events(out.append, small, 0.01, most=5)
    assert len(out) == 5 and out[-1] == b"\x89\0" and serve.frame("x" * 70_000)[1:10] == b"\x7f" + (70_000).to_bytes(8, "big")


def test_clusters_of_a_site(front, spark):
    *_, df = front
    engine = api.Engine(df)
    params = DensityParams(min_cluster_size=2, neighbours=2)
    assert {r.id for r in engine.cluster(params, site="e621").collect()} == {1000, 1002, 1004}
    labels = spark.createDataFrame([(1000, 0), (1001, 0), (1002, 0), (1003, -1)], "id long, label int")
    shown = engine.cluster_members(labels, 3, 1).collect()
    assert [(r.label, r["size"], r["rank"]) for r in shown] == [(0, 3, 1), (0, 3, 2)] and {r.member for r in shown} <= {"#0", "http://x/1"}


def test_arguments():
    assert api.blend_label(0) is None and api.blend_label(1) is None
    for wrong in (["search", "--points", "x", "--image-weight", "2"], ["cluster", "--points", "x", "--top", "0"], ["ingest", "--points", "x", "--marks", "m"], ["ingest", "--points", "x", "--marks", "m", "--landing", "l"]):
        with pytest.raises(SystemExit):
            run(wrong)
    assert parser().parse_args(["cluster", "--points", "x", "--site", "e621"]).site == "e621"
