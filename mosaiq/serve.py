"""A small HTTP front over api.Engine, with the standard library's server; errors are 400, 404, 413 and 500.

/api/ws/ingest is a WebSocket that tells the ingest's events: a greeting, the status, the events kept so far and each
new one, a notice of how many were missed by a reader that fell behind, and a ping when nothing happens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from mosaiq.api import MOST_IMAGE_BYTES, Engine, blend_label, envelope
from mosaiq.functions.media import is_valid_image
from mosaiq.operators.vector import NotFound
from mosaiq.streaming.ingest import EventLog

#: fixed value: what RFC 6455 appends to a key
WEBSOCKET_GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
PING_SECONDS = 20.0


def _page(df) -> str:
    return envelope([r.asDict() for r in df.collect()])  # a page, or a row a site or day


def _search(engine: Engine, query: dict[str, list[str]], image: bytes | None = None) -> str:
    text, url, weight = query.get("q", [None])[0], query.get("image_url", [None])[0], float(query.get("image_weight", [0.5])[0])
    found = json.loads(_page(engine.search(text, image, sites=query.get("site"), limit=int(query.get("limit", [10])[0]), image_weight=weight, image_url=url)))
    label = blend_label(weight) if (text or "").strip() and (image is not None or url) else None
    return json.dumps(found | ({"label": label} if label else {}), sort_keys=True)


def answer(engine: Engine, target: str, log: EventLog | None = None) -> tuple[int, str]:
    """Status and JSON text of a GET request."""
    parts = urlsplit(target)
    query, path = parse_qs(parts.query), [p for p in parts.path.split("/") if p]

    def number(name: str, default: int) -> int:
        return int(query.get(name, [default])[0])

    def found() -> tuple[int, str]:
        match path[1:] if path[:1] == ["api"] else None:
            case ["search"]:
                return 200, _search(engine, query)
            case ["search", "similar", site, post_id]:
                return 200, _page(engine.similar(site, int(post_id), number("limit", 10)))
            case ["recent"]:
                rows, following = engine.recent(number("limit", 20), number("offset", 0), query.get("site"))
                return 200, envelope([{k: v for k, v in r.items() if k != "score"} for r in rows], following)
            case ["post", site, post_id]:
                return 200, json.dumps({"data": engine.post(site, int(post_id))})
            case ["activity"]:
                return 200, _page(engine.activity(number("days", 90), number("now", int(time.time())), query.get("site")))
            case ["sites"]:
                return 200, _page(engine.sites())
            case ["ingest", "status"]:
                return 200, json.dumps({"data": (log or EventLog()).status() | {"events": (log.events if log else [])[-20:]}})
        return 404, json.dumps({"error": "no such route"})

    return _guarded(found)


def _guarded(work) -> tuple[int, str]:
    try:
        return work()
    except NotFound as error:
        return 404, json.dumps({"error": str(error)})
    except ValueError as error:
        return 400, json.dumps({"error": str(error)})
    except Exception as error:  # noqa: BLE001
        return 500, json.dumps({"error": type(error).__name__})


def upload(engine: Engine, content_type: str, body: bytes) -> tuple[int, str]:
    """Status and JSON text of a search by a posted form with a file `image` and the fields of a search."""

    def found() -> tuple[int, str]:
        form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
        if not form.is_multipart():
            return 400, json.dumps({"error": "not a form"})
        fields = {p.get_param("name", header="content-disposition"): p.get_payload(decode=True) or b"" for p in form.iter_parts()}
        image = fields.pop("image", None)
        if not is_valid_image(image):
            return 400, json.dumps({"error": "no valid image"})
        query = {k: [v.decode()] for k, v in fields.items() if k and v}
        query["limit"] = [str(max(1, min(100, int(query.get("limit", ["10"])[0]))))]
        return 200, _search(engine, query, image)

    return _guarded(found)


def frame(text: str, kind: int = 1) -> bytes:
    """An unmasked WebSocket frame: kind 1 is text, 9 a ping, 8 the end."""
    data = text.encode()
    size = bytes([len(data)]) if len(data) < 126 else b"\x7e" + len(data).to_bytes(2, "big") if len(data) < 1 << 16 else b"\x7f" + len(data).to_bytes(8, "big")
    return bytes([0x80 | kind]) + size + data


def tell_events(write, log: EventLog, ping_seconds: float = PING_SECONDS, most: int | None = None) -> None:
    """Writes frames until the reader is gone, or `most` were written."""
    write(frame(json.dumps({"type": "Connected"})))
    write(frame(json.dumps({"type": "StatusSnapshot", "data": log.status()})))
    seen, written = max(0, log.count - len(log.events)), 2
    while most is None or written < most:
        events, missed = log.after(seen, ping_seconds)
        out = [frame(json.dumps({"type": "Lagged", "data": {"missed": missed}}))] if missed else []
        out += [frame(json.dumps(e)) for e in events] or [frame("", 9)]
        for x in out:
            write(x)
        written += len(out)
        seen = events[-1]["number"] if events else seen


def server(engine: Engine, host: str = "0.0.0.0", port: int = 3000, log: EventLog | None = None) -> ThreadingHTTPServer:
    log = log or EventLog()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self) -> None:
            if urlsplit(self.path).path == "/api/ws/ingest":
                self._socket()
            else:
                self._send(*answer(engine, self.path, log))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if urlsplit(self.path).path != "/api/search/upload":
                self.close_connection = True
                self._send(404, json.dumps({"error": "no such route"}))
            elif size > MOST_IMAGE_BYTES + (1 << 16):
                self.close_connection = True
                self._send(413, json.dumps({"error": "too large"}))
            else:
                self._send(*upload(engine, self.headers.get("Content-Type", ""), self.rfile.read(size)))

        def _socket(self) -> None:
            key = self.headers.get("Sec-WebSocket-Key")
            if not key:
                self._send(400, json.dumps({"error": "a WebSocket is expected"}))
                return
            self.send_response(101)
            self.send_header("Upgrade", "websocket")
            self.send_header("Connection", "Upgrade")
            self.send_header("Sec-WebSocket-Accept", base64.b64encode(hashlib.sha1((key + WEBSOCKET_GUID).encode()).digest()).decode())
            self.end_headers()
            self.close_connection = True
            try:
                tell_events(self.wfile.write, log)
            except OSError:  # the reader is gone
                pass

        def _send(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    made = ThreadingHTTPServer((host, port), Handler)
    made.daemon_threads = True
    return made
