"""Polling sources: a Python data source of raw items, page fetching with retries, and bulk downloads.

    spark.dataSource.register(FeedSource)
    spark.readStream.format("posts_feed").option("urls", json.dumps({"rule34": "https://.../{last_id}"})).load()

Each site is one partition; its address may be a list of mirrors, of which the one that answers is kept for the poll. An
address with {offset} is read page by page until an empty page or one like that before; the option pages (none by
default) limits them. A site whose pages can't all be had gives none, so that no mark moves past a missing page. An
address without {offset} is one page, whose items must then reach back to the last poll. {user} and {key} stand for a
site's credentials, which are sent as basic authorization where the address doesn't hold them. A site that fails gives one
row without a body and with the error. {last_id} is the site's mark: given by the option marks, or read from the file of
the option markFile at each poll of a stream. A stream's offset is the time of the poll; what was seen before is cut by
the high-water marks of the sink, so a poll taken twice does no harm.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mosaiq.registry import SITES

RETRIES, FIRST_WAIT, LONGEST_WAIT, TIMEOUT = 6, 5.0, 300.0, 30.0
PAGE_SIZE = 50


class FetchError(OSError):
    """A page or file that couldn't be had; status is that of the last answer, if there was one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def fetch(url: str, retries: int = RETRIES, first_wait: float = FIRST_WAIT, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep, user: tuple[str, str] | None = None, most: int | None = None) -> bytes:
    """The body of an answer 200, of at most `most` bytes. 429, 5xx and lost connections are tried again, waiting twice as
    long each time.
    """
    if urlsplit(url).scheme not in ("http", "https"):
        raise FetchError("not an http address")
    request = urllib.request.Request(url, headers={"User-Agent": "mosaiq/1"})
    if user:
        import base64

        request.add_header("Authorization", "Basic " + base64.b64encode(":".join(user).encode()).decode())
    wait = first_wait
    for left in range(retries, -1, -1):
        status = None
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                body = answer.read() if most is None else answer.read(most + 1)
                if most is not None and len(body) > most:
                    raise FetchError(f"more than {most} bytes", 200)
                return body
        except urllib.error.HTTPError as error:
            status, why = error.code, str(error)
            if error.code != 429 and error.code < 500:
                raise FetchError(why, status) from error
        except FetchError:
            raise
        except (urllib.error.URLError, OSError) as error:
            why = str(error)
        if not left:
            raise FetchError(why, status)
        sleep(min(wait, LONGEST_WAIT))
        wait *= 2
    raise AssertionError


def fetch_first(urls: list[str], **how: object) -> bytes:
    """The first body to be had from a list of mirrors."""
    for k, url in enumerate(urls):
        try:
            return fetch(url, **how)
        except FetchError:
            if k == len(urls) - 1:
                raise
    raise FetchError("no address")


def check_credentials(given: dict[str, tuple[str | None, str | None]]) -> list[str]:
    """Sites to poll, in the registry's order: those without credentials given or with both; half a pair is an error."""
    out = []
    for name, *_ in SITES:
        pair = given.get(name)
        if pair is None or all(pair):
            out.append(name)
        elif any(pair):
            raise ValueError(f"{name}: half of the credentials is missing")
    return out


def feed_options(urls: dict[str, str | list[str]], credentials: dict[str, tuple[str | None, str | None]] | None = None, **options: object) -> dict[str, str]:
    """Options of FeedSource for all sites with an address; a site whose credentials are half given is an error."""
    credentials = credentials or {}
    sites = [s for s in check_credentials(credentials) if s in urls]
    whole = {s: list(credentials[s]) for s in sites if s in credentials}
    return {"urls": json.dumps({s: urls[s] for s in sites}), "credentials": json.dumps(whole)} | {k: str(v) for k, v in options.items()}


class _Site(InputPartition):
    def __init__(self, site: str, urls: list[str], user: tuple[str, str] | None = None):
        super().__init__((site, *urls))
        self.site, self.urls, self.user = site, urls, user


def _empty(body: str) -> bool:
    """Whether a page is JSON without items: an empty list, or an envelope of no list but empty ones."""
    try:
        page = json.loads(body)
    except ValueError:
        return not body.strip()
    lists = [x for x in page.values() if isinstance(x, list)] if isinstance(page, dict) else [page]
    return bool(lists) and not any(lists) or not page


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.urls: dict[str, str | list[str]] = json.loads(options["urls"])
        self.pages, self.page_size = int(options["pages"]) if "pages" in options else None, int(options.get("pagesize", PAGE_SIZE))
        self.marks: dict[str, int] = json.loads(options.get("marks", "{}"))
        self.how = {"retries": int(options.get("retries", RETRIES)), "first_wait": float(options.get("firstwait", FIRST_WAIT)), "timeout": float(options.get("timeout", TIMEOUT))}
        self.credentials: dict[str, list[str]] = json.loads(options.get("credentials", "{}"))
        self.mark_file = options.get("markfile")
        unknown = set(self.urls) - {s[0] for s in SITES}
        if unknown:
            raise ValueError(f"unknown sites: {sorted(unknown)}")

    def _marks(self) -> dict[str, int]:
        if self.mark_file:
            try:  # no session here
                files, path = pa_fs.FileSystem.from_uri(self.mark_file)
                with files.open_input_stream(path) as text:
                    return json.loads(text.read())
            except (OSError, ValueError):
                pass
        return self.marks

    def _parts(self) -> list[_Site]:
        marks, out = self._marks(), []
        for site, given in sorted(self.urls.items()):
            pair = self.credentials.get(site)
            mirrors = [x.replace("{last_id}", str(marks.get(site, 0))) for x in ([given] if isinstance(given, str) else given)]
            named = pair and any("{key}" in x for x in mirrors)
            if named:
                mirrors = [x.replace("{user}", quote(pair[0])).replace("{key}", quote(pair[1])) for x in mirrors]
            out.append(_Site(site, mirrors, tuple(pair) if pair and not named else None))
        return out

    def read(self, partition: _Site) -> Iterator[tuple]:
        """One row a page; a site that can't be reached gives one with the error, so that it doesn't hold up the others."""
        found: list[str] = []
        began, now = int(time.time() * 1000), datetime.now(timezone.utc).replace(tzinfo=None)
        mirrors = list(partition.urls)
        while mirrors and (self.pages is None or len(found) < self.pages):
            try:
                body = fetch(mirrors[0].replace("{offset}", str(len(found) * self.page_size)), user=partition.user, **self.how).decode("utf-8", "replace")
            except FetchError as error:
                mirrors.pop(0)
                found = []  # another mirror may order its pages otherwise
                if not mirrors:
                    yield began, partition.site, now, None, f"credentials missing or refused: {error}" if error.status == 401 else str(error)
                    return
                continue
            paged = "{offset}" in mirrors[0]
            if paged and (_empty(body) or found[-1:] == [body]):
                break
            found.append(body)
            if not paged:
                break
        for page, body in enumerate(found):
            yield began + len(found) - page, partition.site, now, body, None  # the first page is the newest


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._parts()


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"polled": 0}

    def latestOffset(self) -> dict:
        return {"polled": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._parts()


class FeedSource(DataSource):
    """Options: urls (JSON, site to address or mirrors), credentials (JSON, site to pair), marks (JSON, site to last id) or markFile, pages, pageSize, retries, firstWait, timeout."""

    @classmethod
    def name(cls) -> str:
        return "posts_feed"

    def schema(self) -> str:
        return "raw_id bigint, site string, fetched_at timestamp_ntz, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def download(rows: DataFrame, url: str, fallback: str | None = None, concurrency: int = 8, name: str = "content", **how: object) -> DataFrame:
    """rows with the bytes at df[url]; where that is missing (404) those at df[fallback]; null if neither can be had.

    `concurrency` downloads run at a time in each task; a failed one doesn't fail the others.
    """
    names = rows.columns
    at, other = names.index(url), names.index(fallback) if fallback else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def one(pair: tuple[str | None, str | None]) -> bytes | None:
        first, second = pair
        try:
            return fetch(first, **how) if first else None
        except FetchError as error:
            if error.status == 404 and second:
                try:
                    return fetch(second, **how)
                except FetchError:
                    pass
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                urls = batch.column(at).to_pylist()
                spare = batch.column(other).to_pylist() if other is not None else [None] * len(urls)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(pool.map(one, zip(urls, spare))), pa.binary())], names=[*names, name])

    return rows.mapInArrow(run, f"{schema}, `{name}` binary")
