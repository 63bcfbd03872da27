"""Incremental ingest: raw items -> posts -> checks -> images -> embedding -> upsert -> mark, as batches or micro-batches.

A micro-batch is normalized, checked and folded to one row per point; it is upserted before the marks move, and the marks
move once for the whole batch, so a failed batch is taken again and changes nothing the second time. Rows carry the order
of their raw items, so that the last item of a point stays whatever batch it comes in.

A landing folder holds items in any order, and Spark's own checkpoint knows which files were taken: nothing is cut by the
marks there. A poll asks a source for what is above its mark, so what it gives at or below it is cut. Marks are held per site in
a file beside the table.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from mosaiq.functions import columns as C
from mosaiq.functions.media import Embedder, HashEmbedder, embed_with, valid_image
from mosaiq.operators.store import PointStore
from mosaiq.registry import namespace, page_url
from mosaiq.schema import encode_point_id
from mosaiq.sources import feed
from mosaiq.sources.adapters import after_mark, normalize_items, without_ratings
from mosaiq.streaming import checkpoint

RAW_SCHEMA = "raw_id bigint, site string, fetched_at timestamp_ntz, body string"
POLL_SECONDS, BUSY_SECONDS = 60.0, 5.0


@dataclass
class CycleStats:
    fetched: int = 0
    valid: int = 0
    upserted: int = 0
    partitions: int = 0
    elapsed_secs: float = 0.0

    @property
    def skipped(self) -> int:
        return self.fetched - self.valid

    @property
    def posts_per_second(self) -> float:
        return self.upserted / self.elapsed_secs if self.upserted and self.elapsed_secs else 0.0

    @property
    def seconds_per_post(self) -> float:
        return self.elapsed_secs / self.upserted if self.upserted else 0.0


def all_posts(raw: DataFrame) -> DataFrame:
    """Posts of the raw items but those of excluded ratings, with the item's order (raw_id, place in its body)."""
    return without_ratings(normalize_items(raw, keep=("raw_id", "fetched_at"), place="item"))


def new_posts(raw: DataFrame, marks: DataFrame) -> DataFrame:
    """Posts of the raw items above their site's mark."""
    return after_mark(all_posts(raw), marks)


def with_images(posts: DataFrame, concurrency: int = 8, **how: object) -> DataFrame:
    """posts with the bytes of their thumbnail (`content`), those without a valid image left out.

    A cached thumbnail that is gone (404) is replaced by its original.
    """
    asked = posts.withColumn("__original", C.original_of_cached(F.col("thumbnail_url")))
    return feed.download(asked, "thumbnail_url", "__original", concurrency, "content", **how).where(valid_image(F.col("content"))).drop("__original")


def last_of_points(posts: DataFrame) -> DataFrame:
    """The posts that pass preflight with their ids, the last raw item of each point."""
    fine = posts.where(C.preflight(F.col("thumbnail_url"), F.col("width"), F.col("height")))
    keyed = fine.withColumn("site_namespace", namespace(F.col("site"))).withColumn("point_id", encode_point_id(F.col("site_namespace"), F.col("post_id"))).where(F.col("point_id").isNotNull())
    if "item" not in keyed.columns:
        keyed = keyed.withColumn("item", F.lit(0))
    other = [c for c in keyed.columns if c != "point_id"]
    return keyed.groupBy("point_id").agg(F.max_by(F.struct(*other), F.struct("raw_id", "item")).alias("r")).select("point_id", "r.*")


def to_points(posts: DataFrame, batch_time: int, make_embedder: Callable[[], Embedder] = HashEmbedder, images: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write model of posts that pass preflight: ids, page URL, stored image, vector, one stamp for the batch.

    The last raw item of a point wins. `images`, with_images() or the like, adds the bytes that the embedder then gets;
    without it the embedder gets the tags.
    """
    last = last_of_points(posts)
    last = images(last) if images else last
    return last.select(
        "point_id", "post_id", "site", "site_namespace", page_url(F.col("site"), F.col("post_id"), F.col("canonical_post_url")).alias("post_url"), "thumbnail_url",
        C.stored_image(F.col("direct_image_url"), F.col("thumbnail_url")).alias("direct_image_url"), "tags", "width", "height", F.lit(batch_time).cast("long").alias("ingestion_date"), "rating",
        embed_with(make_embedder, F.col("content" if images else "tags")).alias("image_vec"), F.struct("raw_id", "item").alias("batch_order"),
    )


class EventLog:
    """The last events of the ingest, oldest first, each as a dict of `type`, `data` and a number; readers may wait for more."""

    def __init__(self, kept: int = 256):
        self.kept, self.count, self.events = kept, 0, []
        self.more = threading.Condition()

    def add(self, kind: str, **data: object) -> None:
        with self.more:
            self.count += 1
            self.events = [*self.events[1 - self.kept :], {"type": kind, "data": data, "number": self.count}]
            self.more.notify_all()

    def after(self, number: int, wait: float = 0.0) -> tuple[list[dict], int]:
        """Events beyond a number, waiting for one up to `wait` seconds, and how many of them are no longer kept."""
        with self.more:
            if self.count <= number and wait:
                self.more.wait(wait)
            found = [e for e in self.events if e["number"] > number]
            return found, self.count - number - len(found)

    def status(self) -> dict:
        """Whether there is a mark, the sites seen and their last marks, as status_fold() has it."""
        sites = {e["data"]["site"] for e in self.events if e["type"] in ("CycleComplete", "CheckpointUpdated") and e["data"].get("site")}
        marks: dict[str, int] = {}
        for e in self.events:
            if e["type"] == "CheckpointUpdated":
                marks[e["data"]["site"]] = max(e["data"]["last_id"], marks.get(e["data"]["site"], 0))
        return {"is_running": bool(marks), "active_sites": sorted(sites), "last_checkpoint": marks}


def watch_marks(spark: SparkSession, mark_file: str, log: EventLog, seconds: float = 3.0, stop: threading.Event | None = None) -> threading.Thread:
    """Polls a mark file and logs each mark that is new or has changed; for a process beside the one that ingests."""
    stop = stop or threading.Event()

    def run() -> None:
        known: dict[str, int] = {}
        while True:
            found = checkpoint.load(spark, mark_file)
            for site, mark in found.items():
                if known.get(site) != mark:
                    log.add("CheckpointUpdated", site=site, last_id=mark)
            known = found
            if stop.wait(seconds):
                return

    thread = threading.Thread(target=run, daemon=True)
    thread.stop = stop
    thread.start()
    return thread


class Ingest:
    """run_batch() takes one batch of raw items; as a foreachBatch function it serves a stream.

    images: a stage that adds the posts' image bytes, such as with_images(); without it the tags are embedded.
    """

    def __init__(self, spark: SparkSession, store: PointStore, mark_file: str, make_embedder: Callable[[], Embedder] = HashEmbedder, clock: Callable[[], float] = time.time, images: Callable[[DataFrame], DataFrame] | None = None, log: EventLog | None = None):
        self.spark, self.store, self.mark_file, self.make_embedder, self.clock, self.images = spark, store, mark_file, make_embedder, clock, images
        self.history: list[CycleStats] = []
        self.log = log or EventLog()

    def marks(self) -> DataFrame:
        return self.spark.createDataFrame(list(checkpoint.load(self.spark, self.mark_file).items()), "site string, last_id long")

    def run_batch(self, raw: DataFrame, batch_id: int = 0, polled: bool = False) -> CycleStats:
        """One cycle. polled: the batch is the answer to a request for ids above the marks; others are cut."""
        began, stamp = time.monotonic(), int(self.clock())
        if "error" in raw.columns:
            raw = raw.persist()
            for r in raw.where(F.col("error").isNotNull()).groupBy("site").agg(F.first("error").alias("error")).collect():  # one a site
                self.log.add("CycleFailed", site=r.site, error=r.error)
            raw, held = raw.where(F.col("error").isNull()), raw
        else:
            held = None
        posts = (new_posts(raw, self.marks()) if polled else all_posts(raw)).persist()
        try:
            points = to_points(posts, stamp, self.make_embedder, self.images).persist()
            fetched = {r.site: (r.n, r.top) for r in posts.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.max("post_id").alias("top")).collect()}  # one a site
            taken = {r.site: r.n for r in points.groupBy("site").agg(F.count(F.lit(1)).alias("n")).collect()} if fetched else {}
            stats = CycleStats(sum(n for n, _ in fetched.values()), sum(taken.values()))
            if stats.valid:
                stats.partitions, stats.upserted = self.store.upsert(points), stats.valid
            took = time.monotonic() - began
            for site, (n, _) in sorted(fetched.items()):
                self.log.add("CycleComplete", site=site, fetched=n, upserted=taken.get(site, 0), elapsed_secs=took)
            if fetched:  # after the data: a batch that fails before this is taken again
                old = checkpoint.load(self.spark, self.mark_file)
                new = old | {s: max(top, checkpoint.get(old, s)) for s, (_, top) in fetched.items()}
                checkpoint.save(self.spark, self.mark_file, new)
                for site in sorted(fetched):
                    self.log.add("CheckpointUpdated", site=site, last_id=new[site])
            points.unpersist()
        finally:
            posts.unpersist()
            if held is not None:
                held.unpersist()
        stats.elapsed_secs = time.monotonic() - began
        self.history.append(stats)
        return stats

    def stream(self, folder: str, checkpoint_folder: str, files_per_batch: int = 4, seconds: int | None = None) -> StreamingQuery:
        """A query over a landing folder of raw items in Parquet; without `seconds` it ends once all is taken."""
        raw = self.spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
        return raw.writeStream.foreachBatch(lambda df, k: self.run_batch(df, k) and None).option("checkpointLocation", checkpoint_folder).trigger(**trigger).start()

    def poll(self, urls: dict[str, str | list[str]], credentials: dict | None = None, cycles: int | None = None, seconds: float = POLL_SECONDS, busy_seconds: float = BUSY_SECONDS, sleep: Callable[[float], None] = time.sleep, **options: object) -> list[CycleStats]:
        """Asks all sites for what is above their marks, cycle by cycle; without `cycles` it goes on for ever.

        The sites are read side by side, each in a task of its own; one that fails is logged and holds up no other. After a
        cycle with new posts the pause is `busy_seconds`, else `seconds`. A cycle that fails as a whole is logged, moves no
        mark and is tried again.
        """
        self.spark.dataSource.register(feed.FeedSource)
        out: list[CycleStats] = []
        while cycles is None or len(out) < cycles:
            given = feed.feed_options(urls, credentials, marks=json.dumps(checkpoint.load(self.spark, self.mark_file)), **options)
            try:
                stats = self.run_batch(self.spark.read.format("posts_feed").options(**given).load(), len(out), polled=True)
            except Exception as error:  # noqa: BLE001
                self.log.add("CycleFailed", site=None, error=str(error)[:500])
                stats = CycleStats()
            out.append(stats)
            if cycles is None or len(out) < cycles:
                pause = busy_seconds if stats.upserted else seconds
                self.log.add("Sleeping", sleep_secs=pause)
                sleep(pause)
        return out


def checkpoint_max(events: DataFrame) -> DataFrame:
    """(site, last_id): the highest mark of each site in an event log."""
    return events.where((F.col("event_type") == "CheckpointUpdated") & F.col("site").isNotNull()).groupBy("site").agg(F.max("last_id").alias("last_id"))


def status_fold(events: DataFrame) -> DataFrame:
    """One row: is_running, active_sites, last_checkpoint (JSON), n_events of an event log, whatever its order.

    Rows repeated whole count once. Active are the sites with a cycle or a mark; running means that there is a mark.
    """
    once = events.dropDuplicates()
    marks = checkpoint_max(once).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", "last_id")))).alias("m"))  # one a site
    sites = once.where(F.col("event_type").isin("CycleComplete", "CheckpointUpdated") & F.col("site").isNotNull()).agg(F.array_sort(F.collect_set("site")).alias("active_sites"))
    return once.agg(F.count(F.lit(1)).alias("n_events")).join(marks).join(sites).select(
        (F.coalesce(F.size("m"), F.lit(0)) > 0).alias("is_running"), F.coalesce("active_sites", F.array().cast("array<string>")).alias("active_sites"), F.to_json("m").alias("last_checkpoint"), "n_events"
    )


def cycle_metrics(events: DataFrame) -> DataFrame:
    """(site, cycles, failures, fetched, upserted, skipped, posts_per_second, seconds_per_post) of an event log.

    Rows repeated whole count once; rates are 0 without posts or time; a null site is a row of its own.
    """
    done, once = F.col("event_type") == "CycleComplete", events.where(F.col("event_type").isin("CycleComplete", "CycleFailed")).dropDuplicates()
    sums = once.groupBy("site").agg(
        F.count_if(done).alias("cycles"), F.count_if(~done).alias("failures"), F.coalesce(F.sum(F.when(done, F.col("fetched"))), F.lit(0)).alias("fetched"),
        F.coalesce(F.sum(F.when(done, F.col("upserted"))), F.lit(0)).alias("upserted"), F.coalesce(F.sum(F.when(done, F.col("elapsed_secs"))), F.lit(0.0)).alias("secs"),
    )
    rate = lambda a, b: F.when((F.col("upserted") > 0) & (F.col("secs") > 0), F.round(a / b, 6)).otherwise(0.0)
    return sums.select("site", "cycles", "failures", "fetched", "upserted", (F.col("fetched") - F.col("upserted")).alias("skipped"), rate(F.col("upserted"), F.col("secs")).alias("posts_per_second"), rate(F.col("secs"), F.col("upserted")).alias("seconds_per_post"))


def daily_events(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """(day, event_type, count) by event time; on a stream, events later than `delay` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("count")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "count")


class ProgressEvents(StreamingQueryListener):
    """Logs what the session's streaming queries report; add it with spark.streams.addListener()."""

    def __init__(self, log: EventLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log.add("StatusSnapshot", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        self.log.add("BatchComplete", batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.log.add("Sleeping", id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self.log.add("CycleFailed" if event.exception else "StatusSnapshot", id=str(event.id), error=event.exception)
