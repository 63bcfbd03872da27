import json

from pyspark.sql import functions as F

from mosaiq import api
from mosaiq.operators.store import PointStore, recent_page
from mosaiq.streaming import checkpoint
from mosaiq.streaming.ingest import CycleStats, EventLog, Ingest, daily_events, watch_marks


def item(k, site, post, tags="t", width=10):
    return (k, site, json.dumps({"id": post, "tags": tags, "preview_url": "p", "width": width, "height": 10, "rating": "s"}))


def raw(spark, rows):
    return spark.createDataFrame(rows, "raw_id long, site string, body string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz")).select("raw_id", "site", "fetched_at", "body")


def state(store):
    return {(r.site, r.post_id): (r.tags, r.ingestion_date) for r in store.points().collect()}


def test_marks(spark, tmp_path):
    path = str(tmp_path / "deep" / "marks.json")
    assert checkpoint.load(spark, path) == {}
    checkpoint.save(spark, path, {"b": 2, "a": 1})
    assert checkpoint.load(spark, path) == {"a": 1, "b": 2} and checkpoint.get({"a": 1}, "z") == 0
    for text in ("{broken", "[1]", '{"a": "x", "b": true, "c": -1, "d": 4}'):
        (tmp_path / "m.json").write_text(text)
        for crc in tmp_path.glob(".*.crc"):
            crc.unlink()
        assert checkpoint.load(spark, str(tmp_path / "m.json")) == ({"d": 4} if "d" in text else {})


def test_batches_upsert_and_are_idempotent(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"))
    run = Ingest(spark, store, str(tmp_path / "marks.json"), clock=lambda: 100)
    assert store.points() is None
    first = run.run_batch(raw(spark, [item(1, "rule34", 5), item(2, "rule34", 5, "later"), item(3, "xbooru", 1), item(4, "xbooru", 2, width=500)]))
    assert (first.fetched, first.valid, first.upserted, first.skipped) == (4, 2, 2, 2)
    assert state(store) == {("rule34", 5): ("later", 100), ("xbooru", 1): ("t", 100)}
    assert checkpoint.load(spark, run.mark_file) == {"rule34": 5, "xbooru": 2}
    again = run.run_batch(raw(spark, [item(1, "rule34", 5, "old")]))
    assert again.fetched == 1 and state(store)[("rule34", 5)] == ("later", 100)
    assert run.run_batch(raw(spark, [item(3, "rule34", 5, "polled"), item(4, "rule34", 4)]), polled=True).fetched == 0
    run.clock = lambda: 200
    run.run_batch(raw(spark, [item(9, "rule34", 6)]))
    assert state(store)[("rule34", 6)] == ("t", 200) and len(state(store)) == 3
    assert run.run_batch(raw(spark, [])).fetched == 0


def test_deltas_and_compaction(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"), compact_after=3)
    want = {}
    for k in range(9):
        rows = [(1_000_000 + i, i, "s%d" % (i % 2), i % 2, 10 - abs(4 - k) if i == 3 else k, f"v{k}", k) for i in range(k, k + 4)] + [(None, 1, "s", 1, k, "x", k)]
        store.upsert(spark.createDataFrame(rows, "point_id long, post_id long, site string, site_namespace long, batch_order long, tags string, ingestion_date long"))
        for p, _, _, _, order, tags, _ in rows[:-1]:
            if p not in want or order >= want[p][0]:
                want[p] = (order, tags)
        assert {r.point_id: (r.batch_order, r.tags) for r in store.points().collect()} == want
    assert max(map(len, store._manifest().values())) <= 3


def test_failed_batch_moves_no_mark(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"))

    class Broken(PointStore):
        def upsert(self, batch):
            raise OSError("disk")

    run = Ingest(spark, Broken(spark, store.folder), str(tmp_path / "marks.json"))
    try:
        run.run_batch(raw(spark, [item(1, "rule34", 5)]))
    except OSError:
        pass
    assert checkpoint.load(spark, run.mark_file) == {}


def test_stream_equals_batch(spark, tmp_path):
    rows = raw(spark, [item(k, "rule34", 100 + k % 30, f"t{k}") for k in range(60)])
    rows.repartition(3).write.parquet(str(tmp_path / "landing"))
    stores = [PointStore(spark, str(tmp_path / x)) for x in ("a", "b")]
    Ingest(spark, stores[0], str(tmp_path / "a.json"), clock=lambda: 1).run_batch(rows)
    Ingest(spark, stores[1], str(tmp_path / "b.json"), clock=lambda: 1).stream(str(tmp_path / "landing"), str(tmp_path / "state"), files_per_batch=10).awaitTermination()
    assert state(stores[0]) == state(stores[1]) and len(state(stores[0])) == 30


def test_micro_batches_lose_nothing(spark, tmp_path):
    """Files whose ids fall, one a batch; a point's last raw item may come first."""
    rows = [item(k, "rule34" if k % 3 else "xbooru", 500 - k % 50, f"t{k}") for k in range(80)]
    for k in range(8):
        raw(spark, rows[10 * k : 10 * k + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    store = PointStore(spark, str(tmp_path / "points"))
    run = Ingest(spark, store, str(tmp_path / "marks.json"), clock=lambda: 1)
    run.stream(str(tmp_path / "landing"), str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    want = {}
    for k, site, body in rows:
        want[site, json.loads(body)["id"]] = (f"t{k}", 1)
    assert len(run.history) == 8 and state(store) == want
    assert checkpoint.load(spark, run.mark_file) == {"rule34": 500, "xbooru": 500}
    run.stream(str(tmp_path / "landing"), str(tmp_path / "other"), files_per_batch=3).awaitTermination()  # taken again
    assert state(store) == want
    assert run.log.status() == {"is_running": True, "active_sites": ["rule34", "xbooru"], "last_checkpoint": {"rule34": 500, "xbooru": 500}}


def test_event_log(spark, tmp_path):
    log = EventLog(kept=3)
    for k in range(5):
        log.add("Sleeping", sleep_secs=k)
    events, lost = log.after(1)
    assert [e["data"]["sleep_secs"] for e in events] == [2, 3, 4] and lost == 1 and log.after(5, 0.01) == ([], 0)
    checkpoint.save(spark, str(tmp_path / "m.json"), {"rule34": 7})
    thread = watch_marks(spark, str(tmp_path / "m.json"), log, 0.05)
    events, _ = log.after(5, 10)
    thread.stop.set()
    thread.join()
    assert events[0]["data"] == {"site": "rule34", "last_id": 7}


def test_rates():
    assert CycleStats().posts_per_second == 0 and CycleStats().seconds_per_post == 0
    assert CycleStats(10, 8, 8, 1, 4.0).posts_per_second == 2


def test_engine(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"))
    Ingest(spark, store, str(tmp_path / "m.json"), clock=lambda: 86400 * 10).run_batch(raw(spark, [item(k, "rule34", k, f"word{k} x") for k in range(1, 25)]))
    engine = api.Engine(store.points())
    assert engine.search("word7 x", limit=1).first().post_id == 7
    assert engine.similar("rule34", 3, 4).count() == 4
    rows, following = engine.recent(limit=20)
    assert len(rows) == 20 and following == 20 and engine.recent(20, 20)[1] is None
    assert engine.post("rule34", 2)["tags"] == "word2 x"
    assert engine.activity(3, 86400 * 10).count() == 4 - 1
    assert recent_page(store.points(), 5, 22).count() == 2


def test_windows_on_a_stream_leave_out_late_rows(spark, tmp_path):
    def land(name, days):
        rows = spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00", "Sleeping") for d in days], "t string, event_type string").selectExpr("CAST(t AS timestamp) AS ts", "event_type")
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def drain():
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in" / "*"))
        query = daily_events(stream, "2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    land("a", [1, 1, 2])
    drain()
    land("b", [10])
    drain()
    land("c", [1, 9, 20])  # the first is later than the watermark
    drain()
    assert {r.day: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-09": 1, "2024-01-10": 1}
