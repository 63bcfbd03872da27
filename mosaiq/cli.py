"""Command line: python -m mosaiq.cli COMMAND --points FOLDER [options]."""

from __future__ import annotations

import argparse
import json
import sys
from functools import partial

from mosaiq import api
from mosaiq.operators.density import DensityParams, all_loose, cluster_summary, rank_clusters
from mosaiq.operators.store import PointStore
from mosaiq.runtime import build_session, cut_lineage, read_text
from mosaiq.serve import server
from mosaiq.streaming.ingest import POLL_SECONDS, EventLog, Ingest, ProgressEvents, watch_marks, with_images


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mosaiq")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        made.add_argument("--points", required=True, help="folder of the points table")
        return made

    ingest = add("ingest")
    ingest.add_argument("--landing", help="folder of raw items in Parquet")
    ingest.add_argument("--sources", help="instead: JSON file of each site's address or mirrors, polled by turns")
    ingest.add_argument("--credentials", help="JSON file of sites' pairs of user and key")
    ingest.add_argument("--images", action="store_true", help="download and check the thumbnails and embed them instead of the tags")
    ingest.add_argument("--concurrency", type=int, default=8, help="downloads at a time in a task")
    ingest.add_argument("--cycles", type=int, help="end after so many polls")
    ingest.add_argument("--marks", required=True, help="JSON file of the high-water marks")
    ingest.add_argument("--state", help="checkpoint folder of the stream")
    ingest.add_argument("--files-per-batch", type=int, default=4)
    ingest.add_argument("--poll-seconds", type=int, help="keep running and look for files this often")
    search = add("search")
    search.add_argument("text", nargs="?")
    search.add_argument("--image", help="path or http address of an image")
    search.add_argument("--limit", type=int, default=10)
    search.add_argument("--image-weight", type=float, default=1.0)
    search.add_argument("--sites", default="")
    cluster = add("cluster")
    cluster.add_argument("--max-points", type=int, help="cluster only the first so many points by id; all by default")
    cluster.add_argument("--min-cluster-size", type=int, default=10)
    cluster.add_argument("--dims", type=int)
    cluster.add_argument("--site", help="only the points of this site")
    cluster.add_argument("--preview", type=int, default=5, help="members shown beside the most typical one")
    cluster.add_argument("--top", type=int, default=10)
    stats = add("stats")
    stats.add_argument("--width", type=int, default=48)
    front = add("serve")
    front.add_argument("--marks", help="mark file of an ingest whose progress is to be told")
    front.add_argument("--host", default="0.0.0.0")
    front.add_argument("--port", type=int, default=3000)
    contract = add("contract")
    contract.add_argument("action", choices=("export", "check"))
    contract.add_argument("snapshot")
    return out


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "search" and not 0 <= args.image_weight <= 1:
        raise SystemExit("--image-weight must be from 0 to 1")
    for name in ("files_per_batch", "concurrency", "cycles", "poll_seconds", "max_points", "min_cluster_size", "dims", "top", "width"):
        if (value := getattr(args, name, None)) is not None and value < 1:
            raise SystemExit(f"--{name.replace('_', '-')} must be at least 1")
    if args.command == "ingest" and bool(args.landing) == bool(args.sources) or getattr(args, "landing", None) and not args.state:
        raise SystemExit("ingest needs --landing and --state, or --sources")
    spark = build_session()
    store = PointStore(spark, args.points)
    if args.command == "ingest":
        run = Ingest(spark, store, args.marks, images=partial(with_images, concurrency=args.concurrency) if args.images else None)
        if args.landing:
            spark.streams.addListener(ProgressEvents(run.log))
            run.stream(args.landing, args.state, args.files_per_batch, args.poll_seconds).awaitTermination()
        else:
            read = lambda path: json.loads(read_text(spark, path) or "{}") if path else None
            run.poll(read(args.sources), read(args.credentials), args.cycles, args.poll_seconds or POLL_SECONDS)
        return 0
    points = store.points()
    if points is None:
        print("no points yet", file=sys.stderr)
        return 1
    engine = api.Engine(points)
    if args.command == "search":
        url = args.image if args.image and args.image.startswith(("http://", "https://")) else None
        image = open(args.image, "rb").read() if args.image and not url else None
        if args.text and args.image and (label := api.blend_label(args.image_weight)):
            print(label)
        found = engine.search(args.text, image, None, args.sites, args.limit, args.image_weight, url)
        found.selectExpr("format_string('#%d', post_id) AS post", "site", "format_string('%.2f%%', score * 100) AS similarity", "CASE WHEN width > 0 AND height > 0 THEN format_string('%dx%d', width, height) ELSE 'unknown' END AS size", "post_url").show(max(args.limit, 1), False)
    elif args.command == "cluster":
        labels = cut_lineage(engine.cluster(DensityParams(args.min_cluster_size), args.dims, args.max_points, args.site))
        if args.max_points is not None and (left := points.where(points.site == args.site if args.site else "true").count() - labels.count()) > 0:
            print(f"{left} points without a comparable vector or beyond --max-points are left out", file=sys.stderr)
        members = labels.join(points.select(points.point_id.alias("id"), "image_vec"), "id")
        summary = cluster_summary(members)
        rank_clusters(summary, args.top).show(args.top, False)
        engine.cluster_members(labels, args.top, args.preview).show(args.top * (args.preview + 1), False)
        if all_loose(summary).first()[0]:
            print("all clusters are loose; consider another minimum size")
    elif args.command == "serve":
        log = EventLog()
        if args.marks:
            watch_marks(spark, args.marks, log)
        server(engine, args.host, args.port, log).serve_forever()
    elif args.command == "stats":
        engine.stats(args.width).orderBy("rank").show(100, False)
    else:
        found = api.contract({"search": engine.search(vector_query=[1.0] + [0.0] * 63), "sites": engine.sites(), "stats": engine.stats(), "activity": engine.activity()})
        if args.action == "export":
            with open(args.snapshot, "w", encoding="utf-8") as file:
                file.write(found + "\n")
        else:
            with open(args.snapshot, encoding="utf-8") as file:
                if json.load(file) != json.loads(found):
                    print("the contract has changed", file=sys.stderr)
                    return 1
    return 0


if __name__ == "__main__":
    sys.exit(run())
