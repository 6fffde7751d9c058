"""python -m palisade.cli: build, run, fetch, lookup, add, apply-delta, sync, follow, overlay, overlay-lookup, prevalence, info, version."""

from __future__ import annotations

import argparse
import sys
import time

VERSION = "0.1.0"


def _whole(low: int, high: int):
    def parse(text: str) -> int:
        if not text.isdigit() or not low <= int(text) <= high:
            raise argparse.ArgumentTypeError(f"a whole number from {low} to {high} is asked for")
        return int(text)

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palisade")
    top.add_argument("-c", "--config", default="palisade.json")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("fetch", "build", "run", "version", "info"):
        verbs.add_parser(name)
    for name in ("lookup", "overlay-lookup", "prevalence"):
        verbs.add_parser(name).add_argument("values", nargs="+")
    verbs.add_parser("overlay").add_argument("file")
    p = verbs.add_parser("add")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--layer", choices=("cti", "cti_r", "tags"), default="cti")
    p = verbs.add_parser("follow")
    p.add_argument("--source", required=True, help="a folder into which files of one attribute a line come")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--feed-key", required=True)
    p.add_argument("--flush-seconds", type=_whole(1, 86_400), default=300)
    p.add_argument("--available-now", action="store_true")
    for name in ("apply-delta", "sync"):
        p = verbs.add_parser(name)
        p.add_argument("--segment", required=name == "apply-delta")
        p.add_argument("--feed-key")
        p.add_argument("--snapshot", action="store_true")
        p.add_argument("--ttl-days", type=_whole(0, 36500), default=0)
        p.add_argument("--generation", type=_whole(0, 1 << 62), default=0)
        p.add_argument("--hup-cmd")
        if name == "sync":
            p.add_argument("--apply", action="store_true")
            p.add_argument("--page-size", type=_whole(1, 10_000), default=10_000)
            p.add_argument("--slice-rows", type=_whole(1, 10_000_000), default=100_000)
    return top


def fetch(config: dict) -> None:
    from .sources.pull import download, download_editions, download_misp

    download_editions(config.get("geoip") or {})
    for f in config["feeds"]:
        if f.get("url") and f.get("dest") and f.get("type") in ("stix", "ua", "tld", "file"):
            download(f["url"], f["dest"])
        elif f.get("type") == "misp" and f.get("url"):
            download_misp(f)


def sync(spark, config: dict, args, now: int, after) -> bool:
    """Pulls the configuration's MISP feed, folds it slice by slice and keeps the cursor with the version."""
    from pyspark.sql import functions as F

    from .functions.text import attribute_seconds
    from .operators.fold import fold
    from .plans.build import publish_fold
    from .plans.scratch import written
    from .plans.store import Store
    from .sources import feeds
    from .sources.pull import MispSource, next_cursor

    own = next(f for f in config["feeds"] if f.get("type") == "misp" and f.get("url"))
    name = args.feed_key or feeds.stem(own["dest"])
    store = Store(spark, config["output"])
    before = store.open(check=True)
    row = before.feed_state.filter(F.lower("feed") == name.lower()).agg(F.max("cursor")).first()
    since = own.get("since", "7d") if row[0] is None else str(row[0])
    spark.dataSource.register(MispSource)
    pull = spark.read.format("misp_pull").options(url=own["url"], key=own.get("key", ""), since=since, now=str(now), page_size=str(args.page_size), slice_rows=str(args.slice_rows))
    pulled = written(pull.load(), "pulled")
    newest = pulled.agg(F.max(attribute_seconds(F.col("timestamp")))).first()[0]
    if newest is None:
        return False
    contrib = feeds.read_misp(pulled.select(F.col("slice").alias("page"), "row", "value"), name, delta=not args.snapshot)
    done = fold(before.state, contrib, name, now, args.snapshot, args.ttl_days, args.generation, next_cursor(newest, 0, now, row[0]))
    if args.apply and done.applied:
        publish_fold(store, before, done, after)
    return done.applied


def follow(spark, root: str, args):
    """Folds files of attributes as they come, every flush_seconds."""
    from .sources import feeds
    from .streaming.stream import fold_stream

    files = spark.readStream.text(args.source)
    return fold_stream(feeds.read_misp(files, args.feed_key, delta=True), root, args.feed_key, lambda: int(time.time()), args.checkpoint, args.flush_seconds, args.available_now)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from .operators import fold as FO
    from .operators import match as M
    from .plans import build as B
    from .plans.store import Store
    from .sources import feeds

    spark, now, config = SparkSession.builder.appName("palisade").getOrCreate(), int(time.time()), B.load_config(args.config)
    root = config["output"]
    signal = (lambda version: __import__("subprocess").run(args.hup_cmd, shell=True, check=True)) if getattr(args, "hup_cmd", None) else None
    asked = (lambda: spark.createDataFrame([(v,) for v in args.values], "value string")) if hasattr(args, "values") else None

    def show(rows) -> None:
        for row in rows.collect():
            print(row["line"] if row["line"].startswith(("HIT  ", "MISS  ", "key=")) else f"{row['value']} {row['line']}")

    if args.verb in ("fetch", "run"):
        fetch(config)
    if args.verb in ("build", "run"):
        print(B.build(spark, config, root, now))
    elif args.verb == "add":
        print(B.build_onto(spark, args.input, root, now, args.layer))
    elif args.verb == "overlay":
        B.set_overlay(spark, args.file, root)
        for row in Store(spark, root).open(strict=False).overlay.orderBy("value").toLocalIterator():
            print(row["value"], row["action"], row["confidence"])
    elif args.verb == "lookup":
        show(M.report(Store(spark, root).open(strict=False).lookup(asked(), "value", overlay=False), "value"))
    elif args.verb == "overlay-lookup":
        show(M.overlay_only(asked(), "value", Store(spark, root).open(strict=False).overlay))
    elif args.verb == "prevalence":
        at = Store(spark, root).open(strict=False)
        print(f"reporting edges={FO.reporting_edges(at.prevalence, at.prevalence_facts)}")
        show(M.prevalence_report(FO.prevalence_of(asked(), "value", at.prevalence), "value"))
    elif args.verb == "info":
        print(Store(spark, root).open(strict=False).info().first().asDict())
    elif args.verb == "follow":
        follow(spark, root, args).awaitTermination()
    elif args.verb == "apply-delta" or (args.verb == "sync" and args.segment):
        # a sync takes the segment's name without its last extension alone
        key = args.feed_key or (feeds.stem(args.segment) if args.verb == "sync" else None)
        print("applied" if B.apply_delta(spark, root, args.segment, now, key, signal, snapshot=args.snapshot, ttl_days=args.ttl_days, generation=args.generation) else "not newer")
    elif args.verb == "sync":
        print("applied" if sync(spark, config, args, now, signal) else "nothing new")
    return 0


if __name__ == "__main__":
    sys.exit(main())
