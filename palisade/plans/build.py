"""A configuration of feeds, built into a version and folded."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators import compile as C
from ..operators.fold import State, fold
from ..sources import feeds, stix
from .scratch import written
from .store import Snapshot, Store

READERS = {"csv": feeds.read_csv, "csv_delta": feeds.read_csv_delta, "dictionary": feeds.read_dictionary, "lookup": feeds.read_lookup, "list": feeds.read_list, "misp": feeds.read_misp, "tags": feeds.read_tags, "tags_json": feeds.read_tags_json}
LINES = ("csv", "csv_delta", "list", "tags", "tags_json")
FEED_TYPES = ("csv", "json", "lookup", "txt", "ioc", "misp", "stix", "tags")


def load_config(path: str) -> dict:
    """One JSON object of at most 1 MiB with output and feeds; paths are relative to where it is read from."""
    if os.path.getsize(path) > 1 << 20:
        raise S.EngineError(S.EFORMAT, "the configuration is over 1 MiB")
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if not isinstance(config, dict) or not isinstance(config.get("feeds"), list):
        raise S.EngineError(S.EFORMAT, "the configuration has no feeds")
    return config


def read_feed(spark: SparkSession, path: str, layer: str = "cti", src_ord: int = 0, now: int = 0, **options) -> DataFrame:
    kind = feeds.format_of(path)
    files = feeds.lines(spark, path) if kind in LINES else feeds.whole(spark, path)
    name = feeds.stem(path, stix=kind == "stix")
    if kind == "stix":
        return stix.read_stix(spark, files, name, layer, src_ord, now, **options)
    return READERS[kind](files, name, layer, src_ord)


def read_segment(spark: SparkSession, path: str, feed: str, now: int = 0, delta: bool = False) -> DataFrame:
    kind = feeds.fold_format_of(path)
    files = feeds.lines(spark, path) if kind in LINES else feeds.whole(spark, path)
    if kind == "stix":
        return stix.read_stix(spark, files, feed, now=now)
    return feeds.read_misp(files, feed, delta=delta) if kind == "misp" else feeds.read_csv_delta(files, feed)


def contributions_of(spark: SparkSession, config: dict, now: int) -> DataFrame:
    own = [f for f in config["feeds"] if f.get("type") in FEED_TYPES and (f.get("path") or f.get("dest"))]
    layer = lambda f: f.get("layer") or ("tags" if f["type"] == "tags" else "cti")
    return C.all_of([read_feed(spark, f.get("path") or f["dest"], layer(f), k, now) for k, f in enumerate(own)])


def build(spark: SparkSession, config: dict, root: str, now: int, base: Snapshot | None = None) -> str:
    """Builds all feeds of a configuration, on top of base if given (its layers honoured, its overlay kept where the configuration has none), and publishes a version."""
    contrib = written(contributions_of(spark, config, now), "contributions")
    indicators, public = C.compile_contributions(contrib, base.indicators if base else None), C.public_feeds(contrib, base.public_feeds if base else None)
    overlays = [feeds.read_overlay(feeds.whole(spark, f["path"])) for f in config["feeds"] if f.get("type") == "overlay"]
    overlay = C.all_of(overlays) if overlays else base.overlay if base else None
    tables = {"indicators": indicators, "public_feeds": public, "feed_state": base.feed_state if base else None, "overlay": overlay, "prevalence": base.prevalence if base else None, "prevalence_facts": base.prevalence_facts if base else None}
    return Store(spark, root).publish(tables, base=base.version if base else None)


def build_onto(spark: SparkSession, path: str, root: str, now: int, layer: str = "cti") -> str:
    """Builds one file onto the current version, without a generation."""
    base = Store(spark, root).open(check=True)
    return build(spark, {"feeds": [{"type": "csv", "path": path, "layer": layer}]}, root, now, base)


def publish_fold(store: Store, before: Snapshot, done: State, after=None) -> str:
    """The tables of before with what a fold made of them."""
    return store.publish({"indicators": done.indicators, "public_feeds": done.public_feeds, "feed_state": done.feed_state, "overlay": before.overlay, "prevalence": before.prevalence, "prevalence_facts": before.prevalence_facts}, after, before.version)


def apply_delta(spark: SparkSession, root: str, segment: str, now: int, feed: str | None = None, after=None, **options) -> bool:
    """Folds one segment and publishes; False if its generation was not newer. options: snapshot, ttl_days, generation, layer."""
    store = Store(spark, root)
    before = store.open(check=True)
    name = feed or feeds.stem(segment, stix=feeds.fold_format_of(segment) == "stix")
    done = fold(before.state, [read_segment(spark, segment, name, now)], name, now, **options)
    if done.applied:
        publish_fold(store, before, done, after)
    return done.applied


def set_overlay(spark: SparkSession, path: str, root: str) -> str:
    """Publishes the current version with the overlay of a file; on an empty root, with nothing else."""
    store = Store(spark, root)
    before = store.open(strict=False)
    tables = {"indicators": before.indicators, "public_feeds": before.public_feeds, "feed_state": before.feed_state, "prevalence": before.prevalence, "prevalence_facts": before.prevalence_facts, "overlay": feeds.read_overlay(feeds.whole(spark, path))}
    return store.publish(tables, base=before.version or None)


def set_prevalence(prevalence: DataFrame, root: str, facts: DataFrame | None = None) -> str:
    """Publishes the current version with a table of prevalence and the facts about its fleet."""
    store = Store(prevalence.sparkSession, root)
    before = store.open(strict=False)
    tables = {"indicators": before.indicators, "public_feeds": before.public_feeds, "feed_state": before.feed_state, "overlay": before.overlay, "prevalence": prevalence, "prevalence_facts": facts}
    return store.publish(tables, base=before.version or None)
