"""Versions of a database: immutable Parquet directories and a pointer that is replaced at once."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import compile as C
from ..operators.fold import State
from ..operators.match import empty, lookup

#: Of the layout of a version; a reader refuses another one.
FORMAT = 1
TABLES = {"indicators": S.INDICATORS, "public_feeds": "feed string", "feed_state": S.FEED_STATE, "overlay": S.OVERLAY_ROWS, "prevalence": S.PREVALENCE, "prevalence_facts": S.PREVALENCE_FACTS}
RANGES = {"ranges4": f"bucket bigint, ip_start bigint, ip_end bigint, {S.RECORD}", "ranges6": f"bucket string, ip_start string, ip_end string, {S.RECORD}"}


def validate_indicators(indicators: DataFrame) -> dict:
    """Refuses rows that no build makes: identities twice, ranges upside down, masks or scores out of their domain. Returns their number and digest."""
    bad = indicators.agg(
        (F.count("*") - F.countDistinct("key")).alias("repeated"), F.count_if(F.col("ip4_start") > F.col("ip4_end")).alias("upside_down_v4"), F.count_if(F.col("ip6_start") > F.col("ip6_end")).alias("upside_down_v6"),
        F.count_if(~F.col("confidence").between(0, 100) | ~F.col("confidence_r").between(0, 100)).alias("score"), F.count_if(~F.col("type_mask").between(1, 7) | ~F.col("tlp_mask").between(0, 15) | ~F.col("category_mask").between(0, 65535)).alias("mask"),
        F.count_if(F.col("feeds").isNull() | F.col("tags").isNull() | F.col("labels").isNull()).alias("missing"), F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("key", *S.RECORD_COLUMNS)), F.lit(0)).alias("digest"),
    ).first().asDict()
    found = {"rows": bad.pop("rows"), "digest": bad.pop("digest")}
    if any(bad.values()):
        raise S.EngineError(S.EFORMAT, f"indicators: {bad}")
    return found


def validate_ranges(ranges: DataFrame) -> None:
    """Refuses ranges that are upside down or overlap within a bucket; no range crosses one."""
    before = F.lag("ip_end").over(Window.partitionBy("bucket", "part").orderBy("ip_start"))
    part = F.substring(F.col("ip_start").cast("string"), 1, 12) if dict(ranges.dtypes)["ip_start"] == "string" else F.shiftright("ip_start", 16)
    rows = ranges.withColumn("part", part)
    each = rows.withColumn("before", before)
    parts = rows.groupBy("bucket", "part").agg(F.min("ip_start").alias("lo"), F.max("ip_end").alias("hi"))
    crossed = parts.withColumn("before", F.max("hi").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).filter("lo <= before")
    if each.filter("ip_start > ip_end or ip_start <= before").head(1) or crossed.head(1):
        raise S.EngineError(S.EFORMAT, "ranges overlap")


def validate_overlay(overlay: DataFrame) -> None:
    bad = overlay.agg((F.count("*") - F.countDistinct("value")).alias("repeated"), F.count_if(~F.col("action").isin("-", "T", "+")).alias("action")).first().asDict()
    if any(bad.values()):
        raise S.EngineError(S.EFORMAT, f"overlay not published: {bad}")


@dataclass
class Snapshot:
    """One version, pinned when it was opened."""

    version: str
    indicators: DataFrame
    public_feeds: DataFrame
    feed_state: DataFrame
    overlay: DataFrame
    prevalence: DataFrame
    prevalence_facts: DataFrame
    partial: bool
    ranges4: DataFrame
    ranges6: DataFrame

    @property
    def state(self) -> State:
        return State(self.indicators, self.public_feeds, self.feed_state)

    def lookup(self, df: DataFrame, value_col: str, skip_private: bool = False, overlay: bool = True) -> DataFrame:
        """df with the answers of this version, by its disjoint ranges where it has them."""
        ranges = None if self.partial else (self.ranges4, self.ranges6)
        return lookup(df, value_col, self.indicators, self.public_feeds, self.overlay if overlay else None, skip_private, ranges)

    def info(self) -> DataFrame:
        """One row: counts by kind, overlay entries, feeds, the highest generation, when it was published, the version."""
        one = F.lit(1).alias("one")
        i = self.indicators.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in ((4, "networks_v4"), (6, "networks_v6"), (0, "strings"))), one)
        o = self.overlay.agg(F.count("*").alias("overlay_entries"), one)
        f = self.feed_state.agg(F.coalesce(F.max("generation"), F.lit(0)).alias("generation"), one)
        p = self.public_feeds.agg(F.count("*").alias("feeds"), one)
        stamp = F.lit(int(self.version.partition("-")[0]) // 1000 if self.version else None).cast("bigint")
        return i.join(o, "one").join(f, "one").join(p, "one").drop("one").withColumns({"published": stamp, "version": F.lit(self.version)})


class Store:
    """root/v=<name>/<table>; root/CURRENT names the version that readers open. The root is a path that Hadoop's file systems know."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def current(self) -> str | None:
        rows = self.spark.read.text(f"{self.root}/CURRENT").collect() if self._exists("CURRENT") else []
        return json.loads(rows[0][0])["version"] if rows else None

    def _exists(self, name: str) -> bool:
        store, path = self._file(name)
        return bool(store.exists(path))

    def publish(self, tables: dict[str, DataFrame], after: Callable[[str], None] | None = None, base: str | None = None) -> str:
        """Writes a version, checks it, then swaps the pointer; on any failure the version before stays. after: called when all is done.
        base: the version that the tables were made from; if another one is current by now, nothing is published."""
        version = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        for name, ddl in TABLES.items():
            frame = tables.get(name)
            (empty(self.spark, ddl) if frame is None else frame).write.parquet(f"{self.root}/v={version}/{name}")
        read = lambda name: self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/v={version}/{name}")
        manifest = {"format": FORMAT} | validate_indicators(read("indicators"))
        validate_overlay(read("overlay"))
        for name, flatten in (("ranges4", C.flatten_v4), ("ranges6", C.flatten_v6)):
            flatten(read("indicators")).write.parquet(f"{self.root}/v={version}/{name}")
            validate_ranges(self.ranges(version, name))
        self._write(f"v={version}/MANIFEST", manifest)
        self._write(f"CURRENT.{version}", {"version": version})
        if base is not None and self.current() != base:
            raise S.EngineError(S.EIO, f"{self.current()} was published over {base} meanwhile")
        store, new = self._file(f"CURRENT.{version}")
        current = self._file("CURRENT")[1]
        if not store.rename(new, current):
            context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            context.rename(new, current, overwrite)
        if after:
            after(version)
        return version

    def _write(self, name: str, content: dict) -> None:
        store, path = self._file(name)
        out = store.create(path, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def open(self, strict: bool = True, check: bool = False) -> Snapshot:
        """The current version; with strict=False, tables that are missing are empty and the snapshot says it is partial.
        check: its tables are held against what a build makes and against the digest taken when it was published."""
        version, partial, frames = self.current(), False, {}
        if version is None and strict:
            raise S.EngineError(S.ENOENT, f"no database in {self.root}")
        manifest = json.loads(self.spark.read.text(f"{self.root}/v={version}/MANIFEST").first()[0]) if version and self._exists(f"v={version}/MANIFEST") else {}
        if manifest.get("format", FORMAT) != FORMAT:
            raise S.EngineError(S.EVERSION, f"format {manifest['format']}")
        for name, ddl in (TABLES | RANGES).items():
            there = version is not None and self._exists(f"v={version}/{name}")
            if not there and strict:
                raise S.EngineError(S.ENOENT, f"{name} is missing")
            partial |= not there
            frames[name] = self.spark.read.schema(ddl).parquet(f"{self.root}/v={version}/{name}") if there else empty(self.spark, ddl)
        if check:
            found = validate_indicators(frames["indicators"])
            if any(found[k] != manifest.get(k, found[k]) for k in found):
                raise S.EngineError(S.ECHECKSUM, f"indicators hold {found}, the manifest says {manifest}")
            validate_overlay(frames["overlay"])
        return Snapshot(version or "", partial=partial, **frames)

    def ranges(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={version}/{name}")

    def vacuum(self, keep: int = 3) -> None:
        """Deletes all but the newest versions; the current one always stays."""
        store, root = self._file("")
        names = sorted(s.getPath().getName() for s in store.listStatus(root) if s.getPath().getName().startswith("v="))
        for name in names[:-keep]:
            if name != f"v={self.current()}":
                store.delete(self._file(name)[1], True)
