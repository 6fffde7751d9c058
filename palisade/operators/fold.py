"""Folding segments into a state, and prevalence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..plans.scratch import written
from . import compile as C


@dataclass
class State:
    indicators: DataFrame
    public_feeds: DataFrame
    feed_state: DataFrame
    applied: bool = field(default=True)


def evict_feed(indicators: DataFrame, feed) -> DataFrame:
    """A feed leaves every row's provenance; rows without any left go; what else the rows hold stays."""
    named = F.exists("feeds", lambda f: F.lower(f) == F.lower(F.lit(feed)))
    left = indicators.withColumn("feeds", F.filter("feeds", lambda f: F.lower(f) != F.lower(F.lit(feed)))).withColumn("__had", named)
    return indicators.filter(~named).unionByName(left.filter("__had and size(feeds) > 0").drop("__had"))


def evict_expired(state: State, feed: str, days: int, now: int) -> State:
    """Feeds but this one that were last updated over days ago leave; feeds that were only ever built never expire."""
    old = F.expr(f"updated > 0 and updated < {now - days * 86400}") & (F.lower("feed") != F.lower(F.lit(feed)))
    gone = state.feed_state.filter(old).select(F.lower("feed").alias("low")).distinct()
    spread = state.indicators.select("key", F.explode("feeds").alias("f"))
    hit = spread.join(gone, F.lower("f") == F.col("low"), "left_semi").groupBy("key").agg(F.collect_set("f").alias("out"))
    rows = state.indicators.join(hit, "key", "left").withColumn("feeds", F.when(F.col("out").isNull(), F.col("feeds")).otherwise(F.array_except("feeds", "out")))
    return State(rows.filter("out is null or size(feeds) > 0").drop("out"), state.public_feeds, state.feed_state.filter(~old))


def next_generation(feed_state: DataFrame, feed: str) -> int:
    row = feed_state.filter(F.lower("feed") == feed.lower()).agg(F.max("generation")).first()
    return (row[0] or 0) + 1


def fold(state: State, pages: list[DataFrame] | DataFrame, feed: str, now: int, snapshot: bool = False, ttl_days: int = 0, generation: int = 0, cursor: int | None = None, layer: str = "cti", stream: str | None = None, batch: int | None = None) -> State:
    """The state after a pull. In each page adds are merged, then its withdrawals apply, so a later page may add again what an earlier
    one withdrew; a generation that is not newer changes nothing, nor does a batch that its stream has already folded.

    pages: contributions page by page, or all at once with a column page in whose order they apply. All pages take one pass: what is
    known before stays if no page withdraws it, and an add stays if no page from its own on does.
    """
    own = state.feed_state.filter(F.lower("feed") == feed.lower())
    stored = next_generation(state.feed_state, feed) - 1
    again = stream is not None and bool(own.filter((F.col("stream") == stream) & (F.col("batch") >= batch)).head(1))
    if again or 0 < generation <= stored:
        return State(state.indicators, state.public_feeds, state.feed_state, applied=False)
    if snapshot:
        state = State(evict_feed(state.indicators, feed), state.public_feeds, state.feed_state)
    if ttl_days > 0:
        state = evict_expired(state, feed, ttl_days, now)
    if isinstance(pages, list):
        pages = C.all_of([p.withColumn("page", F.lit(k).cast("long")) for k, p in enumerate(pages)])
    rows = C.identified(pages.withColumn("layer", F.lit(layer)))
    gone = rows.filter("action = '-'").groupBy("key").agg(F.max("page").alias("gone"))
    kept = rows.filter("action is null or action <> '-'").join(gone, "key", "left").filter("gone is null or page > gone")
    adds = C.by_layer(kept)
    old = C.withdraw(state.indicators, gone)
    both = written(C.before_all(old).unionByName(C.one_spelling(adds, state.indicators) if layer == "cti" else adds), "folded")
    indicators = written(C.merge(both), "indicators")
    public = C.public_feeds(pages.withColumn("layer", F.lit(layer)), state.public_feeds)
    spark = indicators.sparkSession
    mine = spark.createDataFrame([(feed, generation or stored + 1, now, cursor, stream, batch)], S.FEED_STATE)
    return State(indicators, public, state.feed_state.filter(F.lower("feed") != feed.lower()).unionByName(mine))


def build_prevalence(sightings: DataFrame, value: str, edge: str, source: str) -> DataFrame:
    """(value, fleet_count, edge_count, source_count)."""
    return sightings.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("fleet_count"), F.countDistinct(edge).cast("int").alias("edge_count"), F.countDistinct(source).cast("int").alias("source_count"))


def prevalence_facts(sightings: DataFrame, edge: str, epoch: int) -> DataFrame:
    """One row: how many edges report at all, and when that was taken."""
    return sightings.agg(F.countDistinct(edge).cast("int").alias("reporting_edges"), F.lit(epoch).cast("bigint").alias("epoch"))


def reporting_edges(prevalence: DataFrame, facts: DataFrame) -> int:
    """The edges that report; 0 when that is unknown or the table is cold."""
    warm = (prevalence.agg(F.max("fleet_count")).first()[0] or 0) > 0
    return (facts.agg(F.max("reporting_edges")).first()[0] or 0) if warm else 0


def prevalence_of(values: DataFrame, value_col: str, prevalence: DataFrame) -> DataFrame:
    """values with their counts: 0 where absent, null where the table is cold (counts nothing)."""
    warm = (prevalence.agg(F.max("fleet_count")).first()[0] or 0) > 0
    rows = values.join(prevalence.withColumnRenamed("value", "__value"), F.col(value_col) == F.col("__value"), "left").drop("__value")
    zero = F.lit(0) if warm else F.lit(None)
    return rows.withColumns({c: F.coalesce(F.col(c), zero.cast(t)) if warm else zero.cast(t) for c, t in (("fleet_count", "bigint"), ("edge_count", "int"), ("source_count", "int"))})
