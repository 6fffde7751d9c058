"""Contributions to indicators: identity, layers, merge, withdrawal, disjoint ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import address as A
from ..functions import text as X
from ..plans.scratch import written


def with_identity(contrib: DataFrame) -> DataFrame:
    """Adds key, kind (0 string, 4, 6), plen, ranges and str; the key is equal for two spellings of one network, never for two strings."""
    slash = A.slash_allowed(F.col("type"))
    c = contrib.withColumn("__4", F.when(slash | ~F.col("value").contains("/"), A.ipv4_network(F.col("value")))).withColumn("__6", A.ipv6_network(F.col("value"), slash))
    four, six = F.col("__4").isNotNull(), F.col("__6.plen").isNotNull()
    c = c.withColumn("kind", F.when(four, 4).when(six, 6).otherwise(0)).withColumn("plen", F.when(four, F.col("__4.plen")).when(six, F.col("__6.plen")))
    c = c.withColumn("ip4_start", F.col("__4.start")).withColumn("ip4_end", F.col("__4.end")).withColumn("ip6_start", F.when(~four, F.col("__6.start"))).withColumn("ip6_end", F.when(~four, F.col("__6.end")))
    key = F.when(four, F.concat_ws("|", F.lit("4"), "ip4_start", "ip4_end")).when(six, F.concat_ws("|", F.lit("6"), "ip6_start", "ip6_end")).otherwise(F.concat(F.lit("0|"), F.col("value")))
    return c.withColumn("str", F.when(F.col("kind") == 0, F.col("value"))).withColumn("key", key).drop("__4", "__6")


def by_layer(rows: DataFrame) -> DataFrame:
    """What a layer may tell: cti its public fields and labels, cti_r its score alone, tags its tags alone. Applied before any merge."""
    bit = X.layer_bit(F.col("layer"))
    public, tags = bit == S.CTI, bit == S.TAGS
    none = F.array().cast("array<string>")
    labels = F.coalesce("labels", none)
    return rows.select(
        *S.IDENTITY_COLUMNS, "src_ord", "row_ord", F.when(public, F.col("confidence")).otherwise(0).alias("confidence"), F.when(bit == S.CTI_R, F.col("confidence")).otherwise(0).alias("confidence_r"), bit.alias("type_mask"),
        F.when(public, F.col("tlp_mask")).otherwise(0).alias("tlp_mask"), F.when(public, F.col("category_mask")).otherwise(0).alias("category_mask"),
        F.when(public, F.array(F.coalesce(F.when(F.trim("feed") != "", F.col("feed")), F.lit("Unknown")))).otherwise(none).alias("feeds"), F.when(tags, labels).otherwise(none).alias("tags"), F.when(public, labels).otherwise(none).alias("labels"),
    )


def one_spelling(rows: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Feed names are the same whatever their case; the first spelling seen stays, one of an old state before any. rows: as by_layer() gives."""
    order = F.struct("src_ord", "row_ord")
    named = rows.select(F.explode("feeds").alias("feed"), order.alias("o")).groupBy("feed").agg(F.min("o").alias("o"))
    if old is not None:
        before = F.struct(F.lit(-1).cast("long").alias("src_ord"), F.lit(-1).cast("long").alias("row_ord"))
        named = named.unionByName(old.select(F.explode("feeds").alias("feed")).distinct().select("feed", before.alias("o")))
    first = named.groupBy(F.lower("feed").alias("low")).agg(F.min_by("feed", F.struct("o", "feed")).alias("spelled"))
    odd = named.select("feed").distinct().join(first, F.lower("feed") == F.col("low")).filter("feed <> spelled").select("feed", "spelled")
    own = rows.join(odd, F.get("feeds", F.lit(0)) == F.col("feed"), "left")
    return own.withColumn("feeds", F.when(F.col("spelled").isNotNull(), F.array("spelled")).otherwise(F.col("feeds"))).drop("feed", "spelled")


def _lists_of(rows: DataFrame) -> DataFrame:
    """(key, tags, labels): the distinct strings by key in order of first appearance; grouped by string first, so a common key holds no more than its distinct strings."""
    each = lambda c, tag: F.transform(c, lambda x, i: F.struct(F.lit(tag).alias("tag"), i.alias("at"), x.alias("item")))
    items = rows.select("key", "src_ord", "row_ord", F.explode(F.concat(each("tags", True), each("labels", False))).alias("x"))
    first = items.groupBy("key", "x.tag", "x.item").agg(F.min(F.struct("src_ord", "row_ord", "x.at")).alias("o"))
    lists = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "item", "tag"))).alias("s"))
    pick = lambda keep: F.transform(F.filter("s", keep), lambda x: x["item"])
    return lists.select("key", pick(lambda x: x["tag"]).alias("tags"), pick(lambda x: ~x["tag"]).alias("labels"))


def merge(rows: DataFrame) -> DataFrame:
    """One row for each identity. rows: as by_layer() gives, or indicators with src_ord and row_ord; they are read twice, so write them first."""
    whole = rows.groupBy("key").agg(
        *(F.first(c).alias(c) for c in S.IDENTITY_COLUMNS[1:]), F.max("confidence").alias("confidence"), F.max("confidence_r").alias("confidence_r"), *(F.bit_or(c).alias(c) for c in ("type_mask", "tlp_mask", "category_mask")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("feeds")))).alias("feeds"),
    )
    none = F.array().cast("array<string>")
    whole = whole.join(_lists_of(rows), "key", "left").withColumns({c: F.coalesce(c, none) for c in ("tags", "labels")})
    return whole.select(*S.IDENTITY_COLUMNS, *S.RECORD_COLUMNS)


def identified(contrib: DataFrame) -> DataFrame:
    """The contributions that hold a value, with their identity, written: addresses are read once however often the rows are."""
    return written(with_identity(contrib.filter("value is not null and value <> ''")), "identified")


def withdraw(indicators: DataFrame, deletes: DataFrame) -> DataFrame:
    """Without the identities that deletes name, from whichever feed or layer."""
    return indicators.join(deletes.select("key").distinct(), "key", "left_anti")


def compile_contributions(contrib: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """A full build: adds merged over all feeds, and over the indicators of a base if given, then all withdrawals, whatever their order."""
    rows = identified(contrib)
    adds = one_spelling(by_layer(rows.filter("action is null or action <> '-'")), base)
    return withdraw(merge(adds if base is None else before_all(base).unionByName(adds)), rows.filter("action = '-'"))


def before_all(indicators: DataFrame) -> DataFrame:
    """Indicators as rows that come before any contribution."""
    first = F.lit(-1).cast("long")
    return indicators.withColumns({"src_ord": first, "row_ord": first})


def public_feeds(contrib: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(feed): names that ever stood on the public layer."""
    now = contrib.filter((F.col("layer") == "cti") & (F.coalesce("action", F.lit("+")) != "-")).select(F.coalesce(F.when(F.trim("feed") != "", F.col("feed")), F.lit("Unknown")).alias("feed"))
    now = now.unionByName(before) if before is not None else now
    return now.groupBy(F.lower("feed").alias("low")).agg(F.min("feed").alias("feed")).select("feed")


def _covering(cuts: DataFrame, nets: DataFrame, present: list[int], mask) -> DataFrame:
    """Each cut with the networks that cover it: an equi-join on prefix length and masked start, no range predicate."""
    spread = cuts.withColumn("plen", F.explode(F.array(*(F.lit(p) for p in present))) if present else F.lit(None).cast("int"))
    spread = spread.withColumn("net", mask(F.col("cs"), F.col("plen")))
    return spread.join(nets, ["plen", "net"])


def _lists(column: str) -> Column:
    """Of at most one network for each prefix length, the wider first."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("plen", column))), lambda x: x[column]))).alias(column)


def _merged_cuts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("bucket", "part", "cs", "ce").agg(
        F.max("confidence").alias("confidence"), F.max("confidence_r").alias("confidence_r"), *(F.bit_or(c).alias(c) for c in ("type_mask", "tlp_mask", "category_mask")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("feeds")))).alias("feeds"), _lists("tags"), _lists("labels"),
    )


def _cuts(ends: DataFrame) -> DataFrame:
    """(bucket, part, cs, next) of distinct positions (bucket, part, pos): each with the one behind it in its bucket.

    Windows run over a part of a bucket, and over the first positions of a bucket's parts, so neither a busy bucket nor a busy part
    of it is more than one task can hold: a part has as many positions as it has addresses at its finest, a bucket 65536 parts.
    """
    own = ends.withColumn("next", F.lead("pos").over(Window.partitionBy("bucket", "part").orderBy("pos")))
    firsts = ends.groupBy("bucket", "part").agg(F.min("pos").alias("first"))
    after = firsts.select("bucket", "part", F.lead("first").over(Window.partitionBy("bucket").orderBy("part")).alias("after"))
    return own.join(after, ["bucket", "part"]).select("bucket", "part", F.col("pos").alias("cs"), F.coalesce("next", "after").alias("next")).filter("next is not null")


def _islands(rows: DataFrame, *parts: str) -> DataFrame:
    """Neighbours (cs, ce, before: the position before cs) with one record as one range, within equal parts."""
    w = Window.partitionBy(*parts).orderBy("cs")
    record = F.struct(*S.RECORD_COLUMNS)
    breaks = rows.withColumn("new", F.when((F.lag("ce").over(w) == F.col("before")) & (F.lag(record).over(w) == record), 0).otherwise(1))
    groups = breaks.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    others = [c for c in ("part",) if c not in parts]
    return groups.groupBy(*parts, "g").agg(*(F.first(c).alias(c) for c in others), F.min("cs").alias("cs"), F.max("ce").alias("ce"), F.min("before").alias("before"), *(F.first(c).alias(c) for c in S.RECORD_COLUMNS)).drop("g")


def _coalesced(cut: DataFrame) -> DataFrame:
    """Neighbours with one record as one range: within each part of a bucket, then over the first and last ranges of the parts."""
    own = written(_islands(cut, "bucket", "part"), "ranges-of-parts")
    bounds = own.groupBy("bucket", "part").agg(F.min("cs").alias("lo"), F.max("cs").alias("hi"))
    rows = own.join(bounds, ["bucket", "part"]).withColumn("edge", (F.col("cs") == F.col("lo")) | (F.col("cs") == F.col("hi"))).drop("lo", "hi")
    joined = _islands(rows.filter("edge").drop("edge"), "bucket")
    whole = rows.filter("not edge").drop("edge").unionByName(joined)
    return whole.select("bucket", F.col("cs").alias("ip_start"), F.col("ce").alias("ip_end"), *S.RECORD_COLUMNS)


def flatten_v4(indicators: DataFrame) -> DataFrame:
    """(bucket, ip_start, ip_end, record): disjoint ranges, each with the merge of all networks over it. Buckets are /8, which no network
    crosses, their parts /16. indicators are read several times, so write them first."""
    rows = indicators.filter("kind = 4")
    present = sorted(r[0] for r in rows.select("plen").distinct().collect())
    ends = rows.select(F.explode(F.array("ip4_start", F.col("ip4_end") + 1)).alias("pos"), F.shiftright("ip4_start", 24).alias("bucket")).distinct().withColumn("part", F.shiftright("pos", 16))
    cuts = _cuts(ends).select("bucket", "part", "cs", (F.col("next") - 1).alias("ce"))
    nets = rows.select("plen", F.col("ip4_start").alias("net"), *S.RECORD_COLUMNS)
    return _coalesced(_merged_cuts(_covering(cuts, nets, present, A.masked)).withColumn("before", F.col("cs") - 1))


def flatten_v6(indicators: DataFrame) -> DataFrame:
    """As flatten_v4() in hexadecimal; buckets are /32, their parts /48."""
    rows = indicators.filter("kind = 6")
    present = sorted(r[0] for r in rows.select("plen").distinct().collect())
    ends = rows.select(F.explode(F.array("ip6_start", A.v6_after(F.col("ip6_end")))).alias("pos"), F.substring("ip6_start", 1, 8).alias("bucket")).distinct().withColumn("part", F.substring("pos", 1, 12))
    cuts = _cuts(ends).select("bucket", "part", "cs", A.v6_before(F.col("next")).alias("ce"))
    nets = rows.select("plen", F.col("ip6_start").alias("net"), *S.RECORD_COLUMNS)
    return _coalesced(_merged_cuts(_covering(cuts, nets, present, A.v6_masked)).withColumn("before", A.v6_before(F.col("cs"))))


def build_statistics(contrib: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row of counts of a build."""
    kinds = indicators.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in ((4, "networks_v4"), (6, "networks_v6"), (0, "strings"))), *(F.count_if(F.col("type_mask").bitwiseAND(F.lit(b)) != 0).alias(n) for b, n in ((1, "cti"), (2, "cti_r"), (4, "tagged"))))
    seen = contrib.agg(F.count("*").alias("contributions"), F.count_if(F.col("action") == "-").alias("withdrawals"), F.countDistinct(F.lower("feed")).alias("feeds"))
    one = F.lit(1).alias("one")
    return seen.select(one, "*").join(kinds.select(one, "*"), "one").drop("one")


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
