"""Observables against indicators and overlay, under the policy on whitelists and private addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import address as A
from ..functions import text as X
from ..plans.scratch import written
from . import compile as C

_NONE = "array<string>"


def classify(values: DataFrame) -> DataFrame:
    """values (value) with status, kind (4, 6, 0), ip4, ip6 and whether the address is private."""
    status = X.value_status(F.col("value"))
    rows = values.withColumn("__ok", F.when(status == 0, F.col("value"))).withColumn("__6", A.ipv6_network(F.col("__ok"), F.lit(False)))
    ip4 = A.ipv4_number(F.col("__ok"))
    rows = rows.withColumn("bad", status).withColumn("ip4", ip4).withColumn("ip6", F.col("__6.start"))
    kind = F.when(F.col("ip4").isNotNull(), 4).when(F.col("ip6").isNotNull(), 6).otherwise(0)
    return rows.withColumn("kind", kind).withColumn("private", A.is_private_v4(F.col("ip4")) | A.is_private_v6(F.col("ip6"))).drop("__ok", "__6")


def match_strings(observed: DataFrame, indicators: DataFrame) -> DataFrame:
    """(value, record) for string values: equal bytes."""
    own = indicators.filter("kind = 0").select(F.col("str").alias("value"), *S.RECORD_COLUMNS)
    return observed.filter("kind = 0 and bad = 0").select("value").join(own, "value")


def _merged_by_value(found: DataFrame) -> DataFrame:
    """The networks over one address, at most one for each prefix length, as one record."""
    return found.groupBy("value").agg(
        F.max("confidence").alias("confidence"), F.max("confidence_r").alias("confidence_r"), *(F.bit_or(c).alias(c) for c in ("type_mask", "tlp_mask", "category_mask")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("feeds")))).alias("feeds"), C._lists("tags"), C._lists("labels"),
    )


def _by_prefix(observed: DataFrame, indicators: DataFrame, kind: int, address: str, start: str, mask) -> DataFrame:
    """Prefix expansion: an address meets a network where (prefix length, masked address) are equal; only lengths in use are tried."""
    own = indicators.filter(F.col("kind") == kind)
    present = sorted(r[0] for r in own.select("plen").distinct().collect())
    points = observed.filter(f"kind = {kind} and bad = 0").select("value", F.col(address).alias("__at"))
    if not present:
        points = points.limit(0)
    spread = points.withColumn("plen", F.explode(F.array(*(F.lit(p) for p in present or [32]))))
    spread = spread.withColumn("net", mask(F.col("__at"), F.col("plen")))
    nets = own.select("plen", F.col(start).alias("net"), *S.RECORD_COLUMNS)
    return _merged_by_value(spread.join(nets, ["plen", "net"]))


def match_v4(observed: DataFrame, indicators: DataFrame) -> DataFrame:
    return _by_prefix(observed, indicators, 4, "ip4", "ip4_start", A.masked)


def match_v6(observed: DataFrame, indicators: DataFrame) -> DataFrame:
    return _by_prefix(observed, indicators, 6, "ip6", "ip6_start", A.v6_masked)


def _in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(value, record) of the points (value, bucket, part, pos) that lie in disjoint ranges (bucket, part, ip_start, ip_end, record).

    Each point finds the last range that begins at or before it: in its part of its bucket by a window, else the last one of the
    parts before. A point stays one row, and no range is repeated; a window holds a part, or one row for each part of a bucket.
    """
    last = lambda w: F.last("at", ignorenulls=True).over(w)
    begins = ranges.select("bucket", "part", F.col("ip_start").alias("pos"), F.lit(None).cast("string").alias("value"), F.struct("ip_start", "ip_end").alias("at"))
    asked = points.select("bucket", "part", "pos", "value", F.lit(None).cast(begins.schema["at"].dataType).alias("at"))
    w = Window.partitionBy("bucket", "part").orderBy("pos", F.col("value").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = begins.unionByName(asked).withColumn("at", last(w)).filter("value is not null")
    ends = ranges.groupBy("bucket", "part").agg(F.max(F.struct("ip_start", "ip_end")).alias("at"))
    parts = ends.unionByName(points.select("bucket", "part", F.lit(None).cast(begins.schema["at"].dataType).alias("at")).distinct()).groupBy("bucket", "part").agg(F.max("at").alias("at"))
    earlier = parts.select("bucket", "part", last(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    found = own.join(earlier, ["bucket", "part"]).withColumn("at", F.coalesce("at", "earlier")).filter("pos <= at.ip_end")
    return found.select("value", F.col("at.ip_start").alias("ip_start")).join(ranges, "ip_start").select("value", *S.RECORD_COLUMNS)


def match_v4_ranges(observed: DataFrame, ranges4: DataFrame) -> DataFrame:
    """The same by disjoint ranges, as flatten_v4() gives and versions hold."""
    points = observed.filter("kind = 4 and bad = 0").select("value", F.col("ip4").alias("pos"), F.shiftright("ip4", 24).alias("bucket"), F.shiftright("ip4", 16).alias("part"))
    return _in_ranges(points, ranges4.withColumn("part", F.shiftright("ip_start", 16)))


def match_v6_ranges(observed: DataFrame, ranges6: DataFrame) -> DataFrame:
    """As match_v4_ranges() for IPv6."""
    points = observed.filter("kind = 6 and bad = 0").select("value", F.col("ip6").alias("pos"), F.substring("ip6", 1, 8).alias("bucket"), F.substring("ip6", 1, 12).alias("part"))
    return _in_ranges(points, ranges6.withColumn("part", F.substring("ip_start", 1, 12)))


def _bits(flag: Column, bit: int) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), bit).otherwise(0)


def resolve(rows: DataFrame, skip_private: bool) -> DataFrame:
    """The policy. rows: value, bad, kind, private, m (record or null), o (overlay entry or null), public (public feeds in m.feeds)."""
    m, o = F.col("m"), F.col("o")
    has, over = m.isNotNull(), o.isNotNull()
    action = o["action"]
    suppressed = F.coalesce((action == "-") & o["suppress_full"], F.lit(False))
    skip = F.col("private") if skip_private else F.lit(False)
    type_mask = F.coalesce(m["type_mask"], F.lit(0))
    cti, cti_r = type_mask.bitwiseAND(F.lit(S.CTI)) != 0, type_mask.bitwiseAND(F.lit(S.CTI_R)) != 0
    matched = F.coalesce(action == "+", F.lit(False)) | (has & ~skip & (cti | cti_r))
    flags = (
        _bits(over, S.OVERLAY) + _bits((action == "-") & ~o["suppress_full"], S.WHITELISTED) + _bits(F.col("private"), S.PRIVATE) + _bits(has, S.THRT) + _bits(has & skip & (cti | cti_r), S.PRIVATE_SKIP) + _bits(matched, S.MATCH)
    )
    dead = suppressed | (F.col("bad") != 0)
    show = has & ~skip
    num = lambda when, c: F.when(~dead & when, c).otherwise(0).cast("int")
    arr = lambda when, c: F.when(~dead & when, F.coalesce(c, F.array().cast(_NONE))).otherwise(F.array().cast(_NONE))
    out = rows.select(
        *[c for c in rows.columns if c not in ("m", "o", "public", "bad", "private", "kind", "ip4", "ip6")], "bad", "kind", F.when(F.col("bad") != 0, 0).when(suppressed, S.OVERLAY + S.SUPPRESSED).otherwise(flags).cast("int").alias("flags"),
        num(show, type_mask).alias("type_mask"), num(show & cti, m["confidence"]).alias("confidence"), num(show & cti_r, m["confidence_r"]).alias("confidence_r"), num(show & cti, m["tlp_mask"]).alias("tlp_mask"), num(show & cti, m["category_mask"]).alias("category_mask"),
        arr(show & cti, F.col("public")).alias("feeds"), num(action.isin("T", "+"), o["type_mask"]).alias("ovl_type_mask"), num(action == "+", o["confidence"]).alias("ovl_confidence"), num(action == "+", o["category_mask"]).alias("ovl_category_mask"),
        arr(has, m["tags"]).alias("tags"), arr(show, m["labels"]).alias("labels"), arr(action == "T", o["tags"]).alias("overlay_tags"),
    )
    told = (F.col("flags").bitwiseAND(F.lit(S.MATCH | S.WHITELISTED | S.SUPPRESSED)) != 0) | (F.size("tags") + F.size("labels") + F.size("overlay_tags") > 0)
    return out.withColumn("status", F.when(F.col("bad") != 0, F.col("bad")).when(told, 1).otherwise(0).cast("int")).drop("bad")


def empty(spark, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def lookup(df: DataFrame, value_col: str, indicators: DataFrame | None, public: DataFrame | None = None, overlay: DataFrame | None = None, skip_private: bool = False, ranges: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """df with the result columns of each value. Distinct values are matched once; values under a full whitelist skip the database.

    public: (feed), the feeds that may be named; a missing indicators or overlay simply never matches. ranges: the disjoint IPv4 and
    IPv6 ranges of the indicators, as versions hold them; without them addresses are matched by prefix expansion.
    """
    spark = df.sparkSession
    indicators = empty(spark, S.INDICATORS) if indicators is None else indicators
    overlay = empty(spark, S.OVERLAY_ROWS) if overlay is None else overlay
    public = empty(spark, "feed string") if public is None else public
    entry = overlay.select("value", F.struct("action", "suppress_full", "confidence", "type_mask", "category_mask", "tags").alias("o"))
    seen = written(classify(df.select(F.col(value_col).alias("value")).distinct()).join(entry, "value", "left"), "observed")
    probe = seen.filter("o is null or o.action <> '-' or not o.suppress_full")
    four, six = (match_v4_ranges(probe, ranges[0]), match_v6_ranges(probe, ranges[1])) if ranges else (match_v4(probe, indicators), match_v6(probe, indicators))
    found = written(match_strings(probe, indicators).unionByName(four).unionByName(six), "found")
    named = found.select("value", F.explode("feeds").alias("f")).join(public.select(F.lower("feed").alias("low")).distinct(), F.lower("f") == F.col("low"), "left_semi").groupBy("value").agg(F.array_sort(F.collect_set("f")).alias("public"))
    record = found.select("value", F.struct(*S.RECORD_COLUMNS).alias("m")).join(named, "value", "left")
    result = resolve(seen.join(record, "value", "left"), skip_private).withColumnRenamed("value", "__value")
    return df.join(result, F.col(value_col).eqNullSafe(F.col("__value"))).drop("__value")


def overlay_only(values: DataFrame, value_col: str, overlay: DataFrame) -> DataFrame:
    """(value, line): what the overlay alone says of each value."""
    own = overlay.select(F.col("value").alias("__value"), "action", "suppress_full", "confidence")
    mode = F.when(F.col("action") != "-", 0).when(F.col("suppress_full"), 1).otherwise(2)
    name = F.when(F.col("action") == "-", "whitelist").when(F.col("action") == "T", "tag").otherwise("add")
    hit = F.concat_ws("  ", F.lit("HIT"), F.concat(F.lit("ioc="), F.col(value_col)), F.concat(F.lit("action="), name), F.concat(F.lit("suppress="), mode), F.concat(F.lit("confidence="), "confidence"))
    line = F.when(F.col("action").isNull(), F.concat(F.lit("MISS  ioc="), F.col(value_col))).otherwise(hit)
    return values.join(own, F.col(value_col) == F.col("__value"), "left").select(F.col(value_col).alias("value"), line.alias("line"))


def prevalence_report(rows: DataFrame, value_col: str) -> DataFrame:
    """(value, line) of what prevalence_of() gives."""
    line = F.concat_ws("  ", F.concat(F.lit("key="), F.col(value_col)), F.concat(F.lit("count="), F.coalesce("fleet_count", F.lit(0))), F.concat(F.lit("collectors="), F.coalesce("edge_count", F.lit(0))), F.concat(F.lit("sources="), F.coalesce("source_count", F.lit(0))), F.when(F.coalesce("fleet_count", F.lit(0)) == 0, "(absent = rare)"))
    return rows.select(F.col(value_col).alias("value"), line.alias("line"))


def fold_events(results: DataFrame, event_col: str) -> DataFrame:
    """One row for each event: any match, any whitelist, the highest confidence that counts, unions of masks and feeds."""
    t = F.col("type_mask")
    score = F.greatest(F.when(t.bitwiseAND(F.lit(S.CTI)) != 0, F.col("confidence")).otherwise(0), F.when(t.bitwiseAND(F.lit(S.CTI_R)) != 0, F.col("confidence_r")).otherwise(0), "ovl_confidence")
    good = results.filter("status >= 0")
    flag = lambda bit: F.max(F.col("flags").bitwiseAND(F.lit(bit)) != 0)
    return good.groupBy(event_col).agg(
        flag(S.MATCH).alias("match"), flag(S.WHITELISTED).alias("whitelisted"), F.max(score).alias("confidence"), F.bit_or(t.bitwiseOR(F.col("ovl_type_mask"))).alias("type_mask"), F.bit_or("tlp_mask").alias("tlp_mask"),
        F.bit_or(F.col("category_mask").bitwiseOR(F.col("ovl_category_mask"))).alias("category_mask"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("feeds")))).alias("feeds"),
    )


def hits(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("status") == 1).alias("hits"), F.count("*").alias("values"))


def report(results: DataFrame, value_col: str) -> DataFrame:
    """(value, line): the text report of a lookup."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), c)
    none = lambda c: F.when(c == "", "(none)").otherwise(c)
    tlp = F.coalesce(F.when(X.tlp_name(X.tlp_strictest(F.col("tlp_mask"))) == "CLEAR", "WHITE").otherwise(X.tlp_name(X.tlp_strictest(F.col("tlp_mask")))), F.lit("(none)"))
    line = F.concat_ws(
        " ", F.when(F.col("status") == 1, "HIT").otherwise("MISS"), part("Type", X.type_names(F.col("type_mask"))), part("Confidence", F.col("confidence").cast("string")), part("TLP", tlp), part("Category", none(F.array_join(X.category_names(F.col("category_mask")), ","))),
        part("Feeds", none(F.array_join("feeds", ","))), F.when(F.size("tags") > 0, part("Tags", F.array_join("tags", ","))), F.when(F.size("labels") > 0, part("Labels", F.array_join("labels", ","))),
    )
    return results.select(F.col(value_col).alias("value"), line.alias("line"))
