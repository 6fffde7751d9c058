"""The registered queries of the engine over the driver's tables, each with the same in SQL for DuckDB.

Indicators and observables are derived arithmetically from keys, by one formula on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import address as A
from .functions import text as X
from .operators import compile as C
from .operators import fold as FO
from .operators import match as M
from .plans.scratch import new_folder, written
from .plans.store import Snapshot, Store
from .sources import feeds, pull, stix

#: Unix seconds that folds are judged by.
NOW = 1_700_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contrib(rows: DataFrame, **c) -> DataFrame:
    """Contributions from columns value, type and whatever c names."""
    made = {"src_ord": F.lit(0), "row_ord": F.lit(0), "action": F.lit("+"), "type": F.lit("ip"), "confidence": F.lit(50), "category_mask": F.lit(0), "feed": F.lit("f"), "tlp_mask": F.lit(1), "labels": F.array(), "layer": F.lit("cti")} | c
    return rows.select(*(made[n].cast(t).alias(n) for n, t in (x.split() for x in S.CONTRIB.split(", "))))


def part_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks and domains of a feed for each brand: prefix lengths 12, 16, 20, 24, 28, 32 within 10/8 and 20/8, layers in turn."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    plen = F.lit(12) + 4 * (k % 6)
    ip = F.when(k % 2 == 0, 10 * 16777216).otherwise(20 * 16777216) + (k * 7919) % 16777216
    value = F.when(k % 5 == 0, F.concat(F.lit("host"), (k % 97).cast("string"), F.lit(".example"))).otherwise(F.concat(A.ipv4_text(ip), F.lit("/"), plen.cast("string")))
    layer = F.when(k % 3 == 0, "cti").when(k % 3 == 1, "cti_r").otherwise("tags")
    return _contrib(p, row_ord=k, value=value, type=F.when(k % 5 == 0, "domain").otherwise("ip"), confidence=k % 101, category_mask=F.expr("shiftleft(1, cast(p_partkey % 11 as int))"), feed=F.col("p_brand"), tlp_mask=F.expr("shiftleft(1, cast(p_partkey % 4 as int))"), labels=F.array(F.concat(F.lit("l"), (k % 7).cast("string"))), layer=layer)


def part_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(C.compile_contributions(part_contributions(spark, sf_dir)), "indicators")


# The same as rows of identity (s, e, str) in SQL.
_PART = """
WITH parts AS (
  SELECT p_partkey AS k, 12 + 4 * (p_partkey % 6) AS plen, (CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 20 END)::BIGINT * 16777216 + (p_partkey * 7919) % 16777216 AS ip, p_brand AS feed, p_partkey % 3 AS layer,
    CASE WHEN p_partkey % 5 = 0 THEN 'host' || (p_partkey % 97) || '.example' END AS str FROM part
), contrib AS (
  SELECT k, layer, feed, str, CASE WHEN str IS NULL THEN ip - ip % (1 << (32 - plen)) END AS s, CASE WHEN str IS NULL THEN ip - ip % (1 << (32 - plen)) + (1 << (32 - plen)) - 1 END AS e,
    CASE WHEN layer = 0 THEN k % 101 ELSE 0 END AS confidence, CASE WHEN layer = 1 THEN k % 101 ELSE 0 END AS confidence_r, CASE layer WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS type_mask,
    CASE WHEN layer = 0 THEN 1 << (k % 4) ELSE 0 END AS tlp_mask, CASE WHEN layer = 0 THEN 1 << (k % 11) ELSE 0 END AS category_mask, CASE WHEN layer = 0 THEN feed END AS pub,
    CASE WHEN layer = 2 THEN 'l' || (k % 7) END AS tag, CASE WHEN layer = 0 THEN 'l' || (k % 7) END AS label FROM parts
), ind AS (
  SELECT s, e, str, CAST(max(confidence) AS INT) AS confidence, CAST(max(confidence_r) AS INT) AS confidence_r, CAST(bit_or(type_mask) AS INT) AS type_mask, CAST(bit_or(tlp_mask) AS INT) AS tlp_mask, CAST(bit_or(category_mask) AS INT) AS category_mask,
    coalesce(string_agg(DISTINCT pub, ',' ORDER BY pub), '') AS feeds, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM contrib GROUP BY s, e, str
)"""


def _shown(df: DataFrame, *keys: str) -> DataFrame:
    j = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return df.select(*keys, "confidence", "confidence_r", "type_mask", "tlp_mask", "category_mask", j("feeds"), j("tags"), j("labels"))


def merge_identity(spark, sf_dir):
    return _shown(part_indicators(spark, sf_dir), F.col("ip4_start").alias("s"), F.col("ip4_end").alias("e"), "str")


def flatten_ranges(spark, sf_dir, indicators: DataFrame | None = None):
    return C.flatten_v4(part_indicators(spark, sf_dir) if indicators is None else indicators).select(F.col("ip_start").alias("s"), F.col("ip_end").alias("e"), "confidence", "confidence_r", "type_mask", "tlp_mask", "category_mask", F.array_join("feeds", ",").alias("feeds"))


def observed(spark, sf_dir) -> DataFrame:
    """(event_id, value) of every event: an address within 10/8, 20/8 or elsewhere, or a host."""
    k = F.col("event_id")
    ip = F.when(k % 3 == 0, 10 * 16777216).when(k % 3 == 1, 20 * 16777216).otherwise(198 * 16777216) + (k * 104729) % 16777216
    return _t(spark, sf_dir, "events").select("event_id", "user_id", F.when(k % 4 == 0, F.concat(F.lit("host"), (k % 120).cast("string"), F.lit(".example"))).otherwise(A.ipv4_text(ip)).alias("value"))


_OBS = """, obs AS (
  SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'host' || (event_id % 120) || '.example' END AS host, CASE WHEN event_id % 4 <> 0 THEN (CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 198 END)::BIGINT * 16777216 + (event_id * 104729) % 16777216 END AS ip FROM events
)"""


def _seen(spark, sf_dir) -> DataFrame:
    return written(M.classify(observed(spark, sf_dir).select("value").distinct()), "seen")


def _with_ip(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("value", "ip4"), "value").select(F.col("ip4").alias("ip"), "confidence", "confidence_r", "type_mask", "tlp_mask", "category_mask", F.array_join("feeds", ",").alias("feeds"))


def match_ipv4_range(spark, sf_dir, indicators: DataFrame | None = None):
    """By prefix expansion. indicators: as part_indicators() gives, if they are there already."""
    seen = _seen(spark, sf_dir)
    return _with_ip(M.match_v4(seen, part_indicators(spark, sf_dir) if indicators is None else indicators), seen)


def match_ipv4_disjoint(spark, sf_dir, ranges: DataFrame | None = None):
    """By disjoint ranges. ranges: as flatten_v4() gives, if they are there already."""
    seen = _seen(spark, sf_dir)
    ranges = written(C.flatten_v4(part_indicators(spark, sf_dir)), "ranges") if ranges is None else ranges
    return _with_ip(M.match_v4_ranges(seen, ranges), seen)


_MATCH4 = """SELECT ip, max(confidence) AS confidence, max(confidence_r) AS confidence_r, bit_or(type_mask) AS type_mask, bit_or(tlp_mask) AS tlp_mask, bit_or(category_mask) AS category_mask,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(feeds, ','))), lambda x: x <> ''))), ',') AS feeds FROM (SELECT DISTINCT ip FROM obs WHERE ip IS NOT NULL) o JOIN ind ON ip BETWEEN s AND e GROUP BY ip"""


def match_strings(spark, sf_dir, indicators: DataFrame | None = None):
    return _shown(M.match_strings(_seen(spark, sf_dir), part_indicators(spark, sf_dir) if indicators is None else indicators), "value")


def _overlay(spark) -> DataFrame:
    n = spark.range(1, 31)
    k = F.col("id")
    action = F.when(k % 3 == 0, "-").when(k % 3 == 1, "T").otherwise("+")
    return n.select(F.concat(F.lit("host"), k.cast("string"), F.lit(".example")).alias("value"), action.alias("action"), ((k % 3 == 0) & (k % 2 == 0)).alias("suppress_full"), (k + 40).cast("int").alias("confidence"), F.when(k % 3 == 1, 4).otherwise(1).cast("int").alias("type_mask"), F.lit(16).alias("category_mask"), F.array(F.concat(F.lit("o"), (k % 2).cast("string"))).alias("tags"))


def _looked_up(spark, sf_dir, skip: bool, snapshot: Snapshot | None = None) -> DataFrame:
    if snapshot is not None:
        return snapshot.lookup(observed(spark, sf_dir), "value", skip)
    return M.lookup(observed(spark, sf_dir), "value", part_indicators(spark, sf_dir), C.public_feeds(part_contributions(spark, sf_dir)), _overlay(spark), skip)


def published(spark, sf_dir) -> Snapshot:
    """The indicators of part_contributions() and the overlay as a version in a store of their own, opened and checked."""
    store = Store(spark, new_folder(spark, "store"))
    contrib = part_contributions(spark, sf_dir)
    store.publish({"indicators": C.compile_contributions(contrib), "public_feeds": C.public_feeds(contrib), "overlay": _overlay(spark)})
    return store.open(check=True)


def _flat(df: DataFrame) -> DataFrame:
    j = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return df.select("event_id", "status", "kind", "flags", "type_mask", "confidence", "confidence_r", "tlp_mask", "category_mask", j("feeds"), "ovl_type_mask", "ovl_confidence", "ovl_category_mask", j("tags"), j("labels"), j("overlay_tags"))


def overlay_policy(spark, sf_dir, snapshot: Snapshot | None = None):
    return _flat(_looked_up(spark, sf_dir, False, snapshot))


def published_policy(spark, sf_dir):
    """overlay_policy by a published version and its disjoint ranges."""
    return overlay_policy(spark, sf_dir, published(spark, sf_dir))


def skip_private(spark, sf_dir):
    return _flat(_looked_up(spark, sf_dir, True))


def _policy_sql(skip: str, tail: str = "SELECT * FROM final") -> str:
    lists = lambda c: f"array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split({c}, ','))), lambda x: x <> ''))), ',') AS {c}"
    return _PART + _OBS + f""", ovl AS (
  SELECT 'host' || i || '.example' AS value, CASE i % 3 WHEN 0 THEN '-' WHEN 1 THEN 'T' ELSE '+' END AS action, i % 6 = 0 AS whole_, i + 40 AS conf, 'o' || (i % 2) AS otag FROM range(1, 31) t(i)
), hit AS (
  SELECT event_id, max(confidence) AS c, max(confidence_r) AS r, bit_or(type_mask) AS t, bit_or(tlp_mask) AS p, bit_or(category_mask) AS g, {lists("feeds")}, {lists("tags")}, {lists("labels")}
  FROM (SELECT event_id, ind.* FROM obs JOIN ind ON ip BETWEEN s AND e UNION ALL SELECT event_id, ind.* FROM obs JOIN ind ON host = str) GROUP BY event_id
), j AS (
  SELECT o.*, h.* EXCLUDE (event_id), h.event_id IS NOT NULL AS has, action, whole_, conf, otag, coalesce(action = '-' AND whole_, false) AS dead, coalesce(ip BETWEEN 167772160 AND 184549375, false) AS priv, coalesce(t, 0) AS m FROM obs o LEFT JOIN hit h ON o.event_id = h.event_id LEFT JOIN ovl ON o.host = ovl.value
), x AS (
  SELECT *, has AND NOT dead AND NOT (priv AND {skip}) AS visible, priv AND {skip} AS skipped FROM j
), y AS (
  SELECT event_id, user_id, CAST(CASE WHEN host IS NULL THEN 4 ELSE 0 END AS INT) AS kind,
    CAST(CASE WHEN dead THEN 48 ELSE CASE WHEN action IS NOT NULL THEN 32 ELSE 0 END + CASE WHEN action = '-' THEN 8 ELSE 0 END + CASE WHEN priv THEN 2 ELSE 0 END + CASE WHEN has THEN 64 ELSE 0 END + CASE WHEN has AND skipped AND m & 3 <> 0 THEN 4 ELSE 0 END
      + CASE WHEN coalesce(action = '+', false) OR (has AND NOT skipped AND m & 3 <> 0) THEN 1 ELSE 0 END END AS INT) AS flags,
    CAST(CASE WHEN visible THEN m ELSE 0 END AS INT) AS type_mask, CAST(CASE WHEN visible AND m & 1 <> 0 THEN c ELSE 0 END AS INT) AS confidence, CAST(CASE WHEN visible AND m & 2 <> 0 THEN r ELSE 0 END AS INT) AS confidence_r,
    CAST(CASE WHEN visible AND m & 1 <> 0 THEN p ELSE 0 END AS INT) AS tlp_mask, CAST(CASE WHEN visible AND m & 1 <> 0 THEN g ELSE 0 END AS INT) AS category_mask, CASE WHEN visible AND m & 1 <> 0 THEN feeds ELSE '' END AS feeds,
    CAST(CASE WHEN dead THEN 0 WHEN action = 'T' THEN 4 WHEN action = '+' THEN 1 ELSE 0 END AS INT) AS ovl_type_mask, CAST(CASE WHEN action = '+' THEN conf ELSE 0 END AS INT) AS ovl_confidence, CAST(CASE WHEN action = '+' THEN 16 ELSE 0 END AS INT) AS ovl_category_mask,
    CASE WHEN has AND NOT dead THEN tags ELSE '' END AS tags, CASE WHEN visible THEN labels ELSE '' END AS labels, CASE WHEN action = 'T' THEN otag ELSE '' END AS overlay_tags FROM x
), final AS (
  SELECT event_id, CAST(CASE WHEN flags & 25 <> 0 OR tags || labels || overlay_tags <> '' THEN 1 ELSE 0 END AS INT) AS status, y.* EXCLUDE (event_id, user_id) FROM y
) {tail}"""


def event_fold(spark, sf_dir, snapshot: Snapshot | None = None):
    return M.fold_events(_looked_up(spark, sf_dir, False, snapshot), "user_id").withColumn("feeds", F.array_join("feeds", ","))


_EVENT_TAIL = """SELECT user_id, bool_or(flags & 1 <> 0) AS match, bool_or(flags & 8 <> 0) AS whitelisted, max(greatest(CASE WHEN type_mask & 1 <> 0 THEN confidence ELSE 0 END, CASE WHEN type_mask & 2 <> 0 THEN confidence_r ELSE 0 END, ovl_confidence)) AS confidence,
  bit_or(type_mask | ovl_type_mask) AS type_mask, bit_or(tlp_mask) AS tlp_mask, bit_or(category_mask | ovl_category_mask) AS category_mask, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(feeds, ','))), lambda x: x <> ''))), ',') AS feeds FROM y GROUP BY user_id"""


def _v6(k) -> tuple:
    return F.format_string("2001:db8:%x::%x", k % 13, k % 50)


def six_indicators(spark, sf_dir) -> DataFrame:
    """Networks of suppliers (/32, /48, /128)."""
    s = F.col("s_suppkey")
    plen = F.when(s % 3 == 0, "32").when(s % 3 == 1, "48").otherwise("128")
    own = _contrib(_t(spark, sf_dir, "supplier"), row_ord=s, value=F.concat(_v6(s), F.lit("/"), plen), confidence=s % 101, feed=F.lit("six"))
    return written(C.compile_contributions(own), "indicators")


def _six_seen(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    return written(M.classify(_t(spark, sf_dir, "customer").select(F.format_string("2001:db8:%x::%x", c % 17, c % 70).alias("value")).distinct()), "seen")


def match_ipv6_range(spark, sf_dir, indicators: DataFrame | None = None):
    """Networks of suppliers over addresses of customers, by prefix expansion."""
    seen = _six_seen(spark, sf_dir)
    return M.match_v6(seen, six_indicators(spark, sf_dir) if indicators is None else indicators).join(seen.select("value", "ip6"), "value").select("ip6", "confidence", "type_mask")


def match_ipv6_disjoint(spark, sf_dir):
    """The same by disjoint ranges."""
    seen = _six_seen(spark, sf_dir)
    ranges = written(C.flatten_v6(six_indicators(spark, sf_dir)), "ranges")
    return M.match_v6_ranges(seen, ranges).join(seen.select("value", "ip6"), "value").select("ip6", "confidence", "type_mask")


def flatten_ranges_v6(spark, sf_dir):
    return C.flatten_v6(six_indicators(spark, sf_dir)).select(F.col("ip_start").alias("s"), F.col("ip_end").alias("e"), "confidence", "type_mask")


_V6 = """WITH n AS (SELECT s_suppkey % 101 AS confidence, s_suppkey % 3 AS t, '20010db8' AS a, lpad(to_hex(s_suppkey % 13), 4, '0') AS b, lpad(to_hex(s_suppkey % 50), 20, '0') AS c FROM supplier),
 r AS (SELECT confidence, lower(CASE t WHEN 0 THEN a || repeat('0', 24) WHEN 1 THEN a || b || repeat('0', 20) ELSE a || b || c END) AS s, lower(CASE t WHEN 0 THEN a || repeat('f', 24) WHEN 1 THEN a || b || repeat('f', 20) ELSE a || b || c END) AS e FROM n),
 o AS (SELECT DISTINCT lower('20010db8' || lpad(to_hex(c_custkey % 17), 4, '0') || lpad(to_hex(c_custkey % 70), 20, '0')) AS ip6 FROM customer)
SELECT ip6, CAST(max(confidence) AS INT) AS confidence, 1 AS type_mask FROM o JOIN r ON ip6 BETWEEN s AND e GROUP BY ip6"""

_QUAD = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"


def extract_observables(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_QUAD), 0)).alias("value"))
    return found.select("doc_id", "value", A.ipv4_number(F.col("value")).alias("ip"), A.is_private_v4(A.ipv4_number(F.col("value"))).alias("private"))


_EXTRACT = rf"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_QUAD}')) AS value FROM documents), q AS (SELECT *, list_transform(string_split(value, '.'), lambda x: CAST(x AS BIGINT)) AS o FROM v),
 n AS (SELECT doc_id, value, CASE WHEN list_max(o) < 256 AND NOT regexp_matches(value, '(^|\.)0[0-9]') THEN o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] END AS ip FROM q)
SELECT doc_id, value, ip, coalesce(ip >> 24 IN (0, 10, 127) OR ip >> 20 = 2753 OR ip >> 16 IN (49320, 43518) OR ip >> 22 = 401, false) AS private FROM n"""


def page_hosts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", X.stix_value(F.lit("domain"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"), X.list_type(F.col("url"), A.is_ipv4(F.col("url"))).alias("type"))


def normalize_ipv4(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat_ws(".", *(((k * m) % 300).cast("string") for m in (1, 7, 13, 29)))
    value = F.when(k % 2 == 0, text).otherwise(F.concat(text, F.lit("/"), (k % 40).cast("string")))
    net = A.ipv4_network(value)
    return _t(spark, sf_dir, "orders").select("o_orderkey", net["plen"].alias("plen"), net["start"].alias("s"), net["end"].alias("e"))


_NORMALIZE = """WITH v AS (SELECT o_orderkey AS k, o_orderkey % 300 AS a, (o_orderkey * 7) % 300 AS b, (o_orderkey * 13) % 300 AS c, (o_orderkey * 29) % 300 AS d, CASE WHEN o_orderkey % 2 = 0 THEN 32 ELSE o_orderkey % 40 END AS p FROM orders),
 n AS (SELECT k, p, CASE WHEN greatest(a, b, c, d) < 256 AND p BETWEEN 8 AND 32 THEN a * 16777216 + b * 65536 + c * 256 + d END AS ip FROM v)
SELECT k AS o_orderkey, CAST(CASE WHEN ip IS NOT NULL THEN p END AS INT) AS plen, ip - ip % (1 << (32 - least(p, 32))) AS s, ip - ip % (1 << (32 - least(p, 32))) + (1 << (32 - least(p, 32))) - 1 AS e FROM n"""


def masks(spark, sf_dir):
    """Categories of odd words, TLP and clamped confidence."""
    k = F.col("p_partkey")
    word = F.element_at(F.array(*(F.lit(w) for w in _WORDS)), (k % len(_WORDS) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", X.category_mask(word).alias("category_mask"), X.tlp_mask(F.concat(F.lit("tlp:"), F.element_at(F.array(*(F.lit(x) for x in ("RED", "Amber", "green", "white"))), (k % 4 + 1).cast("int")))).alias("tlp_mask"), X.confidence((k - 50).cast("string")).alias("confidence"))


_WORDS = ("malware", "C2 botnet", "history", "scan", "phishing kit", "3", "16", "spam", "anonymizer", "exploit payload", "ransomware attack", "nothing")
_WORD_MASKS = (2, 24, 512, 256, 4, 4, 32768, 128, 1024, 34, 65, 0)
_MASKS = f"SELECT p_partkey, CAST({list(_WORD_MASKS)}[p_partkey % 12 + 1] AS INT) AS category_mask, CAST([8, 4, 2, 1][p_partkey % 4 + 1] AS INT) AS tlp_mask, CAST(greatest(0, least(100, p_partkey - 50)) AS INT) AS confidence FROM part"


def _sightings(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("value"), (F.col("user_id") % 8).alias("edge"), F.col("user_id").alias("source"))


def prevalence_build(spark, sf_dir):
    return FO.build_prevalence(_sightings(spark, sf_dir).filter("value is not null"), "value", "edge", "source")


_PREV = "SELECT json_extract_string(props, '$.k') AS value, count(*) AS fleet_count, CAST(count(DISTINCT user_id % 8) AS INT) AS edge_count, CAST(count(DISTINCT user_id) AS INT) AS source_count FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1"


def prevalence_lookup(spark, sf_dir):
    asked = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 2000).cast("string").alias("value"))
    return FO.prevalence_of(asked, "value", prevalence_build(spark, sf_dir))


_PREV_LOOKUP = f"SELECT c_custkey, CAST(c_custkey % 2000 AS VARCHAR) AS value, coalesce(fleet_count, 0) AS fleet_count, coalesce(edge_count, 0) AS edge_count, coalesce(source_count, 0) AS source_count FROM customer LEFT JOIN ({_PREV}) p ON p.value = CAST(c_custkey % 2000 AS VARCHAR)"


def _event_contrib(spark, sf_dir, half: int, action=None) -> DataFrame:
    k = F.col("event_id")
    rows = _t(spark, sf_dir, "events").filter(F.lit(half) == k % 2)
    return _contrib(rows, row_ord=k, value=F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example")), type=F.lit("domain"), confidence=k % 101, feed=F.concat(F.lit("feed"), (F.col("user_id") % 3 + half).cast("string")), action=action if action is not None else F.lit("+"))


def _state(spark, sf_dir) -> FO.State:
    contrib = _event_contrib(spark, sf_dir, 0)
    updated = spark.createDataFrame([("feed0", 3, NOW - 50 * 86400, None, None, None), ("feed1", 2, NOW - 86400, None, None, None)], S.FEED_STATE)
    return FO.State(written(C.compile_contributions(contrib), "indicators"), C.public_feeds(contrib), updated)


def _folded(state: FO.State) -> DataFrame:
    return state.indicators.select("str", "confidence", F.array_join("feeds", ",").alias("feeds"))


def fold_withdraw(spark, sf_dir):
    page = _event_contrib(spark, sf_dir, 1, F.when(F.col("user_id") % 7 == 0, "-").otherwise("+"))
    return _folded(FO.fold(_state(spark, sf_dir), [page], "feed1", NOW))


def fold_snapshot(spark, sf_dir):
    return _folded(FO.fold(_state(spark, sf_dir), [_event_contrib(spark, sf_dir, 1)], "feed1", NOW, snapshot=True))


def fold_ttl(spark, sf_dir):
    return _folded(FO.fold(_state(spark, sf_dir), [_event_contrib(spark, sf_dir, 1)], "feed1", NOW, ttl_days=30))


def fold_generation(spark, sf_dir):
    return _folded(FO.fold(_state(spark, sf_dir), [_event_contrib(spark, sf_dir, 1)], "feed1", NOW, generation=2))


def _fold_sql(old_feeds: str, new: bool, drop: str = "false") -> str:
    adds = " UNION ALL SELECT user_id AS u, event_id % 101 AS c, 'feed' || (user_id % 3 + 1) AS f FROM events WHERE event_id % 2 = 1" + (f" AND NOT ({drop})" if drop != "false" else "")
    return f"""WITH base AS (SELECT user_id AS u, max(event_id % 101) AS c, 'feed' || (user_id % 3) AS f FROM events WHERE event_id % 2 = 0 GROUP BY user_id), rows AS (SELECT u, c, f FROM base WHERE {old_feeds}{adds if new else ''})
SELECT 'u' || u || '.example' AS str, CAST(max(c) AS INT) AS confidence, string_agg(DISTINCT f, ',' ORDER BY f) AS feeds FROM rows WHERE u NOT IN (SELECT user_id AS u FROM events WHERE event_id % 2 = 1 AND {drop}) GROUP BY u"""


def dictionary_json(spark, sf_dir):
    k = F.col("s_suppkey")
    one = F.to_json(F.create_map(F.concat(F.lit("s"), k.cast("string"), F.lit(".example")), F.struct(F.lit("amber").alias("tlp"), F.lit("malware").alias("type"), (k % 150).alias("max_score"), F.array(F.concat(F.lit("d"), (k % 3).cast("string"))).alias("feed"))))
    return feeds.read_dictionary(_t(spark, sf_dir, "supplier").select(one.alias("value")), "x").select("value", "confidence", "category_mask", "tlp_mask", "feed")


_DICT = "SELECT 's' || s_suppkey || '.example' AS value, CAST(least(100, s_suppkey % 150) AS INT) AS confidence, 2 AS category_mask, 4 AS tlp_mask, 'd' || (s_suppkey % 3) AS feed FROM supplier"


def misp_attributes(spark, sf_dir):
    k = F.col("c_custkey")
    attribute = F.struct(F.when(k % 3 == 0, "domain").when(k % 3 == 1, "ip-dst|port").otherwise("mutex").alias("type"), F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit(".example"))).otherwise(F.concat(A.ipv4_text(k), F.lit("|80"))).alias("value"), F.lit("Payload delivery").alias("category"), (k % 5 != 0).alias("to_ids"), F.struct(F.lit("i").alias("info"), (k % 4 + 1).cast("string").alias("threat_level_id")).alias("Event"))
    docs = _t(spark, sf_dir, "customer").select(F.to_json(F.struct(F.struct(F.array(attribute).alias("Attribute")).alias("response"))).alias("value"))
    return feeds.read_misp(docs, "m").select("value", "type", "confidence", "category_mask", F.array_join("labels", ",").alias("labels"))


_MISP = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '.example' ELSE concat_ws('.', (c_custkey >> 24) & 255, (c_custkey >> 16) & 255, (c_custkey >> 8) & 255, c_custkey & 255) END AS value, CASE WHEN c_custkey % 3 = 0 THEN 'domain' ELSE 'ip' END AS type,
  CAST([90, 70, 50, 70][c_custkey % 4 + 1] AS INT) AS confidence, 2 AS category_mask, 'misp-event:i' AS labels FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 5 <> 0"""


def stix_patterns(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    pattern = F.concat(F.lit("[domain-name:value = 'S"), k, F.lit(".Example' OR ipv4-addr:value IN ('1.2.3."), (F.col("s_suppkey") % 256).cast("string"), F.lit("') AND url:value LIKE 'no']"))
    o = F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), pattern.alias("pattern"), (F.col("s_suppkey") % 150).alias("confidence"), (F.col("s_suppkey") % 9 == 0).alias("revoked"))
    docs = _t(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.lit("bundle").alias("type"), F.array(o).alias("objects"))).alias("value"))
    return stix.read_stix(spark, docs, "s", now=NOW).select("value", "type", "action", "confidence", "tlp_mask")


_STIX = """WITH o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN '-' ELSE '+' END AS action, CAST(least(100, s_suppkey % 150) AS INT) AS confidence FROM supplier)
SELECT 's' || k || '.example' AS value, 'domain' AS type, action, confidence, 4 AS tlp_mask FROM o UNION ALL SELECT '1.2.3.' || (k % 256), 'ip', action, confidence, 4 FROM o"""


def feed_stats(spark, sf_dir):
    contrib = part_contributions(spark, sf_dir)
    return C.build_statistics(contrib, part_indicators(spark, sf_dir))


_STATS = _PART + """ SELECT (SELECT count(*) FROM contrib) AS contributions, 0::BIGINT AS withdrawals, (SELECT count(DISTINCT lower(feed)) FROM contrib) AS feeds, count(s) AS networks_v4, 0::BIGINT AS networks_v6, count(str) AS strings,
  count(*) FILTER (WHERE type_mask & 1 <> 0) AS cti, count(*) FILTER (WHERE type_mask & 2 <> 0) AS cti_r, count(*) FILTER (WHERE type_mask & 4 <> 0) AS tagged FROM ind"""


def public_feed_set(spark, sf_dir):
    return C.public_feeds(part_contributions(spark, sf_dir))


def window_slices(spark, sf_dir):
    """Slices of the events' time range with at most a quarter of the events each."""
    seconds = written(_t(spark, sf_dir, "events").select(F.unix_timestamp("ts").alias("s")).filter("s is not null").groupBy("s").agg(F.count("*").alias("n")), "seconds")
    lo, hi, n = seconds.agg(F.min("s"), F.max("s"), F.sum("n")).first()
    return spark.createDataFrame(pull.bisect_counts(seconds, lo, hi, n // 4) if n else [], "lo bigint, hi bigint")


_SLICES = """WITH RECURSIVE ev AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), total AS (SELECT min(s) AS lo, max(s) AS hi, CAST(sum(n) AS BIGINT) // 4 AS most FROM ev),
 cuts(a, b) AS (SELECT lo, hi FROM total UNION ALL SELECT CASE k WHEN 0 THEN a ELSE a + (b - a) // 2 + 1 END, CASE k WHEN 0 THEN a + (b - a) // 2 ELSE b END
   FROM (SELECT a, b, sum(n) AS n FROM cuts JOIN ev ON s BETWEEN a AND b GROUP BY a, b) x, total, (VALUES (0), (1)) t(k) WHERE b > a AND x.n > most)
SELECT a AS lo, b AS hi FROM (SELECT a, b, coalesce(sum(n), 0) AS n FROM cuts LEFT JOIN ev ON s BETWEEN a AND b GROUP BY a, b) x, total WHERE NOT (b > a AND x.n > most)"""


_FLATTEN = _PART + """, ev AS (SELECT s AS pos FROM ind WHERE s IS NOT NULL UNION SELECT e + 1 FROM ind WHERE s IS NOT NULL), cut AS (SELECT pos AS cs, lead(pos) OVER (ORDER BY pos) - 1 AS ce FROM ev),
 cov AS (SELECT cs, ce, max(confidence) AS confidence, max(confidence_r) AS confidence_r, bit_or(type_mask) AS type_mask, bit_or(tlp_mask) AS tlp_mask, bit_or(category_mask) AS category_mask, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(feeds, ','))), lambda x: x <> ''))), ',') AS feeds,
   list_sort(list_distinct(list_filter(flatten(list(string_split(tags, ','))), lambda x: x <> ''))) AS tags, list_sort(list_distinct(list_filter(flatten(list(string_split(labels, ','))), lambda x: x <> ''))) AS labels FROM cut JOIN ind ON s <= cs AND e >= ce WHERE ce IS NOT NULL GROUP BY cs, ce)
"""

# Neighbours are one range if their records are equal, tags and labels in order of the networks' width and of first appearance.
_RANGES = _PART + """, ls AS (SELECT s, e, label AS x, min(k) AS k FROM contrib WHERE s IS NOT NULL AND label IS NOT NULL GROUP BY ALL), ts AS (SELECT s, e, tag AS x, min(k) AS k FROM contrib WHERE s IS NOT NULL AND tag IS NOT NULL GROUP BY ALL),
 lists AS (SELECT s, e, coalesce(l, []) AS l, coalesce(t, []) AS t FROM (SELECT s, e, list(x ORDER BY k) AS l FROM ls GROUP BY s, e) a FULL JOIN (SELECT s, e, list(x ORDER BY k) AS t FROM ts GROUP BY s, e) b USING (s, e)),
 ev AS (SELECT s AS pos FROM ind WHERE s IS NOT NULL UNION SELECT e + 1 FROM ind WHERE s IS NOT NULL), cut AS (SELECT pos AS cs, lead(pos) OVER (ORDER BY pos) - 1 AS ce FROM ev),
 cov AS (SELECT cs, ce, max(confidence) AS confidence, max(confidence_r) AS confidence_r, bit_or(type_mask) AS type_mask, bit_or(tlp_mask) AS tlp_mask, bit_or(category_mask) AS category_mask, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(feeds, ','))), lambda x: x <> ''))), ',') AS feeds,
   flatten(list(coalesce(l, []) ORDER BY e - s DESC)) AS l, flatten(list(coalesce(t, []) ORDER BY e - s DESC)) AS t FROM cut JOIN ind ON s <= cs AND e >= ce LEFT JOIN lists USING (s, e) WHERE ce IS NOT NULL GROUP BY cs, ce),
 rec AS (SELECT cs >> 24 AS b, cs, ce, {'c': confidence, 'r': confidence_r, 'm': type_mask, 'p': tlp_mask, 'g': category_mask, 'f': feeds, 'l': list_filter(l, lambda x, i: list_position(l, x) = i), 't': list_filter(t, lambda x, i: list_position(t, x) = i)} AS r FROM cov),
 brk AS (SELECT *, CASE WHEN lag(ce) OVER w = cs - 1 AND lag(r) OVER w = r THEN 0 ELSE 1 END AS fresh FROM rec WINDOW w AS (PARTITION BY b ORDER BY cs)), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY b ORDER BY cs) AS g FROM brk)
SELECT min(cs) AS s, max(ce) AS e, CAST(any_value(r.c) AS INT) AS confidence, CAST(any_value(r.r) AS INT) AS confidence_r, CAST(any_value(r.m) AS INT) AS type_mask, CAST(any_value(r.p) AS INT) AS tlp_mask, CAST(any_value(r.g) AS INT) AS category_mask, any_value(r.f) AS feeds FROM isl GROUP BY b, g"""

# The /32, /48 and /128 networks of suppliers under each other: a cut begins at a start or behind an end, in hexadecimal.
_RANGES6 = _V6[: _V6.index(" o AS (")].rstrip(",\n ") + """, i AS (SELECT s, e, max(confidence) AS confidence FROM r GROUP BY s, e), low AS (SELECT s, e, confidence, length(rtrim(s, '0')) AS z FROM i),
 nx AS (SELECT e, CASE WHEN right(e, 20) = repeat('f', 20) THEN CASE WHEN right(e, 24) = repeat('f', 24) THEN '20010db9' || repeat('0', 24) ELSE '20010db8' || lpad(lower(to_hex(CAST('0x' || substr(e, 9, 4) AS BIGINT) + 1)), 4, '0') || repeat('0', 20) END
   ELSE left(e, 28) || lpad(lower(to_hex(CAST('0x' || right(e, 4) AS BIGINT) + 1)), 4, '0') END AS past FROM i),
 ev AS (SELECT s AS pos FROM i UNION SELECT past FROM nx), cut AS (SELECT pos AS cs, lead(pos) OVER (ORDER BY pos) AS next FROM ev),
 cov AS (SELECT cs, next, max(confidence) AS confidence FROM cut JOIN i ON s <= cs AND e >= cs WHERE next IS NOT NULL GROUP BY cs, next),
 brk AS (SELECT *, CASE WHEN lag(next) OVER w = cs AND lag(confidence) OVER w = confidence THEN 0 ELSE 1 END AS fresh FROM cov WINDOW w AS (ORDER BY cs)), isl AS (SELECT *, sum(fresh) OVER (ORDER BY cs) AS g FROM brk),
 done AS (SELECT min(cs) AS s, max(next) AS n, CAST(any_value(confidence) AS INT) AS confidence FROM isl GROUP BY g)
SELECT s, CASE WHEN right(n, 24) = repeat('0', 24) THEN CASE WHEN n = '20010db9' || repeat('0', 24) THEN '20010db8' || repeat('f', 24) ELSE NULL END
   WHEN right(n, 20) = repeat('0', 20) THEN '20010db8' || lpad(lower(to_hex(CAST('0x' || substr(n, 9, 4) AS BIGINT) - 1)), 4, '0') || repeat('f', 20) ELSE left(n, 28) || lpad(lower(to_hex(CAST('0x' || right(n, 4) AS BIGINT) - 1)), 4, '0') END AS e, confidence, 1 AS type_mask FROM done"""


def covered_addresses(spark, sf_dir):
    """Addresses under each record of the disjoint ranges, which doesn't depend on where neighbours are joined."""
    return flatten_ranges(spark, sf_dir).groupBy("confidence", "confidence_r", "type_mask", "tlp_mask", "category_mask", "feeds").agg(F.sum(F.col("e") - F.col("s") + 1).alias("addresses"))


QUERIES = (
    extract_observables, page_hosts, normalize_ipv4, masks, merge_identity, flatten_ranges, flatten_ranges_v6, covered_addresses, match_strings, match_ipv4_range, match_ipv4_disjoint, match_ipv6_range, match_ipv6_disjoint, overlay_policy, published_policy, skip_private, event_fold, prevalence_build, prevalence_lookup,
    fold_withdraw, fold_snapshot, fold_ttl, fold_generation, dictionary_json, misp_attributes, stix_patterns, feed_stats, public_feed_set, window_slices,
)


def queries() -> dict:
    from . import feed_queries

    return {f.__name__: f for f in QUERIES} | feed_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import feed_queries

    return feed_queries.oracle_sql() | {
        "extract_observables": _EXTRACT, "page_hosts": "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, CASE WHEN contains(url, '@') THEN 'email' WHEN contains(url, '://') THEN 'url' ELSE 'domain' END AS type FROM pages", "normalize_ipv4": _NORMALIZE, "masks": _MASKS,
        "merge_identity": _PART + " SELECT * FROM ind", "covered_addresses": _FLATTEN + " SELECT confidence, confidence_r, type_mask, tlp_mask, category_mask, feeds, CAST(sum(ce - cs + 1) AS BIGINT) AS addresses FROM cov GROUP BY ALL",
        "match_strings": _PART + _OBS + " SELECT DISTINCT str AS value, ind.* EXCLUDE (s, e, str) FROM obs JOIN ind ON host = str", "match_ipv4_range": _PART + _OBS + _MATCH4, "match_ipv4_disjoint": _PART + _OBS + _MATCH4, "match_ipv6_range": _V6, "match_ipv6_disjoint": _V6, "flatten_ranges": _RANGES, "flatten_ranges_v6": _RANGES6, "window_slices": _SLICES, "published_policy": _policy_sql("false"),
        "overlay_policy": _policy_sql("false"), "skip_private": _policy_sql("true"), "event_fold": _policy_sql("false", _EVENT_TAIL), "prevalence_build": _PREV, "prevalence_lookup": _PREV_LOOKUP,
        "fold_withdraw": _fold_sql("true", True, "user_id % 7 = 0"), "fold_snapshot": _fold_sql("f <> 'feed1'", True), "fold_ttl": _fold_sql("f <> 'feed0'", True), "fold_generation": _fold_sql("true", False),
        "dictionary_json": _DICT, "misp_attributes": _MISP, "stix_patterns": _STIX, "feed_stats": _STATS, "public_feed_set": "SELECT min(p_brand) AS feed FROM part WHERE p_partkey % 3 = 0 GROUP BY lower(p_brand)",
    }
