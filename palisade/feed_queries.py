"""Registered queries of feed readers, scalars, folds and reports over texts made from the driver's tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import address as A
from .functions import text as X
from .operators import compile as C
from .operators import fold as FO
from .operators import match as M
from .plans.scratch import written
from .queries import NOW, _contrib, _overlay, _seen, _t, observed, part_indicators, prevalence_build, published
from .sources import feeds, stix

def k() -> Column:
    return F.col("k")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k) of every part."""
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))


def _file(rows: DataFrame, line: Column, head: str = "", end: str = "\n", by: tuple[Column, ...] = ()) -> DataFrame:
    """One document of the lines in order of k, or one for each value of by."""
    lines = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("s"))
    return lines.select(F.concat(F.lit(head), F.array_join(F.transform("s", lambda x: x["line"]), end)).alias("value"))


def _text(c: Column) -> Column:
    return c.cast("string")


def _pick(*words: str) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), (k() % len(words) + 1).cast("int"))


def _sql_pick(*words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][k % {len(words)} + 1]"


def csv_feed(spark, sf_dir):
    """Positional lines: quoted and padded fields, comments, empty fields that collapse, marked and short lines."""
    line = (
        F.when(k() % 11 == 0, F.concat(F.lit("# "), _text(k()))).when(k() % 7 == 0, F.concat(F.lit("-,domain,x"), _text(k()), F.lit(".example")))
        .when(k() % 5 == 0, F.concat(F.lit('domain, "y'), _text(k()), F.lit('.example" ,'), _text(k() % 200), F.lit(",,malware"))).when(k() % 3 == 0, F.concat(F.lit("alone"), _text(k())))
        .otherwise(F.concat(F.lit("+,ip,10.0.0.1,40,scan,feed"), _text(k() % 4), F.lit(",red")))
    )
    return feeds.read_csv(_file(_rows(spark, sf_dir), line, end="\r\n"), "own").select("row_ord", "action", "type", "value", "confidence", "category_mask", "feed", "tlp_mask")


_CSV = """WITH r AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS row_ord FROM part)
SELECT row_ord, CASE WHEN k % 7 = 0 THEN '-' ELSE '+' END AS action, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'domain' ELSE 'ip' END AS type, CASE WHEN k % 7 = 0 THEN 'x' || k || '.example' WHEN k % 5 = 0 THEN 'y' || k || '.example' ELSE '10.0.0.1' END AS value,
  CAST(CASE WHEN k % 7 = 0 THEN 50 WHEN k % 5 = 0 THEN least(100, k % 200) ELSE 40 END AS INT) AS confidence, CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k % 5 = 0 THEN 2 ELSE 256 END AS INT) AS category_mask,
  CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'own' ELSE 'feed' || (k % 4) END AS feed, CAST(CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 1 ELSE 8 END AS INT) AS tlp_mask FROM r WHERE k % 11 <> 0 AND (k % 7 = 0 OR k % 5 = 0 OR k % 3 <> 0)"""

_KINDS = (("10.1.2.3", "ip"), ("2001:db8::7", "ip"), ("d41d8cd98f00b204e9800998ecf8427e", "hash"), ("http://u.example/p", "url"), ("m@x.example", "email"), ("n.example", "domain"))


def csv_delta_feed(spark, sf_dir):
    """A delta with a header; values of every kind, withdrawn by word or by a leading minus."""
    value = _pick(*(v for v, _ in _KINDS))
    line = F.concat(F.when(k() % 4 == 0, "-").otherwise(""), value, F.lit(","), _text(k() % 120), F.lit(","), F.when(k() % 9 == 0, "Remove").otherwise("add"))
    return feeds.read_csv_delta(_file(_rows(spark, sf_dir), line, "#c\nioc,Score,op\n"), "d").select("row_ord", "action", "type", "value", "confidence", "category_mask", "feed", "tlp_mask")


_DELTA = f"""WITH r AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) + 1 AS row_ord FROM part)
SELECT row_ord, CASE WHEN k % 4 = 0 OR k % 9 = 0 THEN '-' ELSE '+' END AS action, {_sql_pick(*(t for _, t in _KINDS))} AS type, {_sql_pick(*(v for v, _ in _KINDS))} AS value, CAST(least(100, k % 120) AS INT) AS confidence, 0 AS category_mask, 'd' AS feed, 4 AS tlp_mask FROM r"""


def list_feed(spark, sf_dir):
    """A plain list with both kinds of comments and blank lines; a network in it is a string."""
    line = F.when(k() % 10 == 0, "; c").when(k() % 10 == 1, "# c").when(k() % 10 == 2, "").when(k() % 10 == 3, F.concat(F.lit("  10.0.0.0/"), _text(k() % 25))).otherwise(_pick(*(v for v, _ in _KINDS)))
    return feeds.read_list(_file(_rows(spark, sf_dir), line), "l").select("value", "type", "confidence", "feed")


_LIST = f"SELECT CASE WHEN k % 10 = 3 THEN '10.0.0.0/' || (k % 25) ELSE {_sql_pick(*(v for v, _ in _KINDS))} END AS value, CASE WHEN k % 10 = 3 THEN 'domain' ELSE {_sql_pick(*(t for _, t in _KINDS))} END AS type, 50 AS confidence, 'l' AS feed FROM (SELECT p_partkey AS k FROM part) WHERE k % 10 > 2"


def tags_feed(spark, sf_dir):
    """value,tag,tag...: repeated tags once, lines without any dropped."""
    line = F.when(k() % 6 == 0, F.concat(F.lit("h"), _text(k()))).otherwise(F.concat(F.lit("h"), _text(k()), F.lit(",a"), _text(k() % 3), F.lit(", b ,a"), _text(k() % 3)))
    return feeds.read_tags(_file(_rows(spark, sf_dir), line), "t").select("value", "type", "confidence", "layer", F.array_join("labels", ",").alias("labels"))


_TAGS = "SELECT 'h' || p_partkey AS value, 'auto' AS type, 100 AS confidence, 'tags' AS layer, 'a' || (p_partkey % 3) || ',b' AS labels FROM part WHERE p_partkey % 6 <> 0"


def tags_json_feed(spark, sf_dir):
    line = F.when(k() % 6 == 0, "no object").when(k() % 6 == 1, F.to_json(F.struct(F.concat(F.lit("h"), _text(k())).alias("index")))).otherwise(F.to_json(F.struct(F.concat(F.lit("h"), _text(k())).alias("index"), F.array(F.lit("q"), F.concat(F.lit("p"), _text(k() % 3)), F.lit("q")).alias("tags"))))
    return feeds.read_tags_json(_file(_rows(spark, sf_dir), line), "t").select("value", F.array_join("labels", ",").alias("labels"))


_TAGS_JSON = "SELECT 'h' || p_partkey AS value, 'q,p' || (p_partkey % 3) AS labels FROM part WHERE p_partkey % 6 > 1"


def lookup_feed(spark, sf_dir):
    """Objects as escaped strings; the first of several feeds counts, without one Unknown."""
    feed = F.when(k() % 3 == 0, F.to_json(F.struct(F.lit("amber").alias("tlp"), _text(k() % 130).alias("max_score"), F.lit("c2").alias("type"), F.array(F.concat(F.lit("f"), _text(k() % 5)), F.lit("z")).alias("feed"))))
    inner = feed.when(k() % 3 == 1, F.to_json(F.struct(F.lit("q").alias("feed"), F.lit("spam").alias("type")))).otherwise(F.to_json(F.struct(F.lit("7").alias("max_score"))))
    one = F.to_json(F.struct(F.concat(F.lit("v"), _text(k())).alias("index"), inner.alias("value")))
    return feeds.read_lookup(_file(_rows(spark, sf_dir), one, '{"table":[', ","), "x").select("value", "confidence", "category_mask", "feed", "tlp_mask")


_LOOKUP = "SELECT 'v' || k AS value, CAST(CASE k % 3 WHEN 0 THEN least(100, k % 130) WHEN 1 THEN 50 ELSE 7 END AS INT) AS confidence, CAST([16, 128, 0][k % 3 + 1] AS INT) AS category_mask, CASE k % 3 WHEN 0 THEN 'f' || (k % 5) WHEN 1 THEN 'q' ELSE 'Unknown' END AS feed, CAST([4, 1, 1][k % 3 + 1] AS INT) AS tlp_mask FROM (SELECT p_partkey AS k FROM part)"


def misp_events(spark, sf_dir):
    """An event for each part, with attributes of its own and of an object: two kinds in one value, a port, a hash behind a file's name."""
    at = lambda t, v, **more: F.to_json(F.struct(F.lit(t).alias("type"), v.alias("value"), F.lit("Network activity").alias("category"), *(F.lit(x).alias(n) for n, x in more.items())))
    host, ip = F.concat(F.lit("g"), _text(k()), F.lit(".example")), A.ipv4_text(k())
    own = F.array(at("domain|ip", F.concat(host, F.lit("|"), ip)), at("ip-src|port", F.concat(ip, F.lit("|443"))), at("mutex", host), at("url", host, to_ids=False))
    inner = F.array(at("filename|md5", F.concat(F.lit("n.exe|"), F.md5(_text(k())))), at("domain", F.lit("")))
    tags = F.concat(F.lit('[{"name":"tlp:'), F.element_at(F.array(*(F.lit(x) for x in ("red", "green", "white"))), (k() % 3 + 1).cast("int")), F.lit('"},{"name":"apt"}]'))
    doc = F.concat(F.lit('{"Event":{"info":"i'), _text(k() % 7), F.lit('","threat_level_id":"'), _text(k() % 4), F.lit('","Tag":'), tags, F.lit(',"Attribute":['), F.array_join(own, ","), F.lit('],"Object":[{"Attribute":['), F.array_join(inner, ","), F.lit("]}]}}"))
    return feeds.read_misp(_rows(spark, sf_dir).select(doc.alias("value")), "m").select("value", "type", "confidence", "category_mask", "tlp_mask", F.array_join("labels", ",").alias("labels"))


_MISP_EVENTS = """WITH r AS (SELECT p_partkey AS k, concat_ws('.', (p_partkey >> 24) & 255, (p_partkey >> 16) & 255, (p_partkey >> 8) & 255, p_partkey & 255) AS ip FROM part),
 v AS (SELECT k, 'g' || k || '.example' AS value, 'domain' AS type FROM r UNION ALL SELECT k, ip, 'ip' FROM r UNION ALL SELECT k, ip, 'ip' FROM r UNION ALL SELECT k, md5(CAST(k AS VARCHAR)), 'md5' FROM r)
SELECT value, type, CAST(CASE k % 4 WHEN 1 THEN 90 WHEN 3 THEN 50 ELSE 70 END AS INT) AS confidence, 1 AS category_mask, CAST([8, 2, 1][k % 3 + 1] AS INT) AS tlp_mask, 'apt,misp-event:i' || (k % 7) AS labels FROM v"""


def stix_observables(spark, sf_dir):
    """Observables of bundles without an indicator."""
    o = _pick("ipv4-addr", "domain-name", "url", "email-addr", "mac-addr", "autonomous-system", "user-account", "file", "mutex")
    number = F.when(k() % 9 == 5, k())
    obj = F.struct(o.alias("type"), F.when(k() % 9 < 5, F.concat(F.lit("V"), _text(k()))).alias("value"), number.alias("number"), F.when(k() % 9 == 6, F.concat(F.lit("u"), _text(k()))).alias("user_id"), F.when(k() % 9 > 6, F.concat(F.lit("N"), _text(k()))).alias("name"), F.when(k() % 9 == 7, F.create_map(F.lit("SHA-256"), F.upper(F.sha2(_text(k()), 256)))).alias("hashes"))
    docs = _rows(spark, sf_dir).select(F.to_json(F.struct(F.lit("bundle").alias("type"), F.array(obj).alias("objects"))).alias("value"))
    return stix.read_stix(spark, docs, "s", now=NOW).select("value", "type", "action", "confidence")


_SCO = """WITH r AS (SELECT p_partkey AS k, p_partkey % 9 AS t FROM part)
SELECT CASE WHEN t IN (1, 3) THEN 'v' || k WHEN t < 5 THEN 'V' || k WHEN t = 5 THEN CAST(k AS VARCHAR) WHEN t = 6 THEN 'u' || k ELSE 'N' || k END AS value, ['ip', 'domain', 'url', 'email', 'mac', 'asn', 'user', 'filename', 'mutex'][t + 1] AS type, '+' AS action, 50 AS confidence FROM r
UNION ALL SELECT sha256(CAST(k AS VARCHAR)), 'sha256', '+', 50 FROM r WHERE t = 7"""


def stix_policy(spark, sf_dir):
    """Markings, labels, indicator types and validity of indicators, ten markings and types deep."""
    refs = F.concat(F.array_repeat(F.lit("marking-definition--613f2e26-407d-48c7-9eca-b8e91df99dc9"), 9), F.array(_pick("marking-definition--f88d31f6-486f-44da-b317-01333bde0b82", "marking-definition--own", "marking-definition--none")))
    types = F.when(k() % 5 == 0, F.array(F.lit("benign"))).when(k() % 5 == 1, F.concat(F.array_repeat(F.lit("unknown"), 9), F.array(F.lit("anonymization")))).otherwise(F.array(F.lit("compromised")))
    o = F.struct(
        F.lit("indicator").alias("type"), F.concat(F.lit("N"), _text(k())).alias("name"), F.concat(F.lit("[url:value = 'U"), _text(k()), F.lit("']")).alias("pattern"), refs.alias("object_marking_refs"), types.alias("indicator_types"),
        F.when(k() % 4 == 0, "2020-01-01T00:00:00Z").alias("valid_until"), F.when(k() % 7 == 0, "2999-01-01T00:00:00.5Z").alias("valid_from"),
    )
    own = F.lit('{"type":"marking-definition","id":"marking-definition--own","definition":{"tlp":"red"}}')
    docs = _rows(spark, sf_dir).select(F.concat(F.lit('{"type":"bundle","objects":['), own, F.lit(","), F.to_json(o), F.lit("]}")).alias("value"))
    return stix.read_stix(spark, docs, "s", now=NOW).select("value", "action", "tlp_mask", "category_mask", F.array_join("labels", ",").alias("labels"))


_STIX_POLICY = """SELECT 'U' || k AS value, CASE WHEN k % 4 = 0 THEN '-' ELSE '+' END AS action, CAST([4, 8, 1][k % 3 + 1] AS INT) AS tlp_mask, CAST(CASE WHEN k % 5 = 1 THEN 1024 ELSE 1 END AS INT) AS category_mask,
  'N' || k || ',' || CASE WHEN k % 5 = 1 THEN 'unknown,anonymization' ELSE 'compromised' END AS labels FROM (SELECT p_partkey AS k FROM part) WHERE k % 5 <> 0 AND k % 7 <> 0"""


def overlay_entries(spark, sf_dir):
    """Actions, modes, defaults and clamped scores of overlay entries, in documents of neighbouring keys that stay below the limits of one."""
    e = F.struct(
        F.concat(F.lit("o"), _text(k())).alias("ioc"), _pick("whitelist", "suppress", "tag", "T", "add", "anything").alias("action"), F.when(k() % 4 == 0, (k() % 300) - 50).alias("confidence"), F.when(k() % 5 == 0, "Malware").when(k() % 5 == 1, "odd").alias("category"),
        F.when(k() % 7 == 0, "score").when(k() % 7 == 1, "full").alias("suppress_mode"), F.when(k() % 2 == 0, F.array(F.lit("x"), F.concat(F.lit("y"), _text(k() % 3)))).alias("tags"),
    )
    files = _file(_rows(spark, sf_dir), F.to_json(e), '{"tenant_id":3,"entries":[', ",", (F.shiftright(k(), 15),)).select(F.concat("value", F.lit("]}")).alias("value"))
    return feeds.read_overlay(files).withColumn("tags", F.array_join("tags", ","))


_OVERLAY_ENTRIES = """WITH r AS (SELECT p_partkey AS k, ['-', '-', 'T', 'T', '+', '+'][p_partkey % 6 + 1] AS action, CASE WHEN p_partkey % 5 = 0 THEN 2 END AS m FROM part)
SELECT 'o' || k AS value, action, action = '-' AND k % 7 <> 0 AS suppress_full, CAST(CASE WHEN k % 4 = 0 THEN greatest(0, least(100, k % 300 - 50)) WHEN action = '-' THEN 100 ELSE 80 END AS INT) AS confidence, CAST(CASE WHEN action = 'T' THEN 4 ELSE 1 END AS INT) AS type_mask,
  CAST(CASE WHEN action = '+' THEN coalesce(m, 16) ELSE coalesce(m, 0) END AS INT) AS category_mask, CASE WHEN k % 2 = 0 THEN 'x,y' || (k % 3) ELSE '' END AS tags FROM r"""


def typed_identity(spark, sf_dir):
    """A slash makes a network only under an address type; what is none stays a string."""
    rows = _contrib(_rows(spark, sf_dir), row_ord=k(), value=F.concat(A.ipv4_text(k() * 65537), F.when(k() % 2 == 0, F.concat(F.lit("/"), _text(k() % 36))).otherwise("")), type=_pick("", "IP", "url", "cidr", "domain", "network", "hash"))
    return C.with_identity(rows).select(F.col("row_ord").alias("k"), "kind", "plen", F.col("ip4_start").alias("s"), F.col("ip4_end").alias("e"), "str")


_TYPED = """WITH r AS (SELECT p_partkey AS k, (p_partkey * 65537) % 4294967296 AS ip, p_partkey % 36 AS p, p_partkey % 2 = 0 AS slash, p_partkey % 7 IN (0, 1, 3, 5) AS net FROM part),
 x AS (SELECT *, concat_ws('.', (ip >> 24) & 255, (ip >> 16) & 255, (ip >> 8) & 255, ip & 255) AS dotted, NOT slash OR (net AND p BETWEEN 8 AND 32) AS four, CASE WHEN slash THEN p ELSE 32 END AS len FROM r)
SELECT k, CAST(CASE WHEN four THEN 4 ELSE 0 END AS INT) AS kind, CAST(CASE WHEN four THEN len END AS INT) AS plen, CASE WHEN four THEN ip - ip % (1 << (32 - len)) END AS s, CASE WHEN four THEN ip - ip % (1 << (32 - len)) + (1 << (32 - len)) - 1 END AS e, CASE WHEN NOT four THEN dotted || '/' || p END AS str FROM x"""


def value_checks(spark, sf_dir):
    """Status and kind of values: null, empty, with a NUL, over 4096 bytes of one or two each, addresses and others."""
    v = F.when(k() % 8 == 1, "").when(k() % 8 == 2, F.repeat(F.lit("a"), 4095 + (k() % 3).cast("int"))).when(k() % 8 == 3, F.repeat(F.lit("é"), 2047 + (k() % 3).cast("int"))).when(k() % 8 == 4, A.ipv4_text(k())).when(k() % 8 == 5, F.concat(F.lit("2001:db8::"), F.hex(k() % 65536))).when(k() % 8 == 6, F.concat(F.lit("w"), _text(k()))).when(k() % 8 == 7, F.concat(F.lit("x"), F.char(F.lit(0)), F.lit("y")))
    rows = _rows(spark, sf_dir).select("k", v.alias("value"))
    return M.classify(rows).select("k", F.col("bad").cast("int").alias("status"), "kind", "private")


_CHECKS = """SELECT k, CAST(CASE WHEN k % 8 IN (0, 1, 7) THEN -1 WHEN k % 8 IN (2, 3) AND k % 3 = 2 THEN -2 ELSE 0 END AS INT) AS status, CAST(CASE k % 8 WHEN 4 THEN 4 WHEN 5 THEN 6 ELSE 0 END AS INT) AS kind, k % 8 = 4 AS private FROM (SELECT p_partkey AS k FROM part)"""


def mask_names(spark, sf_dir):
    """Names of masks for reports."""
    bit = lambda n: F.expr(f"shiftleft(1, cast(k % {n} as int))")
    return _rows(spark, sf_dir).select("k", X.type_names((k() % 8).cast("int")).alias("types"), X.tlp_name(X.tlp_strictest((k() % 16).cast("int"))).alias("tlp"), F.array_join(X.category_names((k() % 2048).cast("int")), "|").alias("categories"), X.category_name(bit(11)).alias("one"))


_NAMES = """SELECT k, ['UNK', 'CTI', 'CTI_R', 'CTI+CTI_R', 'TAGS', 'CTI+TAGS', 'CTI_R+TAGS', 'CTI+CTI_R+TAGS'][k % 8 + 1] AS types, CASE WHEN k & 8 > 0 THEN 'RED' WHEN k & 4 > 0 THEN 'AMBER' WHEN k & 2 > 0 THEN 'GREEN' WHEN k & 1 > 0 THEN 'CLEAR' END AS tlp,
  concat_ws('|', CASE WHEN k & 1 > 0 THEN 'Attack' END, CASE WHEN k & 2 > 0 THEN 'Malware' END, CASE WHEN k & 4 > 0 THEN 'Phishing' END, CASE WHEN k & 8 > 0 THEN 'Botnet' END, CASE WHEN k & 16 > 0 THEN 'C2' END, CASE WHEN k & 32 > 0 THEN 'Exploit' END, CASE WHEN k & 64 > 0 THEN 'Ransomware' END, CASE WHEN k & 128 > 0 THEN 'Spam' END,
    CASE WHEN k & 256 > 0 THEN 'Scanner' END, CASE WHEN k & 512 > 0 THEN 'Tor Exit' END, CASE WHEN k & 1024 > 0 THEN 'Proxy' END) AS categories, ['ATTACK', 'MALWARE', 'PHISHING', 'BOTNET', 'C2', 'EXPLOIT', 'RANSOMWARE', 'SPAM', 'SCANNER', 'TOR_EXIT', 'PROXY'][k % 11 + 1] AS one FROM (SELECT p_partkey AS k FROM part)"""


def coerced_words(spark, sf_dir):
    """Booleans, times and numbers as JSON feeds write them."""
    word = _pick("true", "False", "1", "0", "yes", " TRUE ")
    stamp = F.concat(F.lit("20"), F.lpad(_text(k() % 30 + 10), 2, "0"), F.lit("-03-04T05:06:"), F.lpad(_text(k() % 60), 2, "0"), _pick("Z", ".123Z", ""))
    return _rows(spark, sf_dir).select("k", X.json_bool(word).alias("flag"), X.stix_seconds(F.when(k() % 9 == 0, "soon").otherwise(stamp)).alias("seconds"), X.attribute_seconds(_pick("17", "-5", "7d", "0042", "9" * 19)).alias("stamp"))


_COERCED = """SELECT k, [true, false, true, false, NULL, true][k % 6 + 1] AS flag, CASE WHEN k % 9 <> 0 THEN CAST(epoch(make_timestamp(2010 + k % 30, 3, 4, 5, 6, CAST(k % 60 AS DOUBLE))) AS BIGINT) END AS seconds, CAST([17, 0, 0, 42, 0][k % 5 + 1] AS BIGINT) AS stamp FROM (SELECT p_partkey AS k FROM part)"""


def label_order(spark, sf_dir):
    """Labels and tags of an identity in order of first appearance, and the first spelling of its feeds."""
    rows = _contrib(_rows(spark, sf_dir), row_ord=k(), value=F.concat(F.lit("d"), _text(k() % 37), F.lit(".example")), type=F.lit("domain"), labels=F.array(F.concat(F.lit("l"), _text((k() * 7) % 11)), F.concat(F.lit("m"), _text(k() % 3))), feed=_pick("Feed", "FEED", "other", "feed", "Other"), layer=F.when(k() % 2 == 0, "cti").otherwise("tags"))
    return C.compile_contributions(rows).select("str", F.array_join("labels", ",").alias("labels"), F.array_join("tags", ",").alias("tags"), F.array_join("feeds", ",").alias("feeds"))


_LABELS = """WITH r AS (SELECT p_partkey AS k, 'd' || (p_partkey % 37) || '.example' AS str, 'l' || ((p_partkey * 7) % 11) AS a, 'm' || (p_partkey % 3) AS b, p_partkey % 2 = 0 AS pub, ['Feed', 'FEED', 'other', 'feed', 'Other'][p_partkey % 5 + 1] AS f FROM part),
 i AS (SELECT str, pub, x, min(o) AS o FROM (SELECT str, pub, a AS x, k * 2 AS o FROM r UNION ALL SELECT str, pub, b, k * 2 + 1 FROM r) GROUP BY ALL), first AS (SELECT lower(f) AS low, arg_min(f, k) AS name FROM r WHERE pub GROUP BY 1)
SELECT str, coalesce(string_agg(x, ',' ORDER BY o) FILTER (WHERE pub), '') AS labels, coalesce(string_agg(x, ',' ORDER BY o) FILTER (WHERE NOT pub), '') AS tags, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM r JOIN first ON lower(f) = low WHERE pub AND r.str = i.str), '') AS feeds FROM i GROUP BY str"""


def fold_pages(spark, sf_dir):
    """Three pages: what the second withdraws the third may add again; nothing else comes back."""
    page = lambda n, action: _contrib(_rows(spark, sf_dir).filter(k() % 3 != n), row_ord=k(), value=F.concat(F.lit("u"), _text(k() % 101)), type=F.lit("domain"), confidence=(k() + n) % 101, feed=F.lit("p"), action=action)
    state = FO.State(written(C.compile_contributions(page(3, F.lit("+"))), "indicators"), spark.createDataFrame([], "feed string"), spark.createDataFrame([], S.FEED_STATE))
    pages = [page(0, F.lit("+")), page(1, F.when(k() % 101 % 4 == 0, "-").otherwise("+")), page(2, F.when(k() % 101 % 6 == 0, "-").otherwise("+"))]
    return FO.fold(state, pages, "p", NOW).indicators.select("str", "confidence")


_PAGES = """WITH r AS (SELECT p_partkey AS k, p_partkey % 101 AS u FROM part), a AS (SELECT u, (k + 3) % 101 AS c, -1 AS page, false AS gone FROM r UNION ALL SELECT u, k % 101, 0, false FROM r WHERE k % 3 <> 0
  UNION ALL SELECT u, (k + 1) % 101, 1, u % 4 = 0 FROM r WHERE k % 3 <> 1 UNION ALL SELECT u, (k + 2) % 101, 2, u % 6 = 0 FROM r WHERE k % 3 <> 2),
 g AS (SELECT u, max(page) FILTER (WHERE gone) AS last FROM a GROUP BY u) SELECT 'u' || u AS str, CAST(max(c) AS INT) AS confidence FROM a JOIN g USING (u) WHERE NOT gone AND page > coalesce(last, -2) GROUP BY u"""


def build_onto(spark, sf_dir):
    """New rows over a base: layers honoured, the base's spelling of feeds, withdrawals of either."""
    make = lambda keep, layer, feed, action: _contrib(_rows(spark, sf_dir).filter(keep), row_ord=k(), value=F.concat(F.lit("b"), _text(k() % 53)), type=F.lit("domain"), confidence=k() % 101, feed=F.lit(feed), layer=F.lit(layer), action=action)
    base = written(C.compile_contributions(make(k() % 2 == 0, "cti", "Mine", F.lit("+"))), "indicators")
    more = make(k() % 2 == 1, "cti_r", "x", F.lit("+")).unionByName(make(k() % 10 == 3, "cti", "MINE", F.when(k() % 53 == 7, "-").otherwise("+")))
    return C.compile_contributions(more, base).select("str", "confidence", "confidence_r", "type_mask", F.array_join("feeds", ",").alias("feeds"))


_ONTO = """WITH r AS (SELECT p_partkey AS k, p_partkey % 53 AS b, p_partkey % 101 AS c FROM part), a AS (SELECT b, c, 0 AS r, 1 AS m, 'Mine' AS f FROM r WHERE k % 2 = 0 UNION ALL SELECT b, 0, c, 2, NULL FROM r WHERE k % 2 = 1 UNION ALL SELECT b, c, 0, 1, 'Mine' FROM r WHERE k % 10 = 3 AND b <> 7)
SELECT 'b' || b AS str, CAST(max(c) AS INT) AS confidence, CAST(max(r) AS INT) AS confidence_r, CAST(bit_or(m) AS INT) AS type_mask, coalesce(max(f), '') AS feeds FROM a WHERE b NOT IN (SELECT b FROM r WHERE k % 10 = 3 AND b = 7) GROUP BY b"""


def string_report(spark, sf_dir):
    """The text report of hosts, without an overlay."""
    hosts = observed(spark, sf_dir).filter("event_id % 4 = 0").select("value").distinct()
    return M.report(M.lookup(hosts, "value", part_indicators(spark, sf_dir), spark.createDataFrame([], "feed string")), "value")


def _string_report_sql() -> str:
    from .queries import _OBS, _PART

    names = ", ".join(f"CASE WHEN category_mask & {bit} > 0 THEN '{name}' END" for bit, name in ((1, "Attack"), (2, "Malware"), (4, "Phishing"), (8, "Botnet"), (16, "C2"), (32, "Exploit"), (64, "Ransomware"), (128, "Spam"), (256, "Scanner"), (512, "Tor Exit"), (1024, "Proxy")))
    lists = "ls AS (SELECT str, layer = 2 AS tag, 'l' || (k % 7) AS x, min(k) AS k FROM contrib WHERE str IS NOT NULL AND layer <> 1 GROUP BY ALL), lt AS (SELECT str, string_agg(x, ',' ORDER BY k) FILTER (WHERE tag) AS tags, string_agg(x, ',' ORDER BY k) FILTER (WHERE NOT tag) AS labels FROM ls GROUP BY str)"
    return _PART + _OBS + f""", {lists}, h AS (SELECT DISTINCT host FROM obs WHERE host IS NOT NULL), j AS (SELECT host, i.* EXCLUDE (tags, labels), lt.tags, lt.labels FROM h LEFT JOIN ind i ON host = i.str LEFT JOIN lt ON lt.str = i.str)
SELECT host AS value, concat_ws(' ', CASE WHEN type_mask & 3 > 0 OR tags IS NOT NULL OR labels IS NOT NULL THEN 'HIT' ELSE 'MISS' END,
  'Type=' || coalesce(['CTI', 'CTI_R', 'CTI+CTI_R', 'TAGS', 'CTI+TAGS', 'CTI_R+TAGS', 'CTI+CTI_R+TAGS'][type_mask], 'UNK'), 'Confidence=' || coalesce(confidence, 0),
  'TLP=' || CASE WHEN tlp_mask & 8 > 0 THEN 'RED' WHEN tlp_mask & 4 > 0 THEN 'AMBER' WHEN tlp_mask & 2 > 0 THEN 'GREEN' WHEN tlp_mask & 1 > 0 THEN 'WHITE' ELSE '(none)' END,
  'Category=' || CASE WHEN coalesce(category_mask, 0) & 2047 = 0 THEN '(none)' ELSE concat_ws(',', {names}) END, 'Feeds=(none)', 'Tags=' || tags, 'Labels=' || labels) AS line FROM j"""


def hit_count(spark, sf_dir):
    return M.hits(M.lookup(observed(spark, sf_dir).filter("event_id % 4 = 0"), "value", part_indicators(spark, sf_dir)))


def _hit_sql() -> str:
    from .queries import _OBS, _PART

    return _PART + _OBS + " SELECT count(i.str) FILTER (WHERE type_mask & 3 > 0 OR tags <> '' OR labels <> '') AS hits, count(*) AS values FROM obs LEFT JOIN ind i ON host = i.str WHERE host IS NOT NULL"


def version_info(spark, sf_dir):
    """Counts of a published version."""
    return published(spark, sf_dir).info().drop("published", "version")


def _info_sql() -> str:
    from .queries import _PART

    return _PART + " SELECT count(s) AS networks_v4, 0::BIGINT AS networks_v6, count(str) AS strings, 30::BIGINT AS overlay_entries, 0::BIGINT AS generation, (SELECT count(DISTINCT lower(p_brand)) FROM part WHERE p_partkey % 3 = 0) AS feeds FROM ind"


def overlay_lines(spark, sf_dir):
    """What the overlay alone says of hosts."""
    hosts = observed(spark, sf_dir).filter("event_id % 4 = 0").select("value").distinct()
    return M.overlay_only(hosts, "value", _overlay(spark))


_OVERLAY_LINES = """WITH h AS (SELECT DISTINCT event_id % 120 AS n FROM events WHERE event_id % 4 = 0)
SELECT 'host' || n || '.example' AS value, CASE WHEN n BETWEEN 1 AND 30 THEN 'HIT  ioc=host' || n || '.example  action=' || ['whitelist', 'tag', 'add'][n % 3 + 1] || '  suppress=' || CASE WHEN n % 3 <> 0 THEN 0 WHEN n % 2 = 0 THEN 1 ELSE 2 END || '  confidence=' || (n + 40) ELSE 'MISS  ioc=host' || n || '.example' END AS line FROM h"""


def prevalence_lines(spark, sf_dir):
    asked = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).cast("string").alias("value"))
    return M.prevalence_report(FO.prevalence_of(asked, "value", prevalence_build(spark, sf_dir)), "value")


_PREVALENCE_LINES = """WITH p AS (SELECT json_extract_string(props, '$.k') AS v, count(*) AS n, count(DISTINCT user_id % 8) AS e, count(DISTINCT user_id) AS s FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1)
SELECT CAST(s_suppkey * 3 AS VARCHAR) AS value, 'key=' || (s_suppkey * 3) || '  count=' || coalesce(n, 0) || '  collectors=' || coalesce(e, 0) || '  sources=' || coalesce(s, 0) || CASE WHEN n IS NULL THEN '  (absent = rare)' ELSE '' END AS line FROM supplier LEFT JOIN p ON v = CAST(s_suppkey * 3 AS VARCHAR)"""


def reporting_edges(spark, sf_dir):
    sightings = _t(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("edge"))
    return FO.prevalence_facts(sightings, "edge", NOW)


_EDGES = f"SELECT CAST(count(DISTINCT user_id % 8) AS INT) AS reporting_edges, {NOW}::BIGINT AS epoch FROM events"


def observed_kinds(spark, sf_dir):
    """How many different values of each kind there are to match."""
    return _seen(spark, sf_dir).groupBy("kind", "private").agg(F.count("*").alias("n"))


def _kinds_sql() -> str:
    from .queries import _OBS

    return "WITH z AS (SELECT 1)" + _OBS + " SELECT CAST(CASE WHEN host IS NULL THEN 4 ELSE 0 END AS INT) AS kind, coalesce(ip >> 24 = 10, false) AS private, count(DISTINCT coalesce(host, CAST(ip AS VARCHAR))) AS n FROM obs GROUP BY 1, 2"


_SQL = {
    csv_feed: _CSV, csv_delta_feed: _DELTA, list_feed: _LIST, tags_feed: _TAGS, tags_json_feed: _TAGS_JSON, lookup_feed: _LOOKUP, misp_events: _MISP_EVENTS, stix_observables: _SCO, stix_policy: _STIX_POLICY, overlay_entries: _OVERLAY_ENTRIES, typed_identity: _TYPED, value_checks: _CHECKS, mask_names: _NAMES,
    coerced_words: _COERCED, label_order: _LABELS, fold_pages: _PAGES, build_onto: _ONTO, string_report: _string_report_sql, hit_count: _hit_sql, version_info: _info_sql, overlay_lines: _OVERLAY_LINES, prevalence_lines: _PREVALENCE_LINES, reporting_edges: _EDGES, observed_kinds: _kinds_sql,
}


def queries() -> dict:
    return {f.__name__: f for f in _SQL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql if isinstance(sql, str) else sql() for f, sql in _SQL.items()}
