"""STIX 2.1 bundles to contributions: patterns by a UDTF, markings, validity and labels as expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X
from . import feeds

# Marking definitions of TLP.
TLP_MARKINGS = {
    "marking-definition--613f2e26-407d-48c7-9eca-b8e91df99dc9": "clear", "marking-definition--34098fce-860f-48ae-8e50-ebd3cc5e41da": "green", "marking-definition--f88d31f6-486f-44da-b317-01333bde0b82": "amber", "marking-definition--5e57c739-391a-4eb3-b6be-7d15ca92d5ed": "red",
    "marking-definition--94868c89-83c2-464b-929b-a1a8aa3c8487": "clear", "marking-definition--bab4a63c-aed9-4cf5-a766-dfca5abac2bb": "green", "marking-definition--55d920b0-5e8b-4f79-9ee9-91f868d9b421": "amber", "marking-definition--939a9414-2ddd-4d32-a0cd-375ea402b003": "amber+strict",
    "marking-definition--e828b379-4e03-4974-9ac4-e53a884c97c1": "red",
}
# Object paths whose literals are indicators, and hash names.
PATHS = {
    "ipv4-addr:value": "ip", "ipv6-addr:value": "ip", "domain-name:value": "domain", "url:value": "url", "email-addr:value": "email", "mac-addr:value": "mac", "mutex:value": "mutex", "windows-registry-key:key": "registry", "autonomous-system:number": "asn",
    "user-account:user_id": "user", "user-account:account_login": "user", "directory:path": "path", "file:name": "filename", "artifact:name": "filename", "x509-certificate:serial_number": "x509",
}
HASHES = {"md5": "md5", "sha-1": "sha1", "sha1": "sha1", "sha-256": "sha256", "sha256": "sha256", "sha-512": "sha512", "sha512": "sha512", "ssdeep": "ssdeep"}
OBSERVABLES = ("ipv4-addr", "ipv6-addr", "domain-name", "url", "email-addr", "mac-addr", "mutex", "windows-registry-key", "autonomous-system", "user-account", "directory", "file", "artifact", "x509-certificate")

_LEXER = re.compile(r"""\s*(?:(?P<text>'(?:\\.|[^'\\])*'?)|(?P<hex>[hH]'[^']*'?)|(?P<op>!=|<=|>=|==?|[<>])|(?P<punct>[\[\](),])|(?P<number>-?[0-9]+(?![\w:-]))|(?P<word>[^\s\[\]()=!<>,]+))""", re.S)
_ESCAPED = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def path_type(path: str) -> str | None:
    """The indicator type of an object path, None where its literals are none."""
    if path.endswith(("_ref", "_refs")):
        return None
    if path in PATHS:
        return PATHS[path]
    m = re.fullmatch(r"(?:file|artifact|x509-certificate):hashes\.(?:(['\"])(.*?)\1.*|(.*))", path, re.S)
    return HASHES.get((m[2] or m[3] or "").lower(), "hash") if m else None


def _literal(kind: str, text: str) -> str:
    if kind == "hex":
        return text[2:].rstrip("'")
    if kind == "number":
        return text
    inner = text[1:-1] if len(text) > 1 and text.endswith("'") else text[1:]

    def one(m):
        c = m[1]
        if len(c) == 5:
            return chr(int(c[1:], 16)) if 32 <= int(c[1:], 16) < 127 else "?"
        return _CONTROL.get(c, c)

    return _ESCAPED.sub(one, inner)


def _lex(pattern: str) -> Iterator[tuple[str, str]]:
    at = 0
    while m := _LEXER.match(pattern, at):
        if m.end() == at:
            return
        at = m.end()
        # a quoted key belongs to the path in front of it: file:hashes.'SHA-256'
        word = m["word"]
        yield m.lastgroup, word if word is not None else m[m.lastgroup]


def pattern_values(pattern: str | None) -> list[tuple[str, str]]:
    """(type, value) of each literal that a pattern compares for equality with an indexable path, on whichever side of AND or OR."""
    if not pattern:
        return []
    items = list(_lex(pattern))
    if any(kind == "word" and text == "FOLLOWEDBY" for kind, text in items):
        return []
    out, path, k = [], None, 0

    def add(kind, text):
        of = path_type(path) if path else None
        value = _literal(kind, text)
        if of and value:
            out.append((of, value))

    while k < len(items):
        kind, text = items[k]
        after = items[k + 1] if k + 1 < len(items) else ("", "")
        if kind == "word" and text == "IN" and path and after == ("punct", "("):
            k += 2
            while k < len(items) and items[k] != ("punct", ")"):
                if items[k][0] in ("text", "hex", "number"):
                    add(*items[k])
                k += 1
            path = None
        elif kind == "word" and ":" in text:
            path = text
        elif kind == "word":
            path = None if text != "IN" else path
        elif kind == "op":
            if text == "=" and path and after[0] in ("text", "hex", "number"):
                add(*after)
                k += 1
            path = None
        k += 1
    return out


@F.udtf(returnType=T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
class StixValues:
    def eval(self, pattern: str):
        yield from pattern_values(pattern)


STRINGS = "array<string>"
OBJECT = (
    "struct<type:string,spec_version:string,id:string,name:string,pattern:string,pattern_type:string,value:string,user_id:string,account_login:string,key:string,path:string,serial_number:string,valid_from:string,valid_until:string,"
    "confidence:double,number:bigint,revoked:boolean,indicator_types:array<string>,labels:array<string>,object_marking_refs:array<string>,hashes:map<string,string>,definition:struct<tlp:string>,extensions:map<string,struct<tlp_2_0:string>>>"
)


def _rank(tlp: Column) -> Column:
    low = F.lower(tlp)
    return F.when(low.contains("red"), 4).when(low.contains("strict") | low.contains("amber"), 3).when(low.contains("green"), 2).otherwise(1)


def objects_of(files: DataFrame) -> DataFrame:
    """(row_ord, o, markings) of a bundle, a list or a single object; markings: id -> TLP of the file's own definitions."""
    text = F.regexp_replace("value", "^\ufeff", "")
    bundle = F.from_json(text, f"type string, spec_version string, objects array<{OBJECT}>")
    listed = F.from_json(text, f"array<{OBJECT}>")
    single = F.from_json(text, OBJECT)
    is_list = F.ltrim(text).startswith("[")
    carried = feeds._carried(files)
    rows = files.select(*carried, bundle.alias("b"), F.when(is_list, listed).alias("l"), F.when(~is_list, single).alias("s"))
    rows = rows.filter("b.spec_version is null or b.type is distinct from 'bundle' or b.spec_version in ('2.0', '2.1')")
    every = F.coalesce("l", F.when(F.col("b.type") == "bundle", F.coalesce("b.objects", F.array().cast(f"array<{OBJECT}>"))), F.array("s"))
    rows = rows.select(*carried, every.alias("os"))
    marks = F.filter("os", lambda o: (o["type"] == "marking-definition") & o["id"].isNotNull())
    named = F.transform(marks, lambda o: F.struct(o["id"].alias("id"), F.coalesce(o["definition"]["tlp"], F.get(F.filter(F.transform(F.map_values(F.coalesce(o["extensions"], F.create_map().cast("map<string,struct<tlp_2_0:string>>"))), lambda x: x["tlp_2_0"]), lambda x: x.isNotNull()), F.lit(0)), F.when(F.lower(o["name"]).startswith("tlp:"), F.substring(o["name"], F.lit(5), F.length(o["name"])))).alias("tlp")))
    rows = rows.withColumn("own", F.filter(named, lambda x: x["tlp"].isNotNull())).withColumn("has_indicator", F.exists("os", lambda o: o["type"] == "indicator"))
    return rows.select(*carried, "own", "has_indicator", F.posexplode("os").alias("n", "o")).select(*(c for c in carried if c == "page"), feeds._numbered(rows, F.col("n")).alias("row_ord"), "own", "has_indicator", "o")


def _tlp(rows: DataFrame) -> DataFrame:
    """Adds tlp: the strictest of the markings and tlp: labels; amber where there is none."""
    known = F.create_map(*(F.lit(x) for pair in TLP_MARKINGS.items() for x in pair))
    refs = F.coalesce("o.object_marking_refs", F.array().cast(STRINGS))
    by_ref = F.transform(refs, lambda r: F.coalesce(F.try_element_at(known, r), F.get(F.transform(F.filter("own", lambda x: x["id"] == r), lambda x: x["tlp"]), F.lit(0))))
    by_label = F.transform(F.filter(F.coalesce("o.labels", F.array().cast(STRINGS)), lambda x: F.lower(x).startswith("tlp:")), lambda x: F.substring(x, F.lit(5), F.length(x)))
    ranked = F.array_sort(F.transform(F.filter(F.concat(by_ref, by_label), lambda x: x.isNotNull()), lambda x: F.struct((-_rank(x)).alias("r"), F.when(F.lower(x).contains("strict"), 0).otherwise(1).alias("s"), F.lower(x).alias("t"))))
    return rows.withColumn("tlp", F.coalesce(F.get(ranked, F.lit(0))["t"], F.lit("amber")))


def _category(types: Column, labels: Column) -> Column:
    def one(t):
        low = F.lower(t)
        return F.when(low == "benign", 0).when(low == "anonymization", S.CATEGORIES["PROXY"]).when(low.isin("compromised", "anomalous-activity", "attribution"), S.CATEGORIES["ATTACK"]).otherwise(X.category_mask(t))

    union = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a.bitwiseOR(x))
    first = union(F.transform(types, one))
    return F.when(first != 0, first).otherwise(union(F.transform(F.filter(labels, lambda x: ~F.lower(x).startswith("tlp:")), X.category_mask)))


def read_stix(spark: SparkSession, files: DataFrame, feed: str, layer: str = "cti", src_ord: int = 0, now: int = 0, withdraw: bool = True) -> DataFrame:
    """Indicators of a bundle; its observables where it has no indicator. Expired and revoked ones withdraw their values, or with withdraw=False give no row.

    now: Unix seconds that validity is judged by.
    """
    rows = _tlp(objects_of(files)).filter("o.spec_version is null or o.spec_version in ('2.0', '2.1')")
    types, labels = F.coalesce("o.indicator_types", F.array().cast(STRINGS)), F.coalesce("o.labels", F.array().cast(STRINGS))
    quiet = F.when(~F.col("o.name").rlike(r'["\\]') & (F.col("o.name") != ""), F.array("o.name")).otherwise(F.array().cast(STRINGS))
    strict = F.when(F.col("tlp").contains("strict"), F.array(F.lit("tlp:amber+strict"))).otherwise(F.array().cast(STRINGS))
    rows = rows.withColumn("made", F.array_distinct(F.concat(quiet, types, strict))).withColumn("category", _category(types, labels))
    score = F.when(F.col("o.confidence").isNull() | (F.col("o.confidence") < 0), 50).otherwise(F.least(F.lit(100.0), F.col("o.confidence")).cast("int"))
    rows = rows.withColumn("score", score)
    begins, ends = X.stix_seconds(F.col("o.valid_from")), X.stix_seconds(F.col("o.valid_until"))
    over = F.coalesce(F.col("o.revoked"), F.lit(False)) | F.coalesce(ends < now, F.lit(False))
    benign = (F.size(types) > 0) & F.forall(types, lambda t: F.lower(t) == "benign")
    live = rows.filter((F.col("o.type") == "indicator") & F.coalesce(F.col("o.pattern_type") == "stix", F.lit(True)) & ~benign & ~F.coalesce(begins > now, F.lit(False)))
    live = live.withColumn("action", F.when(over, "-").otherwise("+"))
    live = live if withdraw else live.filter("action = '+'")
    pairs = live.withColumn("pattern", F.col("o.pattern")).lateralJoin(StixValues(F.col("pattern").outer()).toDF("t", "v"))
    sco = rows.filter(~F.col("has_indicator") & F.col("o.type").isin(*OBSERVABLES)).withColumn("action", F.lit("+"))
    kind = F.col("o.type")
    one = lambda t, v: F.struct(F.lit(t).alias("t"), v.cast("string").alias("v"))
    hashed = F.transform(F.map_entries(F.coalesce("o.hashes", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.replace(F.lower(e["key"]), F.lit("-"), F.lit("")).alias("t"), e["value"].alias("v")))
    hashed = F.filter(hashed, lambda x: x["t"].isin("md5", "sha1", "sha256", "sha512"))
    plain = {"ipv4-addr": "ip", "ipv6-addr": "ip", "domain-name": "domain", "url": "url", "email-addr": "email", "mac-addr": "mac"}
    listed = F.when(kind == "mutex", F.array(one("mutex", F.coalesce("o.value", "o.name"))))
    for name, t in plain.items():
        listed = listed.when(kind == name, F.array(one(t, F.col("o.value"))))
    listed = listed.when(kind == "windows-registry-key", F.array(one("registry", F.col("o.key")))).when(kind == "directory", F.array(one("path", F.coalesce("o.path", "o.name"))))
    listed = listed.when(kind == "user-account", F.array(one("user", F.col("o.user_id")), one("user", F.col("o.account_login")))).when(kind == "autonomous-system", F.array(one("asn", F.col("o.number"))))
    listed = listed.when(kind == "x509-certificate", F.concat(hashed, F.array(F.when(F.col("o.serial_number").isNotNull(), one("x509", F.col("o.serial_number"))).otherwise(one("filename", F.col("o.name"))))))
    listed = listed.otherwise(F.concat(hashed, F.array(one("filename", F.col("o.name")))))
    seen = sco.withColumn("p", F.explode(listed)).select("*", F.col("p.t").alias("t"), F.col("p.v").alias("v"))
    columns = [*(c for c in rows.columns if c == "page"), "row_ord", "action", "t", "v", "score", "category", "tlp", "made"]
    both = pairs.select(*columns).unionByName(seen.select(*columns)).filter("v is not null")
    return feeds.contributions(both, src_ord, layer, action=F.col("action"), value=X.stix_value(F.col("t"), F.col("v")), type=F.col("t"), confidence=F.col("score"), category_mask=F.col("category"), feed=F.lit(feed), tlp_mask=X.tlp_mask(F.col("tlp")), labels=F.col("made"))
