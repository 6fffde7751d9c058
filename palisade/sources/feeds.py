"""Feed files to contributions. Every reader keeps the rows' order: files of lines are read in splits, their lines numbered by where they
lie; a file of one JSON document is read whole, and one of a document a line (.jsonl) in splits."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import address as A
from ..functions import text as X

# MISP types and categories.
MISP_TYPES = {"ip-src": "ip", "ip-dst": "ip", "ip-src|port": "ip", "ip-dst|port": "ip", "domain": "domain", "hostname": "domain", "domain|ip": "domain|ip", "md5": "md5", "sha1": "sha1", "sha256": "sha256", "filename|md5": "md5", "filename|sha1": "sha1", "filename|sha256": "sha256", "url": "url", "email-src": "email", "email-dst": "email"}
MISP_CATEGORIES = {"network activity": 1, "payload delivery": 2, "payload installation": 2, "persistence mechanism": 2, "artifacts dropped": 2, "antivirus detection": 2, "targeting data": 4, "attribution": 1, "financial fraud": 4}
ATTRIBUTE = "struct<type:string,value:string,category:string,to_ids:string,deleted:string,timestamp:string,Tag:array<struct<name:string>>,Event:struct<info:string,threat_level_id:string,Tag:array<struct<name:string>>>>"
EVENT = f"struct<info:string,threat_level_id:string,Tag:array<struct<name:string>>,Attribute:array<{ATTRIBUTE}>,Object:array<struct<Attribute:array<{ATTRIBUTE}>>>>"
NO_LABELS = "array<string>"


def stem(path: str, stix: bool = False) -> str:
    """The feed's name: the file's without its last extension, and without one more `.stix` for STIX."""
    name = os.path.basename(path.rstrip("/"))
    name = name.rpartition(".")[0] or name
    return name.removesuffix(".stix") if stix else name


def format_of(path: str) -> str:
    """The reader of a file in a build, by its name."""
    name = os.path.basename(path).lower().replace(".jsonl", ".json")
    if ".tags.json" in name:
        return "tags_json"
    if ".stix.json" in name or name.endswith(".stix"):
        return "stix"
    if ".misp.json" in name or name.endswith(".misp"):
        return "misp"
    for ending, kind in ((".tags", "tags"), (".csv", "csv"), (".lookup", "lookup"), (".txt", "list"), (".ioc", "list"), (".json", "dictionary")):
        if name.endswith(ending):
            return kind
    raise S.EngineError(S.EFORMAT, f"no reader for {path}")


def fold_format_of(path: str) -> str:
    """The reader of a segment in a fold."""
    name = os.path.basename(path).lower().replace(".jsonl", ".json")
    if ".stix.json" in name or name.endswith(".stix"):
        return "stix"
    if ".misp.json" in name or name.endswith(".json"):
        return "misp"
    if name.endswith(".csv"):
        return "csv_delta"
    raise S.EngineError(S.EFORMAT, f"no segment reader for {path}")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(value): the file as one document; of a .jsonl file (row, value): each line."""
    if path.lower().endswith(".jsonl"):
        return lines(spark, path).filter("trim(line) <> ''").select(F.col("row_ord").alias("row"), F.col("line").alias("value"))
    return spark.read.text(path, wholetext=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_ord, line) of a file, read in splits: the number is the place of the split and of the line within its task."""
    rows = spark.read.text(path)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 16), 33).bitwiseOR(at).alias("row_ord"), F.col("value").alias("line"))


def lines_of(files: DataFrame) -> DataFrame:
    """(row_ord, line) of a file read whole, or of lines()."""
    if "line" in files.columns:
        return files
    return files.select(F.posexplode(F.split("value", "\r?\n")).alias("row_ord", "line")).select(F.col("row_ord").cast("long").alias("row_ord"), "line")


def _carried(files: DataFrame) -> list[str]:
    """What documents may say about themselves: their place, and the page of a pull that they came on."""
    return [c for c in ("page", "row") if c in files.columns]


def _numbered(files: DataFrame, n: Column) -> Column:
    """The order of a document's n-th entry."""
    return n.cast("long") + (F.col("row") if "row" in files.columns else F.lit(0).cast("long"))


def contributions(rows: DataFrame, src_ord: int, layer: str, **columns: Column) -> DataFrame:
    defaults = {"src_ord": F.lit(src_ord).cast("long"), "row_ord": F.col("row_ord"), "action": F.lit("+"), "confidence": F.lit(50), "category_mask": F.lit(0), "tlp_mask": F.lit(S.CLEAR), "labels": F.array().cast(NO_LABELS), "layer": F.lit(layer)}
    made = defaults | columns
    kinds = dict(x.split() for x in S.CONTRIB.split(", "))
    page = [F.col("page").cast("long").alias("page")] if "page" in rows.columns else []
    return rows.select(*(made[c].cast(t).alias(c) for c, t in kinds.items()), *page).filter("value is not null and value <> ''")


def _or(c: Column, default) -> Column:
    return F.coalesce(F.when(c != "", c), default if isinstance(default, Column) else F.lit(default))


def read_csv(files: DataFrame, feed: str, layer: str = "cti", src_ord: int = 0) -> DataFrame:
    """Positional type,value[,confidence[,category[,feed[,tlp]]]] with an optional leading + or -; there is no header."""
    rows = lines_of(files).filter(~F.col("line").rlike(r"^\s*(?:#|$)")).withColumn("t", F.slice(X.tokens(F.col("line")), 1, 7))
    marked = F.get("t", F.lit(0)).isin("+", "-")
    rows = rows.withColumn("action", F.when(marked, F.get("t", F.lit(0))).otherwise("+")).withColumn("t", F.when(marked, F.slice("t", 2, 7)).otherwise(F.col("t"))).filter("size(t) >= 2")
    at = lambda k: F.get("t", F.lit(k))
    return contributions(
        rows, src_ord, layer, action=F.col("action"), type=at(0), value=at(1), confidence=F.when(at(2).isNull(), 50).otherwise(X.confidence(at(2))), category_mask=F.when(at(3).isNull(), 0).otherwise(X.category_mask(at(3))), feed=_or(at(4), feed),
        tlp_mask=X.tlp_mask(at(5)),
    )


# Header names of a delta.
DELTA_COLUMNS = {"indicator": "value", "value": "value", "ioc": "value", "type": "type", "confidence": "confidence", "conf": "confidence", "score": "confidence", "category": "category", "cat": "category", "tlp": "tlp", "feed": "feed", "source": "feed", "action": "action", "op": "action"}


def read_csv_delta(files: DataFrame, feed: str, layer: str = "cti", src_ord: int = 0) -> DataFrame:
    """A delta with a header that names its columns, or the value in the first column behind an optional + or -."""
    rows = lines_of(files).filter(~F.col("line").rlike(r"^\s*(?:#|$)")).withColumn("t", F.slice(X.tokens(F.col("line")), 1, 16))
    first = rows.orderBy("row_ord").select("row_ord", "t").first()
    names = [DELTA_COLUMNS.get(x.lower()) for x in first["t"]] if first else []
    at = lambda k: F.get("t", F.lit(k))
    if "value" in names:
        rows = rows.filter(F.col("row_ord") > first["row_ord"])
        column = lambda name: at(names.index(name)) if name in names else F.lit(None).cast("string")
        action, value = F.lower(column("action")), column("value")
        leading = value.rlike("^-")
        action = F.when(leading | action.isin("-", "delete", "del", "remove"), "-").otherwise("+")
        value = F.regexp_replace(value, r"^[+-]\s*", "")
    else:
        column = lambda name: F.lit(None).cast("string")
        marked = at(0).isin("+", "-")
        action, value = F.when((marked & (at(0) == "-")) | (~marked & at(0).startswith("-")), "-").otherwise("+"), F.when(marked, at(1)).otherwise(F.regexp_replace(at(0), r"^[+-]", ""))
    network = A.ipv4_network(value).isNotNull() | A.ipv6_network(value, F.lit(True))["plen"].isNotNull()
    return contributions(
        rows, src_ord, layer, action=action, value=value, type=_or(column("type"), X.delta_type(value, network)), confidence=F.when(_or(column("confidence"), "") == "", 50).otherwise(X.confidence(column("confidence"))),
        category_mask=F.when(_or(column("category"), "") == "", 0).otherwise(X.category_mask(column("category"))), feed=_or(column("feed"), feed), tlp_mask=F.when(_or(column("tlp"), "") == "", S.AMBER).otherwise(X.tlp_mask(column("tlp"))),
    )


def read_list(files: DataFrame, feed: str, layer: str = "cti", src_ord: int = 0) -> DataFrame:
    """One value a line, # and ; comments; a network in a list is a string."""
    rows = lines_of(files).withColumn("v", F.regexp_replace(F.regexp_replace("line", r"^\s+", ""), r"[\s\"]+$", "")).filter("v <> '' and not v like '#%' and not v like ';%'")
    address = A.is_ipv4(F.col("v")) | A.ipv6_network(F.col("v"), F.lit(False))["plen"].isNotNull()
    return contributions(rows, src_ord, layer, value=F.col("v"), type=X.list_type(F.col("v"), address), feed=F.lit(feed))


def read_tags(files: DataFrame, feed: str, layer: str = "tags", src_ord: int = 0) -> DataFrame:
    """value,tag,tag...; a row without a tag is dropped."""
    rows = lines_of(files).filter(~F.col("line").rlike(r"^\s*(?:#|$)")).withColumn("t", X.tokens(F.col("line"))).filter("size(t) >= 2")
    return contributions(rows, src_ord, layer, value=F.get("t", F.lit(0)), type=F.lit("auto"), confidence=F.lit(100), labels=F.array_distinct(F.slice("t", F.lit(2), F.size("t"))), feed=F.lit(feed))


def read_tags_json(files: DataFrame, feed: str, layer: str = "tags", src_ord: int = 0) -> DataFrame:
    rows = lines_of(files).filter(F.col("line").rlike(r"^\s*\{")).withColumn("j", F.from_json("line", "index string, tags array<string>")).filter("j.index is not null and size(j.tags) > 0")
    return contributions(rows, src_ord, layer, value=F.col("j.index"), type=F.lit("auto"), confidence=F.lit(100), labels=F.array_distinct("j.tags"), feed=F.lit(feed))


def read_dictionary(files: DataFrame, feed: str, layer: str = "cti", src_ord: int = 0) -> DataFrame:
    """One object: value -> {tlp, type, max_score, feed[], feed_objects[].lbl[]}; each feed is a contribution."""
    kind = "map<string, struct<tlp:string,type:string,max_score:string,feed:array<string>,feed_objects:array<struct<feed_name:string,lbl:array<string>>>>>"
    rows = files.select(F.posexplode(F.map_entries(F.from_json("value", kind))).alias("n", "e")).select(F.col("n").cast("long").alias("row_ord"), F.col("e.key").alias("v"), F.col("e.value").alias("r"))
    labels = F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce("r.feed_objects", F.array().cast("array<struct<feed_name:string,lbl:array<string>>>")), lambda x: F.coalesce(x["lbl"], F.array().cast(NO_LABELS)))), lambda x: x.isNotNull() & (x != "")))
    feeds = F.filter(F.coalesce("r.feed", F.array().cast(NO_LABELS)), lambda x: x.isNotNull() & (x != ""))
    rows = rows.withColumn("labels", labels).withColumn("f", F.explode(F.when(F.size(feeds) > 0, feeds).otherwise(F.array(F.lit(feed)))))
    return contributions(rows, src_ord, layer, value=F.col("v"), type=F.col("r.type"), confidence=X.confidence(F.col("r.max_score")), category_mask=X.category_mask(F.col("r.type")), feed=F.col("f"), tlp_mask=X.tlp_mask(F.col("r.tlp")), labels=F.col("labels"))


def read_lookup(files: DataFrame, feed: str, layer: str = "cti", src_ord: int = 0) -> DataFrame:
    """Repeats of "index": v ... "value": an object as an escaped string; of several feeds the first counts."""
    pair = r'"index"\s*:\s*"((?:\\.|[^"\\])*)"[^{}]*?"value"\s*:\s*"((?:\\.|[^"\\])*)"'
    found = F.transform(F.regexp_extract_all("value", F.lit("(?s)" + pair), 0), lambda x: F.concat(F.lit("{"), x, F.lit("}")))
    rows = files.select(F.posexplode(found).alias("n", "o")).select(F.col("n").cast("long").alias("row_ord"), F.from_json("o", "index string, value string").alias("o"))
    rows = rows.withColumn("r", F.from_json("o.value", "tlp string, max_score string, type string, feed string"))
    first = F.get(F.from_json("r.feed", "array<string>"), F.lit(0))
    name = F.when(F.col("r.feed").startswith("["), first).otherwise(F.col("r.feed"))
    return contributions(
        rows, src_ord, layer, value=F.col("o.index"), type=F.col("r.type"), confidence=F.when(F.col("r.max_score").isNull(), 50).otherwise(X.confidence(F.col("r.max_score"))), category_mask=X.category_mask(F.coalesce("r.type", F.lit("unknown"))), feed=_or(name, "Unknown"), tlp_mask=X.tlp_mask(F.col("r.tlp"))
    )


def misp_attributes(files: DataFrame) -> DataFrame:
    """(row_ord, a, info, level, etags) of every attribute of an event export or an attribute search, with the page of files that have one."""
    kind = f"Event {EVENT}, Attribute array<{ATTRIBUTE}>, response string"
    carried = _carried(files)
    doc = files.select(*carried, F.from_json("value", kind).alias("d"))
    doc = doc.withColumn("search", F.from_json("d.response", f"struct<Attribute:array<{ATTRIBUTE}>>")).withColumn("events", F.from_json("d.response", f"array<struct<Event:{EVENT}>>"))
    none = F.array().cast(f"array<{ATTRIBUTE}>")
    no_tags = F.array().cast("array<struct<name:string>>")

    def of_event(e: Column) -> Column:
        inner = F.flatten(F.transform(F.coalesce(e["Object"], F.array().cast(f"array<struct<Attribute:array<{ATTRIBUTE}>>>")), lambda o: F.coalesce(o["Attribute"], none)))
        return F.transform(F.concat(F.coalesce(e["Attribute"], none), inner), lambda a: F.struct(a.alias("a"), e["info"].alias("info"), e["threat_level_id"].alias("level"), F.coalesce(e["Tag"], no_tags).alias("etags")))

    searched = F.transform(F.coalesce("search.Attribute", "d.Attribute", none), lambda a: F.struct(a.alias("a"), a["Event"]["info"].alias("info"), a["Event"]["threat_level_id"].alias("level"), F.coalesce(a["Event"]["Tag"], no_tags).alias("etags")))
    single = F.filter(F.array(F.struct(F.col("d.Event").alias("Event"))), lambda x: x["Event"].isNotNull())
    listed = F.when(F.size(single) > 0, single).otherwise(F.coalesce("events", F.array().cast(f"array<struct<Event:{EVENT}>>")))
    every = F.concat(searched, F.flatten(F.transform(F.filter(listed, lambda x: x["Event"].isNotNull()), lambda x: of_event(x["Event"]))))
    return doc.select(*carried, F.posexplode(every).alias("n", "x")).select(*(c for c in carried if c == "page"), _numbered(files, F.col("n")).alias("row_ord"), "x.*")


def read_misp(files: DataFrame, feed: str, layer: str = "cti", src_ord: int = 0, delta: bool = False) -> DataFrame:
    """MISP attributes; delta: what is deleted or no longer for detection withdraws its value, else it is left out."""
    rows = misp_attributes(files)
    types = F.create_map(*(F.lit(x) for pair in MISP_TYPES.items() for x in pair))
    categories = F.create_map(*(F.lit(x) for pair in MISP_CATEGORIES.items() for x in pair))
    rows = rows.withColumn("kind", F.try_element_at(types, F.col("a.type"))).filter("kind is not null and a.value is not null and a.value <> ''")
    off = F.coalesce(X.json_bool(F.col("a.to_ids")) == F.lit(False), F.lit(False))
    gone = off | F.coalesce(X.json_bool(F.col("a.deleted")), F.lit(False))
    rows = rows.withColumn("action", F.when(gone, "-").otherwise("+")) if delta else rows.filter(~off).withColumn("action", F.lit("+"))
    left, right = F.substring_index("a.value", "|", 1), F.element_at(F.split("a.value", r"\|", 2), -1)
    one = lambda t, v: F.struct(t.alias("t"), v.alias("v"))
    both = F.col("a.value").contains("|")
    parts = F.when((F.col("kind") == "domain|ip") & both, F.array(one(F.lit("domain"), left), one(F.lit("ip"), right))).when(F.col("kind") == "domain|ip", F.array(one(F.lit("domain"), F.col("a.value"))))
    parts = parts.when(F.col("a.type").startswith("filename|") & both, F.array(one(F.col("kind"), right))).when(F.col("a.type").endswith("|port"), F.array(one(F.col("kind"), left))).otherwise(F.array(one(F.col("kind"), F.col("a.value"))))
    names = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string>>")), lambda t: t["name"]), lambda n: n.isNotNull() & (n != ""))
    own, event = names(F.col("a.Tag")), names(F.col("etags"))
    last_tlp = lambda tags: F.try_element_at(F.filter(tags, lambda n: F.lower(n).startswith("tlp:")), F.lit(-1))
    info = F.when(F.col("info") != "", F.array(F.concat(F.lit("misp-event:"), F.col("info")))).otherwise(F.array().cast(NO_LABELS))
    no_tlp = lambda tags: F.filter(tags, lambda n: ~F.lower(n).startswith("tlp:"))
    labels = F.array_distinct(F.concat(no_tlp(event), info, no_tlp(own)))
    level = F.col("level")
    rows = rows.withColumn("labels", labels).withColumn("tlp", F.coalesce(last_tlp(own), last_tlp(event))).withColumn("p", F.explode(parts))
    return contributions(
        rows, src_ord, layer, action=F.col("action"), value=F.col("p.v"), type=F.col("p.t"), confidence=F.when(level == "1", 90).when(level == "3", 50).otherwise(70), category_mask=F.coalesce(F.try_element_at(categories, F.lower(F.col("a.category"))), F.lit(0)),
        feed=F.lit(feed), tlp_mask=X.tlp_mask(F.col("tlp")), labels=F.col("labels"),
    )


# Overlay words.
OVERLAY_ACTIONS = {"WHITELIST": "-", "whitelist": "-", "-": "-", "suppress": "-", "TAG": "T", "tag": "T", "T": "T"}


def read_overlay(files: DataFrame) -> DataFrame:
    """Overlay rows. A missing or repeated value, one over 4096 bytes, a tag that is no string, or a document without entries, with more
    than 65536 or over 8 MiB refuse the whole file; of several documents these limits hold for each, and no two may have the same value."""
    entry = "struct<ioc:string,ioc_value:string,action:string,confidence:int,category:string,suppress_mode:string,tags:string>"
    docs = files.select(F.octet_length("value").alias("size"), F.from_json("value", f"tenant_id int, entries array<{entry}>")["entries"].alias("es"))
    rows = docs.select("size", F.size("es").alias("entries"), F.explode_outer("es").alias("e")).withColumn("value", F.coalesce("e.ioc", "e.ioc_value"))
    strings = F.coalesce(F.schema_of_variant(F.try_parse_json("e.tags")).isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"), F.col("e.tags").isNull())
    seen = rows.agg(F.count("*").alias("n"), F.max("entries").alias("most"), F.countDistinct("value").alias("d"), F.count_if(F.col("value").isNull() | (F.col("value") == "")).alias("missing"), F.max(F.octet_length("value")).alias("longest"), F.count_if(~strings).alias("tags"), F.max("size").alias("size")).first()
    if not seen["n"] or seen["missing"] or seen["most"] > 65536 or seen["d"] != seen["n"] or seen["longest"] > 4096 or seen["tags"] or seen["size"] > 8 << 20:
        raise S.EngineError(S.EFORMAT, f"overlay refused: {seen['n']} entries, up to {seen['most']} in a document, {seen['d']} values, {seen['missing']} without one, longest {seen['longest']}, {seen['tags']} with tags that are no strings, up to {seen['size']} bytes")
    actions = F.create_map(*(F.lit(x) for pair in OVERLAY_ACTIONS.items() for x in pair))
    action = F.coalesce(F.try_element_at(actions, F.coalesce("e.action", F.lit("add"))), F.lit("+"))
    category = F.lower("e.category")
    mask = F.lit(None).cast("int")
    for name, bit in S.CATEGORIES.items():
        mask = F.when(category == name.lower(), bit).otherwise(mask)
    default = F.when(action == "-", 100).otherwise(80)
    full = F.when(action != "-", False).when(F.col("e.suppress_mode").isNull() | (F.col("e.suppress_mode") == "full"), True).otherwise(False)
    return rows.select(
        "value", action.alias("action"), full.alias("suppress_full"), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("e.confidence", default))).cast("int").alias("confidence"), F.when(action == "T", S.TAGS).otherwise(S.CTI).cast("int").alias("type_mask"),
        F.when(action == "+", F.coalesce(mask, F.lit(S.CATEGORIES["C2"]))).otherwise(F.coalesce(mask, F.lit(0))).cast("int").alias("category_mask"), F.coalesce(F.from_json("e.tags", NO_LABELS), F.array().cast(NO_LABELS)).alias("tags"),
    )
