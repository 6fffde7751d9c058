"""Scalar functions of feeds and reports as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# Words that feeds use.
CATEGORY_WORDS = (
    ("ATTACK", ("malicious-activity", "attack")), ("C2", ("command-and-control", "c2")), ("RANSOMWARE", ("ransomware",)), ("EXPLOIT", ("exploit",)), ("MALWARE", ("malware", "payload")),
    ("PHISHING", ("phish", "social")), ("BOTNET", ("botnet",)), ("SPAM", ("spam",)), ("SCANNER", ("scan", "recon")), ("TOR_EXIT", ("tor", "exit")), ("PROXY", ("proxy", "anonym")),
)
CATEGORY_LABELS = {"ATTACK": "Attack", "MALWARE": "Malware", "PHISHING": "Phishing", "BOTNET": "Botnet", "C2": "C2", "EXPLOIT": "Exploit", "RANSOMWARE": "Ransomware", "SPAM": "Spam", "SCANNER": "Scanner", "TOR_EXIT": "Tor Exit", "PROXY": "Proxy"}
LOWERED_TYPES = ("domain", "email", "md5", "sha1", "sha256", "sha512", "hash")


def tokens(line: Column) -> Column:
    """Comma-separated fields; empty ones collapse, white space and quotes around each go."""
    parts = F.filter(F.split(line, ","), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"[\s\"]+$", ""), r'^"', ""))


def confidence(text: Column) -> Column:
    """A leading whole number kept within 0..100; anything else is 0."""
    digits = F.regexp_extract(text, r"^\s*([+-]?)0*([0-9]+)", 2)
    minus = F.regexp_extract(text, r"^\s*([+-]?)", 1) == "-"
    value = F.when(digits == "", 0).when(minus, 0).when(F.length(digits) > 3, 100).otherwise(F.least(F.lit(100), F.when(F.length(digits) <= 3, digits).otherwise("0").cast("int")))
    return F.coalesce(value, F.lit(0)).cast("int")


def tlp_mask(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("red"), S.RED).when(low.contains("amber"), S.AMBER).when(low.contains("green"), S.GREEN).otherwise(S.CLEAR).cast("int")


def category_mask(text: Column) -> Column:
    """Leading digits are a bit's number (1..16); otherwise every rule whose word occurs sets its bit."""
    low = F.lower(F.coalesce(text, F.lit("")))
    digits = F.regexp_extract(low, r"^0*([0-9]+)", 1)
    number = F.when(F.length(digits).between(1, 2), digits).otherwise("0").cast("int")
    bit = F.when(number.between(1, 16), F.expr("1").cast("int") * F.pow(F.lit(2), number - 1).cast("int")).otherwise(0)
    words = reduce(lambda a, b: a + b, (F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in own)), S.CATEGORIES[name]).otherwise(0) for name, own in CATEGORY_WORDS))
    return F.when(low.rlike("^[0-9]"), bit).otherwise(words).cast("int")


def layer_bit(layer: Column) -> Column:
    return F.when(layer == "cti_r", S.CTI_R).when(layer == "tags", S.TAGS).otherwise(S.CTI).cast("int")


def is_hash(value: Column) -> Column:
    return value.rlike(r"\A(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})\z")


def list_type(value: Column, is_address: Column) -> Column:
    """Type of a line of a plain list."""
    return F.when(is_address, "ip").when(value.contains("@"), "email").when(is_hash(value), "hash").when(value.contains("://"), "url").otherwise("domain")


def delta_type(value: Column, is_network: Column) -> Column:
    """Type of a value of a delta that names none."""
    return F.when(is_network, "ip").when(is_hash(value), "hash").when(value.contains("/"), "url").when(value.contains("@"), "email").otherwise("domain")


def stix_value(type_: Column, value: Column) -> Column:
    return F.when(type_.isin(*LOWERED_TYPES), F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(value)


def json_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def value_status(value: Column) -> Column:
    """-1: null, empty or with a NUL; -2: over 4096 bytes; 0: fine."""
    bad = value.isNull() | (value == "") | value.contains("\0")
    return F.when(bad, S.EINVAL).when(F.octet_length(value) > 4096, S.ETOOLONG).otherwise(0)


def category_names(mask: Column) -> Column:
    return F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) != 0, CATEGORY_LABELS[name]) for name, bit in S.CATEGORIES.items())), lambda x: x.isNotNull())


def category_name(mask: Column) -> Column:
    """The name of a mask of one bit, else null."""
    out = F.when(mask == 0, "UNKNOWN")
    for name, bit in S.CATEGORIES.items():
        out = out.when(mask == bit, name)
    return out


def tlp_name(mask: Column) -> Column:
    return F.when(mask == S.CLEAR, "CLEAR").when(mask == S.GREEN, "GREEN").when(mask == S.AMBER, "AMBER").when(mask == S.RED, "RED")


def tlp_strictest(mask: Column) -> Column:
    return F.when(mask.bitwiseAND(F.lit(S.RED)) != 0, S.RED).when(mask.bitwiseAND(F.lit(S.AMBER)) != 0, S.AMBER).when(mask.bitwiseAND(F.lit(S.GREEN)) != 0, S.GREEN).when(mask.bitwiseAND(F.lit(S.CLEAR)) != 0, S.CLEAR).otherwise(0)


def type_names(mask: Column) -> Column:
    parts = F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) != 0, name) for name, bit in (("CTI", 1), ("CTI_R", 2), ("TAGS", 4)))), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, "UNK").otherwise(F.array_join(parts, "+"))


def stix_seconds(text: Column) -> Column:
    """Unix seconds of YYYY-MM-DDThh:mm:ss, whatever follows; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def attribute_seconds(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9]{1,18}\z"), text).otherwise("0").cast("long")
