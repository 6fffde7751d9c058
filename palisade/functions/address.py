"""Addresses and networks: strict IPv4 as expressions, IPv6 as an Arrow UDF over the values that hold a colon."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OCTET = "(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IPV4 = rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"
IPV4_NET = rf"\A({OCTET}(?:\.{OCTET}){{3}})/([0-9]{{1,8}})\z"
# Widest networks, and declared types under which a slash makes a network.
WIDEST_V4, WIDEST_V6 = 8, 32
ADDRESS_TYPES = ("", "ip", "cidr", "ipv4", "ipv6", "ip-range", "net", "network")
# Private IPv4 ranges.
PRIVATE_V4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "0.0.0.0/8")


def is_ipv4(value: Column) -> Column:
    return F.coalesce(value.rlike(IPV4), F.lit(False))


def let(c: Column, body) -> Column:
    """body of c, with c evaluated once however often body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def ipv4_number(value: Column) -> Column:
    """The address as a number; null unless it is a strict dotted quad."""

    def number(parts):
        octet = lambda k: F.try_element_at(parts, F.lit(k)).cast("long")
        return octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)

    return let(value, lambda v: let(F.split(F.when(is_ipv4(v), v), r"\."), number))


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def block(plen: Column) -> Column:
    """Addresses of an IPv4 network of this prefix length."""
    return F.pow(F.lit(2.0), F.lit(32) - plen).cast("long")


def masked(number: Column, plen: Column) -> Column:
    return number - F.pmod(number, block(plen))


def ipv4_network(value: Column) -> Column:
    """(plen, ip4_start, ip4_end) of an address or a network of 8 to 32 bits; host bits go; null otherwise."""

    def parts(v):
        digits = F.when(v.rlike(IPV4_NET), F.regexp_extract(v, IPV4_NET, 2)).otherwise("32")
        return F.struct(digits.cast("int").alias("plen"), ipv4_number(F.when(v.rlike(IPV4_NET), F.regexp_extract(v, IPV4_NET, 1)).otherwise(v)).alias("number"))

    def network(x):
        start = masked(x["number"], x["plen"])
        return F.when(x["number"].isNotNull() & x["plen"].between(WIDEST_V4, 32), F.struct(x["plen"].alias("plen"), start.alias("start"), (start + block(x["plen"]) - 1).alias("end")))

    return let(value, lambda v: let(parts(v), network))


def _parse_v6(text: str, slash: bool):
    host, _, bits = text.partition("/") if slash else (text, "", "")
    if "%" in host or len(host) > 45 or len(text) >= 64 or ("/" in text and not (slash and bits.isascii() and bits.isdigit())):
        return None
    try:
        number = int(ipaddress.IPv6Address(host))
    except ValueError:
        return None
    plen = int(bits) if bits else 128
    if not WIDEST_V6 <= plen <= 128:
        return None
    size = 1 << (128 - plen)
    start = number - number % size
    return plen, f"{start:032x}", f"{start + size - 1:032x}"


@F.pandas_udf(T.StructType([T.StructField("plen", T.IntegerType()), T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]))
def _v6(value: pd.Series, slash: pd.Series) -> pd.DataFrame:
    known: dict = {}
    rows = []
    for v, s in zip(value, slash, strict=True):
        if v is None or ":" not in v:
            rows.append((None, None, None))
            continue
        if (v, s) not in known:
            known[v, s] = _parse_v6(v, bool(s)) or (None, None, None)
        rows.append(known[v, s])
    return pd.DataFrame(rows, columns=["plen", "start", "end"]).astype({"plen": "Int32"})


def ipv6_network(value: Column, slash: Column) -> Column:
    """(plen, start, end) in 32 hexadecimal digits; nulls unless it is an address, or a network where slash holds."""
    return _v6(F.when(value.contains(":"), value), slash)


_HALF, _LEAST, _MOST = 16, "0" * 16, "f" * 16


def v6_masked(start: Column, plen: Column) -> Column:
    """The first address of the network of this prefix length, in 32 hexadecimal digits."""
    whole = F.floor(plen / 4).cast("int")
    bits = plen % 4
    digit = F.conv(F.substring(start, whole + 1, F.lit(1)), 16, 10).cast("int")
    size = F.when(bits == 1, 8).when(bits == 2, 4).otherwise(2)
    part = F.when(bits == 0, "").otherwise(F.lower(F.conv((digit - digit % size).cast("string"), 10, 16)))
    return F.rpad(F.concat(F.substring(start, F.lit(1), whole), part), 32, "0")


def _half_moved(half: Column, by: int) -> Column:
    number = F.conv(half, 16, 10).cast("decimal(20,0)") + F.lit(by)
    return F.lpad(F.lower(F.conv(number.cast("string"), 10, 16)), _HALF, "0")


def v6_after(address: Column) -> Column:
    """The next address; past the last one stands `g`, which sorts after it."""
    high, low = F.substring(address, 1, _HALF), F.substring(address, _HALF + 1, _HALF)
    return F.when(low != _MOST, F.concat(high, _half_moved(low, 1))).when(high != _MOST, F.concat(_half_moved(high, 1), F.lit(_LEAST))).otherwise("g")


def v6_before(address: Column) -> Column:
    """The address before; null before the first one."""
    high, low = F.substring(address, 1, _HALF), F.substring(address, _HALF + 1, _HALF)
    return F.when(address == "g", _MOST * 2).when(low != _LEAST, F.concat(high, _half_moved(low, -1))).when(high != _LEAST, F.concat(_half_moved(high, -1), F.lit(_MOST)))


def slash_allowed(type_: Column) -> Column:
    return F.lower(F.coalesce(type_, F.lit(""))).isin(*ADDRESS_TYPES)


def is_private_v4(number: Column) -> Column:
    nets = [ipaddress.ip_network(n) for n in PRIVATE_V4]
    out = F.lit(False)
    for n in nets:
        out = out | number.between(int(n[0]), int(n[-1]))
    return F.coalesce(out, F.lit(False))


def is_private_v6(hexed: Column) -> Column:
    return F.coalesce(hexed.rlike("^(?:fe[89ab]|f[cd])") | hexed.isin("0" * 32, "0" * 31 + "1"), F.lit(False))
