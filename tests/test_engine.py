"""Builds, folds and lookups on small fixtures, with the answers that the engine must give."""

import contextlib
import hashlib
import http.server
import io
import ipaddress
import json
import random
import shutil
import tarfile
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade import cli
from palisade import schema as S
from palisade.functions import address as A
from palisade.functions import hashes
from palisade.functions import text as X
from palisade.operators import compile as C
from palisade.operators import fold as FO
from palisade.operators import match as M
from palisade.plans import build as B
from palisade.plans.store import Store, validate_ranges
from palisade.sources import feeds, prevalence, pull, stix
from palisade.streaming import stream

NOW = 1_700_000_000
#: Feeds of our own making: two public rows over one network and address, a restricted row on one address of it and one on another.
OPEN = """# value lines of the open feed
ip,192.0.2.64/26,35,spam,Harbour,clear
ip,192.0.2.77,62,phish,harbour,amber
domain,ship.test,44,ransomware,harbour,red
ip,2001:db8:77::/48,21,tor,harbour
ip,2001:db8:77::beef,88,proxy,harbour,green
ip,172.16.5.5,12,exploit,harbour
domain,quiet.test,91,attack,harbour,red
domain,muted.test,57,botnet,harbour
"""
CLOSED = "ip,192.0.2.77,99,c2,vault,red\nip,192.0.2.80,71,malware,vault,red\n"
EVENTS = {"response": {"Attribute": [
    {"type": "ip-src", "category": "Payload delivery", "value": "192.0.2.77", "Tag": [{"name": "tlp:white"}, {"name": "apt"}], "Event": {"info": "tide", "threat_level_id": "1"}},
    {"type": "ip-src", "category": "Attribution", "value": "172.16.5.5", "Event": {"info": "reef", "threat_level_id": "3"}},
]}}
SITE = {"entries": [{"ioc": "quiet.test", "action": "suppress"}, {"ioc": "muted.test", "action": "-", "suppress_mode": "score"}, {"ioc": "raised.test", "action": "add", "confidence": 33, "category": "spam"}, {"ioc": "named.test", "action": "T", "tags": ["owner:ops", "lab"]}]}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("db")
    files = {"open.csv": OPEN, "closed.csv": CLOSED, "tide.misp.json": json.dumps(EVENTS), "rooms.tags": "172.16.5.5,printer,floor2\n192.0.2.77,gate\n", "more.tags": "192.0.2.77,edge,gate\n", "site.json": json.dumps(SITE)}
    for name, body in files.items():
        (d / name).write_text(body)
    own = [("open.csv", "csv", "cti"), ("closed.csv", "csv", "cti_r"), ("tide.misp.json", "misp", "cti"), ("rooms.tags", "tags", "tags"), ("more.tags", "tags", "tags"), ("site.json", "overlay", None)]
    (d / "conf.json").write_text(json.dumps({"output": str(d / "store"), "feeds": [{"type": t, "path": str(d / n)} | ({"layer": layer} if layer else {}) for n, t, layer in own]}))
    B.build(spark, B.load_config(str(d / "conf.json")), str(d / "store"), NOW)
    return str(d / "store")


def ask(spark, root, *values, skip=False, by_ranges=True):
    at, rows = Store(spark, root).open(check=True), spark.createDataFrame([(v,) for v in values], "v string")
    found = at.lookup(rows, "v", skip) if by_ranges else M.lookup(rows, "v", at.indicators, at.public_feeds, at.overlay, skip)
    return {r["v"]: r for r in found.collect()}


def test_layers_tell_what_they_may(spark, root):
    """Public and restricted rows, tags and labels on one address; either way of matching gives the same."""
    values = ["192.0.2.77", "192.0.2.80", "192.0.2.64", "192.0.2.127", "192.0.2.128", "192.0.2.63", "ship.test", "ship.tes", "2001:DB8:77::BEEF", "2001:db8:77:1::", "2001:db8:78::", None]
    r = ask(spark, root, *values)
    x = r["192.0.2.77"]
    assert (x["flags"], x["type_mask"], x["kind"], x["status"]) == (S.MATCH + S.THRT, S.CTI + S.CTI_R + S.TAGS, 4, 1)
    assert (x["confidence"], x["confidence_r"], x["tlp_mask"], x["category_mask"]) == (90, 99, S.CLEAR + S.AMBER, 128 + 4 + 2)
    assert (x["feeds"], x["tags"], x["labels"]) == (["Harbour", "tide.misp"], ["gate", "edge"], ["misp-event:tide", "apt"])
    x = r["192.0.2.80"]  # restricted: its score, but neither its category, its markings nor its feed
    assert (x["type_mask"], x["confidence"], x["confidence_r"], x["tlp_mask"], x["category_mask"], x["feeds"]) == (S.CTI + S.CTI_R, 35, 71, S.CLEAR, 128, ["Harbour"])
    assert [r[v]["confidence"] for v in ("192.0.2.64", "192.0.2.127", "2001:DB8:77::BEEF", "2001:db8:77:1::")] == [35, 35, 88, 21]
    assert [r[v]["status"] for v in ("192.0.2.128", "192.0.2.63", "2001:db8:78::", "ship.tes", None)] == [0, 0, 0, 0, -1]
    assert (r["ship.test"]["category_mask"], r["ship.test"]["tlp_mask"], r["ship.test"]["kind"]) == (64, S.RED, 0)
    assert ask(spark, root, *values, by_ranges=False) == r


def test_overlay_rules(spark, root):
    r = ask(spark, root, "quiet.test", "muted.test", "raised.test", "named.test")
    x = r["quiet.test"]
    assert (x["flags"], x["confidence"], x["feeds"], x["status"]) == (S.OVERLAY + S.SUPPRESSED, 0, [], 1)
    x = r["muted.test"]
    assert (x["flags"], x["confidence"]) == (S.OVERLAY + S.WHITELISTED + S.MATCH + S.THRT, 57)
    x = r["raised.test"]
    assert (x["flags"], x["ovl_confidence"], x["ovl_category_mask"], x["type_mask"]) == (S.OVERLAY + S.MATCH, 33, 128, 0)
    x = r["named.test"]
    assert (x["flags"], x["overlay_tags"], x["status"]) == (S.OVERLAY, ["owner:ops", "lab"], 1)


def test_private_addresses(spark, root):
    plain, skipped = (ask(spark, root, "172.16.5.5", "172.31.0.1", skip=s) for s in (False, True))
    x = plain["172.16.5.5"]
    assert (x["flags"], x["confidence"], x["category_mask"], x["labels"]) == (S.PRIVATE + S.MATCH + S.THRT, 50, 32 + 1, ["misp-event:reef"])
    x = skipped["172.16.5.5"]
    assert (x["flags"], x["type_mask"], x["confidence"], x["tags"], x["labels"]) == (S.PRIVATE + S.PRIVATE_SKIP + S.THRT, 0, 0, ["printer", "floor2"], [])
    assert plain["172.31.0.1"]["flags"] == skipped["172.31.0.1"]["flags"] == S.PRIVATE


def test_values_that_cannot_be_looked_up(spark, root):
    long, over = "é" * 2048, "é" * 2048 + "x"
    r = ask(spark, root, long, over, "x\0", "", None)
    assert [r[v]["status"] for v in (long, over, "x\0", "", None)] == [0, S.ETOOLONG, S.EINVAL, S.EINVAL, S.EINVAL] and all(x["flags"] == 0 for x in r.values())


def test_a_batch_answers_like_single_lookups(spark, root):
    values = ["192.0.2.77", "ship.test", "raised.test", "172.16.5.5", "2001:db8:77::1", "nothing"]
    whole = ask(spark, root, *values)
    assert {v: ask(spark, root, v)[v] for v in values} == whole and sum(x["status"] == 1 for x in whole.values()) == 5


def test_event_fold_and_report(spark, root):
    at = Store(spark, root).open()
    rows = at.lookup(spark.createDataFrame([(1, "192.0.2.77"), (1, "raised.test"), (2, "nothing"), (3, "muted.test")], "e int, v string"), "v")
    e = {r["e"]: r for r in M.fold_events(rows, "e").collect()}
    assert (e[1]["match"], e[1]["confidence"], e[1]["category_mask"], e[1]["feeds"]) == (True, 99, 128 + 4 + 2, ["Harbour", "tide.misp"]) and not e[2]["match"] and e[3]["whitelisted"]
    lines = {r["value"]: r["line"] for r in M.report(rows, "v").collect()}
    assert lines["192.0.2.77"] == "HIT Type=CTI+CTI_R+TAGS Confidence=90 TLP=AMBER Category=Malware,Phishing,Spam Feeds=Harbour,tide.misp Tags=gate,edge Labels=misp-event:tide,apt" and lines["nothing"] == "MISS Type=UNK Confidence=0 TLP=(none) Category=(none) Feeds=(none)"
    assert M.hits(rows).first()["hits"] == 3
    only = {r["value"]: r["line"] for r in M.overlay_only(spark.createDataFrame([("quiet.test",), ("x",)], "v string"), "v", at.overlay).collect()}
    assert only == {"quiet.test": "HIT  ioc=quiet.test  action=whitelist  suppress=1  confidence=100", "x": "MISS  ioc=x"}


def copied(spark, root, path):
    at, store = Store(spark, root).open(), Store(spark, str(path))
    store.publish({name: getattr(at, name) for name in ("indicators", "public_feeds", "feed_state", "overlay")})
    return store


def test_withdrawal_generations_and_reload(spark, root, tmp_path):
    store = copied(spark, root, tmp_path / "store")
    (tmp_path / "gone.csv").write_text("op,ioc,type\ndelete,192.0.2.64/26,ip\n")
    assert B.apply_delta(spark, store.root, str(tmp_path / "gone.csv"), NOW, generation=5)
    assert not B.apply_delta(spark, store.root, str(tmp_path / "gone.csv"), NOW, generation=5)
    r = ask(spark, store.root, "192.0.2.64", "192.0.2.77", "192.0.2.80", "2001:db8:77::1")
    assert r["192.0.2.64"]["status"] == 0 and (r["192.0.2.77"]["confidence"], r["192.0.2.77"]["category_mask"]) == (90, 4 + 2)
    assert (r["192.0.2.80"]["type_mask"], r["192.0.2.80"]["confidence"]) == (S.CTI_R, 0) and r["2001:db8:77::1"]["confidence"] == 21
    version, at = store.current(), store.open()
    with pytest.raises(S.EngineError):
        store.publish({"indicators": at.indicators.withColumn("confidence", F.lit(300))})
    with pytest.raises(S.EngineError, match="meanwhile"):
        store.publish({"indicators": at.indicators}, base="another")
    assert store.current() == version
    state = FO.fold(at.state, [feeds.read_csv(one(spark, "domain,new.test,40,0,harbour\n"), "x")], "HARBOUR", NOW, snapshot=True)
    left = {r["str"]: r for r in state.indicators.filter("kind = 0").collect()}
    assert set(left) == {"new.test"} and left["new.test"]["feeds"] == ["harbour"]
    later = FO.fold(state, [feeds.read_csv(one(spark, "domain,z.test,40,0,other\n"), "other")], "other", NOW + 40 * 86400, ttl_days=30)
    assert {r["str"] for r in later.indicators.filter("kind = 0").collect()} == {"z.test"}
    assert sorted((r["feed"], r["generation"]) for r in later.feed_state.collect()) == [("other", 1)]
    assert Store(spark, str(tmp_path / "none")).open(strict=False).partial
    with pytest.raises(S.EngineError) as e:
        Store(spark, str(tmp_path / "none")).open()
    assert e.value.code == S.ENOENT and str(e.value).startswith(S.ERRORS[S.ENOENT])


def test_a_version_is_checked_when_opened(spark, root, tmp_path):
    store = copied(spark, root, tmp_path / "store")
    folder = tmp_path / "store" / f"v={store.current()}"
    info = store.open(check=True).info().first()
    assert (info["networks_v4"], info["networks_v6"], info["strings"], info["overlay_entries"], info["feeds"]) == (4, 2, 3, 4, 2)
    spark.read.parquet(str(folder / "indicators")).filter("str <> 'ship.test' or str is null").write.parquet(str(folder / "fewer"))
    shutil.rmtree(folder / "indicators"), (folder / "fewer").rename(folder / "indicators")
    with pytest.raises(S.EngineError) as e:
        store.open(check=True)
    assert e.value.code == S.ECHECKSUM
    (folder / "MANIFEST").write_text(json.dumps({"format": 99})), (folder / ".MANIFEST.crc").unlink(missing_ok=True)
    with pytest.raises(S.EngineError) as e:
        store.open()
    assert e.value.code == S.EVERSION
    row = store.ranges(store.current(), "ranges4").limit(1)
    for other in (row.withColumn("ip_end", F.col("ip_end") + 1), row.withColumn("ip_start", F.col("ip_end") + 5)):
        with pytest.raises(S.EngineError):
            validate_ranges(row.unionByName(other))


def test_building_onto_a_version(spark, root, tmp_path):
    store = copied(spark, root, tmp_path / "store")
    (tmp_path / "late.csv").write_text("ip,192.0.2.77,100,scan,HARBOUR,red\n-,domain,ship.test\n")
    B.build_onto(spark, str(tmp_path / "late.csv"), store.root, NOW)
    r = ask(spark, store.root, "192.0.2.77", "ship.test", "named.test")
    assert (r["192.0.2.77"]["confidence"], r["192.0.2.77"]["tlp_mask"], r["192.0.2.77"]["feeds"]) == (100, S.CLEAR + S.AMBER + S.RED, ["Harbour", "tide.misp"])
    assert r["ship.test"]["status"] == 0 and r["named.test"]["overlay_tags"] == ["owner:ops", "lab"]


def test_a_later_page_may_add_again(spark):
    page = lambda text: feeds.read_csv(one(spark, text), "p")
    state = FO.State(C.compile_contributions(page("domain,a.test,10\ndomain,b.test,10\ndomain,c.test,10\n")), spark.createDataFrame([], "feed string"), spark.createDataFrame([], S.FEED_STATE))
    pages = ["-,domain,a.test\n-,domain,b.test\ndomain,b.test,70\n", "domain,a.test,20\ndomain,b.test,30\n", "-,domain,b.test\n"]
    got = FO.fold(state, [page(t) for t in pages], "p", NOW)
    assert {(r["str"], r["confidence"]) for r in got.indicators.collect()} == {("a.test", 20), ("c.test", 10)}
    for k in range(len(pages)):  # one after the other gives the same
        state = FO.fold(state, [page(pages[k])], "p", NOW)
    assert sorted(map(tuple, state.indicators.collect())) == sorted(map(tuple, got.indicators.collect()))


def test_addresses(spark):
    good = {"1.2.3.4": 4, "0.0.0.0": 4, "255.255.255.255": 4, "::1": 6, "2001:DB8::1": 6, "::ffff:1.2.3.4": 6, "1.2.3.0/24": 4, "10.0.0.0/8": 4, "2001:db8::/32": 6}
    bad = ["01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", " 1.2.3.4", "1.2.3.4 ", "10.0.0.0/7", "1.2.3.4/33", "1.2.3.4/", "2001:db8::/31", "fe80::1%eth0", "::1/129", "http://1.2.3.4/24", "1.2.3.4/24/3", ":::", "12345::"]
    rows = spark.createDataFrame([(v, "ip") for v in [*good, *bad]] + [("9.9.9.0/24", "url"), ("9.9.9.9", "url")], "value string, type string")
    got = {(r["value"], r["type"]): r for r in C.with_identity(rows).collect()}
    assert all(got[v, "ip"]["kind"] == k for v, k in good.items()) and all(got[v, "ip"]["kind"] == 0 for v in bad)
    assert got["9.9.9.0/24", "url"]["kind"] == 0 and got["9.9.9.9", "url"]["kind"] == 4
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789abcdefg:.") for _ in range(rng.randint(2, 20))) for _ in range(3000)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(500)]
    for t in texts:
        try:
            want = f"{int(ipaddress.IPv6Address(t)):032x}"
        except ValueError:
            want = None
        assert (A._parse_v6(t, False) or (0, None))[1] == want


def test_scalars(spark):
    rows = spark.createDataFrame([(v,) for v in ("300", "-5", "9" * 20, "70", " 42x", "x", "", "0100", "007")], "v string").select("v", X.confidence(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in rows] == [100, 0, 100, 70, 42, 0, 0, 100, 7]
    rows = spark.createDataFrame([(v,) for v in ("3", "16", "17", "0", "malware", "C2 botnet", "history", "actor", "", "Tor exit proxy", "12x")], "v string").select(X.category_mask(F.col("v")).alias("m"), X.tlp_mask(F.col("v")).alias("t")).collect()
    assert [r["m"] for r in rows] == [4, 32768, 0, 0, 2, 24, 512, 512, 0, 512 + 1024, 2048] and rows[0]["t"] == 1
    t = spark.createDataFrame([(' a ,,"b" , c""',)], "v string").select(X.tokens(F.col("v")).alias("t")).first()["t"]
    assert t == ["a ".strip(), "b", "c"]


def test_flatten_equals_brute_force_and_matches_agree(spark):
    rng = random.Random(7)
    nets = {ipaddress.ip_network((rng.choice([0x0A000000, 0x0A010000, 0xFFFFFF00]) + rng.randrange(0, 256) & 0xFFFFFFFF, p), strict=False) for p in (8, 16, 24, 26, 28, 30, 31, 32) for _ in range(9)} | {ipaddress.ip_network("255.0.0.0/8")}
    rows = [("ip", str(n), str(rng.randrange(100)), rng.choice(["malware", "c2", "spam"]), f"f{rng.randrange(4)}") for n in sorted(nets, key=str)]
    text = "\n".join(",".join(r) for r in rows)
    ind = C.compile_contributions(feeds.read_csv(spark.createDataFrame([(text,)], "value string"), "x"))
    ranges = C.flatten_v4(ind)
    spans = sorted((r["ip_start"], r["ip_end"]) for r in ranges.collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    points = [int(n[k]) for n in nets for k in (0, -1)] + [int(n[0]) - 1 for n in nets if int(n[0])] + [rng.randrange(1 << 32) for _ in range(50)]
    values = spark.createDataFrame([(str(ipaddress.IPv4Address(p)),) for p in set(points)], "value string")
    seen = M.classify(values)
    want = {}
    for p in set(points):
        own = [r for r in rows if ipaddress.IPv4Address(p) in ipaddress.ip_network(r[1])]
        if own:
            want[str(ipaddress.IPv4Address(p))] = (max(int(r[2]) for r in own), sorted({r[4] for r in own}))
    validate_ranges(ranges)
    for found in (M.match_v4(seen, ind), M.match_v4_ranges(seen, ranges)):
        assert {r["value"]: (r["confidence"], r["feeds"]) for r in found.collect()} == want


def test_flatten_v6(spark):
    text = "ip,2001:db8::/32,10\nip,2001:db8::/48,20\nip,2001:db8::5,30\nip,ffff:ffff::/32,5\nip,ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff,50\n"
    ind = C.compile_contributions(feeds.read_csv(spark.createDataFrame([(text,)], "value string"), "x"))
    got = sorted((r["ip_start"], r["ip_end"], r["confidence"]) for r in C.flatten_v6(ind).collect())
    h = lambda t: f"{int(ipaddress.IPv6Address(t)):032x}"
    assert [x[2] for x in got] == [20, 30, 20, 10, 5, 50] and got[1][:2] == (h("2001:db8::5"),) * 2 and got[-1][:2] == ("f" * 32,) * 2
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


def test_ipv6_ranges_and_steps_equal_brute_force(spark):
    rng = random.Random(3)
    base = int(ipaddress.IPv6Address("2001:db8::"))
    nets = {ipaddress.ip_network((base + (rng.randrange(4) << 78) + (rng.randrange(3) << 64) + rng.randrange(4) & -1 << (128 - p), p), strict=False) for p in (33, 47, 48, 50, 63, 64, 100, 127, 128) for _ in range(6)} | {ipaddress.ip_network("2001:db8::/32"), ipaddress.ip_network("ffff:ffff::/32")}
    rows = [(str(n), rng.randrange(101)) for n in sorted(nets, key=str)]
    ind = C.compile_contributions(feeds.read_csv(one(spark, "\n".join(f"ip,{n},{c}" for n, c in rows)), "x")).cache()
    ranges = C.flatten_v6(ind).cache()
    validate_ranges(ranges)
    points = {x for n in nets for k in (0, -1) for d in (-1, 0, 1) if 0 <= (x := int(n[k]) + d) < 1 << 128}
    seen = M.classify(spark.createDataFrame([(str(ipaddress.IPv6Address(p)),) for p in points], "value string")).cache()
    want = {str(ipaddress.IPv6Address(p)): max(own) for p in points if (own := [c for n, c in rows if ipaddress.IPv6Address(p) in ipaddress.ip_network(n)])}
    for found in (M.match_v6(seen, ind), M.match_v6_ranges(seen, ranges)):
        assert {r["value"]: r["confidence"] for r in found.collect()} == want
    numbers = [0, 1, (1 << 64) - 1, 1 << 64, (1 << 128) - 1, *(rng.getrandbits(128) for _ in range(50))]
    table = spark.createDataFrame([(f"{n:032x}", p) for n in numbers for p in (32, 37, 64, 127, 128)], "h string, p int")
    for r in table.select("*", A.v6_after(F.col("h")).alias("after"), A.v6_before(F.col("h")).alias("before"), A.v6_masked(F.col("h"), F.col("p")).alias("net")).collect():
        n = int(r["h"], 16)
        assert r["after"] == (f"{n + 1:032x}" if n + 1 < 1 << 128 else "g") and r["before"] == (f"{n - 1:032x}" if n else None) and r["net"] == f"{n >> (128 - r['p']) << (128 - r['p']):032x}"


def one(spark, text):
    return spark.createDataFrame([(text,)], "value string")


def test_other_feeds(spark):
    d = {"a.example": {"tlp": "amber", "type": "malware", "max_score": 250, "feed": ["f1", "f2"], "feed_objects": [{"feed_name": "f1", "lbl": ["x", "y"]}, {"feed_name": "f2", "lbl": ["y"]}]}, "9.8.7.6": {"type": "ip"}}
    rows = feeds.read_dictionary(one(spark, json.dumps(d)), "stem").collect()
    assert {(r["value"], r["feed"], r["confidence"]) for r in rows} == {("a.example", "f1", 100), ("a.example", "f2", 100), ("9.8.7.6", "stem", 0)}
    assert next(r for r in rows if r["feed"] == "f1")["labels"] == ["x", "y"]
    table = "".join(json.dumps({"index": v, "value": json.dumps(x)}) + ",\n" for v, x in (("b.example", {"tlp": "red", "max_score": "77", "type": "phish", "feed": "q"}), ("c.example", {"feed": ["r", "s"]})))
    rows = {r["value"]: r for r in feeds.read_lookup(one(spark, '{"table":[' + table + "]}"), "stem").collect()}
    assert (rows["b.example"]["confidence"], rows["b.example"]["tlp_mask"], rows["b.example"]["feed"]) == (77, 8, "q") and (rows["c.example"]["confidence"], rows["c.example"]["feed"]) == (50, "r")
    rows = {r["value"]: r["type"] for r in feeds.read_list(one(spark, "# c\n1.2.3.4\n1.2.3.0/24\nx@y.z\n; c\n" + "a" * 64 + "\nhttp://u/v\nplain.example\n"), "l").collect()}
    assert list(rows.values()) == ["ip", "domain", "email", "hash", "url", "domain"]
    rows = feeds.read_csv_delta(one(spark, "value,conf,op\nd.example,12,\ne.example,,delete\n-f.example,,\n"), "k").collect()
    # empty fields collapse, so in the second line the word stands under conf
    assert [(r["value"], r["action"], r["confidence"], r["tlp_mask"]) for r in rows] == [("d.example", "+", 12, 4), ("e.example", "+", 0, 4), ("f.example", "-", 50, 4)]
    event = {"Event": {"info": "i", "threat_level_id": "1", "Tag": [{"name": "tlp:red"}, {"name": "apt"}], "Attribute": [{"type": "domain|ip", "value": "g.example|5.5.5.5", "category": "Payload delivery"}, {"type": "md5", "value": "x", "to_ids": False}, {"type": "mutex", "value": "m"}], "Object": [{"Attribute": [{"type": "filename|md5", "value": "n.exe|" + "b" * 32, "deleted": True}]}]}}
    rows = feeds.read_misp(one(spark, json.dumps(event)), "m").collect()
    assert {(r["value"], r["type"], r["confidence"], r["tlp_mask"]) for r in rows} == {("g.example", "domain", 90, 8), ("5.5.5.5", "ip", 90, 8), ("b" * 32, "md5", 90, 8)} and rows[0]["labels"] == ["apt", "misp-event:i"]
    assert {r["value"]: r["action"] for r in feeds.read_misp(one(spark, json.dumps(event)), "m", delta=True).collect()}["b" * 32] == "-"
    assert feeds.read_tags_json(one(spark, '{"index":"h","tags":["a","a","b"]}\nx\n'), "t").first()["labels"] == ["a", "b"]
    many = ",".join(f"t{k}" for k in range(5000))
    assert len(feeds.read_tags(one(spark, f"host,{many}\n"), "t").first()["labels"]) == 5000
    for body in ({"entries": [{"ioc": "a"}, {"ioc": "a"}]}, {"entries": [{"action": "tag"}]}, {"entries": []}, {"entries": [{"ioc": "a", "tags": ["x", 1]}]}, {"entries": [{"ioc": "a", "tags": "x"}]}, {"entries": [{"ioc": "a" * 4097}]}, {"entries": [{"ioc": "a", "category": "x" * (8 << 20)}]}):
        with pytest.raises(S.EngineError):
            feeds.read_overlay(one(spark, json.dumps(body)))
    several = lambda *sizes: spark.createDataFrame([(json.dumps({"entries": [{"ioc": f"{k}-{j}"} for j in range(n)]}),) for k, n in enumerate(sizes)], "value string")
    assert feeds.read_overlay(several(65536, 2)).count() == 65538
    for files in (several(65537), several(2, 0), several(1).unionByName(several(2))):
        with pytest.raises(S.EngineError):
            feeds.read_overlay(files)
    assert [feeds.format_of(n) for n in ("a.tags", "b.tags.json", "c.misp.json", "d.stix.json", "e.json", "f.ioc")] == ["tags", "tags_json", "misp", "stix", "dictionary", "list"] and feeds.stem("x/labels.misp.json") == "labels.misp" and feeds.stem("a.stix.json", True) == "a"


def test_stix(spark):
    assert stix.pattern_values("[ipv4-addr:value = '1.2.3.4' AND file:hashes.'SHA-256' = 'AB'] OR [domain-name:value IN ('a.b', 'c\\'d')] WITHIN 5 SECONDS") == [("ip", "1.2.3.4"), ("sha256", "AB"), ("domain", "a.b"), ("domain", "c'd")]
    assert stix.pattern_values("[url:value LIKE 'x' OR autonomous-system:number = 12 OR file:name != 'y']") == [("asn", "12")]
    assert stix.pattern_values("[a:b='x'] FOLLOWEDBY [ipv4-addr:value='1.1.1.1']") == [] and stix.pattern_values("[domain-name:value = 'a FOLLOWEDBY b']") == [("domain", "a FOLLOWEDBY b")]
    marks = "marking-definition--f88d31f6-486f-44da-b317-01333bde0b82"
    own = {"type": "marking-definition", "id": "marking-definition--x", "definition": {"tlp": "red"}}
    ind = lambda v, **k: {"type": "indicator", "spec_version": "2.1", "name": "N", "pattern_type": "stix", "pattern": f"[domain-name:value = '{v}']", **k}
    objects = [own, ind("A.Example", confidence=300, indicator_types=["malicious-activity"], object_marking_refs=[marks]), ind("b.example", object_marking_refs=["marking-definition--x"]), ind("c.example", revoked=True), ind("d.example", valid_until="2020-01-01T00:00:00Z"), ind("e.example", valid_from="2999-01-01T00:00:00.5Z"), ind("f.example", indicator_types=["benign"]), ind("g.example", labels=["tlp:green"])]
    rows = {r["value"]: r for r in stix.read_stix(spark, one(spark, json.dumps({"type": "bundle", "objects": objects})), "s", now=NOW).collect()}
    assert {v: (r["action"], r["tlp_mask"], r["confidence"]) for v, r in rows.items()} == {"a.example": ("+", 4, 100), "b.example": ("+", 8, 50), "c.example": ("-", 4, 50), "d.example": ("-", 4, 50), "g.example": ("+", 2, 50)}
    assert rows["a.example"]["labels"] == ["N", "malicious-activity"] and rows["a.example"]["category_mask"] == 1
    sco = [{"type": "ipv4-addr", "value": "4.4.4.4"}, {"type": "file", "name": "n.exe", "hashes": {"SHA-256": "CD"}}, {"type": "user-account", "user_id": "u", "account_login": "v"}, {"type": "autonomous-system", "number": 7}]
    rows = stix.read_stix(spark, one(spark, json.dumps({"type": "bundle", "objects": sco})), "s", now=NOW).collect()
    assert {(r["type"], r["value"]) for r in rows} == {("ip", "4.4.4.4"), ("sha256", "cd"), ("filename", "n.exe"), ("user", "u"), ("user", "v"), ("asn", "7")}


def test_prevalence(spark):
    seen = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "v string, e int, s int")
    table = FO.build_prevalence(seen, "v", "e", "s")
    values = spark.createDataFrame([("a",), ("z",)], "v string")
    assert sorted(tuple(r) for r in FO.prevalence_of(values, "v", table).collect()) == [("a", 2, 2, 1), ("z", 0, 0, 0)]
    assert all(r["fleet_count"] is None for r in FO.prevalence_of(values, "v", table.limit(0)).collect())


@contextlib.contextmanager
def misp(rows):
    """A server that answers searches over rows by their timestamp, page by page."""

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            q = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            lo, hi = map(int, q["last"]) if isinstance(q["last"], list) else (0, 1 << 60)
            own = [r for r in rows if lo <= int(r["timestamp"]) <= hi]
            at = (q.get("page", 1) - 1) * q["limit"]
            self.answer(json.dumps({"response": {"Attribute": own[at : at + q["limit"]]}}).encode())

        def do_GET(self):
            self.answer(b"a list\n")

        def answer(self, body):
            self.send_response(200), self.send_header("Content-Length", str(len(body))), self.end_headers(), self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_prevalence_files(spark, tmp_path):
    """Published check values of both hashes, and a file made here, read and refused."""
    assert hashes.crc32c(b"123456789") == 0xE3069283 and hashes.crc32c(b"") == 0
    key = tuple(int.from_bytes(bytes(range(a, a + 8)), "little") for a in (0, 8))
    published = {0: 0x726FDB47DD0E0E31, 1: 0x74F839C593DC67FD, 7: 0xAB0200F58B01D137, 8: 0x93F5F5799A932462, 15: 0xA129CA6149BE45E5}
    got = hashes.siphash([bytes(range(n)) for n in published], key, 2, 4)
    assert got.tolist() == list(published.values())
    values = {f"v{k}": (k * 3, k, k // 2) for k in range(1, 40)}
    table = np.zeros(64, prevalence.ENTRY)
    for v, counts in values.items():
        h = int(hashes.siphash([v.encode()], key)[0]) or 1
        at = h % 64
        while table[at]["hash"]:
            at = (at + 1) % 64
        table[at] = (h, *counts)
    body = table.tobytes()

    def write(name, magic=prevalence.MAGIC, version=3, slots=64, checksum=None, begin=80, most=117):
        head = prevalence.HEADER.pack(magic, version, 80 + len(body), slots, 39, hashes.crc32c(body) if checksum is None else checksum, NOW, begin, most, 5, *key)
        (tmp_path / name).write_bytes(head + body)
        return str(tmp_path / name)

    asked = spark.createDataFrame([("v7",), ("none",), ("",), (None,)], "v string")
    for path in (write("a.prev"), write("b.prev", checksum=0)):
        header, rows = prevalence.read_prevalence(spark, path)
        assert rows.count() == 39 and (header.reporting_edges, header.epoch, header.count_max) == (5, NOW, 117)
        got = {r["v"]: tuple(r)[1:] for r in prevalence.prevalence_of_file(asked, "v", header, rows).collect()}
        assert got == {"v7": (21, 7, 3), "none": (0, 0, 0), "": (0, 0, 0), None: (0, 0, 0)}
    header, rows = prevalence.read_prevalence(spark, write("cold.prev", most=0))
    assert all(r["fleet_count"] is None for r in prevalence.prevalence_of_file(asked, "v", header, rows).collect())
    for code, wrong in ((S.EFORMAT, {"magic": 1}), (S.EVERSION, {"version": 2}), (S.EFORMAT, {"slots": 63}), (S.EFORMAT, {"slots": 128}), (S.EFORMAT, {"begin": 84}), (S.EFORMAT, {"begin": 72})):
        with pytest.raises(S.EngineError) as e:
            prevalence.read_prevalence(spark, write("bad.prev", **wrong))
        assert e.value.code == code
    with pytest.raises(Exception, match="checksum"):
        prevalence.read_prevalence(spark, write("bad.prev", checksum=7))[1].count()


def test_editions_are_fetched_once(tmp_path):
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as archive:
        for name, data in (("x/README", b"r"), ("x/Place.mmdb", b"places")):
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            archive.addfile(entry, io.BytesIO(data))
    served, asked = {"tar.gz": packed.getvalue()}, []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            assert self.headers["Authorization"] == "Basic dTpr"
            kind = self.path.partition("suffix=")[2]
            asked.append(kind)
            body = served["tar.gz"] if kind == "tar.gz" else f"{served.get('sha') or hashlib.sha256(served['tar.gz']).hexdigest()}  Place.tar.gz\n".encode()
            self.send_response(200), self.send_header("Content-Length", str(len(body))), self.end_headers(), self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    geo = {"base_url": f"http://127.0.0.1:{server.server_port}", "account_id": "u", "license_key": "k", "editions": ["Place"], "dest_dir": str(tmp_path)}
    assert pull.download_editions(geo) == ["Place"] and (tmp_path / "Place.mmdb").read_bytes() == b"places"
    assert pull.download_editions(geo) == [] and asked == ["tar.gz.sha256", "tar.gz", "tar.gz.sha256"]
    served["sha"] = "0" * 64
    with pytest.raises(S.EngineError):
        pull.download_editions(geo)
    server.shutdown()
    assert pull.download_editions({}) == []
    with pytest.raises(S.EngineError):
        pull.download_editions({"account_id": "u"})


def test_pull_slices_and_source(spark, monkeypatch):
    now, stamps = 1000, [10, 11, 11, 11, 500, 900]
    spark.dataSource.register(pull.MispSource)
    with misp([{"type": "domain", "value": f"d{k}.example", "timestamp": str(t)} for k, t in enumerate(stamps)]) as url:
        rows = spark.read.format("misp_pull").options(url=url, since="0", now=str(now), page_size="2", slice_rows="2").load().collect()
    assert sorted(int(r["timestamp"]) for r in rows) == stamps and len({r["slice"] for r in rows}) > 1 and sorted(r["row"] for r in rows if r["slice"] == 11) == [0, 1, 2]
    assert pull.window_start("2d", 200_000) == 200_000 - 172_800 and pull.window_start("77", 5) == 77 and pull.next_cursor(None, 1, 2, 9) == 9 and pull.next_cursor(50, 60, 55, 9) == 55
    slices = list(pull.bisect(0, 100, lambda a, b: sum(a <= x % 101 <= b for x in stamps) > 2))
    assert slices[0][0] == 0 and slices[-1][1] == 100 and all(a[1] + 1 == b[0] for a, b in zip(slices, slices[1:]))
    table = spark.createDataFrame([(x % 101, 1) for x in stamps], "s bigint, n bigint")
    assert pull.bisect_counts(table, 0, 100, 2) == slices
    monkeypatch.setattr(pull, "post", lambda *_: [{"timestamp": "1"}] * 2), monkeypatch.setattr(pull, "MAX_PAGES", 3)
    reader = pull.MispReader({"url": "x", "since": "0", "now": "9", "page_size": "2"})
    with pytest.raises(S.EngineError):
        list(reader.read(pull._Slice(0, 9)))


def test_verbs(spark, root, tmp_path, monkeypatch, capsys):
    """Downloads, a sync by slices in which a later one adds again, a segment's key, the overlay, prevalence and a followed folder."""
    monkeypatch.chdir(tmp_path)
    copied(spark, root, tmp_path / "store")
    rows = [("a.test", "100", {}), ("b.test", "100", {}), ("a.test", "200", {"deleted": True}), ("b.test", "300", {"deleted": True}), ("b.test", "400", {})]
    rows = [{"type": "domain", "value": v, "timestamp": t, "Event": {"info": f"at{t}", "threat_level_id": "1"}} | more for v, t, more in rows]
    with misp(rows) as url:
        conf = {"output": str(tmp_path / "store"), "feeds": [{"type": "misp", "url": url, "key": "k", "dest": str(tmp_path / "pulled.misp.json"), "since": "0"}, {"type": "file", "url": url, "dest": str(tmp_path / "plain.txt")}]}
        (tmp_path / "palisade.json").write_text(json.dumps(conf))
        cli.main(["fetch"])
        assert len(json.loads((tmp_path / "pulled.misp.json").read_text())["response"]["Attribute"]) == 5 and (tmp_path / "plain.txt").read_text() == "a list\n"
        cli.main(["sync", "--apply", "--page-size", "1", "--slice-rows", "1"])
    r = ask(spark, conf["output"], "a.test", "b.test", "ship.test")
    assert r["a.test"]["status"] == 0 and r["b.test"]["labels"] == ["misp-event:at400"] and r["ship.test"]["status"] == 1
    state = {x["feed"]: x for x in Store(spark, conf["output"]).open().feed_state.collect()}
    assert state["pulled.misp"]["cursor"] == 400
    segment = {"type": "bundle", "objects": [{"type": "indicator", "pattern": "[domain-name:value = 'seg.test']"}]}
    (tmp_path / "x.stix.json").write_text(json.dumps(segment))
    cli.main(["sync", "--segment", str(tmp_path / "x.stix.json")]), cli.main(["apply-delta", "--segment", str(tmp_path / "x.stix.json")])
    (tmp_path / "o.json").write_text(json.dumps({"entries": [{"ioc": "seg.test", "action": "add"}]}))
    cli.main(["overlay", str(tmp_path / "o.json")]), cli.main(["overlay-lookup", "seg.test"]), cli.main(["lookup", "seg.test"])
    seen = spark.createDataFrame([("v", 1, 1), ("v", 2, 1), ("w", 2, 2)], "v string, e int, s int")
    B.set_prevalence(FO.build_prevalence(seen, "v", "e", "s"), conf["output"], FO.prevalence_facts(seen, "e", NOW))
    capsys.readouterr()
    cli.main(["prevalence", "v", "none"]), cli.main(["overlay-lookup", "seg.test"]), cli.main(["lookup", "seg.test"]), cli.main(["version"])
    out = capsys.readouterr().out
    assert "reporting edges=2" in out and "key=v  count=2  collectors=2  sources=1\n" in out and "key=none  count=0  collectors=0  sources=0  (absent = rare)" in out
    assert "HIT  ioc=seg.test  action=add  suppress=0  confidence=80" in out and "seg.test HIT Type=CTI Confidence=50" in out
    assert {"x.stix", "x"} <= {x["feed"] for x in Store(spark, conf["output"]).open().feed_state.collect()}
    (tmp_path / "late.csv").write_text("domain,late.test,15\n")
    cli.main(["add", "-i", str(tmp_path / "late.csv"), "--layer", "cti_r"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("".join(json.dumps({"Attribute": [{"type": "domain", "value": v}]}) + "\n" for v in ("f1.test", "f2.test")))
    cli.main(["follow", "--source", str(tmp_path / "in"), "--checkpoint", str(tmp_path / "cp"), "--feed-key", "followed", "--available-now"])
    r = ask(spark, conf["output"], "late.test", "f1.test", "f2.test")
    assert (r["late.test"]["type_mask"], r["late.test"]["confidence_r"]) == (S.CTI_R, 15) and r["f1.test"]["feeds"] == r["f2.test"]["feeds"] == ["followed"]


def test_files_of_lines_are_numbered_in_order(spark, tmp_path):
    """A file read in many splits keeps its order, and one document a line is read as one whole."""
    (tmp_path / "big.csv").write_text("".join(f"domain,d{k}.test,{k % 101},0,{'x' * 200}\n" for k in range(6000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k"), spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = feeds.lines(spark, str(tmp_path / "big.csv"))
        assert rows.rdd.getNumPartitions() > 4
        got = B.read_feed(spark, str(tmp_path / "big.csv")).orderBy("row_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0]), spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r["value"] for r in got] == [f"d{k}.test" for k in range(6000)]
    (tmp_path / "e.misp.jsonl").write_text("".join(json.dumps({"Attribute": [{"type": "domain", "value": f"j{k}"}]}) + "\n" for k in range(5)))
    got = B.read_feed(spark, str(tmp_path / "e.misp.jsonl")).orderBy("row_ord").collect()
    assert [r["value"] for r in got] == [f"j{k}" for k in range(5)]


def test_streams(spark, root, tmp_path):
    """A stream goes on from the generation its feed has, with a new checkpoint too, and a batch that comes again changes nothing."""
    store, src = copied(spark, root, tmp_path / "store"), tmp_path / "in"
    at = store.open()
    ahead = spark.createDataFrame([("streamed", 9, NOW, None, None, None)], S.FEED_STATE)
    store.publish({"indicators": at.indicators, "public_feeds": at.public_feeds, "overlay": at.overlay, "feed_state": ahead})
    for number, value in enumerate(("live.test", "next.test")):
        feeds.read_csv(one(spark, f"domain,{value},33,0,streamed\n"), "streamed").write.mode("append").parquet(str(src))
        contrib = spark.readStream.schema(S.CONTRIB).parquet(str(src))
        stream.fold_stream(contrib, store.root, "streamed", lambda: NOW, str(tmp_path / f"c{number}"), available_now=True).awaitTermination()
        assert ask(spark, store.root, value)[value]["confidence"] == 33
    state = store.open().state
    row = state.feed_state.first()
    assert (row["generation"], row["batch"]) == (11, 0)
    again = FO.fold(state, [feeds.read_csv(one(spark, "domain,other.test,1\n"), "streamed")], "streamed", NOW, stream=row["stream"], batch=0)
    assert not again.applied
    spark.createDataFrame([(1, "live.test"), (1, "x"), (2, "y")], "e int, v string").write.parquet(str(tmp_path / "obs"))
    got = []
    observed = spark.readStream.schema("e int, v string").parquet(str(tmp_path / "obs"))
    stream.match_stream(observed, "v", "e", store.root, lambda df, n: got.extend(df.collect()), str(tmp_path / "c9"), available_now=True).awaitTermination()
    assert {r["e"]: r["match"] for r in got} == {1: True, 2: False}


def test_overlay_entries_beyond_a_document(spark, tmp_path):
    """Every key has its entry, 0 and those above 65536 too."""
    import duckdb

    from palisade import feed_queries as FQ

    spark.range(70_000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = FQ.overlay_entries(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    names = ("value", "action", "suppress_full", "confidence", "type_mask", "category_mask", "tags")
    want = db.execute(f"SELECT {', '.join(names)} FROM ({FQ._OVERLAY_ENTRIES})").fetchall()
    assert len(want) == 70_000 and sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
