"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with the hard cases of its docstring."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from palisade.llm import bpe, chat, decontam, ids_io, langid, media, paragraphs, queries, setsketch, sharding, token_counts
from palisade.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, bucket long, node long"
LONG = "wort " * 30_000 + "x" * 5000


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of the small scale with nulls, empty and very long texts, copies, odd white space and clashing names."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = len(rows)
    extra = [None, "", "   ", LONG, LONG, "a", "one two", "Ä é  \x1cb  \n\n c\r\n", "!!! ???", rows[3][1], rows[3][1] + " end", "one <|endoftext|> two<|startoftext|>"]
    rows += [(1000 + k, t, None, None) for k, t in enumerate(extra)] + [(n and rows[0][0], rows[0][1], rows[0][2], rows[0][3]), (None, "null id here", None, "src0")]
    return spark.createDataFrame([(*r, None, "w", 1, 2) for r in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def jaccard_components(rows, k, percent=80):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {d: shingles(t) for d, t in rows if d is not None}
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_setsketch_equals_brute_force(docs, empty):
    for k in (2, 5):
        want = jaccard_components(pairs(docs), k)
        for r in setsketch.near_duplicates(docs, k).collect():
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    assert setsketch.near_duplicates(empty, 2).count() == 0


def test_chain_and_large_group(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[: 100 + 3 * i]) for i in range(60)] + ["x y z " * 50 + f"t{i % 3}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = jaccard_components(list(enumerate(texts)), 2)
    assert {r["doc_id"]: tuple(r)[1:] for r in setsketch.near_duplicates(df, 2).collect()} == want


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = setsketch.registers(x[:2000]), setsketch.registers(x[1000:])
    assert (setsketch.merge(a, b) == setsketch.registers(x)).all()
    best, _, _ = setsketch.joint_estimate(a[None], b[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(best[0] - 1 / 3) < 0.12


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1050)]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert all(got.get(x, x if x in alone else None) == c for x, c in comp.items())


def test_byte_bpe_equals_tiktoken(docs, empty):
    import tiktoken

    path, pattern = queries.tokenizer_path(queries.BYTE_RANKS), queries.piece_pattern()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    text = {d: t or "" for d, t in pairs(docs)}
    for r in bpe.round_trip_digests(docs, path, pattern).collect():
        ids = np.array(enc.encode_ordinary(text[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern)
    assert all(bytes(r["decoded"]).decode() == text[r["doc_id"]] for r in back.collect())
    assert bpe.round_trip_digests(empty, path, pattern).count() == 0


def test_byte_bpe_random_pieces():
    import tiktoken

    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.piece_pattern()
    own = bpe.encoder(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "etaoinshr ", "aé中🙂's \n\t1", "  \n"):
        for _ in range(200):
            t = "".join(rng.choice(list(alphabet), rng.integers(0, 80)))
            assert np.frombuffer(own.encode(t), "<u4").tolist() == enc.encode_ordinary(t)


def test_token_shards_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    t = Tokenizer.from_file(path)
    rows = sorted(((d, x or "") for d, x in pairs(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    manifest = ids_io.write_shards(docs, path, 1, shard_ids=5000)
    got = sorted(ids_io.read_shards(manifest).collect(), key=lambda r: (r["start"]))
    start = 0
    for r, (d, x) in zip(got, rows, strict=True):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = ids_io.open_shard(manifest.first()["uri"])
    keys = [k for k in shard.doc_ids.tolist() if k != ids_io.NO_KEY]
    assert all(shard.get(k) is not None for k in keys) and shard.get(max(keys) + 10**9) is None
    assert ids_io.read_shards(ids_io.write_shards(empty, path, 1)).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 7, 500, 5000):
        keys = np.unique(np.random.default_rng(n).integers(-(10**15), 10**15, n))
        h = ids_io.PerfectHash.build(keys)
        assert not n or sorted(h.slots(keys)) == list(range(len(keys)))


def test_media_round_trip_and_formats(spark, docs, empty):
    text = {d: t for d, t in pairs(docs)}
    tiles = media.write_tiles(media.store_texts(docs))
    stored = {(r["doc_id"], r["media_sha256"]): r for r in tiles.collect()}
    for r in media.media_features(tiles).collect():
        data = media.store(media.payload_of(text[r["doc_id"]])[0])
        pixels, npy = media.decode(data), stored[r["doc_id"], r["media_sha256"]]["tile"]
        # the tile and its features by plain means over the areas
        small = np.load(__import__("io").BytesIO(npy))
        want = plain_resize(pixels, 8, 8)
        assert small.shape == (8, 8, 3) and small.dtype == np.uint8 and np.abs(small - want).max() <= 0.5 + 1e-6
        dhash = lambda x: np.packbits(np.round(plain_resize(x.mean(axis=2), 8, 9), 6)[:, :-1] > np.round(plain_resize(x.mean(axis=2), 8, 9), 6)[:, 1:]).tobytes().hex()
        if pixels.shape[0] < 40:
            assert r["feature"] == f"{dhash(small)}:{dhash(pixels)}:{np.round(plain_resize(small, 2, 2)).astype(np.uint8).tobytes().hex()}"
        assert r["tile_sha256"] == hashlib.sha256(npy).hexdigest() and r["media_sha256"] == hashlib.sha256(data).hexdigest() and r["media_bytes"] == len(data)
        payload, n = media.payload_of(text[r["doc_id"]])
        assert len(payload) % 192 == 0 and len(payload) > 0
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.media_features(media.write_tiles(media.store_texts(empty))).count() == 0
    x = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert media.decode(b"P2\n# c\n2 2\n255\n1 2 3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 2 65535\n\x01\x02\x03\x04").tolist() == [[258], [772]]
    exact = np.arange(48.0).reshape(6, 8)
    assert np.allclose(media.area_resize(exact, 3, 4), exact.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.isclose(media.area_resize(exact, 1, 3)[0, 0], (exact[:, :2].sum() + exact[:, 2].sum() * 2 / 3) / (6 * 8 / 3))
    palette = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 14 + 40 + 8, 40, 2, 1, 1, 8, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0])
    assert media.decode(palette + bytes([0, 1, 0, 0])).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    broken = [b"GIF", b"P6 9 9 255 x", b"P2 1 1 255 " + b"9" * 20, b"P2 1 1 255 300", b"P2 1 1 255 -1", b"P5 1 1 9 \xff", palette + bytes([0, 2, 0, 0]), palette[:40], b"BM", b"P", b"P2 1 1 255 a", b"P5 99999999999 99999999999 255 x", b"P3 0 1 255 "]
    for data in broken:
        with pytest.raises(ValueError):
            media.decode(data)
    table = spark.createDataFrame([(1, bytearray(media.encode_ppm(x))), (2, None), *((3 + k, bytearray(b)) for k, b in enumerate(broken))], "id long, m binary")
    rows = {r["id"]: r for r in media.tile_column(table, "id", "m").collect()}
    assert rows[1]["error"] is None and (rows[1]["height"], rows[1]["width"], rows[1]["channels"]) == (5, 7, 3)
    assert np.load(__import__("io").BytesIO(rows[1]["tile"])).shape == (32, 32, 3)
    assert all(rows[k]["error"] and rows[k]["tile"] is None for k in range(2, 3 + len(broken)))


def plain_resize(x, height, width):
    """Area means by the share of each old pixel in each new one."""

    def shares(old, new):
        edge = np.linspace(0, old, new + 1)
        return np.clip(np.minimum(edge[1:, None], np.arange(1, old + 1)) - np.maximum(edge[:-1, None], np.arange(old)), 0, None) * new / old

    return np.einsum("ay,yx...,bx->ab...", shares(x.shape[0], height), np.asarray(x, float), shares(x.shape[1], width))


def test_language_mixture(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold_of() == 2
    model = langid.train(table.filter(~held))
    rows = langid.identify(table.filter(held), model).join(table.select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    one = {r["lang"]: r["text"] for r in table.filter("n_chars > 600").collect()}
    mixed = dict(model.mixture(one["en"][:600] + " " + one["de"][:600]))
    assert set(mixed) == {"en", "de"} and 0.3 < mixed["en"] < 0.7
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[1000 + k]["lang_pred"] for k in (0, 1, 2, 8)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == docs.select("doc_id").distinct().count()
    assert langid.train(empty).mixture("words") == [] and langid.identify(empty, model).count() == 0
    got = {r["doc_id"]: r["held_out"] for r in queries.op2_language_mixture(spark, SF).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in got.items())


def test_trigrams_do_not_depend_on_slices(monkeypatch):
    text = "Ein  Satz, 3 Wörter! \n und noch ÉTÉ ... " * 40
    whole = langid.trigrams(text).tolist()
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "_SLICE", size)
        assert langid.trigrams(text).tolist() == whole
    assert langid.trigrams("12 !").tolist() == langid.trigrams("").tolist() == []


def test_mixture_equals_a_plain_search(spark):
    """Proportions by many plain steps of expectation-maximisation from other starts, and the set by the same criterion."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (3, langid.BUCKETS)) * (rng.random((3, langid.BUCKETS)) < 0.2)
    model = langid.Model(["aa", "bb", "cc"], counts)
    text = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(200))
    grams = langid.trigrams(text)

    def plain(own):
        p = model.p[own][:, grams]
        share = rng.dirichlet(np.ones(len(own)))
        for _ in range(3000):
            share = (share[:, None] * p / (share @ p)).mean(axis=1)
        return share, np.log(share @ p).sum()

    found = model.mixture(text)
    own = [model.langs.index(lang) for lang, _ in found]
    share, value = plain(own)
    assert np.allclose(share, [x for _, x in found], atol=5e-3)
    penalty = langid.PENALTY / 2 * np.log(len(grams))
    singles = [np.log(model.p[k][grams]).sum() - penalty for k in range(3)]
    assert value - len(own) * penalty >= max(singles) - 1e-6 * abs(max(singles))


def test_passages(spark, docs, empty):
    filler = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' and n_chars between 400 and 900").limit(6).collect()]
    sents = [f"Common passage part {c} goes on for ten words here." for c in "abcdef"]
    passage = " ".join(sents)
    line = " ".join(f"p{i}" for i in range(60))
    near = line.replace("p30 ", "p30x ")
    rows = [(10, filler[0] + " " + passage), (20, filler[1] + " " + passage + " " + filler[2]), (30, filler[3]), (40, filler[4] + "\n" + line), (50, near + "\n" + filler[5]), (60, None), (70, ""), (80, sents[0])]
    got = {r["doc_id"]: r for r in paragraphs.remove_repeats(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pos int")).collect()}
    text = dict(rows)
    assert got[10]["text"] == text[10] and got[30]["text"] == text[30] and got[40]["text"] == text[40] and got[80]["text"] == text[80]
    assert got[60]["text"] is None and got[70]["text"] == "" and got[20]["pos"] == 7
    assert passage not in got[20]["text"] and got[20]["text"] == filler[1] + " " + filler[2]
    assert got[50]["text"] == filler[5] and got[50]["removed_words"] == 60
    assert paragraphs.remove_repeats(docs).count() == docs.count() and paragraphs.remove_repeats(empty).count() == 0


def line_words(text):
    """(first word, words) of the lines of 50 words and more."""
    at, out = 0, []
    for line in text.split("\n"):
        words = ascii_words(line)
        if len(words) >= 50:
            out.append((at, words))
        at += len(words)
    return out


def ascii_words(text):
    return text.encode().lower().split()


def plain_repeats(rows):
    """For rows (order, text) with orders of their own: the words that an earlier text has, by runs of 50 and by lines at an exact Jaccard similarity of 0.8."""
    rows = sorted((d, t) for d, t in rows if t)
    first, firsts, copies = {}, {}, {}
    runs = {d: [tuple(w[k : k + 50]) for k in range(len(w) - 49)] for d, w in ((d, ascii_words(t)) for d, t in rows)}
    for d, _ in rows:
        for x in runs[d]:
            first.setdefault(x, d)
    seen = {d: {k + i for k, x in enumerate(runs[d]) if first[x] < d for i in range(50)} for d in runs}
    lines = [(d, at, w, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for d, t in rows for at, w in line_words(t)]
    comp = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if comp[a] != comp[b] and 10 * len(lines[a][3] & lines[b][3]) >= 8 * len(lines[a][3] | lines[b][3]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    for (d, *_), c in zip(lines, comp, strict=True):
        firsts.setdefault(c, d)
    for (d, at, w, _), c in zip(lines, comp, strict=True):
        if firsts[c] < d:
            seen[d] |= set(range(at, at + len(w)))
    for d, t in rows:
        if copies.setdefault(t, d) < d and len(ascii_words(t)) >= 50:
            seen[d] = set(range(len(ascii_words(t))))
    groups = collections.Counter(c for c, d in {(c, d) for (d, *_), c in zip(lines, comp, strict=True)})
    return seen, max(groups.values(), default=0)


def test_marks_equal_brute_force(spark):
    """Every repeated run of 50 words, and the lines of every component of all pairs."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(70)]
    vary = lambda k: " ".join(f"z{x}" if hit else w for w, x, hit in zip(base, rng.integers(0, 10**9, 70), rng.random(70) < k / 70, strict=True))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(5000 + k, f"head {k}\n{vary(k % 5)}\ntail {k}") for k in range(50)]
    want, largest = plain_repeats(rows)
    got = {r["doc_id"]: r["removed_words"] for r in paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert largest > 10 and got == {d: len(x) for d, x in want.items()}


def test_repeated_words_count_the_first_document(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    passage, copy = fresh(60), fresh(80)
    rows = [(3, f"{fresh(9)} {passage} {fresh(4)}"), (1, copy), (2, copy), (4, f"{fresh(3)} {passage}"), (5, fresh(200))]
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], "doc_id long, text string, removed_words string, __doc_id int")
    got = {r["doc_id"]: (r["removed_words"], r["repeated_words"], r["__doc_id"]) for r in paragraphs.remove_repeats(df).collect()}
    assert got == {1: (0, 80, 5), 2: (80, 80, 5), 3: (0, 60, 5), 4: (60, 60, 5), 5: (0, 0, 5)}


def test_decontamination(spark, docs, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    host = "completely ordinary words stand around the planted passage and nothing else is here " * 3
    w = items[5].split()
    swapped = " ".join(x if k % 9 != 4 else "zzz" for k, x in enumerate(w))
    rows = [(1, host + items[3] + " " + host), (2, host), (3, (items[7] + "!").upper()), (4, host + swapped), (5, None), (6, ""), (7, items[3] + host + items[8])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item long")
    for block in (decontam.BLOCK_WORDS, 500):
        got = {r["doc_id"]: r for r in decontam.contamination(df, bench, block_words=block).collect()}
        assert got[1]["item_ids"] == [3] and got[3]["item_ids"] == [7] and got[7]["item_ids"] == [3, 8] and got[4]["contaminated"] == (len(w) >= 24)
        assert not any(got[k]["contaminated"] for k in (2, 5, 6))
        flags = {r["doc_id"]: r["c"] for r in decontam.with_contamination(df.withColumn("c_", F.lit(3)), bench, "c", block_words=block).collect()}
        assert flags == {d: r["contaminated"] for d, r in got.items()}
    assert decontam.contamination(empty, bench).count() == 0 and decontam.with_contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(df, bench.limit(0)).collect())
    # every place against every item, without seeds
    table = decontam.CleanWords()
    tests = {i: decontam.clean_words(t, table) for i, t in items.items()}
    own = {d: decontam.clean_words(t, table) for d, t in pairs(docs.filter("doc_id < 50")) + rows}
    more = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, k int").select("doc_id", "text").union(docs.filter("doc_id < 50 and doc_id > 7").select("doc_id", "text"))
    own = {d: own[d] if d > 7 else decontam.clean_words(dict(rows)[d], table) for d in own if d > 0}
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontam.contamination(more, bench).collect()}
    assert got == {d: {i for i, x in tests.items() if holds(w, x)} for d, w in own.items()} and any(got.values())


def holds(doc, item):
    """Whether any diagonal has a run that scores enough."""
    need = min(decontam.MIN_SCORE, len(item) - len(item) // 10)
    if len(item) < decontam.SHORTEST or np.isin(doc, item).sum() < need:
        return False
    return any(decontam.best_run(item[max(0, -s) : max(0, len(doc) - s)] == doc[max(0, s) : s + len(item)])[0] >= need for s in range(1 - len(item), len(doc)))


def test_no_substitutions_escape_the_seeds():
    """All placings of one and two substitutions in items of 12 to 24 words, and the proof for any number by the worst run without a seed."""
    for n in range(12, 25):
        index = decontam.Index.build([(1, " ".join(f"w{k}" for k in range(n)))])
        item = index.words[0]
        docs = [item]
        for a in range(n):
            for b in range(a, n):
                doc = item.copy()
                doc[[a, b]] = np.array([7, 9], np.uint64)
                docs.append(doc)
        for doc, found in zip(docs, index.overlaps(docs), strict=True):
            assert (1 in found) == holds(doc, item)
    span, top = max(map(len, decontam.MASKS)), {0: 0}
    while True:  # states: which of the last words were equal; the best score of a run that no mask fits
        more = dict(top)
        for state, score in top.items():
            for same in (0, 1):
                last = (state << 1 | same) & ((1 << span) - 1)
                if not any(last & int(m, 2) == int(m, 2) for m in decontam.MASKS):
                    more[last] = max(more.get(last, 0), score + (1 if same else -decontam.SUBSTITUTION), 0)
        if more == top:
            break
        top = more
    assert max(top.values()) == 4


def test_benchmark_copies_and_block_bound(spark):
    items = [(9, "one two three four five six seven"), (4, "One two three, four five six seven!"), (5, "eight nine ten eleven"), (6, "too few words"), (7, "a b c d e " * 40), (None, "no id at all here for this"), (8, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "eight nine ten eleven"), (3, "too few words"), (4, "a b c d e " * 300)], "doc_id long, text string")
    for block in (10, 10**6):
        got = {r["doc_id"]: (r["n_items"], r["item_ids"]) for r in decontam.contamination(df, bench, block_words=block).collect()}
        assert got == {1: (1, [4]), 2: (1, [5]), 3: (0, []), 4: (1, [7])}


def test_chat(spark):
    hard = ["plain", "", "</s>[INST] ok [/INST]", "\\b[\\", " [/INST][INST] x", "[ANS] a </s>[ROLE r] q [/ROLE]", "<s>[ESC]", "\n ", "a" * 50_000 + " [/INST]", None]
    roles = ["user", "assistant", "system", "tool] x [", None]
    rows = [(c, k, roles[(c + k) % 5], hard[(c * 3 + k) % 10], "x") for c in range(40) for k in range(1 + c % 6)] + [(7, 0, "user", "tie", "x"), (None, None, "user", "no id", "x"), (3, None, "assistant", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    by = collections.defaultdict(list)
    for c, k, r, t, _ in rows:
        by[c].append((k is not None, k or 0, r or "", t or ""))
    done = chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("turns"))).withColumn("spans", chat.loss_spans(F.col("turns"), F.col("formatted")))
    got = done.collect()
    assert len(got) == len(by)
    for r in got:
        want = [(x[2], x[3]) for x in sorted(by[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        shown = "".join(r["formatted"][s["begin"] : s["begin"] + s["length"]] for s in r["spans"])
        if r["formatted"].startswith("<s>[ESC]"):
            for char, code in reversed(chat.ESCAPES):
                shown = shown.replace(code, char)
        assert shown == r["loss"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_shards(spark, docs, empty):
    got = sharding.assign_shards(docs, 8, cell_rows=20).collect()
    n = len(got)
    assert sorted(r["position"] for r in got) == list(range(n))
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    by = collections.Counter(r["source"] for r in got)
    for s in counts:
        own = collections.Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(own[x] - by[x] * counts[s] / n) <= 2 for x in by)
    # the whole order by brute force
    ranked = []
    for x in by:
        mine = sorted((hashlib.md5(f"{sharding.SEED}:{'' if r['doc_id'] is None else r['doc_id']}:{r['text_crc32']}".encode()).hexdigest(), -1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in got if r["source"] == x)
        ranked += [((2 * k + 1) * (1 << 60) // (2 * len(mine)), x is None, x or "", h, d) for k, (h, d, _) in enumerate(mine)]
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in sorted(got, key=lambda r: r["position"])]
    assert [x[4] for x in sorted(ranked)] == order
    assert sharding.assign_shards(empty).count() == 0


def test_edit_aware_counts(docs, empty):
    path, pattern = queries.tokenizer_path(queries.BYTE_RANKS), queries.piece_pattern()
    own, compiled = bpe.encoder(path, pattern), regex.compile(queries.piece_pattern())
    counts = token_counts.PieceCounts(own)
    rng = np.random.default_rng(5)
    for t in ["", "a", "  a b\n\n c 's", "word " * 400] + [x for _, x in pairs(docs) if x][:12]:
        doc = token_counts.CountedText(t, compiled, counts)
        for _ in range(40):
            a = int(rng.integers(0, len(doc.text) + 2))
            doc.edit(a, a + int(rng.integers(0, 30)), str(rng.choice(["", " ", "x", "  \n", "'s", " new words here", "q" * 30, "1 2"])))
            assert doc.tokens == len(own.encode(doc.text)) // 4
    text = dict(pairs(docs))
    for r in token_counts.count_with_edits(docs, path, pattern).collect():
        after = text[r["doc_id"]] or ""
        for a, b, new in token_counts.standard_edits(len(after)):
            after = after[:a] + new + after[b:]
        assert (r["n_tokens"], r["n_chars_after"], r["n_tokens_after"]) == (len(own.encode(text[r["doc_id"]])) // 4, len(after), len(own.encode(after)) // 4) and r["reencoded_pieces"] <= 40
    assert token_counts.count_with_edits(empty, path, pattern).count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """run() and each of its stages against plain versions that look at every row, pair and place."""
    import tiktoken

    import corpus_pipeline as c

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(4)
    real = [r.asDict() for r in table.collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()[1]["text"]
    by_lang = {r["lang"]: r for r in real if r["lang"] and r["n_chars"] > 900}
    passage = " ".join(w for w in by_lang["en"]["text"].split()[:70])
    base = by_lang["de"]
    more = [("near", base["text"].replace(" der ", " xxx ", 1)), ("held", base["text"][::-1][:400] + " " + item), ("has", "aaa bbb " + passage + " ccc"), ("junk", "0 1 2 3"), ("none", None), ("long", by_lang["fr"]["text"] * 40 if "fr" in by_lang else passage * 40)]
    rows = [*real, *({**base, "doc_id": 9000 + k, "text": t, "lang": None, "source": None, "n_chars": None} for k, (_, t) in enumerate(more))]
    docs = spark.createDataFrame(rows, table.schema)
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf/documents.parquet")), spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    out, stage = docs, dict(c.STAGES)
    step = lambda name: c.written(stage[name](spark, out, str(tmp_path / "sf")), f"test-{name}")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    model = langid.train(docs.filter(langid.fold_of() != 2))
    mixed = {r["doc_id"]: model.mixture(r["text"]) for r in rows}
    out = step("language_id")
    assert set(texts(out)) == {d for d, m in mixed.items() if m and m[0][1] >= 0.5} and out.schema == docs.schema
    assert not {9003, 9004} & set(texts(out)) and {r["doc_id"]: r["lang"] for r in out.collect()}[9002] == mixed[9002][0][0]
    before = texts(out)
    out = step("near_dedup")
    assert texts(out) == {d: before[d] for d, (_, comp, kept) in jaccard_components(before.items(), 5).items() if kept}
    assert 9000 not in texts(out)
    before = texts(out)
    out = step("substring_dedup")
    cut, _ = plain_repeats(before.items())
    after = texts(out)
    assert {d: ascii_words(t) for d, t in after.items()} == {d: [w for k, w in enumerate(ascii_words(t)) if k not in cut.get(d, ())] for d, t in before.items()}
    assert ascii_words(after[9002]) == [b"aaa", b"bbb", b"ccc"] and {r["doc_id"]: r["n_chars"] for r in out.collect()} == {d: len(t) for d, t in after.items()}
    words = decontam.CleanWords()
    tests = [decontam.clean_words(r["text"], words) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = step("decontamination")
    assert texts(out) == {d: t for d, t in after.items() if not any(holds(decontam.clean_words(t, words), x) for x in tests)} and 9001 not in texts(out)
    enc = tiktoken.Encoding("own", pat_str=queries.piece_pattern(), mergeable_ranks=bpe.read_ranks(queries.tokenizer_path(queries.BYTE_RANKS)), special_tokens={})
    want = {d: np.array(enc.encode_ordinary(t), "<u4") for d, t in texts(out).items()}
    for got in (step("byte_bpe"), c.run(spark, str(tmp_path / "sf"))):
        assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got.collect()} == {d: (len(x), hashlib.sha256(x.tobytes()).hexdigest()) for d, x in want.items()}
    first = docs.limit(0)
    for _, f in c.STAGES:
        first = f(spark, first, SF)
    assert first.count() == 0


def test_stages_with_odd_rows_and_names(spark):
    """Nulls in every column, repeated and null ids, equal rows, empty and very long texts, and columns named as those that stages add."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, `__own` string, `__row` long, `__found` long, `__doc_id` int, removed_words string, node long, comp long, `a b.c` int"
    clean = "the garden was wet and the rain fell on it all through the night while we slept and dreamt of other things"
    texts = [clean, clean + " again and once more until the sun came up", None, "", "   ", LONG, clean, "one", "one"]
    ids = [1, None, 2, None, 5, 6, None, 7, 7]
    rows = [(d, t, None if k % 2 else "en", None, None, "o", 1, None, k, "r", k, k, None) for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame([*rows, (None,) * 13], schema)
    learned = spark.createDataFrame([(k, clean, "en", "s", 3, *("x", 1, 1, 1, "r", 1, 1, 1)) for k in range(20, 30)], schema)
    for name, f in c.STAGES[:-1]:
        got = f(spark, df.unionByName(learned) if name == "language_id" else df, SF)
        assert got.columns == df.columns
        kept = got.filter("doc_id is null or doc_id < 20").collect()
        by = collections.Counter((r["doc_id"], r["text"]) for r in kept)
        if name == "language_id":
            assert by == collections.Counter({k: n for k, n in collections.Counter(zip(ids, texts)).items() if k[1] and k[1].strip() and by[k]}) and by[1, clean] == by[None, clean] == 1
        elif name == "near_dedup":  # equal texts and near ones leave the row of the least id; texts without words stay, equal rows as one
            assert by == collections.Counter([(1, clean), (None, clean + " again and once more until the sun came up"), (2, None), (None, ""), (5, "   "), (6, LONG), (7, "one"), (None, None)])
        else:
            assert sorted(map(str, by.elements())) == sorted(map(str, [*zip(ids, texts), (None, None)]))
            assert {r["removed_words"] for r in kept} == {"r", None} and {r["__own"] for r in kept} == {"o", None}
    assert c.tokenize(spark, df, SF).count() == 10


def test_links_through_hubs_equal_all_pairs(spark, monkeypatch):
    """Families of near copies with near misses and two centres, with hubs of buckets many times over and with none."""
    from palisade.llm import components as c

    rng = np.random.default_rng(11)
    centre = rng.choice(10**6, 60, replace=False).tolist()
    other = centre[:49] + list(range(10**7, 10**7 + 11))
    sets = []
    for k in range(160):
        own = list(other if k % 3 == 0 else centre)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            own[at] = int(rng.integers(2 * 10**7, 2 * 10**7 + 30))
        sets.append(sorted(set(own[: int(rng.integers(50, 61))])))
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a]), set(sets[b])
            if 100 * len(x & y) >= 80 * len(x | y) and want[a] != want[b]:
                lo, hi = sorted((want[a], want[b]))
                want = [lo if w == hi else w for w in want]
    rows = spark.createDataFrame(list(enumerate(sets)), "node long, elements array<long>")
    infos = rows.select("node", F.size("elements").alias("n"))
    possible = lambda a, b: 100 * F.least(f"n_{a}", f"n_{b}") >= 80 * F.greatest(f"n_{a}", f"n_{b}")
    for small, large, depth in ((1, 4, 4), (1, 4, 0), (16, 512, 6), (1000, 512, 6)):
        monkeypatch.setattr(c, "SMALL", small), monkeypatch.setattr(c, "LARGE", large), monkeypatch.setattr(c, "DEPTH", depth)
        members = c.shared_buckets(rows.select(F.lit(1).cast("long").alias("bucket"), "node").union(rows.filter("node % 2 = 0").select(F.lit(2).cast("long"), "node")))
        got = {r["node"]: r["comp"] for r in c.link_similar(members, infos, rows, 80, possible).collect()}
        assert [got.get(k, k) for k in range(len(sets))] == want
    assert 3 < len(set(want)) < 100


def test_words_and_pieces_as_the_library():
    t = ids_io.WordTokenizer(queries.tokenizer_path(queries.WORD_TOKENIZER))
    assert t._pattern is not None
    texts = ["Plain words, AND capitals.", "it's O'Neil'S 'Ll'd", "́x y", "<|startoftext|> <|ENDOFTEXT|>", "a <|endoftext|> b", "x<|endoftext|>", "<| not one |>", "ẞ İstanbul ΟΔΟΣ ß", "soft\xadhy", "Ǆungla ŉ ſ ª² ÀÉ i̇ É", "a\x00b \x7f c\x85d", "A\x1cB c", "", "  ", "___ 123٣ x1y2", "日本 語x"]
    texts += ["".join(chr(c) for c in range(a, a + 7)) for a in range(0, 0x260, 7)]
    assert t.encode(texts) == [t.whole(x) for x in texts]
    assert t.encode([None]) == [b""]


def test_passages_that_begin_anywhere(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    passage, short, near = fresh(50), fresh(49), [f"k{i}" for i in range(30)]
    x, y, z, p, q = fresh(20), fresh(20), fresh(90), fresh(20), fresh(20)
    rows = [(1, f"{fresh(7)} {passage} {short} {fresh(9)}\n" + " ".join(near)), (2, f"{x} {passage} {y}"), (3, f"{x[::-1]} {short} {y[::-1]}"), (4, z + "\n" + " ".join(near[:29] + ["changed"])), (5, f"{p} {passage}\n{q}")]
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"{x} {y}", 50), 3: (rows[2][1], 0), 4: (rows[3][1], 0), 5: (f"{p}\n{q}", 50)}


def test_pipeline_with_null_and_repeated_ids(spark):
    import corpus_pipeline as c

    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect() if r["text"]]
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else r["doc_id"] + 1000 for k, r in enumerate(rows)]
    table = spark.createDataFrame([r.asDict() | {"doc_id": d} for d, r in zip(ids, rows, strict=True)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    of = {}
    for comp_of in jaccard_components(list(enumerate(r["text"] for r in rows)), 5).items():
        of[rows[comp_of[0]]["text"]] = comp_of[1][1]
    got = c.drop_near_duplicates(spark, table, SF).collect()
    assert sorted(of[r["text"]] for r in got) == sorted(set(of.values()))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()[3]["text"]
    clean, junk = "plain words about a garden and the rain that fell on it in the night ", "0 1 2 !!! 77"
    passage = " ".join(f"u{k}" for k in range(60))
    few = [(d, clean + x) for d in (None, 7) for x in ("", item, passage + f" {d}")] + [(None, junk), (7, junk)]
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in few], table.schema)
    assert sorted(r["text"] for r in c.decontaminate(spark, table, SF).collect()) == sorted(t for _, t in few if item not in t)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert junk not in {r["text"] for r in c.identify_language(spark, real.unionByName(table), SF).collect()}
    assert sum(passage in r["text"] for r in c.cut_repeated_passages(spark, table, SF).collect()) == 1


def test_passages_of_one_id_with_two_texts(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    near, passage = fresh(60), ". ".join(fresh(20) for _ in range(4)) + "."
    rows = [(1, f"{near}\n{passage}"), (5, f"{fresh(30)}\n{fresh(30)}\n{near} end"), (5, f"{fresh(70)}. {fresh(70)}"), (5, f"{passage} {fresh(30)}"), (6, f"{near} more")]
    got = collections.Counter((r["doc_id"], r["text"], r["removed_words"]) for r in paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    head, tail = rows[1][1].rpartition(near)[0], rows[3][1].rpartition(". ")[2]
    assert got == collections.Counter([(1, rows[0][1], 0), (5, head, 61), (5, rows[2][1], 0), (5, tail, 80), (6, "", 61)])


def test_sketches_of_pairs_at_the_limit():
    """Real registers behave as the calculation of losses takes them to: 1500 pairs of sets at a similarity of exactly 0.8."""
    from palisade.llm.common import most_differing

    rng = np.random.default_rng(77)
    rows = []
    for _ in range(1500):
        common = int(rng.integers(20, 60)) * 8
        own = int(rng.integers(0, common // 4 + 1))
        x = rng.integers(0, 1 << 64, common + common // 4, dtype=np.uint64)
        rows.append((x[: common + own], np.concatenate((x[:common], x[common + own :]))))
    a, b = (np.array([setsketch.registers(r[k]) for r in rows]) for k in (0, 1))
    n_a, n_b = (np.array([len(r[k]) for r in rows], float) for k in (0, 1))
    equal, differing = (a == b).sum(axis=1), ((a ^ b) & 1).sum(axis=1)
    assert abs(equal.mean() - 160) < 0.7 and abs(equal.var() - 32) < 5 and abs(differing.mean() - 20) < 0.5 and abs(differing.var() - 18) < 3
    best, top, at = setsketch.joint_estimate(a, b, n_a, n_b)
    assert (differing <= most_differing(0.8, setsketch.M, setsketch.LOSS)).all() and ((best >= 0.8) | (at(np.full(len(best), 0.8)) >= top - setsketch.UNLIKELY)).all()
    assert all((setsketch.bands(x) == setsketch.bands(y)).any() for x, y in zip(a, b, strict=True)) and abs(best.mean() - 0.8) < 0.005


def test_differing_bits_lose_few_links():
    import math

    from palisade.llm.common import most_differing

    for limit, n in ((0.5, 200), (0.8, 200), (0.95, 200), (0.8, 128)):
        p, bits = (1 - limit) / 2, most_differing(limit, n, 3e-7)
        tail = lambda k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))
        assert tail(bits) <= 3e-7 < tail(bits - 1)
    assert most_differing(0.8, 200, 3e-7) == 44


def test_written_tables_have_no_checksum_files(spark):
    """Each file would take further processes, which share the memory of the JVM for a moment."""
    import os

    from palisade.llm.common import discard, written

    table = written(spark.range(0, 1000, 1, 7), "plain")
    names = os.listdir(table.written_to.removeprefix("file:"))
    assert sum(n.startswith("part-") for n in names) == 7 and not [n for n in names if n.endswith(".crc")]
    assert sorted(r["id"] for r in table.collect()) == list(range(1000))
    discard(table)
    assert not os.path.exists(table.written_to.removeprefix("file:"))
