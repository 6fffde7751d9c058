"""Operator 5: benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words of which it looks at some and ignores the others; two places that differ only in
ignored words have one hash. The hashes of all benchmark places under all masks are joined with those of every document place.
A hit fixes a diagonal; along it the words of the item and of the document are compared without gaps, a word in common scoring 1
and a substituted one -SUBSTITUTION. A document is contaminated by an item where the best run scores at least MIN_SCORE, or, for
shorter items, all but a tenth of their words.

No such run is missed. The masks are all those of five compared words with at most one ignored. A run in which none of them fits has
stretches of equal words of which any two neighbours have four words or fewer together, so two each on average; every substitution
takes back what a stretch of two brings, and the run scores four at most, less than any item of five words needs. Items of four
words are sought whole; those of fewer are not sought.

Words are the blank-separated parts in lower case without punctuation at either end. Null or empty texts are clean; so is every
document if the benchmark is empty. Null benchmark texts and items are left out; items with equal words are one, named by the least of
their ids. Rows that repeat give equal rows; extra columns are ignored. The benchmark goes to the executors in blocks of at most
BLOCK_WORDS words (or one item, if that has more), one pass over the documents for each block, so what is broadcast has a bound
whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, map_batches, mix64, written

#: Fixed masks: 1 is compared, 0 is ignored.
MASKS = ("11111", "101111", "110111", "111011", "111101")
WEIGHT = 5
MIN_SCORE, SUBSTITUTION, SHORTEST = 12, 2, 4
BLOCK_WORDS = 400_000
#: Odd factors of the compared words.
_FACTORS = mix64(np.arange(1, WEIGHT + 1, dtype=np.uint64)) | np.uint64(1)
#: Low bits of a seed that a table of 2^FILTER_BITS flags looks at first; most places of a document go no further.
FILTER_BITS = 23
_LOW = np.uint64((1 << FILTER_BITS) - 1)
#: Pairs of places that are looked at together.
PLACES_AT_ONCE = 1_000_000


class CleanWords(dict):
    """Hash of each word without its case and outer punctuation; 0 if nothing is left. Emptied at LIMIT words."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        bare = word.lower()
        a, b = 0, len(bare)
        while a < b and not bare[a].isalnum():
            a += 1
        while b > a and not bare[b - 1].isalnum():
            b -= 1
        self[word] = x = (xxhash.xxh3_64_intdigest(bare[a:b].encode("utf-8", "surrogatepass")) | 1) if a < b else 0
        return x


def clean_words(text: str | None, table: CleanWords) -> np.ndarray:
    words = (text or "").split()
    x = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    return x[x != 0]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each place of the mask, in order."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(n, int(mask, 2) + (len(mask) << 32), np.uint64)
    for factor, j in zip(_FACTORS, (j for j, c in enumerate(mask) if c == "1"), strict=False):
        x += words[j : j + n] * factor
    return mix64(x)


@dataclass
class Index:
    """Sorted seeds of a block of the benchmark, each with its item and place."""

    items: list[int]
    words: list[np.ndarray]
    masks: list[str]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    flags: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> Index:
        table = CleanWords()
        words = [clean_words(t, table) for _, t in items]
        masks = [*MASKS, *("1" * n for n in range(SHORTEST, WEIGHT))]
        found = [(seeds(w, m), k) for k, w in enumerate(words) for m in masks if (len(m) >= WEIGHT if len(w) >= WEIGHT else len(m) == len(w))]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)])
        item = np.concatenate([np.zeros(0, np.int32), *(np.full(len(h), k, np.int32) for h, k in found)])
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(h), dtype=np.int32) for h, _ in found)])
        order = np.argsort(hashes, kind="stable")
        flags = np.zeros(1 << FILTER_BITS, bool)
        flags[hashes & _LOW] = True
        return cls([i for i, _ in items], words, masks, hashes[order], item[order], place[order], flags)

    def _hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Distinct rows (document, item, shift) of places that share a seed."""
        for mask in self.masks if len(self.hashes) else ():
            own = seeds(words, mask)
            maybe = np.flatnonzero(self.flags[own & _LOW])
            lo, hi = (np.searchsorted(self.hashes, own[maybe], side) for side in ("left", "right"))
            of = np.searchsorted(bounds, maybe, "right") - 1
            good = (lo < hi) & (maybe + len(mask) <= bounds[of + 1])
            lo, hi, of, at = lo[good], hi[good], of[good], maybe[good] - bounds[of[good]]
            ends = np.cumsum(hi - lo)
            begin = 0
            while begin < len(lo):
                upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PLACES_AT_ONCE, "right")))
                n = hi[begin:upto] - lo[begin:upto]
                entry = np.repeat(lo[begin:upto] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield np.unique(np.stack([np.repeat(of[begin:upto], n), self.item[entry], np.repeat(at[begin:upto], n) - self.place[entry]], axis=1), axis=0)
                begin = upto

    def overlaps(self, docs: list[np.ndarray]) -> list[dict[int, tuple[int, int]]]:
        """For each document, item_id: (score, words in common) of the items that it holds."""
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(int)
        words = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        diagonals: list[set[tuple[int, int]]] = [set() for _ in docs]
        for rows in self._hits(words, bounds):
            for d, k, shift in rows.tolist():
                diagonals[d].add((k, shift))
        return [self._confirmed(d, found) for d, found in zip(docs, diagonals, strict=True)]

    def _confirmed(self, doc: np.ndarray, diagonals: set[tuple[int, int]]) -> dict[int, tuple[int, int]]:
        out: dict[int, tuple[int, int]] = {}
        for k, shift in diagonals:
            words = self.words[k]
            a, b = max(0, -shift), min(len(words), len(doc) - shift)
            score, common = best_run(words[a:b] == doc[a + shift : b + shift])
            need = min(MIN_SCORE, len(words) - len(words) // 10)
            if score >= need:
                out[self.items[k]] = max(out.get(self.items[k], (0, 0)), (score, common))
        return out


def best_run(same: np.ndarray) -> tuple[int, int]:
    """The best score of a run of compared words, and how many of its words are the same."""
    steps = np.where(same, 1, -SUBSTITUTION)
    sums = np.concatenate(([0], np.cumsum(steps)))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    begin = int(np.argmax(sums[: end + 1] == low[end]))
    return int(sums[end] - low[end]), int(same[begin:end].sum())


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_item, best_score, common_words) of every row."""
    tests, blocks = _items(benchmark, item_col, item_text_col, block_words)
    out = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.array().cast("array<struct<item:long,score:int,common:int>>").alias("found"))
    for k in range(blocks):
        out = _search(out, _index(tests, blocks, k), last=k == blocks - 1)
    hit = F.size("found") > 0
    first = F.when(hit, F.get(F.array_sort(F.transform("found", lambda x: F.struct((-x["score"]).alias("s"), (-x["common"]).alias("c"), x["item"].alias("i")))), F.lit(0)))
    return out.select(
        "doc_id", hit.alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.array_sort(F.transform("found", lambda x: x["item"])).alias("item_ids"),
        first["i"].alias("best_item"), (-first["s"]).alias("best_score"), (-first["c"]).alias("common_words"),
    )


def with_contamination(df: DataFrame, benchmark: DataFrame, added: str = "contaminated", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """df with a column that tells the contaminated rows, without a join; one pass for each block of the benchmark."""
    tests, blocks = _items(benchmark, item_col, item_text_col, block_words)
    out, more = df, f"{added}_"
    while more in df.columns:
        more += "_"
    for k in range(blocks):
        shipped = df.sparkSession.sparkContext.broadcast(_index(tests, blocks, k))

        def make(shipped=shipped):
            own, table = shipped.value, CleanWords()
            return lambda texts: [[bool(x) for x in own.overlaps([clean_words(t, table) for t in texts.to_pylist()])]]

        out = add_columns(out, text_col, make, f"`{added if k == 0 else more}` boolean")
        if k:
            out = out.withColumn(added, F.col(f"`{added}`") | F.col(f"`{more}`")).drop(more)
    return out


def _items(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> tuple[DataFrame, int]:
    """The items that are sought, and into how many blocks they go."""
    named = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("t"))
    tests = _distinct_items(named.filter("item is not null and t is not null"))
    return tests, _blocks(tests, block_words)


def _index(tests: DataFrame, blocks: int, k: int) -> Index:
    own = tests.filter(_block_of(blocks) == k).orderBy("item", "t").toArrow().to_pydict()
    return Index.build(list(zip(own["item"], own["t"], strict=True)))


def _distinct_items(tests: DataFrame) -> DataFrame:
    """Written rows (item, t, n) of the items that are long enough: one for each sequence of words, with the least id."""

    def make():
        table = CleanWords()

        def f(batch):
            words = [clean_words(t, table) for t in batch.column(1).to_pylist()]
            return {"item": batch.column(0), "t": batch.column(1), "n": [len(w) for w in words], "key": [xxhash.xxh3_128_digest(w.tobytes()) for w in words]}

        return f

    rows = map_batches(tests, {"item": "long", "t": "string"}, make, "item long, t string, n long, key binary").filter(F.col("n") >= SHORTEST)
    return written(rows.groupBy("key").agg(F.min(F.struct("item", "t", "n")).alias("x")).select("x.*"), "benchmark-items")


def _block_of(blocks: int):
    return F.pmod(F.xxhash64("item", "t"), F.lit(blocks))


def _blocks(tests: DataFrame, block_words: int) -> int:
    """Into how many blocks the items go by hash so that none with several items has more words than block_words."""
    blocks = max(1, -(-(tests.agg(F.sum("n")).first()[0] or 0) // block_words))
    while tests.groupBy(_block_of(blocks)).agg(F.sum("n").alias("n"), F.count("*").alias("k")).filter((F.col("n") > block_words) & (F.col("k") > 1)).head(1):
        blocks *= 2
    return blocks


def _search(docs: DataFrame, index: Index, last: bool) -> DataFrame:
    """Adds the block's findings; the text goes on only to another block."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        own, table = shipped.value, CleanWords()

        def f(batch):
            got = own.overlaps([clean_words(t, table) for t in batch.column(1).to_pylist()])
            found = [before + [{"item": i, "score": s, "common": c} for i, (s, c) in sorted(x.items())] for before, x in zip(batch.column(2).to_pylist(), got, strict=True)]
            return {"doc_id": batch.column(0), "text": [None] * batch.num_rows if last else batch.column(1), "found": found}

        return f

    kind = "array<struct<item:long,score:int,common:int>>"
    return map_batches(docs, {"doc_id": "long", "text": "string", "found": kind}, make, f"doc_id long, text string, found {kind}")
