"""Operator 4: near-duplicate documents by SetSketch registers.

Each document's set of word shingles is sketched to M registers: register i holds floor(1 - log_b x), cut to 0..Q+1, of the least
of exponential values x that the set's elements get there. Registers merge by maximum, and two of them agree with about the
probability of the sets' Jaccard similarity. Runs of ROWS registers are hashed to bands; documents that share a band are
candidates. Pairs whose set sizes or registers' lowest bits rule the limit out go first; then the likelihood of the counts of greater, lesser and equal registers, given both set sizes,
is maximised over the similarity; a pair goes on unless the likeliest
similarity lies below the limit and the limit itself is hopelessly unlikely (by a factor exp(-UNLIKELY)).
What goes on is confirmed on the full sets. Equal sets are one class from the start, so copies never meet as pairs.

With 40 bands of 5 registers a pair at similarity 0.8 shares no band with probability 1.2e-7; the test of the lowest bits loses it
with at most 3e-7 (the binomial tail: 1.8e-7 beyond 44 of 200 bits), that of the likelihood with 2.4e-7 for sets of equal size.

Null or empty text, or text of white space: an empty set, linked with nothing, kept. Fewer words than a shingle: the whole sequence
is one shingle. Equal sets are linked whatever their order. Rows that repeat a doc_id count as one document when linking. A null
doc_id has its class's least doc_id as component and is not kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_shingles, differing_bits, discard, least_values, lists, low_bits, map_batches, mix64, most_differing, words_of, written
from .components import link_similar, shared_buckets

BANDS, ROWS = 40, 5
M = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Log-likelihood by which the limit may fall short of the best similarity before a pair is dropped unconfirmed.
UNLIKELY = 12.5
#: Probability up to which a pair at the limit may have more differing low bits than are worth its likelihood.
LOSS = 3e-7
_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, M, dtype=np.uint32)


def shingle_sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(x) for x in all_shingles(words_of(texts), k)]


def registers(elements: np.ndarray) -> np.ndarray:
    """The M registers of a set of 64-bit hashes; merge(registers(A), registers(B)) is registers(A | B)."""
    if not len(elements):
        return np.zeros(M, np.uint16)
    least = least_values(elements, _MULTIPLY, _ADD)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_PLACE = mix64(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)


def bands(regs: np.ndarray) -> np.ndarray:
    return mix64((regs.reshape(BANDS, ROWS).astype(np.uint64) * _PLACE).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def _log_b(x):
    return np.log(x) / np.log(BASE)


def log_likelihood(j, greater, lesser, equal, u, v):
    """Of the register counts at similarity j; u, v: the sizes' shares of their sum."""
    p = lambda x: np.clip(-_log_b(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE), 1e-12, 1)
    up, down = p(u - v * j), p(v - u * j)
    return greater * np.log(up) + lesser * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of registers a and b of sets of n_a and n_b elements: the likeliest similarity, its log-likelihood, and the log-likelihood as a function."""
    greater, lesser = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - greater - lesser
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    lo, hi = np.zeros(len(a)), most.astype(float)
    at = lambda j: log_likelihood(j, greater, lesser, equal, u, v)
    for _ in range(40):  # the likelihood has one peak
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = at(x) < at(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    best = (lo + hi) / 2
    return best, at(best), at


def sketch_documents(df: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, regs, bands, bits): key is equal for equal sets; the sketch is null for an empty set."""

    def f(batch):
        sets = shingle_sets_of(batch.column(1), shingle_words)
        regs = [registers(s) if len(s) else None for s in sets]
        return {
            "doc_id": batch.column(0),
            "n_shingles": [len(s) for s in sets],
            "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "regs": [None if r is None else r.tobytes() for r in regs],
            "bands": lists([None if r is None else bands(r) for r in regs], pa.int64()),
            "bits": lists([None if r is None else low_bits(r) for r in regs], pa.int64()),
        }

    return map_batches(df, {id_col: "long", text_col: "string"}, lambda: f, "doc_id long, n_shingles long, key binary, regs binary, bands array<long>, bits array<long>")


def shingle_sets(df: DataFrame, shingle_words: int) -> DataFrame:
    """(node, elements) of rows (doc_id, text)."""

    def f(batch):
        return {"node": batch.column(0), "elements": lists([s.view(np.int64) for s in shingle_sets_of(batch.column(1), shingle_words)], pa.int64())}

    return map_batches(df, {"doc_id": "long", "text": "string"}, lambda: f, "node long, elements array<long>")


def near_duplicates(df: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: components of links with 100 * intersection >= percent * union."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketches = written(sketch_documents(docs, shingle_words), "sketches")
    classes = sketches.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    of_class = written(sketches.select("doc_id", "n_shingles", "key").join(classes, "key", "left").select("doc_id", "n_shingles", "rep"), "classes")
    reps = sketches.filter("n_shingles > 0 and doc_id is not null").join(of_class.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    members = shared_buckets(reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node")))
    nodes = written(members.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    infos = written(reps.join(nodes, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bits", "regs").dropDuplicates(), "registers")
    discard(sketches)
    sets = written(shingle_sets(docs.join(nodes, "doc_id", "left_semi"), shingle_words), "sets")
    limit, most_bits = percent / 100, most_differing(percent / 100, M, LOSS)

    @F.pandas_udf("boolean")
    def hopeful(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, M) for s in (a, b))
        best, top, at = joint_estimate(x, y, n_a.to_numpy(float), n_b.to_numpy(float))
        return pd.Series((best >= limit) | (at(np.full(len(a), limit)) >= top - UNLIKELY))

    def likely(a: str, b: str) -> Column:
        return hopeful(f"regs_{a}", f"regs_{b}", f"n_{a}", f"n_{b}")

    def plausible(a: str, b: str) -> Column:
        n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
        return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (differing_bits(f"bits_{a}", f"bits_{b}", M) <= most_bits)

    comp = link_similar(members, infos, sets, percent, plausible, likely)
    discard(members, nodes, infos, sets)
    joined = of_class.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
