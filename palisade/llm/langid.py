"""Operator 2: language identification as a mixture of languages.

Each language is a smoothed distribution over hashed letter trigrams, counted over all training rows. A document's trigrams are
taken to be drawn from a mixture of languages; expectation-maximisation estimates the proportions. The language set is chosen by
penalised likelihood: languages enter in order of their proportion while the mixture's log-likelihood, less a penalty for each
language, grows. Trigrams overlap, so each letter is counted about three times; the penalty is scaled by the same.

Null text or text without a letter: `und` with score 0. Without any training row: `und` for all. A null language is not learned
from. Ties go to the language that sorts first. Empty tables give no rows; rows that repeat give equal rows; other columns pass by
unread. The set of languages is taken to be small: the model holds BUCKETS numbers for each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, bound_batches, map_batches, pa_schema

BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Penalty for each further language: PENALTY / 2 * log(trigrams).
PENALTY, LEAST_SHARE = 6.0, 0.02
STEPS, ENOUGH = 40, 1e-4
_SLICE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams over lower-case letters, runs of all else being one blank; empty if there is no letter."""
    whole, out = f" {text.lower()} " if text else "", []
    last, before = np.zeros(0, np.uint32), True
    for at in range(0, len(whole), _SLICE):  # slices bound the memory; the last two codes and whether a letter came last go on
        codes = np.frombuffer(whole[at : at + _SLICE].encode("utf-32-le", "surrogatepass"), "<u4").copy()
        letter = _letters()[codes]
        codes[~letter] = 32
        codes = np.concatenate((last, codes[letter | np.concatenate(([before], letter[:-1]))]))
        last, before = codes[-2:], bool(letter[-1])
        if len(codes) >= 3:
            x = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
            out.append((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: a row of BUCKETS counts for each language."""
        order = np.argsort(np.array(langs, dtype=object), kind="stable") if langs else []
        self.langs = [langs[k] for k in order]
        smooth = counts[order].astype(float) + SMOOTHING if langs else np.zeros((0, BUCKETS))
        self.p = smooth / smooth.sum(axis=1, keepdims=True) if langs else smooth

    @staticmethod
    def _em(p: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        share, n = start, counts.sum()
        for _ in range(STEPS if len(share) > 1 else 0):
            new = share * (p @ (counts / (share @ p))) / n
            moved = np.abs(new - share).max()
            share = new
            if moved < ENOUGH:
                break
        return share, float(counts @ np.log(share @ p))

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, the largest first."""
        grams = trigrams(text)
        if not len(grams) or not self.langs:
            return []
        counts = np.bincount(grams, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        counts, p = counts[used].astype(float), self.p[:, used]
        share, _ = self._em(p, counts, np.full(len(p), 1 / len(p)))
        order = np.argsort(-share, kind="stable")
        penalty = PENALTY / 2 * np.log(max(len(grams), 2))
        best = None
        for k in range(1, len(order) + 1):
            own = order[:k]
            if k > 1 and share[own[-1]] < LEAST_SHARE:
                break
            got, value = self._em(p[own], counts, share[own] / share[own].sum())
            value -= k * penalty
            if best is not None and value <= best[0]:
                break
            best = value, own, got
        _, own, got = best
        rank = np.argsort(-got, kind="stable")
        return [(self.langs[own[k]], float(got[k])) for k in rank]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows of df with a language. Each task adds up its own rows; the driver gets one number for each language and bucket."""
    schema = "lang string, bucket int, n long"
    bound_batches(df.sparkSession)
    out = pa_schema(df.sparkSession, schema)

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                totals[lang] += np.bincount(trigrams(t), minlength=BUCKETS)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])], schema=out)

    labelled = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang is not null and text is not null")
    rows = labelled.mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((len(langs), BUCKETS))
    number = {lang: k for k, lang in enumerate(langs)}
    counts[[number[x] for x in rows["lang"]], rows["bucket"]] = rows["n"]
    return Model(langs, counts)


def _found(model: Model, spark: SparkSession):
    """Makes the function from texts to their main language, its proportion, and all chosen ones as name:proportion."""
    shipped = spark.sparkContext.broadcast((model.langs, model.p))

    def make():
        m = Model([], np.zeros((0, BUCKETS)))
        m.langs, m.p = shipped.value

        def f(texts: pa.Array) -> list:
            found = [m.mixture(t) for t in texts.to_pylist()]
            return [[x[0][0] if x else "und" for x in found], [min(1.0, x[0][1]) if x else 0.0 for x in found], [",".join(f"{lang}:{share:.3f}" for lang, share in x) for x in found]]

        return f

    return make


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages): the main language, its proportion, and all chosen ones as name:proportion."""
    found = _found(model, df.sparkSession)
    names = ("lang_pred", "score", "languages")

    def make():
        f = found()
        return lambda batch: {"doc_id": batch.column(0)} | dict(zip(names, f(batch.column(1)), strict=True))

    return map_batches(df, {id_col: "long", text_col: "string"}, make, "doc_id long, lang_pred string, score double, languages string")


def with_language(df: DataFrame, model: Model, added: tuple[str, str, str] = ("lang_pred", "score", "languages"), text_col: str = "text") -> DataFrame:
    """df with the columns of identify() under these names, without a join."""
    return add_columns(df, text_col, _found(model, df.sparkSession), ", ".join(f"`{n}` {t}" for n, t in zip(added, ("string", "double", "string"), strict=True)))


def fold_of(id_col: str = "doc_id"):
    """crc32 of the doc_id as text, mod 4; 2 is held out."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4
