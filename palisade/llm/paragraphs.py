"""Operator 3: passages that repeat across documents, removed from all but the first.

A paragraph is a run of words, and it is looked for in two ways. Every line of at least WINDOW words is one: it has MinHash bands
over its five-word shingles, tuned for high recall at the limit; lines that share a band are candidates, confirmed by the exact
Jaccard similarity of their shingles, and the confirmed are clustered by connected components. And every run of WINDOW words is one,
wherever it begins: its band is the least hash of the runs of PRINT_WORDS words within it, one value for some sixteen neighbouring
runs, so only runs whose band another document has are compared, each by its whole content. Runs that overlap add up, so a repeated
passage is found to its true ends, whatever lines or sentences it begins and ends in.

What a document of lower doc_id has, exactly (runs) or nearly (lines), is removed; nothing shorter than WINDOW words is, so common
short lines and sentences stay. Of the documents with a passage the first (the least doc_id) keeps it. Whole texts that are equal
are compared once, as one text.

Null or empty text stays as it is. Repetition within one document is left alone. Rows that repeat a doc_id count as one document,
also where their texts differ, but each text has its own passages. Rows with a null doc_id are never changed. A document that is
removed whole stays as a row with empty text. An empty table gives no rows. All other columns pass through, but for columns named
as the two that are added, which these replace.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bound_batches, differing_bits, discard, least_values_of, lists, low_bits, map_batches, mix64, most_differing, shingle_hashes, slices, words_of, written
from .components import link_similar, shared_buckets

SHINGLE_WORDS, PERCENT = 5, 80
#: Words from which a repeated run or line is a passage; of the runs within it whose least hash is its band (PIECE times PIECES).
WINDOW, PIECE, PIECES = 50, 5, 4
PRINT_WORDS = PIECE * PIECES
#: Columns that name a text: several texts may have one doc_id.
ROW = ["doc_id", "version"]
ADDED = ("removed_words", "repeated_words")


def tune_bands(limit: float, recall: float, rows: int) -> tuple[int, int]:
    """(bands, rows): the least bands of so many rows that find a pair at the limit with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - limit**rows)), rows


BANDS, ROWS = tune_bands(PERCENT / 100, 0.9995, rows=4)
#: Least values of a line, the first of which make its bands; the lowest bits of all rule out most pairs below the limit.
VALUES, LOSS = 128, 3e-7
_rng = np.random.default_rng(31)
_MULTIPLY = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_BAND = mix64(np.arange(7, 7 + BANDS, dtype=np.uint64))
_PLACE = mix64(np.arange(77, 77 + ROWS, dtype=np.uint64)) | np.uint64(1)


def line_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of all rows that are long enough to be passages: row, first word (of all) and number of words."""
    n = len(words.begin)
    rows = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    line = np.searchsorted(np.flatnonzero(words.data == 0x0A), words.begin) + rows
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(line)) + 1, [n])) if n else np.zeros(1, np.int64)
    begin, size = cuts[:-1], np.diff(cuts)
    long = size >= WINDOW
    return rows[begin[long]], begin[long], size[long]


def line_sets(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each line, one line's behind the other's, and where each line's begin, and the last end."""
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    each = size - SHINGLE_WORDS + 1
    line = np.repeat(np.arange(len(begin)), each)
    at = np.arange(len(line)) + np.repeat(begin - np.cumsum(each) + each, each)
    s = shingle_hashes(hashes, SHINGLE_WORDS)[at]
    order = np.lexsort((s, line))
    s, line = s[order], line[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (line[1:] != line[:-1])))
    s, line = s[new], line[new]
    return s, np.searchsorted(line, np.arange(len(begin) + 1))


def line_bands(least: np.ndarray) -> np.ndarray:
    """The bands of each row of least values."""
    own = least[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    return mix64((mix64(own) * _PLACE).sum(axis=2, dtype=np.uint64) ^ _BAND).view(np.int64)


def _runs(x: np.ndarray, words: int, factor: np.uint64) -> np.ndarray:
    """A hash of each run of so many words, from x, the hashes of runs of PIECE words."""
    n = len(x) + PIECE - words
    out = x[:n]
    for k in range(PIECE, words, PIECE):
        out = mix64(out * factor + x[k : k + n])
    return out


def prints(hashes: np.ndarray) -> np.ndarray:
    """For each run of WINDOW words, in order, the least hash of its runs of PRINT_WORDS words."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    least, width, whole = _runs(shingle_hashes(hashes, PIECE), PRINT_WORDS, _PLACE[0]), 1, WINDOW - PRINT_WORDS + 1
    while 2 * width <= whole:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < whole:
        least = np.minimum(least[: width - whole], least[whole - width :])
    return least.view(np.int64)


def windows(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of WINDOW words, in order."""
    return _runs(shingle_hashes(hashes, PIECE), WINDOW, _PLACE[1]).view(np.int64) if len(hashes) >= WINDOW else np.zeros(0, np.int64)


def _of_rows(words: Words) -> list[slice]:
    """Where the runs of WINDOW words of each row lie among those of all words."""
    return [slice(a, max(a, b - WINDOW + 1)) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def _version(text: Column) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text.cast("string")).alias("version")


_NAMES = "doc_id long, version long"
_TYPES = dict.fromkeys(ROW, "long") | {"text": "string"}


def outlines(docs: DataFrame) -> DataFrame:
    """Of each text: its size, the distinct prints of its runs, and of its lines the place, the size of the set, a key, bands and bits."""

    def f(batch):
        words = words_of(batch.column(2))
        least_of_runs = prints(words.hashes)
        row, begin, size = line_runs(words)
        sets, ends = line_sets(words.hashes, begin, size)
        least = least_values_of(sets, ends, _MULTIPLY, _ADD)
        keys = np.array([xxhash.xxh3_64_intdigest(words.hashes[a : a + n].tobytes()) for a, n in zip(begin.tolist(), size.tolist(), strict=True)], np.uint64).view(np.int64)
        lines = np.searchsorted(row, np.arange(batch.num_rows + 1))
        listed = lambda values, kind, per=1: pa.ListArray.from_arrays(pa.array((lines * per).astype(np.int32)), pa.array(values.reshape(-1), kind))
        long, int_ = pa.int64(), pa.int32()
        return {
            "doc_id": batch.column(0), "version": batch.column(1), "chars": np.diff(words.offset), "words": np.diff(words.first), "prints": lists([np.unique(least_of_runs[own]) for own in _of_rows(words)], long),
            "places": listed(np.stack([begin - words.first[row], size], axis=1).astype(np.int32), int_, 2), "ns": listed(np.diff(ends).astype(np.int32), int_), "keys": listed(keys, long),
            "bands": listed(line_bands(least), long, BANDS), "bits": listed(low_bits(least), long, VALUES // 64),
        }

    kinds = "chars long, words long, prints array<long>, places array<int>, ns array<int>, keys array<long>, bands array<long>, bits array<long>"
    return map_batches(docs, _TYPES, lambda: f, f"{_NAMES}, {kinds}")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key several documents have, with the least of these as lo."""
    return rows.join(rows.groupBy(key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"), key)


def _lines(outline: DataFrame) -> DataFrame:
    """(doc_id, version, pos, len, n, key, bands, bits) of every line."""
    i, per = F.col("i"), VALUES // 64
    each = outline.filter("size(keys) > 0").select("*", F.explode(F.sequence(F.lit(0), F.size("keys") - 1)).alias("i"))
    return each.select(
        *ROW, F.col("places")[2 * i].alias("pos"), F.col("places")[2 * i + 1].alias("len"), F.col("ns")[i].alias("n"), F.col("keys")[i].alias("key"),
        F.slice("bands", i * BANDS + 1, F.lit(BANDS)).alias("bands"), F.slice("bits", i * per + 1, F.lit(per)).alias("bits"),
    )


def _details(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For the texts that wanted names: place and hash of each run whose print is wanted, and the shingles of each wanted line."""

    def f(batch):
        words = words_of(batch.column(2))
        least, own = prints(words.hashes), windows(words.hashes)
        wanted_prints = lambda row: np.zeros(0, np.int64) if (p := batch.column(3)[row].values) is None else p.to_numpy()
        places = [np.flatnonzero(np.isin(least[x], wanted_prints(row))) for row, x in enumerate(_of_rows(words))]
        at, size = (c.to_pylist() for c in batch.columns[4:6])
        begin = np.array([first + a for first, row in zip(words.first.tolist(), at) for a in row or ()], np.int64)
        sets, ends = line_sets(words.hashes, begin, np.array([n for row in size for n in row or ()], np.int64))
        lines = np.cumsum([0, *(len(row or ()) for row in at)]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64)))
        return {
            "doc_id": batch.column(0), "version": batch.column(1), "places": lists([p.astype(np.int32) for p in places], pa.int32()), "hashes": lists([own[x][p] for x, p in zip(_of_rows(words), places, strict=True)], pa.int64()),
            "nodes": batch.column(6), "sets": pa.ListArray.from_arrays(pa.array(lines), each),
        }

    types = _TYPES | {"prints": "array<long>", "line_pos": "array<int>", "line_len": "array<int>", "nodes": "array<long>"}
    return map_batches(docs.join(wanted, ROW), types, lambda: f, f"{_NAMES}, places array<int>, hashes array<long>, nodes array<long>, sets array<array<long>>")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, version, whole_later, whole_first, marks) of the texts of docs (doc_id, text) that hold passages of other documents.

    marks: the passages by first word and number of words; later: an earlier document has it. whole_*: the same of the whole text.
    """
    docs = docs.select("doc_id", "text", _version(F.col("text")))
    outline = written(outlines(docs), "outlines")
    ids = outline.select(*ROW, "chars", "words").distinct()
    classes = ids.groupBy("version", "chars").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    copies = written(ids.join(classes, ["version", "chars"]).select(*ROW, (F.col("doc_id") == F.col("lo")).alias("first"), (F.expr("lo < hi") & (F.col("words") >= WINDOW)).alias("copied")), "copies")
    own = outline.join(copies.filter("first").select(*ROW), ROW, "left_semi")

    prints = written(own.select(*ROW, F.explode("prints").alias("print")), "prints")
    lines = written(_lines(own), "lines")
    discard(outline)
    distinct = lines.groupBy("key").agg(F.min(F.struct(*ROW, "pos", "len", "n", "bits", "bands")).alias("x")).select("key", "x.*")
    nodes = written(distinct, "distinct-lines")
    members = shared_buckets(nodes.select(F.explode("bands").alias("bucket"), F.col("key").alias("node")))
    met = written(members.select(F.col("node").alias("key")).distinct(), "met-lines")
    infos = written(nodes.join(met, "key", "left_semi").select(F.col("key").alias("node"), "n", "bits", *ROW, "pos", "len"), "line-infos")

    line_wants = infos.groupBy(*ROW).agg(F.collect_list(F.struct("pos", "len", "node")).alias("w"))
    run_wants = _shared(prints, "print").groupBy(*ROW).agg(F.collect_set("print").alias("prints"))
    wanted = run_wants.join(line_wants, ROW, "full").select(*ROW, "prints", F.col("w.pos").alias("line_pos"), F.col("w.len").alias("line_len"), F.col("w.node").alias("nodes"))
    details = written(_details(docs, wanted), "details")
    discard(prints, nodes, met)

    runs = details.select(*ROW, F.explode(F.arrays_zip("places", "hashes")).alias("x")).select(*ROW, F.col("x.places").alias("pos"), F.col("x.hashes").alias("hash"))
    in_runs = _shared(runs, "hash").select(*ROW, "pos", F.lit(WINDOW).alias("len"), (F.col("doc_id") > F.col("lo")).alias("later"))
    sets = details.select(F.explode(F.arrays_zip("nodes", "sets")).alias("x")).select(F.col("x.nodes").alias("node"), F.col("x.sets").alias("elements"))
    in_lines = _similar(lines, members, infos.select("node", "n", "bits"), sets)
    marks = in_runs.unionByName(in_lines).groupBy(*ROW).agg(F.collect_list(F.struct("pos", "len", "later")).alias("marks"))
    whole = copies.filter("copied").select(*ROW, (~F.col("first")).alias("whole_later"), F.col("first").alias("whole_first"))
    out = written(marks.join(whole, ROW, "full").select(*ROW, F.coalesce("whole_later", F.lit(False)).alias("whole_later"), F.coalesce("whole_first", F.lit(False)).alias("whole_first"), "marks"), "marks")
    discard(copies, lines, members, infos, details)
    return out


def _similar(lines: DataFrame, members: DataFrame, infos: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, version, pos, len, later) of the lines whose component of equal and near copies several documents have."""
    most = most_differing(PERCENT / 100, VALUES, LOSS)

    def plausible(a: str, b: str) -> Column:
        n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
        return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & (differing_bits(f"bits_{a}", f"bits_{b}", VALUES) <= most)

    comp = link_similar(members, infos, sets, PERCENT, plausible)
    of = lines.select(*ROW, "pos", "len", "key").join(comp.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    return _shared(of, "comp").select(*ROW, "pos", "len", (F.col("doc_id") > F.col("lo")).alias("later"))


def cut_runs(words: Words, row: int, cut: np.ndarray) -> str:
    """The row's text without the words marked in cut, and without the white space that only they needed."""
    own = words.of(row)
    origin = int(words.offset[row])
    text = words.data[origin : words.offset[row + 1]].tobytes()
    begins, ends, n = words.begin[own] - origin, words.end[own] - origin, len(cut)
    out, at = [], 0
    edges = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0)).tolist()
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        begin, end = int(begins[a]) if a else 0, int(begins[b]) if b < n else len(text)
        # behind the rest of a line its end stays
        if 0 < a and b < n and b"\n" in text[ends[b - 1] : end] and b"\n" not in text[ends[a - 1] : begin]:
            begin, end = int(ends[a - 1]), int(ends[b - 1])
        out.append(text[at:begin])
        at = end
    return (b"".join(out) + text[at:]).decode()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str] = ADDED) -> DataFrame:
    """df with repeated passages cut from text_col, and two columns: removed_words (the words cut) and repeated_words (also those kept
    here, as the first document with the passage); no other column changes."""
    names = [c for c in df.columns if c.lower() not in {x.lower() for x in added}]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("doc_id is not null and text <> ''")
    free = "__"
    while any(c.lower().startswith(free) for c in names):
        free += "_"
    flags = ("whole_later", "whole_first")
    m = "marks"
    found = repeats(docs).select(*(F.col(c).alias(free + c) for c in (*ROW, *flags)), *(F.col(f"{m}.{c}").alias(free + c) for c in ("pos", "len", "later")))
    own = (F.col(f"`{id_col}`").cast("long") == F.col(free + "doc_id")) & (_version(F.col(f"`{text_col}`")) == F.col(free + "version"))
    joined = df.join(found, own, "left").drop(*(free + c for c in ROW))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    at = names.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                columns = batch.columns[: len(names)]
                later, first, pos, size, is_later = batch.columns[len(names) :]
                words = words_of(columns[at].cast(pa.string()))
                texts, removed, repeated = columns[at].to_pylist(), [], []
                for row, (all_later, all_first) in enumerate(zip(later.to_pylist(), first.to_pylist(), strict=True)):
                    n = int(words.first[row + 1] - words.first[row])
                    cut, seen = np.full(n, bool(all_later)), np.full(n, bool(all_later or all_first))
                    if pos[row].is_valid:
                        begin, long, mark = (c[row].values.to_numpy(zero_copy_only=False) for c in (pos, size, is_later))
                        cut |= _covered(begin[mark], long[mark], n)
                        seen |= _covered(begin, long, n)
                    if cut.any():
                        texts[row] = cut_runs(words, row, cut)
                    removed.append(int(cut.sum()))
                    repeated.append(int(seen.sum()))
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(repeated, pa.int64())], names=[*names, *added])

    bound_batches(df.sparkSession)
    return joined.toDF(*(f"c{k}" for k in range(len(joined.columns)))).mapInArrow(run, schema)  # a name may hold dots


def _covered(begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the runs hold."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + size, -1)
    return np.cumsum(change[:n]) > 0
