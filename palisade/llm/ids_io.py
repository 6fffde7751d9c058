"""Operator 7: token ids in binary shards with a minimal perfect hash index.

A shard is one file, little-endian throughout:

    "PLSTOK01", then eight u64: ids, documents, keys, buckets, seed, bytes of an id (2 or 4), 0, 0
    pilots        i32 x buckets     displacement of each bucket; below 0: the one slot of a bucket with one key, as -slot - 1
    fingerprints  u32 x keys        32 further bits of the key's hash, by slot
    rows          u32 x keys        the document of the key in this shard, by slot
    offsets       u64 x (documents + 1)   where the ids of each document begin
    doc_ids       i64 x documents
    ids           raw payload

Looking a document up costs one hash, one pilot, one fingerprint and one pair of offsets, whatever the shard's size. Documents
ascend by doc_id over all shards and within each. Files are written under new names into the shared folder by tasks that return
one manifest row a file; only what the written manifest names counts, so files of lost or repeated tasks are never read.

Null text is empty text: it gives the end id alone. A null doc_id sorts first and has no key. Rows that repeat a doc_id stand side
by side in order of text, and the key leads to the first. An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, mix64, new_folder, pa_schema, written

MAGIC = b"PLSTOK01"
#: Ids after which a task begins its next shard; it bounds the memory of a task and the size of a file.
SHARD_IDS = 8_000_000
NO_KEY = np.iinfo(np.int64).min


class WordTokenizer(dict):
    """A tokenizers file whose pieces never cross white space: word -> ids as bytes, each word encoded by the library when it is first met.

    Where the file splits lower-cased words by a pattern and maps bytes, words of characters below U+0250 are split here and the
    library's model gets their pieces, each distinct one once; below U+0250 the composition that the file asks for changes nothing.
    """

    #: Words, and pieces, from which the table is begun anew.
    LIMIT = 600_000
    #: Separators for str.split() that the library takes as ordinary characters.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._model, self._pattern, self._pieces = self._t.model, _split_pattern(self._t.to_str()), {}
        self._added = [t.content.lower() for t in self._t.get_added_tokens_decoder().values()]
        self._sign = os.path.commonprefix(self._added)
        self._sign = self._sign if self._sign.upper() == self._sign else ""
        self._letters_whole = self._pattern is not None and _keeps_letters(self._pattern.pattern)
        self.width = 2 if self._t.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def whole(self, text: str) -> bytes:
        return self._packed(self._t.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _piece(self, piece: str) -> bytes:
        if (x := self._pieces.get(piece)) is None:
            if len(self._pieces) >= self.LIMIT:
                self._pieces.clear()
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
            self._pieces[piece] = x = self._packed([t.id for t in self._model.tokenize(mapped)])
        return x

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        if self._pattern is None or not word.isprintable() or not (word.isascii() or max(word) < "\u0250"):
            x = self.whole(word)
        else:
            low = word.lower()
            x = self._piece(low) if self._letters_whole and low.isascii() and low.isalpha() else b"".join(map(self._piece, self._pattern.findall(low)))
        self[word] = x
        return x

    def _holds_added(self, text: str) -> bool:
        """Whether a token that the file adds, such as one that marks an end, may stand in the text; the library takes it as one."""
        if not self._added or self._sign not in text:
            return False
        low = text.lower()
        return any(t in low for t in self._added)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out = []
        for t in texts:
            t = t or ""
            if any(c in t for c in self.ODD) or self._holds_added(t):
                out.append(self.whole(t))
            else:  # where the pattern is known the file takes no notice of case, so ASCII needs no entries for capitals
                out.append(b"".join(map(self.__getitem__, (t.lower() if self._pattern is not None and t.isascii() else t).split())))
        return out


def _split_pattern(file: str) -> regex.Pattern | None:
    """The pattern of a tokenizers file that composes, lower-cases, keeps what the pattern matches and maps bytes; else None."""
    own = json.loads(file)
    steps = [(own.get(k) or {}).get(of) or [] for k, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    if [x["type"] for x in steps[0]] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps[1]] != ["Split", "ByteLevel"]:
        return None
    blank, (split, mapped) = steps[0][1], steps[1]
    plain = blank["pattern"] == {"Regex": r"\s+"} and split["behavior"] == "Removed" and split["invert"] and not mapped["add_prefix_space"] and not mapped["use_regex"]
    return regex.compile(split["pattern"]["Regex"]) if plain and "Regex" in split["pattern"] else None


def _keeps_letters(pattern: str) -> bool:
    """Whether the pattern's alternatives make one piece of a word of letters alone: those before the one for letters begin with an apostrophe."""
    own = pattern.split("|")
    return r"[\p{L}]+" in own and all(x.startswith("'") for x in own[: own.index(r"[\p{L}]+")])


#: The characters that show bytes in byte-level files: printable Latin-1 shows itself, the rest comes from U+0100 on in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SHOWN = {b: 256 + k for k, b in enumerate(_HIDDEN)}


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


def _slot(h: np.ndarray, pilot: np.ndarray | int, n: int) -> np.ndarray:
    return (mix64(h ^ mix64(np.asarray(pilot).astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by hash and displace: buckets with more keys choose their slots first."""

    def __init__(self, n: int, seed: int, pilots: np.ndarray):
        self.n, self.seed, self.pilots = n, seed, pilots

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.int32))
        for seed in range(1000):
            h = _hashes(keys, seed)
            if len(np.unique(h)) == n and (pilots := cls._place(h, n)) is not None:
                return cls(n, seed, pilots)
        raise ValueError("keys repeat")

    @staticmethod
    def _place(h: np.ndarray, n: int) -> np.ndarray | None:
        buckets = n // 2 + 1
        of = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(buckets + 1))
        counts = np.diff(starts)
        pilots, taken = np.zeros(buckets, np.int32), np.zeros(n, bool)
        tries = np.arange(64)
        for b in np.argsort(-counts, kind="stable"):
            if counts[b] < 2:
                break
            own = h[order[starts[b] : starts[b + 1]]]
            for base in range(0, 1 << 24, 64):
                slots = np.sort(_slot(own[None, :], (tries + base)[:, None], n), axis=1)
                good = ~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    pilots[b], taken[slots[k]] = base + k, True
                    break
            else:
                return None
        singles = np.flatnonzero(counts == 1)
        pilots[singles] = -np.flatnonzero(~taken)[: len(singles)] - 1
        return pilots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot below n of each key; of another key than those it was built from, any slot."""
        h = _hashes(keys, self.seed)
        p = self.pilots[(h % np.uint64(len(self.pilots))).astype(np.int64)].astype(np.int64)
        return np.where(p < 0, -p - 1, _slot(h, np.maximum(p, 0), self.n))

    def fingerprints(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(_hashes(keys, self.seed) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(doc_ids: list[int | None], payloads: list[bytes], width: int) -> list[bytes]:
    """The parts of one shard's file."""
    keys = np.array([NO_KEY if d is None else d for d in doc_ids], dtype=np.int64)
    distinct, first = np.unique(keys, return_index=True)
    if len(distinct) and None in doc_ids:
        distinct, first = distinct[distinct != NO_KEY], first[distinct != NO_KEY]
    ph = PerfectHash.build(distinct)
    prints, rows = np.zeros(ph.n, np.uint32), np.zeros(ph.n, np.uint32)
    if ph.n:
        slots = ph.slots(distinct)
        prints[slots], rows[slots] = ph.fingerprints(distinct), first
    offsets = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum([len(p) // width for p in payloads], out=offsets[1:])
    head = np.array([offsets[-1], len(keys), ph.n, len(ph.pilots), ph.seed, width, 0, 0], dtype="<u8")
    return [MAGIC, head.tobytes(), ph.pilots.astype("<i4").tobytes(), prints.astype("<u4").tobytes(), rows.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(), keys.astype("<i8").tobytes(), *payloads]


class Shard:
    """A shard opened for keyed access: the index is read once, ids only as asked for."""

    def __init__(self, file):
        self._file = file
        head = file.read_at(72, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        n_ids, n_docs, n_keys, buckets, seed, width, *_ = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        sizes = [("<i4", buckets), ("<u4", n_keys), ("<u4", n_keys), ("<u8", n_docs + 1), ("<i8", n_docs)]
        index, at, parts = file.read_at(sum(int(t[2]) * n for t, n in sizes), 72), 0, []
        for t, n in sizes:
            parts.append(np.frombuffer(index, t, n, at))
            at += int(t[2]) * n
        pilots, self._prints, self._rows, self.offsets, self.doc_ids = parts
        self._hash, self.n_ids, self._begin, self.width = PerfectHash(n_keys, seed, pilots), n_ids, 72 + at, width

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where this shard has no such key."""
        if not self._hash.n:
            return np.full(len(keys), -1)
        slots = self._hash.slots(keys)
        rows = self._rows[slots].astype(np.int64)
        return np.where((self._prints[slots] == self._hash.fingerprints(keys)) & (self.doc_ids[rows] == keys), rows, -1)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the rows first to last, as unsigned 32-bit integers."""
        last = len(self.doc_ids) if last is None else last
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self._file.read_at((b - a) * self.width, self._begin + a * self.width), f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int) -> np.ndarray | None:
        row = int(self.rows_of(np.array([doc_id], dtype=np.int64))[0])
        return None if row < 0 else self.ids(row, row + 1)


def open_shard(uri: str) -> Shard:
    store, path = fs.FileSystem.from_uri(uri)
    return Shard(store.open_input_file(path))


def write_shards(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes the texts and writes the shards. The manifest, written beside them: (part, number, uri, n_docs, n_ids), in order by (part, number)."""
    spark = df.sparkSession
    folder = new_folder(spark, "token-ids")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    out = pa_schema(spark, schema := "part int, number int, uri string, n_docs long, n_ids long")

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        t = word_tokenizer(tokenizer_path)
        end = np.array([end_id], dtype=t.dtype).tobytes()
        docs, payloads, held = [], [], 0

        def flush():
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            name = f"shard-{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{root}/{name}") as f:
                for x in shard_bytes(docs, payloads, t.width):
                    f.write(x)
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "uri": f"{folder}/{name}", "n_docs": len(docs), "n_ids": held}], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                cut = batch.slice(at, ROWS_AT_ONCE)
                for d, x in zip(cut.column(0).to_pylist(), t.encode(cut.column(1).to_pylist()), strict=True):
                    docs.append(d)
                    payloads.append(x + end)
                    held += len(payloads[-1]) // t.width
                    if held >= shard_ids:
                        yield flush()
                        docs, payloads, held, number = [], [], 0, number + 1
        if docs:
            yield flush()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return written(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files through their index. start: ids of all documents before it.

    The manifest has one row a shard, so its running sum is small beside the data.
    """
    spark: SparkSession = manifest.sparkSession
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    n = max(1, min(10_000, manifest.count()))
    out = pa_schema(spark, schema := "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(uri)
                keys = np.array(shard.doc_ids)
                found = shard.rows_of(keys[keys != NO_KEY])
                if (found < 0).any() or (shard.doc_ids[found] != keys[keys != NO_KEY]).any():
                    raise ValueError(f"{uri}: the index does not lead to its documents")
                ids, offsets = memoryview(shard.ids()).cast("B"), shard.offsets.astype(np.int64)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=keys == NO_KEY), pa.array(offsets[:-1] + start), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], schema=out)

    return shards.repartition(n).mapInArrow(run, schema)
