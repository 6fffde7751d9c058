"""Operator 8: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1, so one pyahocorasick automaton over the whole vocabulary finds, in one pass, the longest token that
begins at each byte. Encoding takes longest matches from the left and backtracks to shorter ones where two neighbouring tokens
could not both come out of the merges; whether a pair can is worked out once and memoised. The result is what merging by rank
gives, in time linear in the piece. Pieces are the matches of the pre-token pattern; they repeat, so ids are kept by word.

Null or empty text: no ids. Ties and repeated rows: equal texts give equal ids. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_batches


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Words(dict):
    """ids of a word, found by `encode` when first asked for. When full, what has been asked for since the last time stays one time more."""

    def __init__(self, encode, limit: int = 150_000):
        super().__init__()
        self._encode, self._limit, self._old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        x = self._old.get(word)
        if x is None:
            x = self._encode(word)
        if len(word) <= 256:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[word] = x
        return x


class ByteBPE:
    """Encoder and decoder for a table of ranks; ids travel as little-endian unsigned 32-bit integers."""

    #: Pairs of neighbours whose compatibility is kept.
    MEMO = 250_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        top = max(ranks.values()) + 1
        self._size = [0] * top
        for t, i in ranks.items():
            self._size[i] = len(t)
        self._piece, self._chunk = regex.compile(pattern), regex.compile(r"\s*\S+|\s+")
        self._automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), i)
        self._automaton.make_automaton()
        self._shorter = [-1] * top
        for t, i in ranks.items():
            self._shorter[i] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1)
        self._halves: dict[int, tuple[int, int]] = {}
        self._joined: dict[tuple[int, int], int] = {}
        self._pairs: dict[int, bool] = {}
        self._learn_merges()
        self._after_space = _Words(lambda w: self._encode_chunk(" " + w if w[:1] != "\n" else w))
        self._alone = _Words(self._encode_chunk)

    def _learn_merges(self) -> None:
        """The two tokens that each token is merged from, in order of rank."""
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            left = self._shorter[i]
            while left >= 0:
                right = self.ranks.get(token[self._size[left] :])
                if right is not None and left < i and right < i and self._together(left, right):
                    self._halves[i], self._joined[left, right] = (left, right), i
                    break
                left = self._shorter[left]

    def _together(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves left and right side by side: undo merges from the latest, and no pair across the seam may have been due earlier."""
        bound = 1 << 60
        while True:
            if self._joined.get((left, right), bound) < bound:
                return False
            undo_left = left in self._halves and (left > right or right not in self._halves)
            if not undo_left and right not in self._halves:
                return True
            if left > right:
                if left in self._halves:
                    bound, left = left, self._halves[left][1]
                else:
                    bound, right = right + 1, self._halves[right][0]
            elif right in self._halves:
                bound, right = right + 1, self._halves[right][0]
            else:
                bound, left = left, self._halves[left][1]

    def _fit(self, left: int, right: int) -> bool:
        """_together, kept."""
        if len(self._pairs) >= self.MEMO:
            self._pairs.clear()
        known = self._pairs[left << 32 | right] = self._together(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        size, shorter, pairs, n = self._size, self._shorter, self._pairs, len(piece)
        longest = [0] * n
        for end, i in self._automaton.iter(piece.decode("latin-1")):
            longest[end - size[i] + 1] = i  # ends ascend, so the longest is written last
        open_at = bytearray(b"\x01") * (n + 1)  # 0: no encoding of the rest begins here
        out: list[int] = []
        at, token, last = 0, longest[0] if n else -1, -1
        while at < n:
            end = at + size[token]
            if open_at[end]:
                fits = last < 0
                if not fits:
                    fits = pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self._fit(last, token)
                if fits:
                    out.append(token)
                    at, last = end, token
                    token = longest[at] if at < n else -1
                    continue
            token = shorter[token]
            while token < 0:  # nothing shorter: the last token was wrong
                open_at[at] = 0
                wrong = out.pop()
                at -= size[wrong]
                token, last = shorter[wrong], out[-1] if out else -1
        return out

    def _encode_chunk(self, chunk: str) -> bytes:
        ids, ranks = array("I"), self.ranks
        for piece in self._piece.findall(chunk):
            own = piece.encode("utf-8", "surrogatepass")
            known = ranks.get(own)
            if known is None:
                ids.extend(self.encode_piece(own))
            else:
                ids.append(known)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text. No piece reaches from a letter over the white space after it, so white space with the word behind it can be encoded by itself."""
        if not text:
            return b""
        if text.replace("\n", " ").split(" ") == text.split():  # words with one blank or line end between them
            first, *rest = text.replace("\n", " \n").split(" ")
            return self._alone[first] + b"".join(map(self._after_space.__getitem__, rest))
        return b"".join(map(self._alone.__getitem__, self._chunk.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE(read_ranks(path), pattern)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary): ids as little-endian unsigned 32-bit integers."""

    def make():
        bpe = encoder(ranks_path, pattern)

        def f(batch):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return f

    return map_batches(df, {id_col: "long", text_col: "string"}, make, "doc_id long, n_tokens long, ids binary")


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of the ids that encode_documents() made."""

    def make():
        bpe = encoder(ranks_path, pattern)
        return lambda batch: {"doc_id": batch.column(0), "decoded": [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]}

    return map_batches(df, {id_col: "long", ids_col: "binary"}, make, "doc_id long, decoded binary")


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, so the ids never travel between processes."""

    def make():
        bpe = encoder(ranks_path, pattern)

        def f(batch):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }

        return f

    return map_batches(df, {id_col: "long", text_col: "string"}, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
