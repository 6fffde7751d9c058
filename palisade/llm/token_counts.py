"""Operator 10: token counts that follow edits.

A document is kept as the lengths and token counts of its pre-tokens, in leaves of about LEAF pre-tokens, under a segment tree of
sums. An edit finds its place by descending the tree, splits pre-tokens anew from one that the edit can reach (its own context
included) until a boundary behind the edit falls on an old one, encodes only those, and updates the sums above the leaves touched.
Matches of the pre-token pattern look one character past their end, so a pre-token that ends two characters before an edit stands.

Null or empty text has no tokens; edits beyond the end apply at the end. Equal texts and edits give equal rows; a null doc_id is
passed on; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .bpe import ByteBPE, encoder
from .common import map_batches

LEAF = 64


class PieceCounts(dict):
    """Tokens of a pre-token, kept for the common ones."""

    def __init__(self, bpe: ByteBPE, limit: int = 400_000):
        super().__init__()
        self._bpe, self._limit = bpe, limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self._limit:
            self.clear()
        n = len(self._bpe.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 256:
            self[piece] = n
        return n


class CountedText:
    """A text with its token count under edits."""

    def __init__(self, text: str | None, pattern, counts: PieceCounts):
        self.text, self._pattern, self._counts, self.encoded = text or "", pattern, counts, 0
        pieces = pattern.findall(self.text)
        lengths, tokens = self._measured(pieces)
        self._plant(lengths, tokens)

    def _measured(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.encoded += len(pieces)
        return np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(self._counts.__getitem__, pieces), np.int64, len(pieces))

    def _plant(self, lengths: np.ndarray, tokens: np.ndarray) -> None:
        n = max(1, -(-len(lengths) // LEAF))
        self._leaves = [(lengths[k * LEAF : (k + 1) * LEAF], tokens[k * LEAF : (k + 1) * LEAF]) for k in range(n)]
        self._width = 1 << (n - 1).bit_length()
        self._sums = np.zeros((2 * self._width, 2), np.int64)
        if len(lengths):
            starts = np.arange(0, len(lengths), LEAF)
            self._sums[self._width : self._width + n, 0] = np.add.reduceat(lengths, starts)
            self._sums[self._width : self._width + n, 1] = np.add.reduceat(tokens, starts)
        level = self._width
        while level > 1:
            self._sums[level // 2 : level] = self._sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self._sums[1, 1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place (the last leaf at the end), and where it begins."""
        node, begin = 1, 0
        while node < self._width:
            node *= 2
            if begin + self._sums[node, 0] <= place and self._sums[node + 1, 0]:
                begin += int(self._sums[node, 0])
                node += 1
        return node - self._width, begin

    def _update(self, leaf: int) -> None:
        node = self._width + leaf
        self._sums[node] = [x.sum() for x in self._leaves[leaf]]
        while node > 1:
            node //= 2
            self._sums[node] = self._sums[2 * node] + self._sums[2 * node + 1]

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replaces the characters begin to end."""
        begin = min(max(begin, 0), len(self.text))
        end = min(max(end, begin), len(self.text))
        text = self.text[:begin] + new + self.text[end:]
        moved, behind = len(new) - (end - begin), begin + len(new)
        first, at = self._leaf_at(max(0, begin - 2))
        lengths, _ = self._leaves[first]
        ends = at + np.cumsum(lengths)
        skip = int(np.searchsorted(ends + 1, begin, side="left"))  # those that end more than one character before the edit stand
        start = at + int(lengths[:skip].sum())
        pieces, place = [], start
        leaf, k, old = first, skip, start  # an old boundary, and the pre-token behind it
        joined = False
        while place < len(text):
            m = self._pattern.match(text, place)
            pieces.append(m[0])
            place = m.end()
            if place >= behind:
                while old + moved < place and leaf < len(self._leaves):
                    own = self._leaves[leaf][0]
                    if k < len(own):
                        old += int(own[k])
                        k += 1
                    else:
                        leaf, k = leaf + 1, 0
                if old + moved == place and old >= end:
                    joined = True
                    break
        if not joined:
            leaf, k = len(self._leaves), 0
        new_lengths, new_tokens = self._measured(pieces)
        rest = [x[k:] for x in self._leaves[leaf]] if leaf < len(self._leaves) else [np.zeros(0, np.int64)] * 2
        own = [x[:skip] for x in self._leaves[first]]
        self.text = text
        if leaf == first:
            self._leaves[first] = tuple(np.concatenate(x) for x in zip(own, (new_lengths, new_tokens), rest, strict=True))
        else:
            self._leaves[first] = tuple(np.concatenate(x) for x in zip(own, (new_lengths, new_tokens), strict=True))
            for gone in range(first + 1, min(leaf, len(self._leaves))):
                self._leaves[gone] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                self._update(gone)
            if leaf < len(self._leaves):
                self._leaves[leaf] = tuple(rest)
                self._update(leaf)
        if len(self._leaves[first][0]) > 8 * LEAF:
            self._plant(*(np.concatenate([x[c] for x in self._leaves]) for c in (0, 1)))
        else:
            self._update(first)


def standard_edits(n: int) -> list[tuple[int, int, str]]:
    """The edits of the query on a text of n characters, each made on the result of the one before: an insertion at a third, a replacement in the middle, a deletion at two thirds."""
    return [(n // 3, n // 3, " inserted words"), (n // 2, n // 2 + 7, "Replaced"), (2 * n // 3, 2 * n // 3 + 11, "")]


def count_with_edits(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits=standard_edits) -> DataFrame:
    """(doc_id, n_pieces, n_tokens, n_chars_after, n_tokens_after, reencoded_pieces) of every row."""
    import regex

    def make():
        counts, compiled = PieceCounts(encoder(ranks_path, pattern)), regex.compile(pattern)

        def one(text):
            doc = CountedText(text, compiled, counts)
            pieces, tokens = doc.encoded, doc.tokens
            for edit in edits(len(doc.text)):
                doc.edit(*edit)
            return pieces, tokens, len(doc.text), doc.tokens, doc.encoded - pieces

        names = ("n_pieces", "n_tokens", "n_chars_after", "n_tokens_after", "reencoded_pieces")
        return lambda batch: {"doc_id": batch.column(0)} | dict(zip(names, zip(*(one(t) for t in batch.column(1).to_pylist()), strict=True), strict=True))

    return map_batches(df, {id_col: "long", text_col: "string"}, make, "doc_id long, n_pieces long, n_tokens long, n_chars_after long, n_tokens_after long, reencoded_pieces long")
