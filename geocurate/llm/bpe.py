"""Byte-level BPE with a public vocabulary: encoding by backtracking from longest matches, and decoding.

A sequence of tokens is what the merges produce just when every pair of neighbours is:
merging the bytes of the pair alone must give the pair back.  So a piece is covered from
left to right with the longest token that fits its left neighbour; where none fits, the
last token is replaced by its next shorter alternative.  The tokens of a prefix are
unique, so a position that failed once is dead for good and the work stays linear.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries of a worker's tables of pieces and of pairs; a full table is emptied, which costs time only.
MEMO = 1 << 18
#: Characters of text whose ids are held at once.
SLICE_CHARS = 1_000_000


class _Pieces(dict):
    """Piece of text -> its ids as the bytes of 32-bit integers, which join without a list of numbers."""

    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = array("i", self.coder.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _ranks(raw: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


@lru_cache(maxsize=2)
def _tokens(raw: bytes) -> dict[int, bytes]:
    """All that decoding needs of a vocabulary."""
    return {rank: token for token, rank in _ranks(raw).items()}


class Coder:
    """A vocabulary's tables, built once in each Python worker."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = _ranks(raw)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.size = {rank: len(token) for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        self.words: dict[str, int] = {}
        #: The two tokens whose merge makes a token, where merges lead to it at all.
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                halves = self.merge(token, until=2)
                if len(halves) != 2 or self.merge(token) != [rank]:
                    continue  # stands for a whole piece only
                self.halves[rank] = (halves[0], halves[1])
            self.words[token.decode("latin-1")] = rank
        for word, rank in self.words.items():
            self.automaton.add_word(word, rank)
        self.longest = max(map(len, self.words))
        #: Merges in order of rank: a token's parts are always older than itself.
        self.in_order = all(rank > max(half) or len(self.tokens[max(half)]) == 1 for rank, half in self.halves.items())
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)

    def merge(self, word: bytes, until: int = 1) -> list[int]:
        """The definition: join the neighbours of lowest rank, the leftmost first, until none can be joined."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > until:
            joined = [self.ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
            low = min(joined)
            if low == 1 << 62:
                break
            i = joined.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that were at one end of a token while it was made, newest first: (bytes, made at, ended at).

        Times are ranks of merges; single bytes are there from the start, the token itself stays.
        """
        known = self.edges.get((token, side))
        if known is None:
            known, ended, part = [], 1 << 62, token
            while part in self.halves:
                known.append((self.tokens[part], part, ended))
                ended, part = part, self.halves[part][side]
            known.append((self.tokens[part], -1, ended))
            self.edges[token, side] = known
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: no merge across the border came first."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            if self.in_order:
                known = not self._crossed(self.edge(left, 1), self.edge(right, 0))
            else:
                known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def _crossed(self, ends: list[tuple[bytes, int, int]], starts: list[tuple[bytes, int, int]]) -> bool:
        """Whether a part at the end of the left token merges with one at the start of the right one.

        Parts meet while both are there.  They merge if that merge comes before the next one
        that either takes part in; of equal ranks the leftmost merge comes first.
        """
        i = j = 0
        while i < len(ends) and j < len(starts):
            end, end_made, end_over = ends[i]
            start, start_made, start_over = starts[j]
            rank = self.ranks.get(end + start)
            if rank is not None and rank < end_over and rank <= start_over:
                return True
            if end_made > start_made:  # the newer of the two is taken apart first
                i += 1
            else:
                j += 1
        return False

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, size, fit, known = piece.decode("latin-1"), self.size, self.fit, self.words.get
        untried: dict[int, int] = {}  # at a byte, the greatest length not tried yet
        dead = bytearray(len(piece) + 1)
        chosen: list[int] = []
        at = 0
        while at < len(piece):
            length = untried.get(at, -1)
            if length < 0:
                length = self.automaton.longest_prefix(text[at:at + self.longest])
            while length:
                token = known(text[at:at + length])
                if token is not None and not dead[at + length] and (not chosen or fit(chosen[-1], token)):
                    untried[at] = length - 1
                    chosen.append(token)
                    at += length
                    break
                length -= 1
            else:
                dead[at] = 1
                at -= size[chosen.pop()]
        return chosen

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.find(text))), np.int32)


@lru_cache(maxsize=2)
def _coder(raw: bytes, pattern: str) -> Coder:
    return Coder(raw, pattern)


def read_vocabulary(path: str) -> bytes:
    """A rank file's bytes (about 1 MB), read by the driver and sent to the workers."""
    with open(path, "rb") as file:
        return file.read()


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has at most *most* units, or one row."""
    totals = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = totals[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(totals, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), values], [*kept, name])


def encode(
    df: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", checked: bool = False
) -> DataFrame:
    """Add *ids_col*, the token ids of each whole text; each match of *pattern* is encoded by itself.

    With *checked* every row is decoded at once, in the worker that encoded it, and ids that don't give the
    text's bytes back fail the query.

    A null or empty text has no ids.  Special tokens have no meaning here.  All other columns
    are kept as they are, but for one that already has the name *ids_col*, which is
    replaced.  Rows are independent: no shuffle, any text length, any number of copies.
    """
    raw = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value, pattern)
        for batch in batches:
            lengths = batch.column(text_col).cast(pa.large_string())
            sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:][:len(lengths) + 1])
            for part in _slices(batch, sizes, SLICE_CHARS):
                rows = []
                for value in part.column(text_col):
                    text = value.as_py() or ""
                    rows.append(coder.encode(text))
                    if checked and b"".join(map(coder.tokens.__getitem__, rows[-1].tolist())) != text.encode("utf-8", "surrogatepass"):
                        raise ValueError("ids don't decode to their text")
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                yield _put(part, ids_col, pa.ListArray.from_arrays(offsets, values))

    return df.mapInArrow(run, _with(df.schema, ids_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: bytes, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add *bytes_col*, the bytes that the ids stand for; null ids count as none.  An unknown id fails."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(raw.value).__getitem__
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            for part in _slices(batch, sizes, SLICE_CHARS):
                texts = [
                    b"".join(map(token, row.values.to_numpy().tolist())) if row.is_valid else b"" for row in part.column(ids_col)
                ]
                yield _put(part, bytes_col, pa.array(texts, pa.binary()))

    return df.mapInArrow(run, _with(df.schema, bytes_col, T.BinaryType()))
