"""Benchmark passages in documents, verbatim or with a few edits, by q-gram filtering.

A passage within ``e`` edits of a segment of length ``L`` shares at least
``L - q + 1 - q * e`` q-grams with it (the q-gram lemma), on diagonals that differ by at
most ``e``.  So shared q-grams are counted, first in windows of the text whatever the
segment, then by segment in overlapping bands of diagonals; bands that reach the bound are
aligned, within the band, and stand if the alignment keeps the budget.

Segments are whole items, or overlapping parts of long ones, so a part of an item counts too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
#: Edits allowed in a segment, as a share of its length.
EDIT_SHARE = 0.08
#: Length of the parts of an item that is longer than a part and a fifth, and how far they are apart.
PART, STRIDE = 100, 50
#: Shorter items may be common phrases: what holds one is reported, but dropped only where the match is at least this share of the text.
SHORT, SHORT_SHARE = 40, 0.5
#: Characters of benchmark that one pass over the documents compares with; more take several passes.
PASS_CHARS = 4_000_000
#: Characters of documents that are looked at together; longer documents are cut, with an overlap.
BLOCK_CHARS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BITS = 22


def normal(text: str) -> np.ndarray:
    """Code points, lower-cased one by one, white space as one kind; positions stay those of *text*."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes <= 32) | (codes == 0xA0)] = 32
    return codes


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each position on, by doubling the length thrice."""
    h, step, power = codes.astype(np.uint64), 1, np.array([_BASE])
    while step < Q:
        h = h[:-step] * power + h[step:]
        step, power = step * 2, power * power
    return (h ^ (h >> np.uint64(29))) * _MIX


def segments(length: int) -> list[tuple[int, int]]:
    if length <= PART + PART // 5:
        return [(0, length)]
    starts = list(range(0, length - PART, STRIDE)) + [length - PART]
    return [(s, s + PART) for s in starts]


def budgets(length: np.ndarray) -> np.ndarray:
    """Edits allowed in segments: their share, but no more than leave one shared q-gram by the lemma."""
    return np.maximum(0, np.minimum((length * EDIT_SHARE).astype(np.int64), length // Q - 1))


@dataclass
class Index:
    """The q-grams of the segments of benchmark items, as sorted arrays."""

    items: np.ndarray  # item of each segment
    codes: list[np.ndarray]
    length: np.ndarray
    budget: np.ndarray
    least: np.ndarray  # shared q-grams by the lemma
    gram: np.ndarray
    gram_segment: np.ndarray
    gram_at: np.ndarray
    present: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str | None]]) -> Index:
        items, codes = [], []
        for item, text in rows:
            whole = normal(text or "")
            for start, end in segments(len(whole)):
                items.append(item)
                codes.append(whole[start:end])
        length = np.array([len(c) for c in codes], np.int64)
        budget = budgets(length)
        grams = [_grams(c) for c in codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        segment = np.repeat(np.arange(len(codes)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        present = np.zeros(1 << _BITS, bool)
        present[flat >> np.uint64(64 - _BITS)] = True
        return cls(
            np.array(items, np.int64), codes, length, budget, length - Q + 1 - Q * budget,
            flat[order], segment[order], at[order], present,
        )

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Matches in a run of characters: (segment, start, end, edits), positions in the run."""
        if not len(self.items) or len(codes) < Q:
            return []
        hashes = _grams(codes)
        hit = self.present[hashes >> np.uint64(64 - _BITS)]
        # windows of the text that hold as many known q-grams as the least demanding segment needs
        width = int((self.length + self.budget).max())
        counts = np.concatenate([[0], np.cumsum(hit)])
        after = np.minimum(np.arange(len(hit)) + width, len(hit))
        rich = (counts[after] - counts[:-1]) >= max(1, int(self.least.min()))
        if not rich.any():
            return []
        marks = np.zeros(len(hit) + 1, np.int64)
        begins = np.flatnonzero(rich)
        np.add.at(marks, begins, 1)
        np.add.at(marks, after[begins], -1)
        place = np.flatnonzero(hit & (np.cumsum(marks[:-1]) > 0))
        low = np.searchsorted(self.gram, hashes[place], "left")
        many = np.searchsorted(self.gram, hashes[place], "right") - low
        place, low, many = place[many > 0], low[many > 0], many[many > 0]
        entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        segment = self.gram_segment[entry]
        diagonal = np.repeat(place, many) - self.gram_at[entry]
        # any diagonals that differ by the budget at most lie together in one of the overlapping bands
        step = int(self.budget.max()) + 1
        band = (diagonal + 4 * width) // step
        bands = 8 + (len(codes) + 8 * width) // step
        key, shared = np.unique(np.concatenate([segment * bands + band, segment * bands + band - 1]), return_counts=True)
        good = shared >= np.maximum(1, self.least[key // bands])
        segment, first = key[good] // bands, (key[good] % bands) * step - 4 * width
        return self._verify(codes, segment, first, 2 * step)

    def _verify(self, codes: np.ndarray, segment: np.ndarray, first: np.ndarray, wide: int) -> list[tuple[int, int, int, int]]:
        if not len(segment):
            return []
        pad = int(self.length.max()) + wide + 2 * int(self.budget.max()) + 2
        padded = np.concatenate([np.zeros(pad, np.uint32), codes, np.zeros(2 * pad, np.uint32)])
        slack = int(self.budget.max())
        lengths = self.length[segment]
        pattern = np.full((len(segment), int(lengths.max())), 1, np.uint32)
        for row, s in enumerate(segment):
            pattern[row, :lengths[row]] = self.codes[s]
        begin = first - slack
        region = padded[np.clip(begin + pad, 0, len(padded) - 1)[:, None] + np.arange(pattern.shape[1] + wide + 2 * slack).clip(0)]
        edits, end = _align(pattern, lengths, region, wide + 2 * slack)
        fine = edits <= self.budget[segment]
        if not fine.any():
            return []
        segment, begin, lengths, edits, end = segment[fine], begin[fine], lengths[fine], edits[fine], end[fine]
        # the same alignment backwards, from its end, finds the start
        column = np.arange(pattern.shape[1])
        back = np.take_along_axis(pattern[fine], (lengths[:, None] - 1 - column).clip(0), 1)
        where = begin[:, None] + end[:, None] - 1 - np.arange(pattern.shape[1] + wide + 2 * slack) + pad
        _, size = _align(back, lengths, padded[where.clip(0, len(padded) - 1)], 2 * slack + 1)
        start = begin + end - size
        return list(zip(segment.tolist(), start.tolist(), (begin + end).tolist(), edits.tolist()))


def _align(pattern: np.ndarray, lengths: np.ndarray, region: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each pattern and any part of its region that starts in the band, and where that part ends.

    Cell k of a row stands for column row + k, so a band is a fixed number of cells.  All
    patterns advance together, row by row.
    """
    cells = np.arange(band + 1)
    row = np.zeros((len(pattern), band + 1), np.int64)  # a match may start anywhere in the band
    best = np.full(len(pattern), 1 << 30, np.int64)
    end = np.zeros(len(pattern), np.int64)
    for i in range(pattern.shape[1]):
        width = min(band + 1, region.shape[1] - i)
        text = np.zeros((len(pattern), band + 1), np.uint32)
        text[:, :width] = region[:, i:i + width]
        change = row + (text != pattern[:, i:i + 1])
        skip = np.full_like(row, 1 << 29)
        skip[:, :-1] = row[:, 1:] + 1  # a character of the pattern without partner
        new = np.minimum(change, skip)
        row = np.minimum.accumulate(new - cells, axis=1) + cells  # characters of the text without partner
        done = np.flatnonzero(lengths == i + 1)
        if len(done):
            at = row[done].argmin(axis=1)
            best[done], end[done] = row[done, at], i + 1 + at
    return best, end


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Runs of (row, offset in the row, code points) of at most about `BLOCK_CHARS`; long texts overlap by two widest matches."""
    block, size, overlap = [], 0, 4 * PART
    for row, text in enumerate(texts):
        codes = normal(text)
        for offset in range(0, max(1, len(codes) - overlap), BLOCK_CHARS):
            piece = codes[offset:offset + BLOCK_CHARS + overlap]
            block.append((row, offset, piece))
            size += len(piece)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


@dataclass
class Benchmark:
    """Indexes of long and of short items, so that short ones don't weaken the filter, and items too short for a q-gram."""

    indexes: list[Index]
    whole: dict[bytes, list[int]]
    chars: dict[int, int]

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str | None]]) -> Benchmark:
        rows = [(item, text, len(normal(text or ""))) for item, text in rows]
        short = [(i, t) for i, t, n in rows if Q <= n < SHORT]
        whole: dict[bytes, list[int]] = {}
        for item, text, n in rows:
            bare = _bare(normal(text or ""))
            if n < Q and len(bare):
                whole.setdefault(bare.tobytes(), []).append(item)
        chars: dict[int, int] = {}
        for item, _, n in rows:  # of rows with one id the longest counts
            chars[item] = max(n, chars.get(item, 0))
        return cls([Index.of([(i, t) for i, t, n in rows if n >= SHORT]), Index.of(short)], whole, chars)


def _bare(codes: np.ndarray) -> np.ndarray:
    """*codes* without white space at both ends."""
    at = np.flatnonzero(codes != 32)
    return codes[at[0]:at[-1] + 1] if len(at) else codes[:0]


def find(benchmark: Benchmark, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item) -> (start, end, edits): the span of an item's matches and the fewest edits of one."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def add(row: int, item: int, span: tuple[int, int, int]) -> None:
        old = found.get((row, item), span)
        found[row, item] = (min(old[0], span[0]), max(old[1], span[1]), min(old[2], span[2]))

    gap = np.zeros(Q, np.uint32)
    for block in _blocks(texts):
        starts = np.cumsum([0] + [len(p) + Q for _, _, p in block])
        run = np.concatenate([x for _, _, p in block for x in (p, gap)])
        for index in benchmark.indexes:
            for segment, start, end, edits in index.search(run):
                which = int(np.searchsorted(starts, (start + end) // 2, "right")) - 1
                row, offset, piece = block[which]
                first, last = max(0, start - int(starts[which])), min(len(piece), end - int(starts[which]))
                add(row, int(index.items[segment]), (offset + first, offset + last, edits))
    if benchmark.whole:
        for row, text in enumerate(texts):
            codes = normal(text)
            for item in benchmark.whole.get(_bare(codes).tobytes(), ()) if len(codes) else ():
                add(row, item, (0, len(codes), 0))
    return found


def drops(benchmark: Benchmark, texts: list[str]) -> set[int]:
    """Rows that hold a long item or a part of one, or a short item as a good part of the text."""
    return {
        row for (row, item), (start, end, _) in find(benchmark, texts).items()
        if benchmark.chars[item] >= SHORT or end - start >= SHORT_SHARE * len(texts[row])
    }


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, pass_chars: int) -> Iterator[Broadcast[Benchmark]]:
    """Indexes over the benchmark, part by part, so that what is sent at once is bounded."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = items.filter("text IS NOT NULL AND item IS NOT NULL")
    passes = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // pass_chars))
    for turn in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == turn)
        yield context.broadcast(Benchmark.of(sorted((int(i), t) for i, t in part.collect())))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """Rows (id, item, start, end, edits, item_chars) of every document that holds a benchmark item or a part of one.

    Positions are code points of the whole text, the end exclusive; they span all matching
    parts.  Case and kinds of white space don't count as edits.  Items of any length count; those shorter
    than `Q` characters only as the whole text, but for white space around it.  ``item_chars`` is the item's length,
    by which common phrases can be told.  Null or blank texts and items match nothing.  Rows with a null id are
    reported under it; repeated rows are reported each.  Other columns are not read.

    No shuffle.  The benchmark goes to every task, `PASS_CHARS` characters of it in a pass
    over the documents, so what is broadcast is bounded whatever its size.
    """
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, item_id bigint, start bigint, end bigint, edits bigint, item_chars bigint"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, pass_chars):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = find(index.value, ["" if t is None else t for t in batch.column(1).to_pylist()])
                keys = sorted(found)
                columns = [ids.take(pa.array([r for r, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.int64())]
                columns += [pa.array([found[k][n] for k in keys], pa.int64()) for n in range(3)]
                columns.append(pa.array([index.value.chars[i] for _, i in keys], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "item_id", "start", "end", "edits", "item_chars"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaky(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """The rows of *docs* that don't leak, with their columns, without a join.

    A row leaks if `leaks` finds an item of at least `SHORT` characters or a part of one, or a shorter item whose match is
    at least `SHORT_SHARE` of the text.
    """
    for index in _indexes(benchmark, item_col, item_text_col, pass_chars):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[list(drops(index.value, ["" if t is None else t for t in batch.column(text_col).to_pylist()]))] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
