"""Phrase collocations by best-first branch and bound.

Words are counted first, then the pairs whose words are both frequent enough; every pair is a
prefix that may grow, and a part that longer phrases are cut into.  A phrase of three words
can't score more than its prefix and its suffix allow (``f(prefix) / f(first word)`` and
``f(suffix) / f(last word)``), so the pairs are expanded best bound first: a round counts the
triples that could reach a language's present threshold, and those that could displace a pair above it.  A
language is settled when enough phrases above its threshold survive; the others get a lower one.

Counting runs on 64-bit keys of (language, word) that are proven free of collisions for the
corpus at hand; phrases are tuples of keys, so every count is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geocurate.llm.common import release
from geocurate.llm.words import mixed
from geocurate.runtime import stage

# What parts a text into pieces, and a piece into words.
DELIMITERS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
#: Language of documents without one.
NO_LANGUAGE = "und"
#: Bytes of text that are looked at at once; a longer text is cut between its pieces.
SLICE_BYTES = 2_000_000
#: Distinct phrases that a task holds before it hands their counts on.
HELD = 1 << 20
#: Cells of the filters that are sent to the tasks, as a power of two: 2 MB for words, 16 MB for pairs.  Words or
#: pairs that share a cell cost work, never results.
CELL_BITS = 24
#: A round's threshold is the score of the pair with this many times the limit before it; then four times as many.
FIRST_AIM, NEXT_AIM = 2, 4
#: Hash functions that are tried before equal keys of unlike words are an error.
SEEDS = 4

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(DELIMITERS)] = 2
_MASK = np.uint64((1 << CELL_BITS) - 1)
_TURN = np.uint64(0x9E3779B97F4A7C15)


# -- words of a slice of texts ----------------------------------------------------


@dataclass
class _Words:
    """The words of some texts: keys, piece numbers, and where they are."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    pieces: np.ndarray
    texts: np.ndarray


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end between two pieces."""
    start = 0
    while len(raw) - start > SLICE_BYTES:
        limit = start + SLICE_BYTES
        end = max(raw.rfind(bytes([c]), start + 1, limit) for c in DELIMITERS)
        if end < 0:
            end = min((at for c in DELIMITERS if (at := raw.find(bytes([c]), limit)) >= 0), default=len(raw))
        yield raw[start:end]
        start = end
    yield raw[start:]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    """Lower-cased texts and their languages, about `SLICE_BYTES` at a time."""
    texts, languages, size = [], [], 0
    for text, language in zip(batch.column(1).cast(pa.large_binary()), batch.column(0).to_pylist()):
        for part in _parts((text.as_py() or b"").lower()):  # bytes: A-Z only
            texts.append(part)
            languages.append(NO_LANGUAGE if language is None else language)
            size += len(part)
            if size >= SLICE_BYTES:
                yield texts, languages
                texts, languages, size = [], [], 0
    if texts:
        yield texts, languages


class _Reader:
    """Keys of words by one hash function."""

    def __init__(self, seed: int):
        self.base = np.uint64(int.from_bytes(blake2b(b"base %d" % seed, digest_size=8).digest()) | 1)
        self.powers = np.ones(1, np.uint64)
        self.seeds: dict[str, int] = {}
        self.seed = seed

    def _language(self, name: str) -> int:
        if name not in self.seeds:
            self.seeds[name] = int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8, salt=b"%d" % self.seed).digest())
        return self.seeds[name]

    def words(self, texts: list[bytes], languages: list[str]) -> _Words:
        raw = b"\n".join(texts)
        codes = np.frombuffer(raw, np.uint8)
        kind = _KIND[codes]
        solid = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        sizes = ends - starts
        longest = int(sizes.max(initial=0))
        if longest > len(self.powers):
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * longest, self.base, np.uint64))])
        inside = np.flatnonzero(solid[1:-1])
        parts = (codes[inside].astype(np.uint64) + np.uint64(1)) * self.powers[np.repeat(ends, sizes) - inside - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts)])
        total = np.concatenate([[0], np.cumsum(sizes)])
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        text = np.searchsorted(begins, starts, "right") - 1
        of_language = np.array([self._language(name) for name in languages], np.uint64)
        keys = mixed(mixed(sums[total[1:]] - sums[total[:-1]]) + of_language[text])
        return _Words(raw, starts, ends, keys.view(np.int64), np.cumsum(kind == 2)[starts] if len(starts) else starts, text)


def _tally(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal rows of *columns* as one, with the sum of their counts and where the first of them was."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, counts, order
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first), order[first]


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(a.view(np.uint64) * _TURN + b.view(np.uint64)) & _MASK).astype(np.int32)


# -- counts over the corpus -------------------------------------------------------


def _word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(key, lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(seed)
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            columns = [pa.array(list(held), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64())))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "lang", "word", "n"])

        for batch in batches:
            for texts, languages in _slices(batch):
                w = reader.words(texts, languages)
                (keys,), counts, first = _tally([w.keys], np.ones(len(w.keys), np.int64))
                spans = zip(keys.tolist(), counts.tolist(), w.starts[first].tolist(), w.ends[first].tolist(), w.texts[first].tolist())
                for key, n, start, end, text in spans:
                    row = held.get(key)
                    if row is None:
                        held[key] = [languages[text], w.raw[start:end], n]
                    elif row[1] == w.raw[start:end] and row[0] == languages[text]:
                        row[2] += n
                    else:  # unlike words with one key: both go out, and are found below
                        yield out()
                        held[key] = [languages[text], w.raw[start:end], n]
                if len(held) >= HELD // 4:
                    yield out()
        yield out()

    counted = docs.mapInArrow(run, "key long, lang string, word binary, n long")
    return counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _phrase_counts(docs: DataFrame, seed: int, size: int, chosen: Callable[[list[np.ndarray]], np.ndarray], least: int) -> DataFrame:
    """(k0, k1, ..., n) of the phrases of *size* words that *chosen* picks by their keys and that occur *least* times."""
    names = [f"k{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(seed)
        held, counts = [np.zeros(0, np.int64)] * size, np.zeros(0, np.int64)
        for batch in batches:
            for texts, languages in _slices(batch):
                w = reader.words(texts, languages)
                n = max(0, len(w.keys) - size + 1)
                at = np.flatnonzero(w.pieces[:n] == w.pieces[size - 1:]) if n else np.zeros(0, np.int64)
                at = at[chosen([w.keys[at + i] for i in range(size)])]
                found, more, _ = _tally([w.keys[at + i] for i in range(size)], np.ones(len(at), np.int64))
                held, counts = [np.concatenate(pair) for pair in zip(held, found)], np.concatenate([counts, more])
                if len(counts) >= HELD:
                    held, counts, _ = _tally(held, counts)
                    if len(counts) >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(counts)], [*names, "n"])
                        held, counts = [np.zeros(0, np.int64)] * size, np.zeros(0, np.int64)
        held, counts, _ = _tally(held, counts)
        yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(counts)], [*names, "n"])

    counted = docs.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _bits(words: DataFrame) -> np.ndarray:
    """A bit per cell that holds the key of one of *words*; at most 2^`CELL_BITS` cells reach the driver."""
    cells = words.select(F.col("key").bitwiseAND(F.lit(int(_MASK))).cast("int").alias("cell")).distinct().toArrow()
    marks = np.zeros(1 << CELL_BITS, bool)
    marks[cells.column("cell").to_numpy()] = True
    return np.packbits(marks)


def _flags(pairs: DataFrame) -> np.ndarray:
    """The flags of the pairs (k0, k1, flag) of each cell, united; at most 2^`CELL_BITS` cells reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(batch.column("k0").to_numpy(), batch.column("k1").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column("flag")], ["cell", "flag"])

    cells = pairs.select("k0", "k1", "flag").mapInArrow(run, "cell int, flag int").groupBy("cell").agg(F.bit_or("flag").alias("flag")).toArrow()
    flags = np.zeros(1 << CELL_BITS, np.uint8)
    flags[cells.column("cell").to_numpy()] = cells.column("flag").to_numpy()
    return flags


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exact up to counts of 10^15."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


# -- growth -----------------------------------------------------------------------

#: Flags of a pair: it grows as a prefix, as a suffix, or it is above the threshold itself.
_GROWS, _ENDS, _CONTENDS, _COUNTS = 1, 2, 4, 8


def _score_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """*pairs* with their language, their words' counts and their scores."""
    of = lambda i, *more: words.select(F.col("key").alias(f"k{i}"), F.col("n").alias(f"n{i}"), *more)
    joined = pairs.join(of(0, "lang"), "k0").join(of(1), "k1")
    return joined.select("lang", "k0", "k1", "n", "n0", "n1", score(F.col("n"), F.col("n0"), F.col("n1")).alias("score"))


def _thresholds(scored: DataFrame, limit: int, aim: int, open_languages: DataFrame | None) -> DataFrame:
    """(lang, least): the score of the pair at the rank aimed at, 0 where there are fewer."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), "k0", "k1")
    some = scored if open_languages is None else scored.join(open_languages, "lang", "left_semi")
    top = some.select("lang", "score", "k0", "k1").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit * aim)
    return top.groupBy("lang").agg(F.when(F.count(F.lit(1)) == limit * aim, F.min("score")).otherwise(0).alias("least"))


def _grown(docs: DataFrame, seed: int, scored: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """The triples that could reach their language's threshold, or displace a pair above it, with the cut that counts.

    *scored* are pairs with ``least_score``.  The bounds follow from the counts of a triple's parts: a part occurs at least as
    often as the whole.
    """
    bound = lambda n: F.floor(F.col("n") * 1_000_000 / F.col(n)) + 1 >= F.col("least_score")  # noqa: E731  + 1: the quotient is rounded
    flag = lambda condition, bit: F.when(condition, bit).otherwise(0)
    flagged = scored.withColumn(
        "flag",
        F.lit(_COUNTS) + flag(bound("n0"), _GROWS) + flag(bound("n1"), _ENDS) + flag(F.col("score") >= F.col("least_score"), _CONTENDS),
    )
    sent = docs.sparkSession.sparkContext.broadcast(_flags(flagged))

    def chosen(keys: list[np.ndarray]) -> np.ndarray:
        before, after = sent.value[_cells(keys[0], keys[1])], sent.value[_cells(keys[1], keys[2])]
        both = (before & _COUNTS != 0) & (after & _COUNTS != 0)
        return both & ((before & _GROWS != 0) & (after & _ENDS != 0) | ((before | after) & _CONTENDS != 0))

    triples = stage(_phrase_counts(docs, seed, 3, chosen, least), "triples").df
    sent.unpersist()
    before = scored.select("k0", "k1", "lang", F.col("n").alias("n01"), F.col("n0"), "least_score")
    after = scored.select(F.col("k0").alias("k1"), F.col("k1").alias("k2"), F.col("n").alias("n12"), F.col("n1").alias("n2"))
    joined = triples.join(before, ["k0", "k1"]).join(after, ["k1", "k2"])
    first, second = score(F.col("n"), F.col("n0"), F.col("n12")), score(F.col("n"), F.col("n01"), F.col("n2"))
    cut = joined.withColumn("_1", first).withColumn("_2", second)
    lower = F.col("_2") < F.col("_1")
    return cut.select(
        "lang", "k0", "k1", "k2", "n", F.when(lower, F.col("n01")).otherwise(F.col("n0")).alias("l"),
        F.when(lower, F.col("n2")).otherwise(F.col("n12")).alias("r"), F.least("_1", "_2").alias("score"), "least_score",
    )


def _survivors(scored: DataFrame, triples: DataFrame, share: int) -> DataFrame:
    """Phrases above their threshold that no longer candidate displaces."""
    inside = F.explode(F.array(F.struct("k0", "k1"), F.struct(F.col("k1").alias("k0"), F.col("k2").alias("k1"))))
    longer = triples.select("n", inside.alias("p")).groupBy("p.k0", "p.k1").agg(F.max("n").alias("longer"))
    above = F.col("score") >= F.col("least_score")
    pairs = scored.filter(above).join(longer, ["k0", "k1"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * share)
    )
    return pairs.select(
        "lang", "k0", "k1", F.lit(None).cast("long").alias("k2"), "n", F.col("n0").alias("l"), F.col("n1").alias("r"), "score"
    ).unionByName(triples.filter(above).drop("least_score"))


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, limit: int = 2000, share: int = 50
) -> DataFrame:
    """The first *limit* phrases of two or three words of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase occurs at least *least* times (``a``); ``n`` is the language's number of words, ``l`` and ``r`` the counts of the
    parts of the cut that scores lowest.  Phrases inside a longer candidate that occurs at least *share* percent as
    often are left out.  Order: score, then ``a``, both falling, then the phrase.

    Null texts count as empty and give nothing, null languages count as `NO_LANGUAGE`; repeated rows count as often as they
    come; texts of any length are taken whole; an empty table gives no rows.  Other columns are not read.

    Each task adds up its own counts before the shuffle, so a phrase that every document holds
    costs no more than any other.  Words, pairs and triples are stored tables.
    """
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    for seed in range(SEEDS):
        all_words = stage(_word_counts(docs, seed), "words").df
        if all_words.groupBy("key").count().filter("count > 1").isEmpty():
            break
    else:
        raise ArithmeticError("unlike words share their keys under every hash function")
    totals = stage(all_words.groupBy("lang").agg(F.sum("n").alias("words")), "word_totals").df
    words = stage(all_words.filter(F.col("n") >= least), "frequent_words").df
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_bits(words))

    def both(keys: list[np.ndarray]) -> np.ndarray:
        cells = [(k.view(np.uint64) & _MASK).astype(np.int64) for k in keys]
        marks = [frequent.value[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 for c in cells]
        return (marks[0] & marks[1]).astype(bool)

    scored = stage(_score_pairs(stage(_phrase_counts(docs, seed, 2, both, least), "pairs").df, words), "scored_pairs").df
    frequent.unpersist()
    release(spark)
    aim, open_languages, settled = FIRST_AIM, None, None
    while True:
        thresholds = stage(_thresholds(scored, limit, aim, open_languages), "thresholds").df
        if thresholds.isEmpty():
            break
        here = stage(scored.join(thresholds.withColumnRenamed("least", "least_score"), "lang"), "frontier").df
        triples = stage(_grown(docs, seed, here, words, least), "scored_triples").df
        found = stage(_survivors(here, triples, share), "survivors").df
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
        state = stage(thresholds.join(enough, "lang", "left").select("lang", ((F.col("least") == 0) | (F.col("_n") >= limit)).alias("done")), "settled").df
        done = found.join(state.filter("done"), "lang", "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        open_languages = state.filter("NOT coalesce(done, false)").select("lang")
        aim *= NEXT_AIM
        release(spark)
    if settled is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    spelled = settled
    for i in range(3):
        word = words.select(F.col("key").alias(f"k{i}"), F.col("word").cast("string").alias(f"w{i}"))
        spelled = spelled.join(word, f"k{i}", "left" if i == 2 else "inner")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = (
        spelled.select("lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
        .withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    )
    return ranked.join(totals.withColumnRenamed("words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
