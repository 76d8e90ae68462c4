"""Toxicity: lexicon terms and their misspellings, weighed by how they are used.

The lexicon is learned from labelled documents.  A Levenshtein automaton over the lexicon's
trie is run on every distinct word; its states are sets of (trie node, edits) and its
steps are remembered, so a word costs one look-up a letter.  The words around a hit tell
quotation and mention from abuse.  A logistic model turns the sums of a document into its score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocurate.llm import linear

TOXIC_FROM = 0.7
#: Most terms of a lexicon; those with the highest evidence are taken.
LEXICON_TERMS = 2_000
#: Groups of toxic documents that a term must be in, its least ratio of rates between toxic and other
#: documents, and how many standard deviations it must be above what chance gives.
LEAST_DOCS, LEAST_RATIO, LEAST_DEVIATIONS = 3, 6.0, 4.0
#: Parts of the sample for the fit of the weights.
FOLDS = 4
#: Words longer than this are no words; their ends can't hide a term.
LONGEST = 64
#: Entries of a worker's memo of words and of automaton steps; a full one is emptied, which costs time only.
MEMO = 1 << 18
#: Words on either side of a hit that are looked at.
WINDOW = 6

# Words that report what others say, and words of address, in the languages of the corpus.
REPORTING = frozenset(
    "said says wrote writes quoted quote called calls term word slur dit écrit mot terme sagte schrieb wort begriff dijo escribió palabra término"
    .split()
)
ADDRESS = frozenset("you your youre tu vous toi ton votre du dich dein ihr euch tú usted vosotros te".split())
QUOTES = frozenset("\"“”„«»‹›")
#: Letters that stand for others in disguised words.
DISGUISE = str.maketrans("013457@$", "oleastas")

WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*|[\"“”„«»‹›]")
FEATURES = ("strength", "terms", "rate", "near_strength", "near_rate", "quoted", "addressed", "words")


class Automaton:
    """All words within a few edits of the terms of a lexicon."""

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.terms = terms
        for term in sorted(terms):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children.append({})
                    self.term.append(None)
                    self.children[node][letter] = len(self.children) - 1
                node = self.children[node][letter]
            self.term[node] = term
        self.most = max(map(self.allowed, terms), default=0)
        self.reset()

    @staticmethod
    def allowed(term: str) -> int:
        """Edits that leave a term recognisable."""
        return 0 if len(term) < 5 else 1 if len(term) < 12 else 2

    def reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._number(self._skipping({0: 0}))

    def _skipping(self, state: dict[int, int]) -> dict[int, int]:
        """Add the nodes that are reached by leaving out letters of a term."""
        state = dict(state)
        waiting = list(state)
        while waiting:
            node = waiting.pop()
            if state[node] < self.most:
                for child in self.children[node].values():
                    if state.get(child, self.most + 1) > state[node] + 1:
                        state[child] = state[node] + 1
                        waiting.append(child)
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[key]

    def _step(self, number: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits < after.get(node, self.most + 1):
                after[node] = edits

        for node, edits in self.states[number].items():
            reach(node, edits + 1)  # a letter too many
            for other, child in self.children[node].items():
                reach(child, edits + (other != letter))
        self.steps[number][letter] = to = self._number(self._skipping(after))
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, the strongest of the nearest."""
        if len(self.states) > MEMO:
            self.reset()
        number = self.start
        for letter in word:
            number = self.steps[number].get(letter, -1) if letter in self.steps[number] else self._step(number, letter)
            if not self.states[number]:
                return None
        found = [
            (edits, -self.terms[term], term)
            for node, edits in self.states[number].items()
            if (term := self.term[node]) is not None and edits <= self.allowed(term)
        ]
        if not found:
            return None
        edits, _, term = min(found)
        return term, edits


class Scanner(dict):
    """Word -> (term, weight, edits) for words that match, None for others."""

    def __init__(self, terms: dict[str, float]):
        self.automaton = Automaton(terms)

    def __missing__(self, word: str) -> tuple[str, float, int] | None:
        if len(self) >= MEMO:
            self.clear()
        hit = None
        if len(word) <= LONGEST:
            found = self.automaton.match(word)
            if found is None and not word.isalpha():
                found = self.automaton.match(word.translate(DISGUISE).replace("*", ""))
            if found is not None:
                hit = (found[0], self.automaton.terms[found[0]], found[1])
            self[word] = hit
        return hit

    def describe(self, text: str | None) -> list[float]:
        words = WORD.findall((text or "").lower())
        hits = list(map(self.__getitem__, words))
        if not any(hits):
            return [0.0] * (len(FEATURES) - 1) + [math.log1p(len(words))]
        exact: dict[str, float] = {}  # a term's strength is that of its worst use, however often it is repeated
        near: dict[str, float] = {}
        count = near_count = quoted = addressed = 0.0
        inside = False  # between quotation marks
        for i, (word, hit) in enumerate(zip(words, hits)):
            if word in QUOTES:
                inside = not inside
            elif hit is not None:
                term, weight, edits = hit
                around = words[max(0, i - WINDOW):i + WINDOW + 1]
                marked = inside and any(w in QUOTES for w in words[i + 1:i + 1 + 4 * WINDOW])
                reported = marked and any(w in REPORTING for w in around)
                share = 0.25 if reported else 0.5 if marked else 1.0  # a quotation is no abuse
                into = near if edits else exact
                into[term] = max(into.get(term, 0.0), share * weight)
                count += share * (not edits)
                near_count += share * (edits > 0)
                quoted += marked
                addressed += share * (not edits) * any(w in ADDRESS for w in around)
        return [
            math.log1p(sum(exact.values())), math.log1p(len(exact)), math.log1p(1000 * count / len(words)),
            math.log1p(sum(near.values())), math.log1p(1000 * near_count / len(words)),
            math.log1p(quoted), math.log1p(addressed), math.log1p(len(words)),
        ]


def learn_lexicon(sample: DataFrame, text_col: str = "text", most: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms and their weights, from labelled rows (text, ``_label``).

    Copies of a document would lend its rare words false weight, so what is counted are the
    distinct least hashes of the words of the documents that hold a word: copies and near
    copies share theirs.  A term is a word whose smoothed rate is at least `LEAST_RATIO` times
    higher among toxic documents, and not by chance; its weight is the logarithm of that
    ratio.  At most *most* terms, those with the most evidence, reach the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    groups = (
        sample.select("_label", words.alias("words"))
        .withColumn("group", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
        .select("_label", "group", F.explode("words").alias("word")).distinct()
    )
    groups = groups.persist()
    totals = {r[0]: r[1] for r in groups.groupBy("_label").agg(F.countDistinct("group")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        groups.unpersist()
        return {}
    counts = groups.groupBy("word").agg(F.sum("_label").alias("bad"), F.sum(1 - F.col("_label")).alias("good"))
    ratio = ((F.col("bad") + 0.2) / (toxic + 1)) / ((F.col("good") + 0.2) / (other + 1))
    chance = (F.col("bad") + F.col("good")) * (toxic / (toxic + other))
    deviations = (F.col("bad") - chance) / F.sqrt(chance)
    terms = (
        counts.filter((F.col("bad") >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (deviations >= LEAST_DEVIATIONS))
        .filter(F.length("word").between(3, LONGEST))
        .select("word", F.log(ratio).alias("weight"), deviations.alias("evidence"))
        .orderBy(F.desc("evidence"), "word").limit(most)
    )
    lexicon = {r.word: r.weight for r in terms.collect()}
    groups.unpersist()
    return lexicon


def features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """Replace the column of texts by ``features``, an array of `FEATURES`; all other columns stay."""
    kept = [c for c in docs.columns if c not in (text_col, "features")]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value)
        for batch in batches:
            rows = np.array([scanner.describe(t.as_py()) for t in batch.column(text_col)], np.float64).reshape(-1, len(FEATURES))
            offsets = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
            arrays = [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(offsets, rows.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "features"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(*kept, text_col).mapInArrow(run, schema)


_scanners: dict[tuple, Scanner] = {}


def _scanner(lexicon: dict[str, float]) -> Scanner:
    """One scanner in each worker, with what it remembers."""
    key = tuple(sorted(lexicon.items()))
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(lexicon)
    return _scanners[key]


@dataclass(frozen=True)
class Judge:
    lexicon: dict[str, float]
    model: linear.Linear

    def score(self, described: DataFrame) -> Column:
        return linear.sigmoid(self.model.column([described["features"][i] for i in range(len(FEATURES))]))


def fit(rows: Iterable[tuple[list[float], int]], ridge: float = 0.3) -> linear.Linear:
    """Logistic weights; without both labels every score is the smoothed share of toxic rows."""
    rows = list(rows)
    x = np.array([r[0] for r in rows], np.float64).reshape(-1, len(FEATURES))
    y = np.array([r[1] for r in rows], np.float64)
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if not 0 < y.sum() < len(y):
        return linear.Linear((0.0,) * len(FEATURES), min(prior, -prior))
    mean, scale = linear.scaling(x)
    order = np.lexsort((*x.T, y))
    w = linear.logistic(np.column_stack([(x - mean) / scale, np.ones(len(x))])[order], y[order], ridge)
    return linear.Linear.of_scaled(w[:-1], mean, scale, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Judge:
    """Learn from the rows of *labels* with a ``toxic``, at most `linear.FIT_ROWS` of them.

    The weights are fitted to each fold of the sample with a lexicon from the other folds, so
    that they see terms as they hit in unseen documents; the lexicon that is kept is
    learned from the whole sample.
    """
    sample = linear.labelled_sample(docs.select(id_col, text_col), labels, "toxic", id_col)
    sample = sample.withColumn("_fold", F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(FOLDS))).persist()
    rows = []
    for fold in range(FOLDS):
        lexicon = learn_lexicon(sample.filter(F.col("_fold") != fold), text_col)
        unseen = features(sample.filter(F.col("_fold") == fold), lexicon, text_col)
        rows += unseen.select("features", "_label").collect()
    judge = Judge(learn_lexicon(sample, text_col), fit((list(r[0]), r[1]) for r in rows))
    sample.unpersist()
    return judge


def rate(docs: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` to the columns other than the text.

    Null and empty texts have no hits.  Rows are independent; an empty table stays empty.
    """
    described = features(docs, judge.lexicon, text_col)
    scored = described.withColumn("score", judge.score(described)).drop("features")
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
