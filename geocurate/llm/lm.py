"""Language model scores by a hierarchical Pitman-Yor process.

Contexts are restaurants: a token's context is the word before it, or the start of its text,
and every pair that was seen has its place, however rare.  All contexts share one parent
restaurant, whose base is uniform over the vocabulary and one unknown word.  Customers are tokens;
which of them share a table is drawn by Gibbs sampling, and every table of a context is a
customer of the parent.

Pairs, words (the parent's dishes) and restaurants are tables.  Pairs seen once have one table
whatever is drawn, so a sweep joins the other pairs with the totals of their restaurant and the
counts of their word, draws all of them given the state after the sweep before (each
without its own tables), and ends in new totals.  Probabilities are averaged over the samples that are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocurate.llm.common import HEAVY_SHARE, join_lookup, release
from geocurate.llm.words import MIX, mixed, word_hashes
from geocurate.runtime import Stage, stage

#: A word that makes up one token in so many is a heavy context (no more than this): its probabilities
#: are sent to every task, those of the others are joined.
CONTEXT_SHARE = 200
#: A word that makes up one token in so many is sent to every task with its probabilities in the heavy
#: contexts, and so is a pair that does (no more of each than this); the others meet their probabilities by a join.
COMMON_SHARE = 40_000
#: Sweeps before the first sample that is kept, and samples kept.
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Customers of one dish in one restaurant up to which their tables are drawn in one exact step.
EXACT = 128
#: Stands for the end of a text, and no word hashes to it (hashes of words are made odd).
END = np.uint64(0)
_CHUNK = 1 << 19


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, lower-cased for A-Z, and the end."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = word_hashes(raw) | np.uint64(1) if raw else np.zeros(0, np.uint64)
    return np.concatenate([words, np.array([END])])


def contexts_of(hashes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """For each token the number of the last context word before it, 0 at the start; *contexts* is sorted.

    The model's contexts are the words just before (`before`); this is for callers that skip words.
    """
    if not len(contexts):
        return np.zeros(len(hashes), np.int64)
    at = np.searchsorted(contexts, hashes).clip(max=len(contexts) - 1)
    own = np.where(contexts[at] == hashes, at + 1, 0)
    last = np.maximum.accumulate(np.where(own > 0, np.arange(len(own)), -1))
    before = np.concatenate([[-1], last[:-1]])
    return np.where(before >= 0, own[before], 0)


def before(hashes: np.ndarray) -> np.ndarray:
    """For each token the word before it; `END`, which comes before nothing, stands for the start."""
    return np.concatenate([[END], hashes[:-1]])


def _counted(docs: DataFrame) -> DataFrame:
    """(u, w, c): counts of words w after u, summed for every few million tokens before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            w = np.concatenate(parts)
            u = np.concatenate([before(x) for x in parts])
            order = np.lexsort((w, u))
            u, w = u[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
            counts = np.diff(np.append(first, len(w)))
            return pa.RecordBatch.from_arrays([pa.array(u[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(counts)], ["u", "w", "c"])

        parts, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                parts.append(tokens(text.as_py()))
                size += len(parts[-1])
                if size >= 4 * _CHUNK:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return docs.select("text").mapInArrow(run, "u long, w long, c long").groupBy("u", "w").agg(F.sum("c").alias("c"))


@lru_cache(maxsize=4)
def _table_weights(discount: float) -> np.ndarray:
    """Row c: logarithms of the generalised Stirling numbers, the weight of all seatings of c customers at t tables."""
    weights = np.full((EXACT + 1, EXACT + 1), -np.inf)
    weights[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, EXACT):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + weights[c]
            weights[c + 1, 1:] = np.logaddexp(stay[1:], weights[c, :-1])
    return weights


def _uniform(noise: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the row and the step only, so a task that is run again draws the same."""
    return (mixed(noise + np.array([step + 1], np.uint64) * MIX) >> np.uint64(11)) * 2.0**-53


def _binomial(n: np.ndarray, chance: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """The binomial quantile of *uniform*, by adding up the odds from 0; for small expected numbers."""
    out = np.where(chance >= 1, n, 0)
    going = np.flatnonzero((chance < 1) & (n > 0))
    odds = np.exp(n[going] * np.log1p(-chance[going]))
    total, ratio = odds.copy(), chance[going] / (1 - chance[going])
    k = 0
    while True:
        more = (uniform[going] > total) & (k < n[going]) & (odds > 1e-18)
        going, odds, total, ratio = going[more], odds[more], total[more], ratio[more]
        if not len(going):
            return out
        odds = odds * (n[going] - k) / (k + 1) * ratio
        total, k = total + odds, k + 1
        out[going] = k


def seat(c: np.ndarray, new_table: np.ndarray, discount: float, noise: np.ndarray) -> np.ndarray:
    """Draw the number of tables of c customers who all eat one dish; *noise* is a random integer of each row.

    ``new_table`` is what a new table weighs for that dish.  Up to `EXACT` customers the draw
    is from the exact conditional distribution over all seatings; further ones arrive in groups of
    a 32nd at most, and how many of a group open a table is drawn (`_binomial`) given those before.
    """
    tables, uniform = np.minimum(c, 1), _uniform(noise, 0)
    weights = _table_weights(discount)
    few = np.minimum(c, EXACT)
    order = np.argsort(few, kind="stable")
    cuts = np.searchsorted(few[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        for begin in range(cuts[n], cuts[n + 1], _CHUNK // n):  # bounds memory
            rows = order[begin:min(begin + _CHUNK // n, cuts[n + 1])]
            score = weights[n, 1:n + 1] + np.log(new_table[rows])[:, None] * np.arange(1, n + 1)
            odds = np.exp(score - score.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[rows] = 1 + (odds < uniform[rows, None] * odds[:, -1:]).sum(axis=1).clip(max=n - 1)
    many = np.flatnonzero(c > EXACT)
    seated = np.full(len(many), EXACT)
    step = 0
    while len(many):
        step += 1
        weight = new_table[many]
        chance = np.clip(weight / np.maximum(seated - discount * tables[many] + weight, 1e-12), 0, 1)
        # no group expects more than a few tables, which keeps the draw short and the chance near enough
        most = np.maximum(np.minimum(seated // 32, 8 / np.maximum(chance, 1e-9)), 1).astype(np.int64)
        group = np.minimum(most, c[many] - seated)
        tables[many] += _binomial(group, chance, _uniform(noise[many], step))
        seated = seated + group
        going = seated < c[many]
        many, seated = many[going], seated[going]
    return tables


@dataclass
class Totals:
    """Customers and tables of the start and the heavy contexts, and of the parent."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    vocabulary: int
    discount: float
    root_discount: float

    @property
    def uniform(self) -> float:
        return 1.0 / (self.vocabulary + 1)

    @property
    def root_new(self) -> float:
        return (STRENGTH + self.root_discount * self.root_tables) * self.uniform

    def back_off(self) -> np.ndarray:
        """What each context leaves to the parent."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)


#: A word's customers and tables in the parent by sample; a restaurant's tables by sample.
_BY_SAMPLE = [f"{kind}_{s}" for s in range(SAMPLES) for kind in ("c0", "t0")]
_TABLES = [f"tables_{s}" for s in range(SAMPLES)]
_PAIR = ["u", "w", "c", "t", "sum_t"]


def _drawn_pairs(rows: DataFrame, now: Totals, seed: int, kept: bool) -> DataFrame:
    """Pairs with tables drawn anew, given (tables, c0, t0) of their restaurant and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(n).to_numpy() for n in (*_PAIR, "tables", "c0", "t0")}
            t = x["t"]
            dish = x["w"].view(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
            noise = mixed(mixed(dish) + (x["u"].view(np.uint64) + np.uint64(1)) * MIX)
            c0 = x["c0"] - t
            rest0 = np.minimum(x["t0"], c0)
            base = (c0 - now.root_discount * rest0 + now.root_new) / (STRENGTH + now.root_customers - t)
            t = seat(x["c"], (STRENGTH + now.discount * np.maximum(x["tables"] - t, 0)) * base, now.discount, noise)
            made = [x["u"], x["w"], x["c"], t, x["sum_t"] + t if kept else x["sum_t"]]
            yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], _PAIR)

    return rows.select(*_PAIR, "tables", "c0", "t0").mapInArrow(run, ", ".join(f"{n} long" for n in _PAIR))


def _drawn_words(words: DataFrame, now: Totals, seed: int) -> DataFrame:
    """Words with their tables in the parent drawn anew from their customers there."""
    names = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            dish = columns["w"].to_numpy().view(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
            new0 = (STRENGTH + now.root_discount * np.maximum(now.root_tables - columns["t0"].to_numpy(), 0)) * now.uniform
            columns["t0"] = pa.array(seat(columns["c0"].to_numpy(), new0, now.root_discount, mixed(dish)))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return words.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _with_made(rows: DataFrame, pairs: DataFrame, key: str, name: str) -> DataFrame:
    """Set column *name* to the tables of the key's pairs: one for each seen once, and those drawn."""
    made = pairs.groupBy(key).agg(F.sum("t").alias("_made"))
    return rows.join(made, key, "left").withColumn(name, F.col("alone") + F.coalesce("_made", F.lit(0))).drop("_made")


def _looked_up(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join with a stored table (one row per key, its size in ``dishes``) as in `join_lookup`."""
    total = lookup.agg(F.sum("dishes")).first()[0] or 0
    is_heavy = F.col("dishes") * HEAVY_SHARE >= F.lit(total)
    heavy, light = F.broadcast(lookup.filter(is_heavy)).drop("dishes"), lookup.filter(~is_heavy).drop("dishes")
    return rows.join(heavy, key).unionByName(
        rows.join(heavy.select(key), key, "left_anti").join(light.hint("merge"), key, "left")
    )


def _discount(ones: int, twos: int) -> float:
    """The usual estimate from how many dishes have one customer and two."""
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones + twos else 0.5


@dataclass
class Model:
    """Stored tables of the words, the pairs (u, w, c, sum_t) and the restaurants; the heavy contexts, and the totals of the samples kept."""

    words: Stage
    pairs: Stage
    houses: Stage
    contexts: np.ndarray
    samples: list[Totals]
    trained: int
    vocabulary: int

    def base(self, count: Column) -> Column:
        return F.log10((count + 1) / F.lit(float(self.trained + self.vocabulary + 1)))

    def parent(self, s: int, c0: Column, t0: Column) -> Column:
        """Probability of a word in the parent restaurant, by one sample; of an unknown one with zeros."""
        x = self.samples[s]
        return (c0 - F.lit(x.root_discount) * t0 + F.lit(x.root_new)) / F.lit(STRENGTH + x.root_customers)

    def probability(self, ctx: Column) -> Column:
        """Average over the samples, for a row of a word (or none) and the number of the start (0) or of a heavy context."""
        zero = F.lit(0).cast("long")
        total = F.when(
            F.array_contains("ctx", ctx), F.element_at("direct", F.array_position("ctx", ctx).cast("int"))
        ).otherwise(F.lit(0.0))
        for s, sample in enumerate(self.samples):
            left = F.element_at(F.array(*map(F.lit, sample.back_off().tolist())), ctx + 1)
            c0, t0 = (F.coalesce(f"{kind}_{s}", zero) for kind in ("c0", "t0"))
            total = total + left * self.parent(s, c0, t0) / len(self.samples)
        return total


    def joined_probability(self) -> Column:
        """The same for a row of a pair joined with its word, its restaurant and its counts, each of which may be missing."""
        zero, n, first = F.lit(0).cast("long"), len(self.samples), self.samples[0]
        customers = F.coalesce("customers", zero)
        total = F.coalesce((F.col("c") - F.lit(first.discount) * F.col("sum_t") / n) / (F.lit(STRENGTH) + customers), F.lit(0.0))
        for s, name in enumerate(_TABLES):
            left = (F.lit(STRENGTH) + F.lit(first.discount) * F.coalesce(name, zero)) / (F.lit(STRENGTH) + customers)
            c0, t0 = (F.coalesce(f"{kind}_{s}", zero) for kind in ("c0", "t0"))
            total = total + left * self.parent(s, c0, t0) / n
        return total

    def pair_scores(self, wanted: DataFrame) -> DataFrame:
        """Rows (u, w) of a stored table, each once, with score, base and whether the word is known; other columns stay."""
        words = self.words.df.select("w", "c_all", "dishes", *_BY_SAMPLE)
        with_w = stage(_looked_up(wanted, words, "w"), "wanted_words")
        with_u = stage(_looked_up(with_w.df, self.houses.df.select("u", "customers", "dishes", *_TABLES), "u"), "wanted_houses")
        with_w.drop()
        release(wanted.sparkSession)
        scored = stage(with_u.df.join(self.pairs.df, ["u", "w"], "left").select(
            *wanted.columns, F.log10(self.joined_probability()).alias("pair_score"),
            self.base(F.coalesce("c_all", F.lit(0))).alias("pair_base"), F.col("c_all").isNotNull().cast("long").alias("pair_known"),
        ), "pair_scores")
        with_u.drop()
        release(wanted.sparkSession)
        return scored.df


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Learn from all rows of *docs*; what is kept between sweeps are stored tables."""
    spark = docs.sparkSession
    counted = stage(_counted(docs.select(F.col(text_col).alias("text"))), "pair_counts")
    counts = counted.df
    release(spark)  # here and below: finished shuffles would pile up on disk
    of_pairs = [
        F.sum("c").alias("customers"), F.count(F.lit(1)).alias("dishes"),
        F.count_if(F.col("c") == 1).alias("alone"), F.count_if(F.col("c") > 1).alias("drawn"),
    ]
    one = F.lit(1).cast("long")
    houses = stage(counts.groupBy("u").agg(*of_pairs).withColumn("tables", F.col("dishes")), "houses")
    words = stage(
        counts.groupBy("w").agg(*of_pairs).withColumnRenamed("customers", "c_all").withColumns({"c0": F.col("dishes"), "t0": one}), "words"
    )
    trained, vocabulary, dishes, word_ones, word_twos = words.df.agg(
        F.coalesce(F.sum("c_all"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("dishes"), F.lit(0)),
        F.count_if(F.col("c_all") == 1), F.count_if(F.col("c_all") == 2),
    ).first()
    ones, twos = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount, root_discount = _discount(ones, twos), _discount(word_ones, word_twos)
    frequent = words.df.filter((F.col("c_all") * CONTEXT_SHARE >= trained) & (F.col("w") != int(END))).select("w").collect()
    contexts = np.sort(np.array([r[0] for r in frequent], np.int64).view(np.uint64))
    numbers = {int(u): i for i, u in enumerate([0, *contexts.view(np.int64)])}
    nobody = np.zeros(len(numbers))

    totals = Totals(nobody, nobody, float(dishes), float(vocabulary), vocabulary, discount, root_discount)
    pairs = stage(counts.filter("c > 1").withColumns({"t": one, "sum_t": F.lit(0).cast("long")}), "pairs")
    samples = []
    for sweep in range(BURN_IN + SAMPLES):
        sample = sweep - BURN_IN if sweep >= BURN_IN else None
        old = [pairs, words, houses]
        joined = stage(join_lookup(pairs.df, houses.df.select("u", "tables", "drawn"), "u", "drawn").select(*_PAIR, "tables"), "pairs_joined")
        both = join_lookup(joined.df, words.df.select("w", "c0", "t0", "drawn"), "w", "drawn")
        pairs = stage(_drawn_pairs(both, totals, sweep, sample is not None), "pairs")
        tables, parent = _with_made(houses.df, pairs.df, "u", "tables"), _drawn_words(_with_made(words.df, pairs.df, "w", "c0"), totals, sweep)
        if sample is not None:
            tables = tables.withColumn(f"tables_{sample}", F.col("tables"))
            parent = parent.withColumns({f"{kind}_{sample}": F.col(kind) for kind in ("c0", "t0")})
        houses, words = stage(tables, "houses"), stage(parent, "words")
        for done in (*old, joined):
            done.drop()
        release(spark)
        sums = words.df.agg(F.sum("c0"), F.sum("t0")).first()
        totals = Totals(nobody, nobody, float(sums[0] or 0), float(sums[1] or 0), vocabulary, discount, root_discount)
        if sample is not None:
            samples.append(totals)

    heavy = houses.df.filter(F.col("u").isin(list(numbers))).collect()
    customers = np.array([next((r.customers for r in heavy if r.u == u), 0) for u in numbers], float)
    for name, sample in zip(_TABLES, samples):
        sample.customers = customers
        sample.tables = np.array([next((r[name] for r in heavy if r.u == u), 0) for u in numbers], float)
    seen = stage(counts.filter("c = 1").withColumn("sum_t", F.lit(SAMPLES).cast("long")).unionByName(pairs.df.drop("t")), "pairs_seen")
    told = spark.createDataFrame([(u, i, c) for (u, i), c in zip(numbers.items(), customers.tolist())], "u long, at int, customers double")
    direct = (F.col("c") - F.lit(discount) * F.col("sum_t") / SAMPLES) / (F.lit(STRENGTH) + F.col("customers"))
    lists = seen.df.join(F.broadcast(told), "u").groupBy("w").agg(F.collect_list(F.struct("at", direct.alias("direct"))).alias("_in"))
    finished = words.df.select("w", "c_all", "dishes", *_BY_SAMPLE).join(lists, "w", "left").withColumns(
        {"ctx": F.col("_in.at"), "direct": F.col("_in.direct")}
    ).drop("_in")
    final = stage(finished, "words")
    for done in (counted, words, pairs):
        done.drop()
    release(spark)
    return Model(final, seen, houses, contexts, samples, trained, vocabulary)


def _common(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the common words: sorted hashes, base scores, and scores by heavy context; `COMMON_SHARE` rows at most."""
    chosen = model.words.df.filter(F.col("c_all") * COMMON_SHARE >= model.trained)
    places = range(len(model.contexts) + 1)
    told = chosen.select(
        "w", model.base(F.col("c_all")).alias("base"),
        F.array(*(F.log10(model.probability(F.lit(i))) for i in places)).alias("by_context"),
    ).toArrow()
    w = told.column("w").to_numpy().view(np.uint64)
    order = np.argsort(w)
    by_context = told.column("by_context").combine_chunks().flatten().to_numpy().reshape(len(w), len(places))
    return w[order], told.column("base").to_numpy()[order], by_context[order]


def _pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(u) + w * MIX)


def _common_pairs(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the common pairs: sorted keys, base scores and scores; `COMMON_SHARE` rows at most."""
    chosen = model.pairs.df.filter(F.col("c") * COMMON_SHARE >= model.trained).select("u", "w")
    told = model.pair_scores(stage(chosen, "common_pairs").df).toArrow()
    keys = _pair_keys(*(told.column(n).to_numpy().view(np.uint64) for n in ("u", "w")))
    order = np.argsort(keys)
    return keys[order], told.column("pair_base").to_numpy()[order], told.column("pair_score").to_numpy()[order]


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of *keys*, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys).clip(max=len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row of *docs*: logarithms of base 10 of its probability.

    A null or empty text is its end alone.  Repeated rows are scored each.  Common words after
    heavy contexts and common pairs are scored where the text is read; all others are scored once for each
    pair of words and joined, so no table of the whole vocabulary is sent around.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_common(model), _common_pairs(model), model.contexts))
    names = ["_row", "id", "n_tokens", "n_known", "base", "score", "u", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, base, by_context), (pairs, pair_base, pair_score), contexts = shared.value
        for batch in batches:
            sizes, known, bases, scores, rare, where = [], [], [], [], [], []
            for text in batch.column(2):
                w = tokens(text.as_py())
                u = before(w)
                ctx, is_heavy = _found(contexts, u)
                ctx, is_heavy = np.where(is_heavy, ctx + 1, 0), is_heavy | (u == END)
                at, here = _found(common, w)
                here &= is_heavy
                in_pairs, paired = _found(pairs, _pair_keys(u, w))
                paired &= ~here
                left = ~here & ~paired
                sizes.append(len(w))
                known.append(len(w) - int(left.sum()))
                bases.append(base[at[here]].sum() + pair_base[in_pairs[paired]].sum())
                scores.append(by_context[at[here], ctx[here]].sum() + pair_score[in_pairs[paired]].sum())
                rare.append(w[left].view(np.int64))
                where.append(u[left].view(np.int64))
            offsets = np.zeros(len(rare) + 1, np.int32)
            np.cumsum([len(x) for x in rare], out=offsets[1:])
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                pa.array(bases, pa.float64()), pa.array(scores, pa.float64()),
                pa.ListArray.from_arrays(offsets, np.concatenate(where + empty)), pa.ListArray.from_arrays(offsets, np.concatenate(rare + empty)),
            ], names)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "_row long, id long, n_tokens long, n_known long, base double, score double, u array<long>, w array<long>"
    parts = stage(rows.mapInArrow(run, kinds), "scored_parts").df  # row numbers stay as they are from here on
    rare = parts.select("_row", F.inline(F.arrays_zip("u", "w")))
    wanted = stage(rare.groupBy("u", "w").agg(F.count(F.lit(1)).alias("n")), "wanted_pairs")
    release(docs.sparkSession)
    scored = model.pair_scores(wanted.df)
    wanted.drop()
    sums = join_lookup(rare, scored, ["u", "w"], "n").groupBy("_row").agg(
        F.sum("pair_score").alias("rare_score"), F.sum("pair_base").alias("rare_base"), F.sum("pair_known").alias("rare_known")
    )
    return parts.drop("u", "w").join(sums, "_row", "left").select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def perplexity(scored: DataFrame) -> Column:
    """Perplexity a token of rows of `score`, as an aggregate."""
    return F.pow(F.lit(10.0), -F.sum(scored["score"]) / F.sum(scored["n_tokens"]))
