"""Similarity join on word shingles: documents whose shingle sets have a Jaccard index of 0.8 or more.

Two sets of sizes a and b with overlap o link when 9 * o >= 4 * (a + b).

1.  Equal sets are one class, represented by its smallest id; only representatives go on.
2.  Linked sets share one of their first fifth of shingles, in any fixed order.  The order puts
    frequent shingles last, so documents that only share a common passage don't meet.
    Each such shingle is the key of a block of documents.
3.  Every document of a block is compared with the block's smallest id.  This joins most
    of what belongs together, at a cost linear in the size of a group.
4.  Blocks that still hold several components, one of each set of documents, are searched by an R-tree: shingles are hashed
    into groups, their counts by group are a document's point, and the sum of the coordinates'
    minima bounds the overlap, with a single point as with the corner of a tree's box.
    Pairs that survive and aren't in one component yet are verified.

Candidates are verified on the words themselves.  Steps 2 and 4 lose no link, whatever the
frequencies; step 3 only saves work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.llm.common import components, join_lookup, release
from geocurate.llm.words import MIX, mixed, word_hashes
from geocurate.runtime import stage

WORDS = 5
#: Coordinates of a document's point.  Unrelated sets of n shingles are told apart up to n = 26 * GROUPS.
GROUPS = 128
#: Documents with a shingle from which on it goes last in the order.
FREQUENT = 8
#: Bits of the filter that says which shingles are frequent: 2 MB, whatever the corpus.  A shingle that
#: is taken for a frequent one by mistake is only moved in the order.
FILTER_BITS = 1 << 24
#: Buckets of ids in the broadcast that thins out texts before they are joined by id: 2^20 numbers at most.
ID_BUCKETS = 1 << 20
#: Points of one R-tree; larger blocks are cut, and every pair of their parts is searched.
TREE_POINTS = 2048
LEAF = 32
#: Rows that the blocks with one smallest id have together before they are cut: a task's share of all rows or half of what
#: all others must meet, so that copies stay in proportion; but no less than the first number and no more than the second.
ROUTE_ROWS, MOST_ROUTE_ROWS = 2048, 1 << 16
#: Pairs that a task of the search holds before it counts how often each met.
HELD_PAIRS = 1 << 20
#: Pairs that meet one copy of a text in a task of the verification.
PAIRS_A_COPY = 500
#: Bytes of text that are hashed together.
SLICE = 1 << 21

def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str | None) -> set[tuple[bytes, ...]]:
    """The set itself: distinct runs of five words; of fewer words, all as one; of none, empty."""
    words = words_of(text)
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WORDS))))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The set as sorted distinct 64-bit hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    w = word_hashes(raw) if raw else np.zeros(0, np.uint64)
    if not len(w):
        return w
    if len(w) < WORDS:
        w = np.concatenate([w, np.full(WORDS - len(w), 1 + len(w), np.uint64)])
    total = np.zeros(len(w) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        total = total * MIX + w[i:len(w) - WORDS + 1 + i]
    return np.unique(mixed(total))


def prefix_length(n: int) -> int:
    """Shingles that two linked sets must share one of: all but the least overlap, and one more."""
    return n - (4 * n + 4) // 5 + 1


def _rest(n: np.ndarray) -> np.ndarray:
    """Shingles behind the first part."""
    return (4 * n + 4) // 5 - 1


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(40)) % np.uint64(FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _profiles(rows: DataFrame) -> DataFrame:
    """(id, n, print BINARY, point BINARY, first ARRAY) of every row; ``first`` is the first fifth of the set, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, points, first = [], [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py())
                n.append(len(h))
                first.append(h[:prefix_length(len(h)) if len(h) else 0].view(np.int64))
                prints.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                point = np.bincount((h % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
                points.append(point.astype("<u2" if point.max() < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(points, pa.binary()), _lists(first)],
                ["id", "n", "print", "point", "first"],
            )

    return rows.mapInArrow(run, "id long, n long, print binary, point binary, first array<long>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts) if parts else np.zeros(0, np.int64))


def _keys(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, rare ARRAY, often ARRAY): the first fifth of each set, frequent shingles last in the order."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rare, often = [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py())
                p = prefix_length(len(h)) if len(h) else 0
                late = _is_set(bits, h)
                early = h[~late][:p]
                rare.append(early.view(np.int64))
                often.append(h[late][:p - len(early)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rare), _lists(often)], ["id", "rare", "often"])

    return rows.mapInArrow(run, "id long, rare array<long>, often array<long>")


def _frequent(profiles: DataFrame, least: int) -> np.ndarray:
    """Bit filter of the shingles that *least* documents or more have among their first ones."""
    counts = profiles.select(F.explode("first").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    bit = F.pmod(F.shiftrightunsigned("key", 40), F.lit(FILTER_BITS))
    parts = (
        counts.filter(F.col("c") >= least)
        .groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        .collect()  # at most FILTER_BITS bits
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, part in parts:
        # bucket 1 begins with value 1, bucket 0 holds the value 0 in its last place
        values = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(part), np.uint8), bitorder="little"))
        numbers = (bucket - 1) * 8 * len(part) + 1 + values
        np.bitwise_or.at(bits, numbers >> 3, (1 << (numbers & 7)).astype(np.uint8))
    return bits


def _thin(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id may be among *ids*: a small broadcast thins texts out before they are shuffled."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    buckets = ids.select(bucket("id").alias("_bucket")).distinct()
    return rows.join(F.broadcast(buckets), bucket("id") == F.col("_bucket"), "left_semi")


def _verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the stored, distinct *pairs* (a, b) that link, by their words.

    The text of b travels to a's; a text that is in many pairs is copied, once for every
    `PAIRS_A_COPY` of them, so that no task gets more than its share.
    """
    uses = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("uses")), "uses").df
    copies = F.ceil(F.col("uses") / PAIRS_A_COPY)
    salted = join_lookup(pairs, uses, "a", "uses").select("a", "b", F.pmod(F.xxhash64("b"), copies).alias("copy"))
    texts_b = _thin(rows, pairs.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    texts_a = _thin(rows, uses.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    of_a = texts_a.join(uses, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    joined = salted.join(texts_b, "b").join(of_a.hint("merge"), ["a", "copy"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, set()
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                one, other = one.as_py(), other.as_py()  # one pair at a time: texts may be long
                if one != last_text:
                    last_text, last = one, shingles_of(one)
                second = shingles_of(other)
                keep.append(9 * len(last & second) >= 4 * (len(last) + len(second)) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _points(column: list[bytes]) -> np.ndarray:
    """Stored points as rows of an array; two bytes a coordinate, or four where a document is huge."""
    if all(len(p) == 2 * GROUPS for p in column):
        return np.frombuffer(b"".join(column), "<u2").reshape(-1, GROUPS).astype(np.int64)
    return np.stack([np.frombuffer(p, f"<u{len(p) // GROUPS}").astype(np.int64) for p in column])


class Tree:
    """R-tree over points, packed by size and then by the most spread coordinate; boxes are kept by their upper corner."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        if len(order) > LEAF:
            leaves = -(-len(order) // LEAF)
            tile = LEAF * int(np.ceil(np.sqrt(leaves)))
            spread = int(points.var(axis=0).argmax())
            order = np.concatenate([t[np.argsort(points[t, spread], kind="stable")] for t in np.split(order, range(tile, len(order), tile))])
        self.order = order
        self.points, self.sizes = points[order], sizes[order]
        #: Levels from the leaves up: upper corner and least size of each box.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        corner, least = self.points, self.sizes
        while len(corner) > LEAF:
            cuts = np.arange(0, len(corner), LEAF)
            corner, least = np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((corner, least))

    @staticmethod
    def _fits(points: np.ndarray, sizes: np.ndarray, corner: np.ndarray, least: np.ndarray) -> np.ndarray:
        return 9 * np.minimum(points, corner).sum(axis=1) >= 4 * (sizes + least)

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, point) whose overlap may reach the bound."""
        levels = [(self.points, self.sizes), *self.levels]
        top = len(levels[-1][0])
        found_q, found_p = [], []
        for begin in range(0, len(points), LEAF):  # bounds the frontier
            rows = np.arange(begin, min(begin + LEAF, len(points)))
            query, box = np.repeat(rows, top), np.tile(np.arange(top), len(rows))
            for depth in range(len(levels) - 1, -1, -1):
                corner, least = levels[depth]
                keep = self._fits(points[query], sizes[query], corner[box], least[box])
                query, box = query[keep], box[keep]
                if depth:
                    below = len(levels[depth - 1][0])
                    query = np.repeat(query, LEAF)
                    box = (box[:, None] * LEAF + np.arange(LEAF)).ravel()
                    inside = box < below
                    query, box = query[inside], box[inside]
            found_q.append(query)
            found_p.append(self.order[box])
        return np.concatenate(found_q), np.concatenate(found_p)


def _search_tasks(spark: SparkSession) -> int:
    """A task's work grows with its pairs, so small shuffles are dealt to the whole cluster as well."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _search_blocks(blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of the blocks' documents that are in different components and may link.

    A pair meets in blocks that stand for as many shingles as the first parts of its sets have in common:
    ``weight`` is the number of a block's shingles.  The same cells of all blocks with one smallest id have one
    ``route`` and meet in one task, which makes one row of a pair for all of them.  Beyond the part that ends first, the overlap is at most what that set has left, so
    pairs that meet too seldom for a link are dropped.

    Rows are (route, key, one, two, part, weight, id, label, n, point): a block's cell (one, two) holds the
    parts ``one`` and ``two`` of a block; pairs go from the first to the second.
    """
    cells = blocks.repartition(_search_tasks(blocks.sparkSession), "route").sortWithinPartitions("route", "key", "one", "two")

    def cell(rows: pa.Table) -> np.ndarray:
        column = lambda c: rows.column(c).to_numpy()
        ids, labels, n, part, one, two = map(column, ("id", "label", "n", "part", "one", "two"))
        points = _points(rows.column("point").to_pylist())
        if one[0] == two[0]:
            q, p = (Tree(points, n).search(points, n)) if len(ids) > 1 else (np.zeros(0, int),) * 2
        else:
            left, right = np.flatnonzero(part == one[0]), np.flatnonzero(part == two[0])
            if not len(left) or not len(right):
                return np.zeros((4, 0), np.int64)
            q, p = Tree(points[right], n[right]).search(points[left], n[left])
            q, p = left[q], right[p]
        other = labels[q] != labels[p]
        q, p = q[other], p[other]
        if one[0] == two[0]:  # the tree meets every pair of its points from both sides
            once = ids[q] < ids[p]
            q, p = q[once], p[once]
        least = -((-4 * (n[q] + n[p])) // 9) - np.maximum(_rest(n[q]), _rest(n[p]))
        return np.stack([np.minimum(ids[q], ids[p]), np.maximum(ids[q], ids[p]), least, np.full(len(q), rows.column("weight")[0].as_py())])

    def once_each(parts: list[np.ndarray]) -> np.ndarray:
        found = np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1)
        found = found[:, np.lexsort(found[:2])]
        new = np.flatnonzero(np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)])) if found.size else np.zeros(0, int)
        return np.concatenate([found[:3, new], np.add.reduceat(found[3:], new, axis=1)]) if len(new) else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([table.column(c).to_numpy() for c in ("key", "one", "two")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), table.num_rows]
            parts, size = [], 0
            for x, y in zip(cuts, cuts[1:]):
                if y - x > 1:
                    parts.append(cell(table.slice(x, y - x)))
                    size += parts[-1].shape[1]
                if size > HELD_PAIRS:
                    parts = [once_each(parts)]
                    size = parts[0].shape[1]
                    if 2 * size > HELD_PAIRS:
                        yield batch_of(parts[0])
                        parts, size = [], 0
            yield batch_of(once_each(parts))

        def batch_of(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row) for row in found], ["a", "b", "least", "shared"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            route = table.column("route").to_numpy()
            last = int(np.searchsorted(route, route[-1]))
            rest = table.slice(last)
            if last:
                yield from done(table.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from done(rest)

    pairs = cells.mapInArrow(run, "a long, b long, least long, shared long")
    met = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
    return met.filter("shared >= least").select("a", "b")


def _one_of_each_set(rows: DataFrame) -> DataFrame:
    """(key, size, first, weight): of the blocks with the same documents the one with the smallest key, and how many they are.

    Near copies share whole runs of shingles, so most blocks hold what another one holds.  Documents are
    told apart by their count, their ends and 128 bits of sums of hashes; *rows* are a stored table (key, id, size).
    """
    halves = [
        F.sum(half).alias(f"h{i}{seed}")
        for seed in (0, 1) for h in [F.xxhash64("id", F.lit(seed))]
        for i, half in enumerate((h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)))
    ]
    sets = rows.groupBy("key").agg(F.max("size").alias("size"), F.min("id").alias("first"), F.max("id").alias("last"), *halves)
    names = [c for c in sets.columns if c != "key"]
    return sets.groupBy(*names).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).select("key", "size", "first", "weight")


def _cells(met: DataFrame) -> DataFrame:
    """(route, key, one, two, part, weight, id, label) of the stored rows (key, first, weight, id, label) of blocks.

    The blocks with the same smallest id, ``first``, are cut alike, so a pair of documents is in the same cell of
    each, and all those are one route.  Documents in the component of ``first`` need only meet the others:
    where blocks have to be cut, these others have the parts from 0 on and meet all, and the parts behind are of the component.
    """
    by_label = met.groupBy("first", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    by_block = by_label.groupBy("first", "key").agg(F.sum("n").alias("n"), F.min(F.struct("id", "label", "n")).alias("own"))
    inner, outer = F.col("own.n"), F.col("n") - F.col("own.n")
    groups = stage(
        by_block.groupBy("first").agg(
            F.min("own.label").alias("own"), F.sum("n").alias("n"), F.max("n").alias("block"),
            F.sum(inner).alias("inner"), F.max(inner).alias("inner_block"), F.sum(outer).alias("outer"), F.max(outer).alias("outer_block"),
        ),
        "groups",
    ).df
    share = (groups.agg(F.sum("n")).first()[0] or 0) // _search_tasks(met.sparkSession)
    most = F.least(F.lit(MOST_ROUTE_ROWS), F.greatest(F.lit(ROUTE_ROWS), F.lit(share), F.ceil(F.col("outer") / 2)))
    parts = lambda c: F.ceil(F.greatest(F.col(c) / most, F.col(f"{c}_block") / TREE_POINTS)).cast("int").alias(c)
    # at most one group for every ROUTE_ROWS rows or TREE_POINTS
    cut = groups.filter((F.col("n") > most) | (F.col("block") > TREE_POINTS)).select("first", "own", parts("inner"), parts("outer"))
    numbered = met.join(F.broadcast(cut), "first", "left").withColumns({
        "is_own": F.coalesce(F.col("label") == F.col("own"), F.lit(False)),
        "inner": F.coalesce("inner", F.lit(0)), "outer": F.coalesce("outer", F.lit(1)),
    })
    number = lambda c: F.pmod(F.xxhash64("id"), F.greatest(F.col(c), F.lit(1))).cast("int")
    part = F.when(F.col("is_own"), F.col("outer") + number("inner")).otherwise(number("outer"))
    last = F.when(F.col("is_own"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    one, two = F.least("part", "other"), F.greatest("part", "other")
    return numbered.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        F.xxhash64("first", one, two).alias("route"), "key", one.alias("one"), two.alias("two"), "part", "weight", "id", "label"
    )


def _blocks(rows: DataFrame, frequent: np.ndarray, representatives: DataFrame) -> DataFrame:
    """Stored rows (key, id, size, first): the blocks of two documents or more."""
    keys = _keys(rows, frequent)
    keyed = stage(keys.join(representatives.select("id"), "id", "left_semi"), "keyed")
    release(rows.sparkSession)
    whole = "OVER (PARTITION BY key)"  # a rare key has few documents
    rare = keyed.df.select("id", F.explode("rare").alias("key")).select(
        "key", "id", F.expr(f"count(*) {whole}").alias("size"), F.expr(f"min(id) {whole}").alias("first")
    ).filter("size > 1")
    often = stage(keyed.df.select("id", F.explode("often").alias("key")), "often")
    sizes = stage(often.df.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")), "often_sizes").df
    frequent = join_lookup(often.df, sizes, "key", "size").filter("size > 1")
    blocks = stage(rare.unionByName(frequent.select("key", "id", "size", "first")), "blocks").df
    for done in (keyed, often):
        done.drop()
    release(rows.sparkSession)
    return blocks


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_shingles``, ``component_id``.

    Words are what white space separates, in lower case for A-Z; a document's set are its
    distinct runs of five words, or all its words as one if there are fewer.  Documents
    without words link with nothing and are their own component.  ``component_id`` is the smallest
    id of the documents that links lead to, the document itself included.

    Null texts count as empty.  Ids are meant to be unique; rows that repeat an id are linked
    through it.  A row with a null id is in the component of the documents with an equal set,
    null if there are none.  Equal texts are one class whatever their number, a group of
    near copies costs work in proportion to its size, and common passages are passed over
    by the order of shingles, never by leaving documents or shingles out.  Other columns
    aren't read.
    """
    rows = _rows(docs, id_col, text_col)
    with_first = stage(_profiles(rows), "profiles_first")
    frequent = _frequent(with_first.df, FREQUENT)
    release(rows.sparkSession)  # the counts, and half of what the profiles take, are gone before keys are written
    profiles = stage(with_first.df.drop("first"), "profiles").df
    with_first.drop()
    filled = profiles.filter("print IS NOT NULL")
    classes = stage(
        filled.groupBy("print").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("class_size"), F.max("n").alias("n")),
        "classes",
    ).df
    representatives = classes.filter("id IS NOT NULL").select("id").distinct()
    blocks = _blocks(rows, frequent, representatives)

    # step 3: the head that a document shares most with, if that is enough to make a link likely
    sizes = profiles.groupBy("id").agg(F.max("n").alias("n"))
    stars = (
        blocks.filter("id <> first").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("b", "best.a", "best.shared")
        .join(sizes.withColumnRenamed("id", "b"), "b").filter(20 * F.col("shared") >= F.col("n"))
    )
    links = stage(_verify(stage(stars.select("a", "b"), "stars").df, rows), "star_links").df
    release(rows.sparkSession)

    # step 4: what is left are blocks with several components
    labels = components(links)
    labelled = stage(
        blocks.select("key", "id", "size").join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "id", "size", F.coalesce("root", "id").alias("label")),
        "labelled",
    ).df
    open_keys = stage(
        labelled.groupBy("key").agg(F.max("size").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low <> high").select("key", "size"),
        "open_keys",
    ).df
    points = profiles.select("id", "n", "point").join(representatives, "id", "left_semi").dropDuplicates(["id"])
    opened = stage(join_lookup(labelled.drop("size"), open_keys, "key", "size"), "opened").df
    sets = stage(_one_of_each_set(opened), "sets").df
    met = stage(join_lookup(opened.drop("size"), sets, "key", "size").select("key", "first", "weight", "id", "label"), "met").df
    cells = _cells(met).join(points, "id").select("route", "key", "one", "two", "part", "weight", "id", "label", "n", "point")
    candidates = stage(_search_blocks(cells), "candidates").df
    release(rows.sparkSession)
    more = stage(_verify(candidates, rows), "tree_links").df

    roots = components(links.unionByName(more)).withColumnRenamed("node", "id")
    known = stage(
        classes.join(roots, "id", "left").select("print", "class_size", F.coalesce("root", "id").alias("component_id")), "known"
    ).df
    linked = join_lookup(filled.select("id", "n", "print"), known, "print", "class_size").select("id", "n", "component_id")
    alone = profiles.filter("print IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* whose id is that of their component, with all their columns."""
    stay = join(docs, id_col, text_col).filter(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("_stays")).distinct()
    return docs.join(stay, F.col(id_col) == F.col("_stays"), "left_semi")
