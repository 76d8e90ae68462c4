"""Secret scan: key patterns, and windows of high entropy, as expressions inside one row.

Nothing is exploded or shuffled: a text's spans are computed where the text is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and least lengths of the kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24

KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Character classes: name, maximal runs that windows slide over, what a run must hold, alphabet, least bits
#: a character.  A run of letters only is a word, one of digits only a number.
CLASSES = (
    ("hexadecimal", r"[0-9A-Fa-f]{20,}+", r"[A-Fa-f]", "0123456789abcdefABCDEF", 3.0),
    ("capital", r"[A-Z0-9]{20,}+", r"^(?=.*[0-9])(?=.*[A-Z])", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.6),
    ("small", r"[a-z0-9]{20,}+", r"^(?=.*[0-9])(?=.*[a-z])", "abcdefghijklmnopqrstuvwxyz0123456789", 3.6),
    (
        "base64", r"[A-Za-z0-9+/_=-]{20,}+", r"^(?=.*[0-9])(?=.*[A-Za-z])",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9,
    ),
)
#: What marks a span as a sample value, and the form of an ordinary identifier, which is a whole run.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|123456789|abcdefghij"
IDENTIFIER = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Of these, words that may stand alone in a path or name, where they say nothing about what follows.
NAMES = ("example", "sample", "dummy", "placeholder", "changeme", "your")

#: Prefix sums are taken block by block, so their cost stays linear in the number of matches.
BLOCK = 128



def _running(steps: Column) -> Column:
    """Running totals of an array of integers.  *steps* must be a stored column: it is referred to often."""
    count = F.size(steps)
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK)))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda done, s: F.array_append(done, F.element_at(done, -1) + s))
    within = lambda b, s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(BLOCK), count - b * BLOCK)),
        lambda i: s + total(F.slice(steps, b * BLOCK + 1, i)),
    )
    return F.when(
        count > 0, F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), within))
    ).otherwise(F.array().cast("array<int>"))


def _matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add array *name* of structs (start, end, what): all leftmost non-overlapping matches in ``_text``.

    Positions follow from the lengths of what lies between the matches.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_has", F.rlike("_text", F.lit(pattern)))
    df = df.withColumns({
        "_what": F.when(F.col("_has"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none),
        "_gaps": F.when(F.col("_has"), F.split("_text", pattern, -1)).otherwise(none),
    })
    df = df.withColumn(
        "_steps",
        F.zip_with("_what", F.slice("_gaps", 1, F.size("_what")), lambda m, gap: F.length(m) + F.length(gap)),
    )
    df = df.withColumn("_ends", _running(F.col("_steps")))
    found = F.zip_with(
        "_what", "_ends",
        lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("what")),
    )
    return df.withColumn(name, found).drop("_has", "_what", "_gaps", "_steps", "_ends")


def _region(run: Column, alphabet: str, least_bits: float) -> Column:
    """Struct (first, last) of the characters of *run* from the first window of high entropy to the last, 1-based; nulls if none.

    The window's counts by character change by one in and one out, and with them the sum
    of c * log2(c), from which the entropy follows.
    """
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    w = lambda c: F.element_at(weight, c + 1)

    def slide(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            old = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
            n_new = F.element_at(state["counts"], new)
            n_old = F.element_at(state["counts"], F.greatest(old, F.lit(1)))
            gained = F.when(new == old, F.lit(0.0)).otherwise(
                w(n_new + 1) - w(n_new) + F.when(old > 0, w(n_old - 1) - w(n_old)).otherwise(F.lit(0.0))
            )
            total = state["total"] + gained
            high = (i >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= least_bits - 1e-9)
            counts = F.transform(
                state["counts"],
                lambda c, j: c + (j + 1 == new).cast("int") - (j + 1 == old).cast("int"),
            )
            return F.struct(
                counts.alias("counts"),
                total.alias("total"),
                F.when(high & state["first"].isNull(), i - WINDOW + 1).otherwise(state["first"]).alias("first"),
                F.when(high, i).otherwise(state["last"]).alias("last"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"),
            F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(
            F.sequence(F.lit(1), F.size(codes)), start, step,
            lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
        )

    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    return F.element_at(F.transform(F.array(codes), slide), 1)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``secrets``: an array of structs (kind, start, end) of every secret in the whole text.

    Kinds are ``assign``, ``access`` and ``hex`` by their patterns (leftmost, without
    overlaps within a kind, too short ones dropped), and ``entropy`` for the part of a
    maximal run of a character class in which windows of `WINDOW` characters reach the entropy of
    that class, unless what was found is on the allow list.  Every class has runs of its own, so a name
    before a secret doesn't change its class; spans of several classes that overlap are united.  Words of
    the allow list that stand alone in a path or name are masked first and don't suppress what is beside them.
    The allow list doesn't touch the other kinds.  Positions count code points, the end is exclusive.  Spans are
    ordered by start, then kind in the order above, then end.

    A null or empty text has none.  Repeated rows get equal spans.  A column of *docs* named
    ``secrets`` is replaced; names that begin with ``_`` are kept for inner use.
    """
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    df = _matches(df, "_assign", ASSIGN)
    df = _matches(df, "_access", ACCESS)
    # runs are maximal, so asking for the least length in the pattern drops just the short ones
    df = _matches(df, "_hex", HEX[:-1] + f"{{{HEX_LEAST},}}+")
    for name, runs, *_ in CLASSES:
        df = _matches(df, f"_{name}", runs)
    df = df.withColumn("_regions", F.concat(*(_found(F.col(f"_{name}"), *rule) for name, _, *rule in CLASSES)))
    df = df.withColumn("_regions", _united(F.sort_array("_regions")))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)

    def spans(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    every = F.sort_array(F.concat(
        spans(0, F.filter("_assign", lambda m: F.length(value(m["what"])) >= ASSIGN_LEAST)),
        spans(1, F.filter("_access", lambda m: m["end"] - m["start"] >= ACCESS_LEAST)),
        spans(2, F.col("_hex")),
        spans(3, F.col("_regions")),
    ))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(
        every,
        lambda m: F.struct(F.element_at(kinds, m["kind"] + 1).alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
    )
    return df.withColumn("secrets", named).drop("_text", "_assign", "_access", "_hex", "_regions", *(f"_{name}" for name, *_ in CLASSES))


def _masked(run: Column) -> Column:
    """*run* with words of the allow list that stand alone replaced by as many equals signs."""
    for word in NAMES:
        run = F.regexp_replace(run, f"(?i)(?<![A-Za-z0-9+]){word}(?![A-Za-z0-9+])", "=" * len(word))
    return run


def _found(runs: Column, holds: str, alphabet: str, bits: float) -> Column:
    """Array of structs (start, end) of what windows of high entropy find in the runs of a class."""
    likely = F.filter(runs, lambda m: F.rlike(m["what"], F.lit(holds)) & ~F.rlike(m["what"], F.lit(IDENTIFIER)))
    masked = F.transform(likely, lambda m: F.struct(m["start"].alias("start"), _masked(m["what"]).alias("what")))
    regions = F.transform(masked, lambda m: F.struct(m["start"].alias("start"), m["what"].alias("what"), _region(m["what"], alphabet, bits).alias("at")))

    def fine(r: Column) -> Column:
        part = F.substring(r["what"], r["at"]["first"], r["at"]["last"] - r["at"]["first"] + 1)
        return r["at"]["first"].isNotNull() & ~F.rlike(part, F.lit(ALLOWED))

    return F.transform(
        F.filter(regions, fine),
        lambda r: F.struct((r["start"] + r["at"]["first"] - 1).alias("start"), (r["start"] + r["at"]["last"]).alias("end")),
    )


def _united(spans: Column) -> Column:
    """Overlapping ones of sorted spans as one."""

    def step(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        joins = (F.size(done) > 0) & (span["start"] < last["end"])
        return F.when(joins, F.array_append(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.array_append(done, span))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
