import re
from collections import Counter

import duckdb

from geocurate.llm import phrases
from geocurate.llm.queries import ORACLES

KIND = "doc_id long, text string, lang string, n long, k0 string"


def brute(rows, least=10, limit=2000, share=50):
    """The definition, phrase by phrase."""
    count, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                count.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    candidates = {p for p, a in count.items() if len(p) > 2 and a >= least}
    for p in candidates:
        lang, *w = p
        if any(100 * count[q] >= share * count[p] for q in candidates if len(q) > len(p) and q[0] == lang and tuple(w) in (q[1:-1], q[2:])):
            continue
        cuts = [(1000000 * count[p] ** 2 // (count[lang, *w[:k]] * count[lang, *w[k:]]), k) for k in range(1, len(w))]
        best, k = min(cuts)
        out.append((lang, -best, -count[p], " ".join(w).encode(), count[lang, *w[:k]], count[lang, *w[k:]]))
    ranked, seen = [], Counter()
    for lang, s, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= limit:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, words[lang], -s))
    return sorted(ranked)


def texts():
    base = [
        ("New York, new york is A Big City; état d'âme  d'âme\tétat d'âme!", "fr"), ("the the the the the. the the", "en"),
        ("New York City has new york city lights", "en"), ("a b c a b c a b d; a b", None), ("a b c a b", "und"), ("x y z x y z", "en"),
        (None, "en"), ("", "de"), (" \t ", "de"), (".,;:!?", None), ("word", ""), ("İstanbul ŞEHİR istanbul şehir", "tr"),
    ]
    return [row for row in base for _ in range(11)] + [("the end of the story " * 3, "en")] * 7 + [("w " * 30_000, "long"), ("p q. " * 400, "long")]


def test_against_the_definition(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate(rows)], KIND).repartition(5)
    got = sorted(tuple(r) for r in phrases.mine(df).collect())
    assert got == brute(rows) and len({r[0] for r in got}) >= 5


def test_settles_ties_in_rounds(spark, monkeypatch):
    """A low limit ends above threshold 0; phrases inside longer ones make further rounds needed."""
    monkeypatch.setattr(phrases, "FIRST_AIM", 1)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 400)
    monkeypatch.setattr(phrases, "HELD", 64)
    rows = texts() + [(f"k{i % 30} l{i % 30} m{i % 30} n{i % 4} k{i % 30} l{i % 7}", "en") for i in range(900)]
    df = spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate(rows)], KIND)
    for limit in (1, 3, 10, 40):
        assert sorted(tuple(r) for r in phrases.mine(df, limit=limit).collect()) == brute(rows, limit=limit)


def test_sql_agrees_with_the_definition():
    rows = texts()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(ORACLES["op13_phrase_collocations"]).fetchall()) == brute(rows)


def test_exact_scores_of_large_counts(spark):
    a, left, right = 999_999_999_989, 1_000_000_000_039, 999_999_999_990
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases.score(df.a, df.l, df.r).alias("s")).first().s == 1_000_000 * a * a // (left * right)


def test_empty_table(spark):
    empty = phrases.mine(spark.createDataFrame([], KIND))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.mine(spark.createDataFrame([(1, "a b", "en", 1, "x")], KIND)).count() == 0
