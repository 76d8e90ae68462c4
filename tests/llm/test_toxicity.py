import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geocurate.llm import toxicity as X
from geocurate.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
TERMS = {"idiot": 4.0, "idiotic": 3.0, "scum": 2.0, "disgustingly": 5.0, "worthless": 4.5, "achlich": 3.5}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(TERMS)), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("xdi"), st.integers(0, 2)), max_size=3))
def test_automaton_matches_edit_distance(term, edits):
    word = list(term)
    for at, letter, kind in edits:
        at = min(at, len(word) - 1)
        word[at:at + (kind < 2)] = [] if kind == 1 and len(word) > 1 else [letter]
    word = "".join(word)
    near = [(d, -w, t) for t, w in TERMS.items() if (d := distance(word, t)) <= X.Automaton.allowed(t)]
    assert AUTOMATON.match(word) == ((min(near)[2], min(near)[0]) if near else None)


AUTOMATON = X.Automaton(TERMS)


def test_context_and_odd_texts():
    scan = X.Scanner(TERMS).describe
    names = dict(zip(X.FEATURES, range(len(X.FEATURES))))
    abuse, quotation = scan("you are an idiot"), scan('he said "what an idiot" and left')
    assert abuse[names["addressed"]] > 0 and quotation[names["quoted"]] > 0
    assert quotation[names["strength"]] < abuse[names["strength"]]
    assert scan("what an id1ot")[names["near_strength"]] > 0 and scan("what an idi0t")[names["near_strength"]] > 0
    assert scan(None) == scan("") == [0.0] * len(X.FEATURES)
    assert scan("idiot " * 50)[0] == scan("idiot")[0]
    assert scan("x" * 100_000)[:-1] == [0.0] * (len(X.FEATURES) - 1)
    assert X.Scanner({}).describe("idiot")[0] == 0.0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (2, None, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rated = X.rate(docs, X.train(docs, labels))
    assert rated.columns == ["doc_id", "score", "predicted"]
    assert {r.predicted for r in rated.collect()} == {0}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_held_out_accuracy(spark, labels):
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
