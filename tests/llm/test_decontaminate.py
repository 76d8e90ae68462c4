import random

import numpy as np

from geocurate.llm import decontaminate as D

SYLLABLES = "er tion th en re on an st ing ou de la".split()


def prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(letters)), rng.random()
        if kind < 0.4:
            letters[at] = "#"
        elif kind < 0.7:
            del letters[at]
        else:
            letters.insert(at, "#")
    return "".join(letters)


def least_edits(pattern, text):
    """Edits between *pattern* and the most similar part of *text*, by the whole table."""
    row = np.zeros(len(text) + 1, int)
    columns = np.arange(len(text) + 1)
    for i, c in enumerate(pattern):
        new = np.minimum(np.concatenate([[i + 1], row[:-1] + (text != c)]), row + 1)
        row = np.minimum.accumulate(new - columns) + columns
    return row.min()


def brute(items, texts):
    found = {}
    for r, text in enumerate(texts):
        whole = D.normal(text)
        for item, words in items:
            codes = D.normal(words)
            if len(codes) < 8:  # too short for a q-gram: only as the whole text
                if len(codes) and text.strip().lower() == words.strip().lower():
                    found[r, item] = 0
                continue
            edits = [
                e for a, b in D.segments(len(codes))
                if (e := least_edits(codes[a:b], whole)) <= int((b - a) * D.EDIT_SHARE)
            ]
            if edits:
                found[r, item] = min(edits)
    return found


def test_matches_brute_force():
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate((8, 12, 20, 30, 45, 60))] + [(9, "short")]
    texts = ["", "e", prose(rng, 300)]
    for _, words in items:
        for share in (0, 0.03, 0.06, 0.08, 0.1, 0.15):
            passage = edited(rng, words, int(share * len(words)))
            texts.append(prose(rng, 20) + " " + passage.upper() + "\n" + prose(rng, 20))
        texts += [words, words[: len(words) // 2], words[10:], words.replace(" ", "\n")]
    found = D.find(D.Benchmark.of(items), texts)
    assert {k: v[2] for k, v in found.items()} == brute(items, texts)


def test_long_text_is_cut_without_loss(monkeypatch):
    rng = random.Random(6)
    item = prose(rng, 20)[:115]
    text = prose(rng, 3000)
    index = D.Benchmark.of([(1, item)])
    monkeypatch.setattr(D, "BLOCK_CHARS", 700)
    for at in range(600, 820, 7):
        assert D.find(index, [text[:at] + item + text[at:]]) == {(0, 1): (at, at + len(item), 0)}


def test_leaks_in_passes(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, 15)) for i in range(6)] + [(None, "x" * 90), (7, None)]
    texts = [prose(rng, 30) + " " + items[i % 6][1] + " " + prose(rng, 30) if i % 2 else prose(rng, 60) for i in range(12)]
    docs = spark.createDataFrame(
        [(i, t, 0) for i, t in enumerate(texts)] + [(50, None, 0), (51, "", 0), (1, texts[1], 0)], "doc_id long, text string, item_id int"
    )
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, i % 6) for i in range(1, 12, 2)] + [(1, 1)])
    for size in (D.PASS_CHARS, 150):
        assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, bench, pass_chars=size).collect()) == want
    assert D.leaks(docs.limit(0), bench).count() == D.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_are_found():
    rng = random.Random(8)
    items = [(n, prose(rng, 40)[:n - 2] + "qz") for n in range(8, 41)] + [(1, "42"), (2, " "), (3, "Yes!"), (4, "")]
    texts, want = ["", " ", prose(rng, 200)], set()
    for n, item in items[:33]:
        for passage, edits in ((item, 0), (item.upper().replace(" ", "\n"), 0), (edited(rng, item, 1), 1)):
            for text in (passage, prose(rng, 20) + " " + passage + " " + prose(rng, 20)):
                texts.append(text)
                if edits <= (n * 8 // 100 if n >= 16 else 0):
                    want.add((len(texts) - 1, n))
    texts += ["42", "so 42 it is", " yes!\n", "yes!!"]
    want |= {(len(texts) - 4, 1), (len(texts) - 2, 3)}
    index = D.Benchmark.of(items)
    found = D.find(index, texts)
    assert want <= set(found)
    for (row, item), (start, end, edits) in found.items():
        codes, whole = D.normal(dict(items)[item]), D.normal(texts[row])
        assert item < 8 or least_edits(codes, whole) == edits <= (item * 8 // 100 if item >= 16 else 0)
    short = {row for row, item in found if item < 40 and 2 * (found[row, item][1] - found[row, item][0]) >= len(texts[row])}
    assert D.drops(index, texts) == short | {row for row, item in found if item == 40}


def test_common_phrases_drop_nothing(spark):
    bench = spark.createDataFrame([(1, "thank you very much"), (2, "Paris"), (3, "w" * 20 + " " + "v" * 30)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(0, "well, thank you very much for all that you have done here"), (1, "Thank you very much!"), (2, "paris"), (3, "in Paris"),
         (4, "x " * 90 + "w" * 20 + " " + "v" * 30), (5, None), (6, "")], "doc_id long, text string",
    )
    told = {(r.doc_id, r.item_id, r.item_chars) for r in D.leaks(docs, bench).collect()}
    assert told == {(0, 1, 19), (1, 1, 19), (2, 2, 5), (4, 3, 51)}
    assert sorted(r.doc_id for r in D.drop_leaky(docs, bench).collect()) == [0, 3, 5, 6]
