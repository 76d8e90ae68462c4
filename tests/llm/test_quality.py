import zlib

from geocurate.llm import quality
from geocurate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PROSE = "The sea was calm, and we could hear the birds over the hill as they went home."
JUNK = "BUY!!! NOW!!! | $$$ | BUY!!! NOW!!! | $$$ | BUY!!! NOW!!! | ### ###"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op9_quality_ranking"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_ranks_prose_above_junk_whatever_the_columns(spark):
    rows = [(i, (PROSE if i % 2 else JUNK) + f" {i}", 0.5, [1.0]) for i in range(60)] + [(100, None, 0.1, []), (101, "", 0.1, []), (102, "w " * 200_000, 0.1, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, features array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (1, 1), (900, 0)], "doc_id long, quality int")
    ranking = quality.train(docs, labels)
    rated = {r.doc_id: r for r in quality.rate(docs, ranking).collect()}
    assert all(rated[i].predicted == i % 2 for i in range(60)) and rated[100].score == rated[101].score
    kept = quality.keep_good(docs, ranking)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rated.items() if r.predicted}
    assert quality.rate(docs.limit(0), ranking).count() == 0


def test_without_one_kind_of_label_everything_stays(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, JUNK), (3, None)], "doc_id long, text string")
    for some in ([], [(1, 1)]):
        ranking = quality.train(docs, spark.createDataFrame(some, "doc_id long, quality int"))
        assert {r.predicted for r in quality.rate(docs, ranking).collect()} == {1}
