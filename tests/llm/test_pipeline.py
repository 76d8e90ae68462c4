import base64
import re

import pytest

import public_tokenizers as P

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from geocurate.llm import bpe, decontaminate, ngram_join  # noqa: E402
from geocurate.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_matches_brute_force(spark):
    import tiktoken

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = sorted(r.doc_id for r in QUERIES["op9_quality_ranking"](spark, SF).collect() if r.predicted)
    assert 0 < len(kept) < len(docs)
    first = {}
    for i in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i].text or ""), i)
    kept = sorted(first.values())
    sets = {i: ngram_join.shingles_of(docs[i].text) for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in kept:
        for b in kept:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [i for i in kept if find(i) == i]
    exact = [[decontaminate.normal(t)[a:b].tobytes() for a, b in decontaminate.segments(len(t))] for _, t in benchmark]
    kept = [i for i in kept if not any(s in decontaminate.normal(docs[i].text or "").tobytes() for item in exact for s in item)]
    vocabulary = bpe.read_vocabulary(P.path(corpus_pipeline.VOCABULARY))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(docs[i].text or "") for i in kept}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want)
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns_and_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "a b c d e f g.", "en", "s", 14), (3, "a b c d e f g.", "en", "s", 14)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kinds)
    for _, step in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = step(spark, table, SF)
            if step is not corpus_pipeline.encode:
                assert out.columns == docs.columns
            assert (out.count() > 0) == (table is docs) or step is corpus_pipeline.keep_quality
