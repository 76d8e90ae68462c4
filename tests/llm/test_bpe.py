import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from geocurate.llm import bpe
from geocurate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(vocabulary):
    return bpe._coder(vocabulary, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("ab etnioshé 'sß\n\t\x1c\x85 !9"), max_size=80))
def test_same_ids_as_the_library(coder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert coder.encode(text).tolist() == library.encode_ordinary(text)


def test_long_pieces(coder, library):
    for text in ("a" * 5000, " " * 5000 + "x", "ab" * 3000, "ernthesti" * 900, "日本語" * 700, "\n" * 999, "=-" * 2000):
        assert coder.encode(text).tolist() == library.encode_ordinary(text)


def test_nulls_and_clashing_columns(spark, vocabulary):
    rows = [(1, None, "x"), (2, "", "y"), (3, "straße the end", None), (3, "straße the end", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    both = bpe.decode(bpe.encode(df, vocabulary, P.PATTERN), vocabulary).collect()
    assert [bytes(r.decoded).decode() for r in both] == [t or "" for _, t, _ in rows]
    assert both[0].ids == [] and both[2].ids == both[3].ids
    assert bpe.encode(df.limit(0), vocabulary, P.PATTERN).count() == 0


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
