"""Image numbers of nine digits, which SQL's eight-digit paths cut: no two images share a key."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from geocurate.operators import embed
from geocurate.operators.checks import DataCheckError
from registry import load_all
from registry.check import compare

load_all()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    lines = [(order, line, order * 7 % 900, order % 90) for order in range(9_999_990, 10_000_020) for line in range(1, 8)]
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pq.write_table(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*lines))}), f"{folder}/lineitem.parquet")
    # a number that no vector has: SQL leaves its images out
    vectors = {"vec_id": pa.array([0, 1, 2, 3, 5, 6], pa.int64()), "embedding": pa.array([[0.5, k / 3] for k in range(6)], pa.list_(pa.float32()))}
    pq.write_table(pa.table(vectors), f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["images_with_vectors", "images_to_embed", "embed_missing_images", "embedding_stream"])
def test_long_image_numbers(spark, tables, name):
    folder, con = tables
    assert compare(spark, con, folder, name) == ""


def test_numbered_vectors_are_one_each(spark):
    frame = spark.createDataFrame([("s", f"p{i}", i % 3) for i in range(9)], "source string, image_path string, vec_id long")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in (0, 1, 2, 7)], "vec_id long, embedding array<double>")
    images = frame.drop("vec_id")
    got = embed.attach(images, frame, vectors).collect()
    assert sorted((r.image_path, r.embedding) for r in got) == [(f"p{i}", [float(i % 3), 1.0]) for i in range(9)]
    with pytest.raises(DataCheckError, match="of 3 images 1 have no vector, 0 have several"):
        embed.attach(images, frame, vectors.filter("vec_id <> 1"))
    with pytest.raises(DataCheckError, match="0 have no vector, 1 have several"):
        embed.attach(images, frame, vectors.union(vectors.filter("vec_id = 2")))
    with pytest.raises(DataCheckError, match="of 9 images 1 have no vector"):
        embed.attach(images, frame.filter("image_path <> 'p4'"), vectors)
