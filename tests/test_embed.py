import numpy as np
import pytest

from geocurate.operators import embed


def test_vectors_leave_a_task_as_arrow_lists(spark):
    def load():
        def model(paths):
            assert 0 < len(paths) <= 7
            return np.array([[int(p), 2 * int(p)] for p in paths])
        return model

    paths = spark.range(50).selectExpr("cast(id as string) AS image_path", "'s' AS source")
    out = embed.apply_model(paths, load, 7)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    assert sorted((int(r.image_path), list(r.embedding), r.source) for r in out.collect()) == [(i, [i, 2 * i], "s") for i in range(50)]
    assert embed.apply_model(paths.limit(0), load, 7).count() == 0


def test_a_model_must_make_one_vector_a_path(spark):
    paths = spark.range(20).selectExpr("cast(id as string) AS image_path", "'s' AS source")
    with pytest.raises(Exception, match="vectors of"):
        embed.apply_model(paths, lambda: lambda p: np.zeros((len(p) + (-1) ** int(p[0]), 2)), 5).count()
