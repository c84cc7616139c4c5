"""Operator 1 on vectors of great and small length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taskloom.llm import neighbours


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e9])
def test_op1_lengths(spark, scale):
    """Few rows are all scored: the first 20 are exact whatever the vectors' lengths, equal scores by id, other columns aside."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 32)) * scale * rng.uniform(0.5, 2, (200, 1))
    x[100:120] = x[7]  # equal scores
    x = x.astype(np.float32)
    d = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(200), "embedding": list(x), "score": "clash", "rank": 1}), "vec_id long, embedding array<float>, score string, rank int")
    got = neighbours.search(d, F.col("vec_id") % 20 == 0).toPandas()
    y = x.astype(float)
    for q in range(0, 200, 20):
        s = y @ y[q]
        want = [i for i in np.lexsort((np.arange(200), -s)) if i != q][:20]
        g = got[got.query_id == q].sort_values("rank")
        assert np.allclose(g.score, s[g.vec_id], rtol=1e-12)
        assert np.allclose(s[g.vec_id], s[want], rtol=1e-12)
