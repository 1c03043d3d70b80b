"""Vectors with very large components take part."""

import random

from test_knn import brute

from bitloom.llm import knn


def test_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [(120, [3e5, 0.0, 1.0, 0.0]), (121, [-262144.0, 2.0, 0.0, 0.0]), (140, [0.5, 4e7, 0.0, -1e6])]
    rows += [(141, [float("inf")] * 4), (142, [float("nan"), 3e5, 0.0, 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = knn.whole_vectors(data)
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in knn.top_k(whole.where("vec_id % 20 = 0"), whole).collect()}
    assert got == brute([(x.vec_id, x.embedding) for x in data.collect()], 20)
    huge = spark.createDataFrame([(0, [1e38, 1.0]), (1, [3e38, 0.0]), (2, [-1e38, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    whole = knn.whole_vectors(huge)
    got = [(x.rank, x.vec_id, x.score) for x in knn.top_k(whole.where("vec_id = 0"), whole).orderBy("rank").collect()]
    assert got == [(1, 1, None), (2, 3, None), (3, 2, None)]
