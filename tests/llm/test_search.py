"""Exact search against all products."""

import numpy as np
from pyspark.sql import functions as F

from cadence.llm import search


def brute(vectors, k=5):
    out = {}
    for q, v in vectors.items():
        if q % 3 == 0:
            scored = sorted((-int(v @ w), c) for c, w in vectors.items() if c != q and len(w) == len(v))
            out[q] = [(r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return {q: rows for q, rows in out.items() if rows}


def test_against_all_products(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(0, rng.choice([0.2, 1, 3]), 12)], 0) for k in range(150)]
    rows += [(200 + k, rows[k][1], 0) for k in range(9)]
    rows += [(300, None, 0), (303, [1.0, None], 0), (306, [float("nan")] * 12, 0), (309, [], 0), (312, [0.0] * 12, 0), (315, [1.0, 2.0], 0), (318, [2.0, 1.0], 0), (321, [1e200, 1.0], 0), (324, [1e308, 1.0], 0), (327, [1e7, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int")
    valid = {k: np.floor(256 * np.array(v)).astype(int) for k, v, _ in rows if v and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v)}
    for bucket in (16, 4096):
        got = {}
        for r in search.top(spark, table, F.col("vec_id") % 3 == 0, bucket=bucket, block=7).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(x) for q, x in got.items()} == brute(valid)
    assert search.top(spark, table.limit(0), F.col("vec_id") % 3 == 0).collect() == []


def test_large_products_are_exact():
    q, c = np.array([[2.0**40, 3.0]]), np.array([[2.0**30, 1.0], [1.0, 1.0]])
    assert search.products(q, c).tolist() == [[2**70 + 3, 2**40 + 3]]
