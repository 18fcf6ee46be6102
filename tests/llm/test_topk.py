import math
import random

import numpy as np

from moraine.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, k):
    fine = [(i, [math.floor(64 * float(x)) for x in np.array(v, np.float32)]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: x for i, x in fine if i % 20 == 0}.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 0, 5) for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, lambda i: i % 20 == 0, k).collect()))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(200)]
    rows += [(301, rows[3][1]), (302, None), (303, [1.0, None]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, rows[4][1]), (320, [0.0] * 6), (321, [2.0]), (322, []), (321, [2.0])]
    assert run(spark, rows) == brute(rows, 20)


def test_few_rows_and_none(spark):
    assert run(spark, [(20, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]) == [(20, 1, 1, 64 * 32 + 128 * 32), (20, 2, 2, 64 * 32 + 128 * 32)]
    assert run(spark, [(20, [1.0])]) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, []) == []


def test_stops_early():
    rng = np.random.default_rng(2)
    vectors = np.zeros((4000, 3), np.int64)
    vectors[:, 0] = np.arange(4000)
    vectors[:, 1:] = rng.integers(0, 3, (4000, 2))
    got = topk.threshold_search(np.arange(4000), vectors, np.array([9999]), np.array([[5, 1, 1]]), 10)
    s = vectors @ [5, 1, 1]
    assert [x[1] for x in got] == np.lexsort((np.arange(4000), -s))[:10].tolist()


def test_query_equals_sql(spark, same):
    same(topk.op2_threshold_topk(spark, "/root/testdata/sf0.001"), topk.ORACLE)


def test_huge_components(spark):
    big = [[1e300, 1.0], [-1e300, 1.0], [1e17, 1e17], [3e15, 2.0], [1.0, 1e300]]
    rows = [(20 * i if i < 3 else i, v) for i, v in enumerate(big)] + [(7, [0.5, 0.5]), (9, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lo, hi = -(1 << 63), (1 << 63) - 1
    held = {i: [min(max(math.floor(64 * x), lo), hi) for x in v] for i, v in rows}
    want = []
    for q in (i for i in held if i % 20 == 0):
        s = sorted((-min(max(sum(a * b for a, b in zip(held[q], held[i])), lo + 1), hi), i) for i in held if i != q)
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:4])]
    assert sorted(map(tuple, topk.top_k(df, lambda i: i % 20 == 0, 4).collect())) == sorted(want)
