import math
import random
import time

import numpy as np

from strataweave.llm import topk
from strataweave.llm.topk import exact_topk

SCHEMA = "vec_id long, embedding array<double>, score string, lane int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(queries, rows, k, scale):
    out, low, high = [], -(2**63), 2**63 - 1
    whole = lambda v: [math.floor(scale * x) for x in v]
    asked = {}
    for i, v in queries:
        if usable(v) and i is not None:
            asked[i] = min(v, asked.get(i, v))
    for i, v in asked.items():
        found = sorted((-min(max(sum(a * b for a, b in zip(whole(v), whole(w))), low), high), j) for j, w in rows if j is not None and j != i and usable(w) and len(w) == len(v))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(spark, queries, rows, k=5, scale=256.0):
    frames = [spark.createDataFrame([(i, v, "x", 0) for i, v in x], SCHEMA).repartition(3) for x in (queries, rows)]
    found = exact_topk(*frames, id_col="vec_id", vector_col="embedding", k=k, scale=scale)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


def test_many_tiles_ties_and_odd_vectors(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice((-1.0, 0.5, 0.25)) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.5] * 4) for i in range(300, 400)] + [(401, None), (402, [None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (405, [1.0, 1.0]), (406, [2.0, 1.0]), (407, []), (408, []), (None, [9.0] * 4), (7, rows[7][1])]
    queries = [r for r in rows if r[0] is not None and r[0] % 25 == 0] + [(405, [1.0, 1.0]), (407, []), (401, None), (0, rows[0][1])]
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    assert run(spark, queries, rows) == brute(queries, rows, 5, 256.0)


def test_huge_components_are_exact_or_at_the_ends_of_long(spark):
    rows = [(1, [1e10, 3.0]), (2, [1e10, 1.0]), (3, [-1e30, 0.0]), (4, [1e30, 0.0]), (5, [0.1, 0.1])]
    assert run(spark, rows, rows, k=3) == brute(rows, rows, 3, 256.0)


def test_products_in_limbs_equal_whole_numbers():
    rng = random.Random(3)
    value = lambda: float(math.floor(rng.choice((-1, 1)) * 2 ** rng.choice((rng.uniform(0, 10), rng.uniform(0, 62), rng.uniform(0, 300)))))
    for dim in (0, 1, 3, 5000):
        q, c = ([[rng.choice((value(), 1.0, -1.0, 0.0, 1e30, -1e30)) for _ in range(dim)] for _ in range(9)] for _ in range(2))
        want = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -(2**63)), 2**63 - 1) for y in c] for x in q]
        assert topk._exact_scores(np.array(q).reshape(9, dim), np.array(c).reshape(9, dim)).tolist() == want


def test_a_full_tile_with_an_outlier_takes_no_longer_than_a_few_products():
    rng = np.random.default_rng(5)
    q, c = rng.integers(-200, 200, (128, 64)).astype(float), rng.integers(-200, 200, (4096, 64)).astype(float)
    c[77, 5] = 3e12
    began = time.time()
    rows, ids, scores = topk._best(np.arange(128), q, np.arange(1000, 5096), c, 5)
    assert time.time() - began < 5
    exact = q.astype(np.int64) @ c.astype(np.int64).T
    for i in range(128):
        want = sorted((-s, j + 1000) for j, s in enumerate(exact[i].tolist()))[:5]
        assert sorted(zip((-scores[rows == i]).tolist(), ids[rows == i].tolist(), strict=True)) == want


def test_empty_and_short_tables(spark):
    one = [(1, [1.0])]
    assert run(spark, one, one) == []
    assert run(spark, [], []) == []
    assert run(spark, one, [(1, [1.0]), (2, [1.0])], k=0) == []
