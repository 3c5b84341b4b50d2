"""Nearest vectors against plain Python, with odd vectors and several blocks of queries; time in proportion to pairs of numbers."""

import math
import random
import time

from marlstone.operators import search as S

rng = random.Random(4)


def cosine(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return 0.0
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    return sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) if norm(a) and norm(b) else 0.0


def test_odd_vectors_and_blocks(spark):
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)] + [(300, None), (301, []), (302, [0.0] * 5), (303, [1.0, None, 1.0, 1.0, 1.0]), (304, [1.0, 2.0])]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(500, rows[3][1]), (500, rows[4][1]), (600, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] > 295]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    want = set()
    for q in {i for i, _ in asked}:
        found = sorted((-round(cosine(v, e), 6), j) for i, v in asked if i == q for j, e in rows if j != q)[:10]
        want |= {(q, j, -c, n + 1) for n, (c, j) in enumerate(found)}
    for block in (10_000, 20):
        assert {(r.query_id, r.vec_id, abs(r.cosine) if r.cosine == 0 else r.cosine, r.rank) for r in S.nearest(df, queries, 10, block).collect()} == {(q, j, abs(c) if c == 0 else c, n) for q, j, c, n in want}


def test_many_pairs(spark):
    v = spark.range(40_000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> rand(7) - 0.5 + sin(id * i)) AS embedding")
    began = time.perf_counter()
    got = S.nearest(v, v.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query"), 10)
    assert got.count() == 4000
    assert time.perf_counter() - began < 25
