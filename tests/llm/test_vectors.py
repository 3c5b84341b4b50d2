"""Vector codes and clusters against full comparison in plain Python."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import clusters, vector_codes
from marlstone.llm.vectors import squared

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, width, seed, spread=0.3):
    rng = random.Random(seed)
    homes = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(7)]
    return [(i, [h + rng.uniform(-spread, spread) for h in homes[i % 7]], i % 5 if i % 6 else None) for i in range(n)]


def odd_rows(width):
    nan, inf = float("nan"), float("inf")
    base = [0.5] * width
    return [(None, base, 1), (-3, None, 1), (-2, [None] + base[1:], 1), (-1, [nan] + base[1:], None), (-4, base[1:] + [-inf], None), (9_000, base[:-1], 2), (9_001, [], 2), (9_002, base, None), (9_002, base, None), (3, [-x for x in base], 3)]


def kept(rows, width):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def full(x, entries, rounds):
    """Lloyd's rounds on lists of integers: assignment, distances, centroids."""
    at = [list(e) for e in entries]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at)) for v in x]

    for _ in range(rounds):
        found = near()
        for i in range(len(at)):
            if own := [v for v, (_, e) in zip(x, found) if e == i]:
                at[i] = [sum(c) // len(own) for c in zip(*own)]
    found = near()
    return [e for _, e in found], [d for d, _ in found], at


def brute_codes(rows, width, scale=4096, parts=8, entries=16, rounds=6):
    rows = sorted(((i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in kept(rows, width)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut, codes, errors, books = width // parts, [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        x = [v[p * cut : (p + 1) * cut] for _, v, _ in rows]
        code, error, book = full(x, x[:entries], rounds)
        codes, errors = [a + f"{b:02x}" for a, b in zip(codes, code)], [a + b for a, b in zip(errors, error)]
        books += [c for e in book for c in e]
    total = {}
    for (_, _, label), e in zip(rows, errors):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for (i, _, label), c, e in zip(rows, codes, errors)), key=str)


def brute_clusters(rows, width, scale=256, centroids=40, rounds=5):
    rows = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in kept(rows, width)]
    rows.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    code, distance, at = full([v for _, v in rows], [v for _, v in rows[:centroids]], rounds)
    sums = [sum(d for d, c in zip(distance, code) if c == i) for i in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, sums[c], sum(sums), digest[c]) for (i, _), c, d in zip(rows, code, distance)), key=str)


@pytest.mark.parametrize("n", [0, 3, 150])
def test_codes(spark, n):
    rows = vectors(n, 16, 1) + odd_rows(16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vector_codes.codes(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, 16)
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]


@pytest.mark.parametrize("n", [0, 25, 200])
def test_clusters(spark, n):
    rows = vectors(n, 64, 2) + odd_rows(64)
    got = clusters.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 64)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]


@pytest.mark.parametrize("make", [vector_codes.codes, clusters.clusters])
def test_empty_and_clashing(spark, make):
    assert make(spark.createDataFrame([], SCHEMA)).count() == 0
    assert make(spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 64, 1)], SCHEMA)).count() == 0
    df = spark.createDataFrame(vectors(60, 64, 4), SCHEMA)
    names = ["row", "ints", "code", "upper", "lower", "distance", "id", "digest", "of", "error", "cluster", "total", "n", "part", "entry"]
    extra = df.select("*", *[F.lit("x").alias(c) for c in names])
    assert sorted(map(tuple, make(df).collect())) == sorted(map(tuple, make(extra).collect()))


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clusters.clusters(spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA)).collect()


def test_equal_centroids(spark):
    rows = [(i, [float(i % 3)] * 64, i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, clusters.clusters(df).collect()), key=str) == brute_clusters(rows, 64)
    assert sorted(map(tuple, vector_codes.codes(df).collect()), key=str) == brute_codes(rows, 64)


def test_pruning_is_exact_and_saves_work():
    rng = np.random.default_rng(5)
    homes = rng.integers(-4000, 4000, (16, 8))
    x = homes[rng.integers(0, 16, 3000)] + rng.integers(-500, 500, (3000, 8))
    x[:40] = (homes[0] + homes[1]) // 2  # ties and near ties
    book, bounds = x[100:116].copy(), vector_codes.Bounds(np.zeros(3000, np.int64), np.full(3000, np.inf, np.float32), np.zeros((3000, 16), np.float32))
    moved, work = np.zeros(16), []
    for _ in range(6):
        bounds, n = vector_codes.nearest(x, book, vector_codes.shifted(bounds, moved))
        work.append(n)
        exact = np.stack([squared(x, c) for c in book], axis=1)
        assert (bounds.entry == exact.argmin(axis=1)).all()
        assert (bounds.lower.astype(float) <= np.sqrt(exact)).all() and (bounds.upper.astype(float) >= np.sqrt(exact.min(axis=1))).all()
        new = np.array([x[bounds.entry == e].sum(0) // max(1, (bounds.entry == e).sum()) if (bounds.entry == e).any() else book[e] for e in range(16)])
        moved, book = np.sqrt(squared(new, book)), new
    assert work[-1] < 0.3 * 3000 * 16


def test_scan_stops_early():
    rng = np.random.default_rng(6)
    homes = rng.integers(-4000, 4000, (40, 64))
    was = rng.integers(0, 40, 2000)
    x = homes[was] + rng.integers(-200, 200, (2000, 64))
    x[:5] = homes[:5]
    order, apart = clusters.by_distance(homes)
    assert all(set(o) == set(range(40)) - {i} for i, o in enumerate(order)) and (np.diff(apart, axis=1) >= 0).all()
    for start in (was, np.zeros(2000, np.int64)):
        found, distance, n = clusters.nearest(x, start, homes, order, apart)
        exact = np.stack([squared(x, c) for c in homes], axis=1)
        assert (found == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert n < (2.2 if start is was else 41) * 2000


@pytest.mark.parametrize("name", ["op12", "op13"])
def test_sql(spark, sf, name):
    module, make = (vector_codes, vector_codes.codes) if name == "op12" else (clusters, clusters.clusters)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    out = make(spark.read.parquet(f"{sf}/embeddings.parquet"))
    found = con.sql(module.oracle_sql())
    assert found.columns == out.columns
    assert sorted(map(tuple, out.collect())) == sorted(found.fetchall())
