import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marlstone.llm import simhash
from marlstone.llm.components import components


def slow_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hs = [xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(fps):
    u = sorted(set(fps))
    parent = {x: x for x in u}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    return {x: find(x) for x in u}


def check(docs, rows):
    fp = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    root = slow_classes([f for _, f in fp])
    least = {}
    for d, f in fp:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    want = sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in fp), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want


@pytest.fixture
def near(table):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(300)] = rng.choice(words)
            rows.append((i, " ".join(t), "en", "s", 0))
            i += 1
    return table(rows)


def test_against_brute_force(near, odd, clashing, empty):
    check(near, simhash.near_duplicates(near).collect())
    check(odd, simhash.near_duplicates(odd).collect())
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(clashing).count() == odd.count()


def test_no_link_is_lost(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    rows = set(base.tolist())
    for b in base.tolist():
        for k in (1, 2, 3, 4):
            bits = rng.choice(63, k, replace=False)
            rows.add(b ^ sum(1 << int(x) for x in bits))
    rows = sorted(rows)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in rows], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_one_of_each_class_stays(near, odd, clashing, empty):
    kept = simhash.keep_one(near)
    want = {r.component_id for r in simhash.near_duplicates(near).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == near.columns
    ids = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids
    assert simhash.keep_one(clashing).columns == clashing.columns
    assert simhash.keep_one(empty).count() == 0


def test_near_copies_at_five_words(spark):
    """Pairs of unequal texts at 0.8 or more, found by brute force over the documents, fall into one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text).tolist()) for r in docs.collect()}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 0.8 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.8 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    unequal = [(a, b) for a, b in pairs if sets[a] != sets[b]]
    found = {r["row"]["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs.withColumn("tie", F.xxhash64("text"))).collect()}
    assert len(unequal) >= 10 and all(found[a] == found[b] for a, b in pairs)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {i: find(i) for i in ids}


def classes_by_force(texts):
    """Least id reachable over pairs at 0.8 or more."""
    sets = {i: set(simhash.shingle_hashes(t).tolist()) for i, t in texts}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed, changes, length", [(1, (2, 6), 200), (2, (3, 9), 200), (3, (1, 3), 60)])
def test_families_lose_no_link(table, seed, changes, length):
    """Families of texts that differ from one another in a few words, at similarities on both sides of the bound."""
    rng = np.random.default_rng(seed)
    rows = []
    for family in range(8):
        base = [f"f{family}w{int(x)}" for x in rng.integers(0, 5000, length)]
        for k in range(30):
            ws = list(base)
            for at in rng.choice(length, int(rng.integers(*changes)), replace=False):
                ws[int(at)] = f"new{int(rng.integers(1 << 30))}"
            rows.append((1000 * family + k, " ".join(ws), "en", "s", 0))
    docs = table(rows).withColumn("tie", F.xxhash64("text"))
    found = {r["row"]["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs).collect()}
    want = classes_by_force([(r[0], r[1]) for r in rows])
    assert len(set(want.values())) >= 8 and found == want


@pytest.mark.parametrize("block", [simhash.BLOCK, 8_000])
def test_no_row_for_a_pair_of_a_large_key(table, monkeypatch, block):
    """A large family on both sides of the bound gives the classes of brute force, and no table of it has a row for each pair."""
    rng, rows = np.random.default_rng(4), []
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 150)]
    for k in range(300):
        ws = list(base)
        for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
            ws[int(at)] = f"new{int(rng.integers(1 << 30))}"
        rows.append((k, " ".join(ws), "en", "s", 0))
    made = []
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.Rounds, "keep", lambda self, df, keep=simhash.Rounds.keep: (made.append((out := keep(self, df)).count()), out)[1])
    docs = table(rows).withColumn("tie", F.xxhash64("text"))
    found = {r["row"]["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs).collect()}
    want = classes_by_force([(r[0], r[1]) for r in rows])
    assert len(set(want.values())) > 20 and found == want
    assert max(made) <= simhash.BANDS * len(rows)


def test_blocks_compare_whole_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, int(n)).astype(np.uint64)) for n in rng.integers(1, 200, 60)] + [np.zeros(0, np.uint64)]
    like = lambda x, y: len(set(x.tolist()) & set(y.tolist())) >= 0.8 * len(set(x.tolist()) | set(y.tolist())) - 1e-9
    want = [[like(x, y) for y in sets[30:]] for x in sets[:30]]
    assert simhash._near(sets[:30], sets[30:], 0.8).tolist() == want and any(map(any, want))
    got = simhash._near(sets, sets, 0.8)
    assert all(got[i, j] == like(sets[i], sets[j]) for i in range(61) for j in range(61) if i != j)
    linked = np.zeros((6, 6), bool)
    linked[[0, 2, 4, 2], [2, 5, 4, 0]] = True
    assert [x.tolist() for x in simhash._forest(linked | linked.T)] == [[0, 0], [2, 5]]


def test_one_of_near_copies_stays(table, odd, clashing, empty):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:i] + ["new"] + words[i + 1 :]), "en", "s", 0) for i in range(5, 300, 20)] + [(900, " ".join(reversed(words)), "en", "s", 0)]
    assert sorted(r.doc_id for r in simhash.keep_one_similar(table(rows)).collect()) == [5, 900]
    ids = [r.doc_id for r in simhash.keep_one_similar(odd).collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids
    assert simhash.keep_one_similar(clashing).columns == clashing.columns
    assert simhash.keep_one_similar(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(-5, 300), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[300] == -5
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
