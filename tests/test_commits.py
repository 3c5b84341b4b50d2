"""Merge bases against closures worked out in plain Python."""

import random

import pytest

from marlstone.operators import commits as C


def history(seed, n):
    """Commits in order, each with parents before it."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        near = [f"c{j}" for j in range(max(0, i - 6), i)]
        out.append((f"c{i}", rng.sample(near, min(len(near), rng.choice([1, 1, 1, 2, 3]))) if near and rng.random() > 0.03 else []))
    return out


def ancestors(parents, sha):
    seen, todo = set(), [sha]
    while todo:
        s = todo.pop()
        if s not in seen and s in parents:
            seen.add(s)
            todo += parents[s]
    return seen


def frame(spark, rows):
    return spark.createDataFrame([(r, s, p, 0) for r, s, p in rows], "repo_id string, sha string, parents array<string>, x int").drop("x")


def numbered(spark, rows, known=None):
    commits = frame(spark, rows)
    return commits.join(C.generations(commits, known), ["repo_id", "sha"], "left")


PAIR = "pair_id int, repo_id string, head string, base string"


def test_random_histories(spark):
    rows, pairs = [], []
    rng = random.Random(1)
    for repo in ("a", "b", "c", "d"):
        h = history(repo, 24)
        rows += [(repo, s, p) for s, p in h] + [(repo, *h[5])]
        pairs += [(len(pairs) + k, repo, f"c{rng.randrange(24)}", f"c{rng.randrange(24)}") for k in range(25)]
    got = {r.pair_id: r for r in C.merge_bases(numbered(spark, rows), spark.createDataFrame(pairs, PAIR)).collect()}
    assert len(got) == len(pairs)
    for i, repo, head, base in pairs:
        parents = {s: p for r, s, p in rows if r == repo}
        left, right = ancestors(parents, head), ancestors(parents, base)
        both = left & right
        best = {c for c in both if not any(c != d and c in ancestors(parents, d) for d in both)}
        r = got[i]
        assert (set(r.merge_bases), r.ahead, r.behind, r.state) == (best, len(left - right), len(right - left), "complete"), (i, head, base)
        assert r.merge_base == (r.merge_bases[0] if best else None)


def test_generations_go_on_from_known(spark):
    h = [("r", s, p) for s, p in history(9, 14)]
    whole = {(r.sha, r.generation) for r in C.generations(frame(spark, h)).collect()}
    first = C.generations(frame(spark, h[:9]))
    assert {(r.sha, r.generation) for r in C.generations(frame(spark, h), first).collect()} == whole
    parents = {s: p for _, s, p in h}
    of = dict(whole)
    assert all(of[s] == 1 + max([of[p] for p in parents[s]], default=0) for s in parents)


def test_odd_pairs(spark):
    rows = [("r", "a", []), ("r", "b", ["a"]), ("r", "c", ["a"]), ("r", "d", ["b", "c"]), ("r", "e", ["c", "b"]), ("r", "alone", None), ("r", "cut", ["b", "not here"]), ("r", "tip", ["cut"])]
    pairs = [(1, "r", "d", "e"), (2, "r", "d", "d"), (3, "r", "alone", "d"), (4, "r", "d", None), (5, "r", "d", "unknown"), (6, "r", "tip", "b"), (7, "r", "b", "d"), (8, "other", "a", "b")]
    got = {r.pair_id: (r.merge_base, r.merge_bases, r.ahead, r.behind, r.state) for r in C.merge_bases(numbered(spark, rows), spark.createDataFrame(pairs, PAIR)).collect()}
    assert got == {
        1: ("b", ["b", "c"], 1, 1, "complete"), 2: ("d", ["d"], 0, 0, "complete"), 3: (None, [], 1, 4, "complete"), 4: (None, [], None, None, "missing_head"), 5: (None, [], None, None, "missing_head"),
        6: ("b", ["b"], None, None, "missing_history"), 7: ("b", ["b"], 0, 2, "complete"), 8: (None, [], None, None, "missing_head"),
    }


def test_default_branches(spark):
    refs = spark.createDataFrame([("a", "local", "dev", None), ("a", "local", "main", None), ("b", "remote", "origin/HEAD", "origin/trunk"), ("b", "local", "main", None), ("c", "local", "main", None), ("c", "local", "master", None), ("d", "local", "master", None), ("e", "local", "x", None)], "repo_id string, kind string, name string, target string")
    conf = spark.createDataFrame([("a", "dev"), ("c", "gone")], "repo_id string, branch string")
    assert sorted(map(tuple, C.default_branches(refs, conf).collect())) == [("a", "dev", "config"), ("b", "trunk", "remote_head"), ("c", "main", "local_main"), ("d", "master", "local_master"), ("e", None, "explicit_base_required")]


def test_bases_to_build(spark):
    res = spark.createDataFrame([("r", "h1", "m1", True), ("r", "h2", "m1", True), ("r", "h3", "m2", True), ("r", "h4", "h4", True), ("r", "h5", "m5", False), ("r", "h6", None, True)], "repo_id string, head_commit string, base_commit string, materialize boolean")
    snaps = spark.createDataFrame([("r", "m2")], "repo_id string, commit string")
    assert sorted(map(tuple, C.bases_to_build(res, snaps).collect())) == [("r", "m1")]


@pytest.mark.parametrize("rows", [[], [("r", "a", [])]])
def test_empty(spark, rows):
    pairs = spark.createDataFrame([], PAIR)
    assert C.merge_bases(numbered(spark, rows), pairs).count() == 0


def test_rounds_move_what_still_goes_on(spark, monkeypatch):
    """Pairs that are done leave the loop, and a round of generations reads no edges."""
    rows, reads = {}, {}

    def stored(df, at, whole=C.stored):
        reads[at] = df.inputFiles()
        out = whole(df, at)
        rows[at] = out.count()
        return out

    monkeypatch.setattr(C, "stored", stored)
    chain = lambda repo, n: [(repo, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]
    commits = numbered(spark, [x for k in range(40) for x in chain(f"r{k}", 3)] + chain("long", 10))
    pairs = spark.createDataFrame([(k, f"r{k}", "c2", "c1") for k in range(40)] + [(99, "long", "c9", "c0")], PAIR)
    got = {r.pair_id: (r.merge_base, r.ahead, r.behind) for r in C.merge_bases(commits, pairs).collect()}
    assert got == {**{k: ("c1", 1, 0) for k in range(40)}, 99: ("c0", 9, 0)}
    later = [at for at in rows if "/generations-" in at and at.rsplit("/", 1)[1] not in ("edges", "first", "0")]
    assert later and not any(f.rsplit("/", 2)[1] == "edges" for at in later for f in reads[at])
    assert sum(n for at, n in rows.items() if "/merge-bases-" in at and not at.endswith(("/known", "/ways"))) < 1100
