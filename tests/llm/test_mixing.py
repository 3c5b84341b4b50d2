from collections import defaultdict

import pytest

from marlstone.llm import mixing


def brute_targets(sizes, weights, share, most):
    budget, level = share * sum(sizes.values()), 0.0
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            break
        level = (budget - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in rest)
        more = {s for s in rest if w[s] * level > most * sizes[s]}
        if not more:
            break
        capped |= more
    return {s: float(most * sizes[s]) if s in capped else w[s] * level for s in names}


@pytest.fixture
def corpus(table):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), "en", f"s{i * i % 7}" if i % 11 else None, 0) for i in range(900)]
    return table(rows)


def test_targets_and_takes(corpus):
    rows = mixing.mix(corpus).collect()
    source = {r.doc_id: r.source for r in corpus.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r["size"]
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s in sizes:
        assert 0 <= want[s] - taken[s] <= 0.02 * want[s] + 2


def test_reruns_agree(corpus):
    a = sorted(map(tuple, mixing.mix(corpus).collect()))
    assert a == sorted(map(tuple, mixing.mix(corpus.repartition(5)).collect()))


def test_one_long_document_leaves_no_gap(table):
    docs = table([(0, "w " * 1000, "en", "a", 0)] + [(i, "w " * 5, "en", "a", 0) for i in range(1, 200)] + [(i, "w " * 20, "en", "b", 0) for i in range(200, 400)])
    rows = mixing.mix(docs).collect()
    got = sum(r.taken for r in rows if r.doc_id < 200)
    want = next(r.target for r in rows if r.doc_id == 0)
    assert abs(got - want) < 0.05 * want


def test_odd_rows(odd, clashing, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert mixing.mix(empty).count() == 0
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns
    assert mixing.mix(clashing).count() == odd.count()
