"""Language model, classifiers and the pipeline."""

import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from marlstone.llm import hmm, quality_pu, toxicity


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    m = hmm.first_model(np.full(5, 0.2), 3)
    texts = [rng.integers(0, 5, n) for n in (4, 1, 6)]
    got = hmm.log_likelihoods(m, texts)
    for t, g in zip(texts, got):
        total = sum(m.start[p[0]] * m.emit[t[0], p[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], t[1:])) for p in itertools.product(range(3), repeat=len(t)))
        assert g == pytest.approx(math.log10(total))


def test_every_text_trains_the_model(spark, table):
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"{'ab'[(i + j // 40) % 2]}{rng.integers(17)}" for j in range(int(rng.choice([1, 300, 4000])))), "en", "s", 0) for i in range(60)] + [(99, None, "en", "s", 0)]
    texts = table(docs).select("text").repartition(7)
    counts = hmm.count_tokens(texts)
    symbols, *_ = hmm.fit_symbols(counts)
    seqs = [symbols.read(hmm.tokens(r[1]))[0] for r in docs]
    held = spark.sparkContext.broadcast(symbols)
    coded = hmm.as_symbols(texts, held)
    first = hmm.first_model(symbols.shares, hmm.STATES)
    sums = {(r["kind"], r["at"]): r for r in hmm.expected_counts(coded, len(symbols.shares), spark.sparkContext.broadcast(first)).collect()}
    whole = hmm.expected(first, [p for s in seqs for p in hmm.pieces_of(s)])
    assert sums[3, 0]["x1"] == sum(map(len, seqs)) and sums[3, 0]["x0"] == pytest.approx(whole[3], rel=1e-4)
    np.testing.assert_allclose([sums[0, 0][f"x{s}"] for s in range(hmm.STATES)], whole[0], rtol=1e-3, atol=1e-3)
    for i in np.flatnonzero(whole[2].sum(1)):
        np.testing.assert_allclose([sums[2, int(i)][f"x{s}"] for s in range(hmm.STATES)], whole[2][i], rtol=1e-2, atol=1e-2)
    model, path = hmm.baum_welch(coded, symbols.shares)
    assert len(path) > 2 and all(b > a - 1e-3 for a, b in zip(path, path[1:])) and hmm.log_likelihoods(model, seqs).sum() / sum(map(len, seqs)) > path[0]


def test_expected_counts_are_posteriors():
    rng = np.random.default_rng(2)
    m = hmm.first_model(np.full(4, 0.25), 2)
    seqs = [rng.integers(0, 4, n) for n in (5, 3, 1)]
    start, move, emit, log = hmm.expected(m, [(s, True) for s in seqs])
    assert log == pytest.approx(hmm.log_likelihoods(m, seqs).sum(), rel=1e-5)
    want = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
    for t in seqs:
        paths = list(itertools.product(range(2), repeat=len(t)))
        p = np.array([m.start[q[0]] * m.emit[t[0], q[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(q, q[1:], t[1:])) for q in paths])
        for q, w in zip(paths, p / p.sum()):
            want[0][q[0]] += w
            for a, b in zip(q, q[1:]):
                want[1][a, b] += w
            for x, s in zip(t, q):
                want[2][x, s] += w
    for a, b in zip((start, move, emit), want):
        np.testing.assert_allclose(a, b, atol=1e-5)


def test_likelihood_never_falls():
    rng = np.random.default_rng(3)
    shares = np.full(6, 1 / 6)
    pieces = [(rng.choice(3, 40) + (3 if i % 2 else 0), True) for i in range(20)]
    m, last = hmm.first_model(shares, 2), -np.inf
    for _ in range(6):
        m = hmm.improved(*hmm.expected(m, pieces)[:3], shares * 0 + 1e-9)
        now = hmm.log_likelihoods(m, [p for p, _ in pieces]).sum()
        assert now > last - 1
        last = now


def test_scores_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in hmm.score(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter()
    for d, t in text.items():
        if crc32(str(d).encode()) % 7 != 2:
            counts.update(hmm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for d, t in text.items():
        ws = hmm.tokens(t)
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, crc32(str(d).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_odd_rows(odd, clashing, empty):
    rows = hmm.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert hmm.score(empty).count() == 0
    assert hmm.score(clashing).count() == odd.count()


def test_excerpts():
    assert toxicity.excerpt(None) == b"  " and toxicity.excerpt("A, b c") == b" a b c "
    text = " ".join(f"w{i}" for i in range(40_000))
    part = toxicity.excerpt(text)
    places = [int(w[1:]) for w in part.split()]
    assert len(part) <= toxicity.EXCERPT + 2 and places == sorted(places) and places[0] < 10_000 and places[-1] > 30_000
    assert part == toxicity.excerpt(text) and len(toxicity.excerpt("x" * 50_000)) == toxicity.EXCERPT + 2


def toxic_corpus(table, marks):
    rng = np.random.default_rng(4)
    common = [f"{a}{b}" for a in ("lor", "sem", "tat", "vel", "num") for b in ("an", "is", "orum", "ibus", "et")]
    rows, labels = [], []
    for i in range(400):
        ws = [str(rng.choice(common)) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                ws[int(rng.integers(60))] = str(rng.choice(["grumpkin", "blighter", "scoundrel"]))
        rows.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return table(rows), marks(labels)


def test_toxicity(table, marks):
    docs, labels = toxic_corpus(table, marks)
    rows = toxicity.classify(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


@pytest.mark.parametrize("filler", ["", " plain words about the river and the old town" * 250])
def test_toxicity_held_out(spark, filler):
    """Labelled rows count whatever their length: with filler every text is over 11,000 characters."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    docs = docs.withColumn("text", F.concat("text", F.lit(filler)))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = ([r.predicted for r in rows if truth[r.doc_id] == k] for k in (1, 0))
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_dictionary_by_contrast():
    worth = {b" bad ": 3.0, b"grum ": 2.0, b" grum": 2.5}
    out = toxicity.covered([b"bad", b"grum", b"grumgrum", b"fine"], worth, 100)
    assert out == b" bad grum "
    assert toxicity.covered([b"bad", b"grum"], worth, 3) == b" grum "


def test_quality_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality_pu.classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert rows and sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_risk_is_non_negative_learning():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1, 1, (500, 2)), rng.normal(-1.5, 1, (300, 2))
    w = quality_pu.nn_pu(good[:200], np.r_[good[200:], bad[:200]], np.full(500, 1 / 500), 0.6)
    z = lambda x: x @ w[:-1] + w[-1]
    assert (z(good) > 0).mean() > 0.85 and (z(bad) < 0).mean() > 0.85


def test_prior_from_unlabelled():
    rng = np.random.default_rng(6)
    for prior in (0.3, 0.8):
        good, mix = rng.normal(1.5, 1, (4000, 2)), np.r_[rng.normal(1.5, 1, (int(4000 * prior), 2)), rng.normal(-1.5, 1, (4000 - int(4000 * prior), 2))]
        cell = lambda x: np.floor(2 * x[:, 0]).astype(int) * 100 + np.floor(2 * x[:, 1]).astype(int)
        names, at, n = np.unique(cell(mix), return_inverse=True, return_counts=True)
        means = np.stack([np.bincount(at, mix[:, k]) for k in (0, 1)], 1) / n[:, None]
        met = np.array([(cell(good) == c).sum() for c in names])
        assert abs(quality_pu.estimated_prior(good, means, n / n.sum(), met / len(good)) - prior) < 0.07


def test_all_documents_count_in_the_risk(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    x = quality_pu.all_features([r.text for r in texts.collect()])
    cells = quality_pu.Cells(x.mean(0), x.std(0) + 1e-3)
    rows = {r["cell"]: r for r in cells.sums(texts).collect()}
    np.testing.assert_allclose(rows[-1][2:], (x * x).sum(0))
    at = cells.of(x)
    assert {c: r["n"] for c, r in rows.items() if c >= 0} == dict(Counter(at.tolist()))
    for c in set(at.tolist()):
        np.testing.assert_allclose(rows[c][2:], x[at == c].sum(0))


@pytest.mark.parametrize("module", [toxicity, quality_pu])
def test_classifier_odd_rows(module, odd, clashing, empty, marks):
    for labels in (marks([]), marks([(1, 1, 0), (3, 1, 1), (8, 0, 0), (None, 1, 1), (10, None, None), (99, 1, 1)])):
        rows = module.classify(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(empty, labels).count() == 0
    keep = toxicity.keep_clean if module is toxicity else quality_pu.keep_good
    assert keep(clashing, marks([(1, 1, 0)])).columns == clashing.columns


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, left = docs.count(), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out = out.cache()
        left[name] = out.count()
        docs = out
    assert n > left["toxicity"] > left["quality"] > left["near_duplicates"] > 0
    assert left["mixing"] == left["encoding"] > left["near_duplicates"]
    assert {"ids", "decoded"} <= set(docs.columns)


def test_pipeline_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
