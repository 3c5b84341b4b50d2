"""Quality classifier by positive-unlabelled learning.

A linear model over FEATURES statistics of a text is fitted by minimising the non-negative unbiased risk
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))
with the logistic loss: R_p over trusted positives (labels.quality = 1 outside the held-out fold), R_u over all documents.
Where the second term is negative its gradient is taken back, as usual. No labelled negative is used. The loss is that of
a probability, so the margin's sigmoid is the score.

Every document counts in R_u, and in the mean and spread of the statistics: each falls into one of 2^BITS cells by the
signs of BITS fixed projections of its statistics, and the cells' document counts and sums are added up over all
partitions. R_u is taken at the cells' means, weighted by their counts, which is a bounded summary of any corpus.

The prior is estimated from the same cells: a logistic regression of positives against unlabelled text orders the cells;
of every leading part that holds LEAST_PART of the positives or more, the share of documents in it over the share of
positives is an upper bound of the prior, and the least of them is the estimate (each share moved by half a standard error
of n positives, 1 / (2 sqrt n), as the least of noisy ratios is too low).

At most POSITIVES trusted rows fit the model, by lowest hash of doc_id; their statistics are computed where the texts are,
and only the statistics come to the driver. Scoring is map-only over whole texts.

Defined cases: null and empty texts have the statistics of an empty text and a score like any other; without trusted
positives every score is 0.5, or 0 where rows are labelled and none is trusted; repeated rows score alike; extra columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold
from marlstone.llm.toxicity import chosen_ids

POSITIVES, BITS, LEAST_PART = 8000, 11, 0.5
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Ridge, and what a small number of positives adds to it; steps and rate of the descent.
RIDGE, PULL, STEPS, RATE = 1e-3, 1.0, 600, 0.05

UPPER, LOWER, DIGIT, HIGH = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58), (128, 256)))
# Groups of characters whose share of the text is a statistic.
GROUPS = (b"!", b"?", b".", b",", b"|", b"#*$%&<>", b"@/:\\=_~^+", b"\"'`", b"()[]{}", b"-", b";")
RATIOS = 12 + len(GROUPS)
FEATURES = 3 * RATIOS + 4


def ratios(text: str | None) -> tuple[list[float], float, float]:
    b = (text or "").encode()
    n = max(len(b), 1)
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    ws = b.split()
    m = max(len(ws), 1)
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper = share(UPPER)
    letters = upper + share(LOWER)
    half = len(ws) // 2
    out = [
        upper,
        upper / letters if letters else 0.0,
        share(DIGIT),
        share(HIGH),
        sum(map(bytes.__eq__, ws, ws[1:])) / m,
        sum(map(bytes.__eq__, ws, ws[2:])) / m,
        1 - len(set(ws)) / m,
        1 - len(set(ws[:half])) / max(half, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(map(bytes.isupper, ws)) / m,
        sum(len(w) == 1 for w in ws) / m,
        1 - sum(map(bytes.isalpha, ws)) / m,
    ]
    return out + [share(g) for g in GROUPS], float(len(ws)), (sum(map(len, ws)) / m)


def features(text: str | None) -> np.ndarray:
    r, words, length = ratios(text)
    r = np.array(r)
    return np.concatenate([r, np.sqrt(r), r > 0.02, [np.log1p(words), np.log1p(length), words < 20, 1.0]])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float
    known: bool = True

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.known:
            return np.full(len(texts), self.prior)
        return sigmoid(self.margin(all_features(texts)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return scaled(x, self.mean, self.spread) @ self.weights[:-1] + self.weights[-1]


def all_features(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), FEATURES)


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -8, 8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(gradient, size: int, ridge: float, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights (last: intercept) by Adam; gradient takes weights, ridge spares the intercept."""
    w, m, v = np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(w) + ridge * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative risk; share is the part of the documents that each unlabelled row is."""
    p, u = (np.c_[x, np.ones(len(x))] for x in (positive, unlabelled))

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        # logistic losses: l(+1) = log(1 + e^-z), l(-1) = log(1 + e^z)
        up = prior * (p.T @ (sigmoid(zp) - 1)) / len(p)
        down = u.T @ (sigmoid(zu) * share) - prior * (p.T @ sigmoid(zp)) / len(p)
        risk_down = np.logaddexp(0, zu) @ share - prior * np.logaddexp(0, zp).mean()
        return up + down if risk_down >= 0 else -down

    return minimise(gradient, p.shape[1], RIDGE + PULL / len(p))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, share: np.ndarray, positive_share: np.ndarray) -> float:
    """Least ratio of documents to positives in leading parts of the cells; positive_share is each cell's part of them."""
    p, u = (np.c_[x, np.ones(len(x))] for x in (positive, unlabelled))
    w = minimise(lambda w: p.T @ (sigmoid(p @ w) - 1) / len(p) + u.T @ (sigmoid(u @ w) * share), p.shape[1], RIDGE + PULL / len(p))
    order = np.argsort(-(u @ w), kind="stable")
    docs, good = np.cumsum(share[order]), np.cumsum(positive_share[order])
    enough, slack = good >= LEAST_PART, 0.5 / np.sqrt(len(p))
    return float(np.clip(((docs[enough] + slack) / (good[enough] - slack)).min(), 0.01, 0.99)) if enough.any() else 0.5


@dataclass
class Cells:
    """Where a document's statistics fall: signs of fixed projections, around the positives' mean and spread."""

    mean: np.ndarray
    spread: np.ndarray

    def __post_init__(self):
        self.directions = np.random.default_rng(11).normal(size=(FEATURES, BITS))

    def of(self, x: np.ndarray) -> np.ndarray:
        return (scaled(x, self.mean, self.spread) @ self.directions > 0) @ (1 << np.arange(BITS))

    def sums(self, texts: DataFrame) -> DataFrame:
        """(cell, n, s0, s1, ...) added up over all texts; cell -1 has the sums of squares."""
        names = [f"s{i}" for i in range(FEATURES)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, squares = np.zeros(1 << BITS, np.int64), np.zeros((1 << BITS, FEATURES)), np.zeros(FEATURES)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    x = all_features(batch.column(0).slice(at, 1000).to_pylist())
                    cell = self.of(x)
                    n += np.bincount(cell, minlength=len(n))
                    np.add.at(total, cell, x)
                    squares += (x * x).sum(0)
            met = np.flatnonzero(n)
            if len(met):
                columns = [pa.array(np.r_[-1, met], pa.int32()), pa.array(np.r_[0, n[met]], pa.int64()), *map(pa.array, np.r_[squares[None], total[met]].T)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", *names])

        parts = texts.mapInArrow(run, "cell int, n long, " + ", ".join(f"{x} double" for x in names))
        return parts.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])


def statistics(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Statistics of the chosen documents; chosen is small and bounded, so the texts stay where they are."""
    docs = docs.select("doc_id", "text")
    source = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["chosen"]).select("chosen", docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["chosen", "x"])

    rows = sorted((r[0], bytes(r[1])) for r in source.mapInArrow(run, "chosen long, x binary").collect())
    return np.frombuffer(b"".join(x for _, x in rows)).reshape(-1, FEATURES)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    good, n = known.agg(F.sum((F.col("quality") == 1).cast("double")), F.count("*")).first()
    unknown = Model(*(np.zeros(0),) * 3, 0.0 if n and not good else 0.5, False)
    if not good:
        return unknown
    positive = statistics(docs, chosen_ids(labels, "quality", 1, POSITIVES, FOLDS, HELD_OUT))
    if not len(positive):
        return unknown
    cells = Cells(positive.mean(0), positive.std(0) + 1e-3)
    rows = sorted(cells.sums(docs.select(docs["text"].cast("string").alias("text"))).collect())  # a row for each cell
    squares, rows = np.array(rows[0][2:]), rows[1:]
    counts, totals = np.array([r["n"] for r in rows], float), np.array([r[2:] for r in rows])
    mean = totals.sum(0) / counts.sum()
    spread = np.sqrt(np.maximum(squares / counts.sum() - mean**2, 0)) + 1e-6
    x, u = scaled(positive, mean, spread), scaled(totals / counts[:, None], mean, spread)
    share = counts / counts.sum()
    met = np.bincount(cells.of(positive), minlength=1 << BITS)[[r["cell"] for r in rows]]
    prior = estimated_prior(x, u, share, met / len(positive))
    return Model(mean, spread, nn_pu(x, u, share, prior), prior)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): docs' columns packed in row."""
    source = docs.select(F.struct("*").alias("row"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()))], names=["row", "score"])

    return source.mapInArrow(run, source.select("row", F.lit(0.0).alias("score")).schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold."""
    return with_scores(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")
