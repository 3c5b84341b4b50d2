"""Toxicity by compression distance: one zstd dictionary of toxic text, one of ordinary text.

A window is a word, lower-cased and stripped of outer punctuation, set into a fixed carrier that both dictionaries hold;
so a window's own cost shows even where it is a few bytes long, which a frame of its own would store raw. Literals are
left uncoded, so the cost is what the dictionary could not supply. What the toxic dictionary saves against the ordinary
one, and what is left to pay with it, is summed up over all windows: how many save j bytes or more, and how many of these
pay i bytes or less. The thresholds on these counts are calibrated by logistic regression on labelled rows.

The ordinary dictionary is trained by the library's cover method on whole ordinary texts. The toxic one is trained by
cover too, but by contrast: a string of GRAM bytes counts by how much more often toxic texts hold it than their share of
all texts says (signed root deviance of the binomial), if that exceeds BOUND * sqrt(2 ln of all strings), which chance
alone hardly reaches (where no string does, those of greatest worth count); windows of toxic texts are then taken
greedily, best gain first, until TOXIC_BYTES are full. Plain cover on whole toxic texts fills the dictionary with what all
texts share: see the README for figures, also of windows of several words.

Fitting takes a bounded sample: at most TOXIC_ROWS toxic and ORDINARY_ROWS ordinary labelled documents (lowest hashes of
doc_id) of any length, outside the held-out fold. Strings and statistics are counted over their whole texts; the first
DICTIONARY_ROWS ordinary ones train the ordinary dictionary, each by EXCERPT characters at most, taken in runs of
words from all over the text by their hash. Scoring is map-only over whole texts.

Defined cases: null and empty texts have no window and get the score of an empty document; without labelled rows of both
kinds every score is the share of toxic labels, or 0; repeated rows score alike; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold
from marlstone.session import cut

TOXIC_ROWS, ORDINARY_ROWS, DICTIONARY_ROWS, EXCERPT = 4000, 6000, 2000, 10_000
#: Words of a run in an excerpt.
RUN = 50
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
TOXIC_BYTES, ORDINARY_BYTES = 8192, 112_640
#: Bytes of a string of the contrast, and what its root deviance must reach as a multiple of sqrt(2 ln of all strings).
GRAM, BOUND = 5, 1.1
#: Largest saving told apart, bounds of what is left to pay, and ridge of the calibration.
SAVED, PAID, RIDGE = 8, (0, 1, 2, 4), 0.3
#: Windows whose costs a worker remembers.
CACHE = 400_000
OUTER = bytes(c for c in range(33, 127) if not (48 <= c < 58 or 97 <= c < 123))
CARRIER = (hashlib.sha256(b"carrier").hexdigest() + hashlib.sha256(b"carrier again").hexdigest()).encode()


def windows(text: str | None) -> list[bytes]:
    return [w.strip(OUTER) for w in (text or "").encode().lower().split()]


def excerpt(text: str | None, most: int = EXCERPT) -> bytes:
    """The windows between blanks, as training takes them: all of a text, or so many runs of it by lowest hash, in text order."""
    ws = windows(text)
    runs = [b" ".join(ws[i : i + RUN]) for i in range(0, len(ws), RUN)]
    if sum(map(len, runs)) > most:
        chosen, size = set(), 0
        for h, i in sorted((hashlib.sha1(b"%d " % i + r).digest(), i) for i, r in enumerate(runs)):
            size += len(runs[i]) + 1
            if size > most and chosen:
                break
            chosen.add(i)
        runs = [r[:most] for i, r in enumerate(runs) if i in chosen]
    return b" " + b" ".join(runs) + b" "


def grams(window: bytes) -> set[bytes]:
    """The strings of GRAM bytes within a window between blanks."""
    w = b" " + window + b" "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def sums() -> np.ndarray:
    """Which cells (saving, class of what is paid) each statistic adds up."""
    cells = [(s, p) for s in range(SAVED + 1) for p in range(len(PAID) + 1)]
    rules = [(j, len(PAID)) for j in range(1, SAVED + 1)] + [(j, i) for i in range(len(PAID)) for j in range(1, SAVED - 1)]
    return np.array([[s >= j and p <= i for j, i in rules] for s, p in cells], float)


SUMS = sums()


class Cells(dict):
    """Cell of each window, computed when it is first met; the older half goes when CACHE are held."""

    def __init__(self, codecs: list, base: int):
        self.codecs, self.base = codecs, base

    def __missing__(self, window: bytes) -> int:
        data = CARRIER + b" " + window + b" " + CARRIER[:40]
        ordinary, toxic = (len(c.compress(data)) - self.base for c in self.codecs)
        out = min(max(ordinary - toxic, 0), SAVED) * (len(PAID) + 1) + sum(toxic > p for p in PAID)
        if len(self) >= CACHE:
            for old in list(islice(self, CACHE // 2)):
                del self[old]
        self[window] = out
        return out


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0

    def __post_init__(self):
        self.key = hashlib.sha1(pickle.dumps((self.toxic, self.ordinary, self.weights.tobytes()))).hexdigest()

    def start(self) -> Model:
        """Open the compressors; done once in each worker."""
        parameters = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=6, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        codecs = []
        for data in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(data + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            codecs.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))
        self.cells = Cells(codecs, min(len(c.compress(CARRIER + b"  " + CARRIER[:40])) for c in codecs))
        return self

    def features(self, text: str | None) -> np.ndarray:
        ws = windows(text)
        counts = np.bincount(np.fromiter(map(self.cells.__getitem__, ws), np.int64, len(ws)), minlength=len(SUMS))
        return np.concatenate([[1.0, math.log1p(len(ws))], np.log1p(counts @ SUMS)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge on all but the first weight."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:  # too little to choose from: the last of it is the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def covered(candidates: list[bytes], worth: dict[bytes, float], size: int) -> bytes:
    """Windows by what their strings are worth, each string once, until size bytes are full; the best stand last, where
    offsets are short."""
    left = dict(worth)
    gain = lambda w: sum(left.get(g, 0.0) for g in sorted(grams(w)))
    heap = [(-gain(w), w) for w in candidates]
    heapq.heapify(heap)
    out, used = [], 0
    while heap and used < size:
        said, w = heapq.heappop(heap)
        now = -gain(w)
        if now >= 0:
            continue
        if now > said + 1e-9:  # another window has taken some of it
            heapq.heappush(heap, (now, w))
            continue
        out.append(w)
        used += len(w) + 1
        for g in grams(w):
            left.pop(g, None)
    return b" " + b" ".join(reversed(out)) + b" "


def chosen_ids(labels: DataFrame, column: str, value: int, rows: int, folds: int, held_out: int) -> DataFrame:
    """At most `rows` labelled ids outside the held-out fold, by lowest hash."""
    ids = labels.where((F.col(column) == value) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return ids.select(F.col("doc_id").cast("long").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(rows)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, ordinary): texts of either kind that hold it, added up within the worker."""
    seen = (Counter(), Counter())

    def out():
        both = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), *(pa.array([seen[k][x] for x in both], pa.int64()) for k in (1, 0))], names=["gram", "toxic", "ordinary"])

    for batch in batches:
        for kind, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen[kind].update(set().union(*map(grams, set(windows(text.as_py())))))
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield out()
                seen = (Counter(), Counter())
    yield out()


def contrast(sample: DataFrame, toxic_share: float) -> dict[bytes, float]:
    """Root deviance of every string that toxic texts hold more often than chance would have it."""
    counts = cut(sample.select("kind", "text").mapInArrow(_gram_counts, "gram binary, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    n = F.col("toxic") + F.col("ordinary")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * share))).otherwise(0.0)
    worth = F.sqrt(2 * F.greatest(part("toxic", toxic_share) + part("ordinary", 1 - toxic_share), F.lit(0.0)))
    bound = BOUND * math.sqrt(2 * math.log(max(counts.count(), 2)))
    often = counts.where(F.col("toxic") > n * toxic_share).select("gram", worth.alias("worth"))
    best = often.agg(F.max("worth")).first()[0] or 0.0
    rows = often.where(F.col("worth") >= min(bound, best)).collect()
    return {bytes(g): w for g, w in rows}


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Dictionaries and calibration from the labelled sample, which stays with the workers.

    Strings above the bound, the windows of toxic texts that hold one, excerpts of DICTIONARY_ROWS ordinary texts and the statistics
    of the sample's rows come to the driver; all are bounded by the sample.
    """
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    kinds = chosen_ids(labels, "toxic", 1, TOXIC_ROWS, folds, held_out).withColumn("kind", F.lit(1)).unionByName(chosen_ids(labels, "toxic", 0, ORDINARY_ROWS, folds, held_out).withColumn("kind", F.lit(0)))
    docs = docs.select("doc_id", "text")
    text = docs["text"].cast("string")
    # the ids are at most TOXIC_ROWS + ORDINARY_ROWS, so the texts stay where they are
    sample = cut(docs.join(F.broadcast(kinds), docs["doc_id"] == kinds["chosen"]).select("kind", text.alias("text"), "chosen"))
    n = dict(sample.groupBy("kind").count().collect())
    if not n.get(1) or not n.get(0):
        return Model(prior=share)
    worth = contrast(sample, n[1] / (n[0] + n[1]))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for t in batch.column(0) for w in windows(t.as_py()) if not grams(w).isdisjoint(worth)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["window"])

    marked = sample.where("kind = 1").select("text").mapInArrow(candidates, "window binary").distinct().collect() if worth else []

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([excerpt(t.as_py()) for t in batch.column(2)], pa.binary())], names=["h", "chosen", "part"])

    # ids are put in order first, so that only the chosen texts are read and only their excerpts move
    ids = sample.where("kind = 0").select(F.xxhash64("chosen").alias("h"), "chosen").distinct().orderBy("h", "chosen").limit(DICTIONARY_ROWS)
    some = sorted((r[0], r[1], bytes(r[2])) for r in sample.where("kind = 0").join(F.broadcast(ids), "chosen").select("h", "chosen", "text").mapInArrow(excerpts, "h long, chosen long, part binary").dropDuplicates().collect())
    model = Model(covered(sorted(bytes(r[0]) for r in marked), worth, TOXIC_BYTES), trained([t for _, _, t in some], ORDINARY_BYTES), np.zeros(1), share)
    del some

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = started(model)
        for batch in batches:
            x = [scorer.features(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["kind", "chosen", "x"])

    rows = sorted((r[0], r[1], bytes(r[2])) for r in sample.select("kind", "chosen", "text").mapInArrow(counted, "kind int, chosen long, x binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in rows)).reshape(len(rows), -1)
    return Model(model.toxic, model.ordinary, logistic(x, np.array([float(r[0]) for r in rows]), RIDGE), share)


_started: dict[str, Model] = {}


def started(model: Model) -> Model:
    if model.key not in _started:
        _started.clear()
        _started[model.key] = model.start() if len(model.weights) else model
    return _started[model.key]


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): docs' columns packed in row."""
    source = docs.select(F.struct("*").alias("row"), docs["text"].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = started(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()))], names=["row", "score"])

    return source.mapInArrow(run, source.select("row", F.lit(0.0).alias("score")).schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    out = with_scores(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents whose score reaches the threshold."""
    return with_scores(docs, fit(docs, labels)).where(F.col("score") < threshold).select("row.*")
