"""Hidden Markov language model over words.

Tokens are the words of a text, A-Z lowered, and one end token. A token emits through a symbol: each of the most
frequent words is a symbol of its own, every other word falls into one of CLASSES symbols by its last three bytes. A
text's probability is
    P(symbols) * product of P(word | symbol),   P(word | symbol) = (c + 1) / (C + V + 1)
where P(symbols) comes from the scaled forward recursion over STATES latent states, c is the word's count in the
training tokens, C and V the tokens and distinct words of its symbol, and one unseen word shares what is left; it is 1
for a word that is its own symbol.

Training: word counts over all training texts; every training text is written once as its symbols, and each round of
Baum-Welch runs over all of them, with expected counts added up across partitions, from seeded first parameters until the
mean log10 likelihood of a symbol rises by less than RISE, ROUNDS times at most. Only symbol tables (a fixed number of
rows) come to the driver. Workers hold at most HEAD words with their counts; every other word's count is joined to its
texts by word, where no word can be frequent.

Defined cases: null text is empty and has the end token alone; without training texts every count is 0; texts of any
length are scored exactly (training cuts them into pieces of PIECE tokens); repeated rows score alike; extra columns
of the input are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold
from marlstone.session import cut

FOLDS, HELD_OUT = 7, 2
STATES, OWN, CLASSES, HEAD = 8, 4096, 2048, 131_072
ROUNDS, RISE = 8, 0.01
#: Tokens of a piece in training, tokens handled together, and weight of the unigram in an emission row.
PIECE, TOGETHER, SMOOTH = 256, 300_000, 50.0
#: The end token; no word is empty.
END = b""
#: Distinct words a worker gathers before it hands their counts on.
GATHER = 150_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lowered (bytes know ASCII alone), then the end."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token binary, n) over a column text: counted within workers, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) >= GATHER:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def octave(n: Column) -> Column:
    """Bin of a count, 16 to a doubling: a few hundred bins, whatever the corpus."""
    return F.floor(F.log2(n) * 16)


def cuts(counts: DataFrame, *most: int) -> list[int]:
    """For each bound the lowest bin from which the words number at most that many."""
    bins = sorted(counts.groupBy(octave(F.col("n")).alias("bin")).agg(F.count("*").alias("words")).collect(), reverse=True)
    out = []
    for bound in most:
        total, low = 0, (bins[0]["bin"] + 1 if bins else 0)
        for b, words in bins:
            if (total := total + words) > bound:
                break
            low = b
        out.append(low)
    return out


@dataclass
class Symbols:
    """What workers know of words: index of each head word, its log10(c + 1) and symbol, and the symbols' masses."""

    index: dict[bytes, int]
    logs: np.ndarray
    symbol: np.ndarray
    own: int
    mass: np.ndarray  # log10(C + V + 1) of each symbol, 0 for own ones
    shares: np.ndarray  # unigram share of each symbol

    def __post_init__(self):
        self.classes: dict[bytes, int] = {}

    def class_of(self, word: bytes) -> int:
        end = word[-3:]
        if (out := self.classes.get(end)) is None:
            out = self.classes[end] = self.own + crc32(end) % CLASSES
        return out

    def read(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, head index or -1) of a token list."""
        find = self.index.get
        at = np.array([find(w, -1) for w in ws], np.int32)
        out = self.symbol[at]
        rare = np.flatnonzero(at < 0)
        out[rare] = [self.class_of(ws[i]) for i in rare.tolist()]
        return out, at


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states
    stay: np.ndarray  # mean state shares: where a piece that is not a text's first starts


def fit_symbols(counts: DataFrame) -> tuple[Symbols, int, int, int]:
    """Symbols, training tokens N, distinct tokens V, and the bin from which words are in the head."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own_bin, head_bin = cuts(counts, OWN, HEAD)
    head = sorted(counts.where(octave(F.col("n")) >= head_bin).collect(), key=lambda r: (-r["n"], r["token"]))
    words = [bytes(r["token"]) for r in head]
    number = np.array([r["n"] for r in head], np.int64)
    own = sum(1 for x in number if math.floor(math.log2(x) * 16) >= own_bin) if len(number) else 0
    own = min(own, OWN)
    index = {w: i for i, w in enumerate(words)}
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in words[:own]], "token binary")), "token", "left_anti") if own else counts
    by_class = rest.groupBy((F.crc32(F.substring("token", -3, 3)) % CLASSES).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens_of, mass = np.zeros(own + CLASSES), np.zeros(own + CLASSES)
    tokens_of[:own] = number[:own]
    for r in by_class:
        tokens_of[own + r["c"]] = r["n"]
        mass[own + r["c"]] = math.log10(r["n"] + r["v"] + 1)
    shares = (tokens_of + 1) / (tokens_of + 1).sum()
    symbol = np.array([i if i < own else own + crc32(w[-3:]) % CLASSES for i, w in enumerate(words)] + [0], np.int32)
    return Symbols(index, np.log10(number + 1.0), symbol, own, mass, shares), n, v, head_bin


def first_model(shares: np.ndarray, states: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * (rng.gamma(0.5, 2.0, (len(shares), states)) + 0.05)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    even = np.full(states, 1 / states)
    return Model(even, move / move.sum(1, keepdims=True), emit / emit.sum(0), even)


def expected(model: Model, pieces: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, move, emit) of pieces (symbols, is a text's first) by forward and backward recursion, and
    their log10 likelihood. Pieces go side by side, longest first; rows of one time stand together."""
    k, single = len(model.start), np.float32
    emit_of, move, start, stay = (x.astype(single) for x in (model.emit, model.move, model.start, model.stay))
    pieces = sorted(pieces, key=lambda p: -len(p[0]))
    sizes, firsts = np.array([len(p[0]) for p in pieces]), np.array([f for _, f in pieces])
    steps, n = int(sizes[0]), len(pieces)
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    at = np.concatenate([[0], np.cumsum(active)]).tolist()
    flat, begin = np.concatenate([p for p, _ in pieces]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seen = np.concatenate([flat[begin[: active[t]] + t] for t in range(steps)])
    ahead = emit_of[seen]
    alpha, scale = np.empty_like(ahead), np.empty(len(seen), single)
    now = np.where(firsts[:, None], start, stay)
    for t in range(steps):
        here = slice(at[t], at[t + 1])
        prior = now[: active[t]] if t == 0 else now[: active[t]] @ move
        now = np.multiply(prior, ahead[here], out=alpha[here])
        scale[here] = now.sum(1)
        now /= scale[here, None]
    ahead /= scale[:, None]
    gamma, beta, back = np.empty_like(alpha), np.ones((n, k), single), np.ascontiguousarray(move.T)
    for t in range(steps - 1, -1, -1):
        here, m = slice(at[t], at[t + 1]), active[t]
        np.multiply(alpha[here], beta[:m], out=gamma[here])
        ahead[here] *= beta[:m]  # what a state at t and all after it add, over the scale
        if t:
            beta[:m] = ahead[here] @ back
    moves = sum((alpha[at[t - 1] : at[t - 1] + active[t]].T @ ahead[at[t] : at[t + 1]] for t in range(1, steps)), np.zeros((k, k)))
    emit = np.stack([np.bincount(seen, gamma[:, s], len(emit_of)) for s in range(k)], 1)
    return gamma[:n][firsts].sum(0, dtype=np.float64), model.move * moves, emit, float(np.log10(scale, dtype=np.float64).sum())


def improved(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
    stay = emit.sum(0) + 1e-9
    emit = (emit + SMOOTH * shares[:, None]) / (emit.sum(0) + SMOOTH)
    return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit, stay / stay.sum())


def pieces_of(symbols: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    return [(symbols[i : i + PIECE], i == 0) for i in range(0, len(symbols), PIECE)]


def grouped(pieces: list[tuple[np.ndarray, bool]]) -> Iterator[list[tuple[np.ndarray, bool]]]:
    """Pieces by length, in groups of about TOGETHER tokens."""
    group, size = [], 0
    for p in sorted(pieces, key=lambda p: -len(p[0])):
        group.append(p)
        size += len(p[0])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def as_symbols(texts: DataFrame, symbols) -> DataFrame:
    """Every text as its symbols, two bytes each, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = symbols.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([known.read(tokens(t.as_py()))[0].astype(np.int16).tobytes() for t in batch.column(0)], pa.binary())], names=["symbols"])

    return cut(texts.mapInArrow(run, "symbols binary"))


def expected_counts(texts: DataFrame, size: int, model) -> DataFrame:
    """(kind, at, x0, x1, ...) added up over all partitions: kind 0 start, 1 a row of move, 2 a row of emit, 3 the
    likelihood and the number of symbols."""
    k = STATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = model.value
        sums = [np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0]
        pieces, held, total = [], 0, 0

        def add():
            for group in grouped(pieces):
                for i, new in enumerate(expected(now, group)):
                    sums[i] += new

        for batch in batches:
            for t in batch.column(0):
                one = np.frombuffer(t.as_py(), np.int16)
                pieces += pieces_of(one)
                held, total = held + len(one), total + len(one)
                if held >= 5 * TOGETHER:
                    add()
                    pieces, held = [], 0
        if pieces:
            add()
        if total:
            met = np.flatnonzero(sums[2].sum(1))
            rows = np.concatenate([sums[0][None], sums[1], sums[2][met], [[sums[3], total] + [0.0] * (k - 2)]])
            kind = np.repeat([0, 1, 2, 3], [1, k, len(met), 1])
            at = np.concatenate([[0], np.arange(k), met, [0]])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), *map(pa.array, rows.T)], names=["kind", "at"] + [f"x{s}" for s in range(k)])

    schema = "kind int, at int, " + ", ".join(f"x{s} double" for s in range(k))
    return texts.mapInArrow(run, schema).groupBy("kind", "at").agg(*[F.sum(f"x{s}").alias(f"x{s}") for s in range(k)])


def baum_welch(texts: DataFrame, shares: np.ndarray) -> tuple[Model, list[float]]:
    """The model, and the mean log10 likelihood of a symbol before each round; texts as as_symbols gives them."""
    sc = texts.sparkSession.sparkContext
    model, path = first_model(shares, STATES), []
    for _ in range(ROUNDS):
        held = sc.broadcast(model)
        start, move, emit, log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(shares), STATES)), np.zeros(STATES)
        rows = expected_counts(texts, len(shares), held).collect()  # a row for each symbol and state
        held.unpersist()
        if not rows:  # no training texts
            break
        for r in rows:
            (start[None], move, emit, log[None])[r["kind"]][r["at"]] = [r[f"x{s}"] for s in range(STATES)]
        path.append(log[0] / log[1])
        model = improved(start, move, emit, shares)
        if len(path) > 1 and path[-1] - path[-2] < RISE:
            break
    return model, path


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 P(symbols) of each text by the scaled forward recursion, all texts side by side, longest first."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out, now = np.zeros(len(texts)), None
    m = len(texts)
    for t in range(int(sizes[0])):
        while sizes[m - 1] <= t:
            m -= 1
        e = model.emit[flat[starts[:m] + t]]
        now = model.start * e if t == 0 else (now[:m] @ model.move) * e
        total = now.sum(1)
        now /= total[:, None]
        out[:m] += np.log10(total)
    back = np.zeros(len(texts))
    back[order] = out
    return back


SCORED = "row_id long, doc_id long, n_tokens long, head_known long, base_head double, model_head double, tail string"


def head_scores(docs: DataFrame, symbols, model) -> DataFrame:
    """What a worker can tell of each text: its likelihood and head words; the other words go out in `tail`."""
    source = docs.select(F.monotonically_increasing_id().alias("row_id"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = symbols.value, model.value
        for batch in batches:
            begin, size, rows, seqs = 0, 0, [], []
            for i in range(batch.num_rows):
                ws = tokens(batch.column(2)[i].as_py())
                seq, at = known.read(ws)
                in_head = at >= 0
                logs = known.logs[at[in_head]] if len(known.logs) else np.zeros(0)
                base = logs.sum()
                spelled = base - logs[at[in_head] < known.own].sum() - known.mass[seq].sum()
                rows.append((len(ws), int(in_head.sum()), base, spelled, b" ".join([ws[j] for j in np.flatnonzero(~in_head).tolist() if ws[j] != END]).decode()))
                seqs.append(seq)
                size += len(seq)
                if size >= 5 * TOGETHER or i == batch.num_rows - 1:
                    n, head, base_sum, rest, tail = zip(*rows)
                    total = log_likelihoods(now, seqs) + np.array(rest)
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(base_sum, pa.float64()), pa.array(total), pa.array(tail, pa.string())], names=["row_id", "doc_id", "n_tokens", "head_known", "base_head", "model_head", "tail"])
                    begin, size, rows, seqs = i + 1, 0, [], []

    return source.mapInArrow(run, SCORED)


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    training = docs.where(fold(docs["doc_id"], folds) != held_out)
    texts = training.select(training["text"].cast("string").alias("text"))
    counts = cut(count_tokens(texts))
    symbols, n, v, head_bin = fit_symbols(counts)
    shared = sc.broadcast(symbols)  # at most HEAD words and OWN + CLASSES symbols
    trained, _ = baum_welch(as_symbols(texts, shared), symbols.shares)
    model = sc.broadcast(trained)
    scored = cut(head_scores(docs, shared, model))
    tail = scored.where("tail <> ''").select("row_id", F.explode(F.split("tail", " ")).alias("word"))
    rare = counts.where(octave(F.col("n")) < head_bin).select(F.col("token").cast("string").alias("word"), "n")
    known = tail.join(rare, "word").groupBy("row_id").agg(F.sum(F.log10(F.col("n") + 1)).alias("tail_logs"), F.count("*").alias("tail_known"))
    logs = F.coalesce("tail_logs", F.lit(0.0))
    return scored.drop("tail").join(known, "row_id", "left").select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_head") + logs - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("model_head") + logs).alias("score"),
    )
