"""Quality rules: heuristics, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over BUCKETS hash buckets of words and word pairs are counted in one pass: one over the trusted documents
(labels.quality = 1) outside the calibration fold, one over every document. A document's score is the mean over its
n-grams of log(p_trusted / p_raw), in whole millionths of a nat so that sums do not depend on their order; documents at
or above the threshold pass. The threshold follows from the scores of the trusted documents in the calibration fold (one
in FOLDS by crc32 of the id) that pass the base rules: MARGIN times as far below their median as their lowest
LOW-quantile, taken from an exact histogram of the scores; with fewer than LEAST such documents it is taken from all
trusted ones. Everything is built-in expressions over one row: nothing is shuffled but the counts and, where there are
more than BROADCAST_ROWS trusted ids, the join that marks them; the model is a fixed-size array literal.

Defined cases: null and empty texts have no words, fail the base rules and score 0; without trusted rows every ratio is
0 and every document that passes the base rules is kept; ties are equal scores and so equal verdicts; extra columns of
the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold, let, small, text_of, words

#: Hash buckets of n-grams.
BUCKETS = 1 << 14
#: One trusted document in FOLDS sets the threshold; how many there must be; the quantile, the margin, and the width of
#: the histogram's bins in millionths of a nat.
FOLDS, LEAST, LOW, MARGIN, BIN = 5, 20, 0.01, 2.0, 500
#: N-grams that the raw distribution counts for in the trusted one.
DRAW = 4096
SYMBOLS = "#*$%&|<>"
UNIT = 1_000_000


def ngram_buckets(ws: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""

    def of(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 2, F.size(h)), lambda b, i: F.xxhash64(F.get(h, i), b))
        return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, trusted (null, or whether the row is in the calibration fold)."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    ids = small(ids.withColumn("trusted", fold(F.col("trusted_id"), FOLDS) == 0), ids.count())
    return docs.select("doc_id", text_of(docs).alias("text")).join(ids, F.col("doc_id") == ids["trusted_id"], "left").drop("trusted_id")


def fit(marked: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Millionths of a nat for each bucket; only the bounded table of counts comes to the driver."""
    counts = marked.select((~F.coalesce("trusted", F.lit(True))).cast("long").alias("good"), F.explode(ngram_buckets(words(F.col("text")), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = {r["bucket"]: r["raw"] for r in counts}, {r["bucket"]: r["good"] for r in counts}
    n_raw, n_good = sum(raw.values()) + buckets, sum(good.values())
    if not n_good:
        return [0] * buckets
    share = [(raw.get(b, 0) + 1) / n_raw for b in range(buckets)]
    # the trusted share is drawn towards the raw one, so that what a small sample lacks speaks against a text mildly
    return [round(UNIT * math.log((good.get(b, 0) + DRAW * share[b]) / (n_good + DRAW) / share[b])) for b in range(buckets)]


def calibrated(marked: DataFrame, weights: list[int]) -> int:
    """The threshold that the scores of trusted documents set."""
    def scores(rows: DataFrame) -> list[tuple[int, int]]:
        # no filter on the measures: it would be pushed below the join that finds the rows, and run over all texts
        scored = measures(rows).select(F.when(~base_failed(), F.floor(score(F.col("ws"), weights) / BIN)).alias("bin"))
        return [tuple(r) for r in scored.groupBy("bin").count().collect() if r[0] is not None]  # at most a row for each bin

    held = scores(marked.where("trusted"))
    if sum(n for _, n in held) < LEAST:
        held = scores(marked.where("trusted is not null"))
    if not held:
        return -(1 << 62)

    def quantile(q: float) -> int:
        left = q * sum(n for _, n in held)
        for b, n in sorted(held):
            if (left := left - n) <= 0:
                return b * BIN
        return max(held)[0] * BIN

    middle = quantile(0.5)
    return math.floor(middle - MARGIN * (middle - quantile(LOW)) - BIN)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Low bits of a window's key that hold its position: enough for any string Spark can hold.
PLACE = 30


def repeated_words(ws: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.

    Windows are sorted by 64-bit keys that carry a hash above and the position below; windows whose hash part agrees
    with a neighbour's are compared again as whole strings, so that the count is exact.
    """

    def keys(h: Column) -> Column:
        return F.sort_array(F.transform(F.slice(h, 3, F.size(h)), lambda c, i: F.shiftleft(F.xxhash64(F.get(h, i), F.get(h, i + 1), c), PLACE).bitwiseOR(i.cast("long"))))

    def suspects(k: Column) -> Column:
        near = F.filter(k, lambda x, i: (F.shiftright(F.get(k, i + 1).bitwiseXOR(x), PLACE) == 0) | (F.shiftright(F.get(k, i - 1).bitwiseXOR(x), PLACE) == 0))
        return F.transform(near, lambda x: x.bitwiseAND((1 << PLACE) - 1).cast("int"))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["s"] == F.get(s, i + 1)["s"]) | (x["s"] == F.get(s, i - 1)["s"]))

    def covered(w: Column) -> Column:
        found = let(let(F.transform(w, lambda x: F.xxhash64(x)), keys), suspects)
        named = F.array_sort(F.transform(found, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("s"), i.alias("i"))))
        return F.size(F.array_distinct(F.flatten(F.transform(let(named, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(ws, lambda w: F.when(F.size(w) > 3, covered(w)).otherwise(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, words, and the base counts of each document."""
    text = text_of(docs)
    base = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), words(text).alias("ws"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id",
        "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc + F.char_length(w)).alias("word_chars"),
        sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
    )


def score(ws: Column, weights: list[int]) -> Column:
    """Mean ratio of the n-grams in millionths of a nat; 0 without any."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    total = F.aggregate(ngram_buckets(ws, len(weights)), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b).cast("long"))
    return F.when(F.size(ws) > 0, F.floor(total / (2 * F.size(ws) - 1))).otherwise(0).cast("long")


def judge(docs: DataFrame, labels: DataFrame, threshold: int | None = None, **how) -> DataFrame:
    """One row per document: the base counts, base_failed, score and kept; the threshold is calibrated if none is given."""
    marked = with_trust(docs, labels)
    weights = fit(marked, **how)
    if threshold is None:
        threshold = calibrated(marked, weights)
    rows = measures(docs).withColumn("base_failed", base_failed()).withColumn("score", score(F.col("ws"), weights))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
