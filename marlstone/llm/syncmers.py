"""Document fingerprints from closed syncmers over words.

A k-word window is chosen if the smallest hash of its (k - s + 1) inner s-word substrings stands at either edge; the
choice depends on the window alone, so equal passages give equal anchors wherever they stand. The fingerprint of a text
is all its anchors in text order, 24 hexadecimal digits each: 16 of the hash and 8 of the word position. The likeness of
two texts is the Dice share of all their distinct anchor hashes, counted and not estimated. Positional matching goes
further: shared anchors are lined up by how far they are apart in the two texts, and `aligned` is the share of those on
the commonest distance, so that passages in another order count less.

Defined cases: null text is empty; texts with fewer than k words have one anchor, the hash of all their words; texts
without words have none, and their fingerprint is the empty string; two empty fingerprints have likeness 1; equal texts
have equal fingerprints. Neighbours go by (doc_id, nulls first; text hash); rows alike in both follow one another. Ids are
taken to be nearly unique: rows of one id are put in order by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import BROADCAST_ROWS, let, text_of, words
from marlstone.session import cut

K, S = 5, 2
#: Ids that share a bucket, and so a task's window, when texts are dealt out by id.
BUCKET_IDS = 256


def substring_hashes(ws: Column, s: int) -> Column:
    """Hashes of the s-word substrings, in order."""
    out = F.transform(ws, lambda w: F.xxhash64(w))
    for _ in range(s - 1):
        out = let(out, lambda h: F.transform(F.slice(h, 2, F.size(h)), lambda b, i: F.xxhash64(F.get(h, i), b)))
    return out


def sliding_min(h: Column, width: int) -> Column:
    """Smallest of each `width` neighbours, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = let(out, lambda m: F.zip_with(F.slice(m, 1, F.greatest(F.size(m) - step, F.lit(0))), F.slice(m, step + 1, F.size(m)), lambda a, b: F.least(a, b)))
        have += step
    return out


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position, hash>>: word position (from 0) and hash of every chosen window."""
    width = k - s + 1
    inner = sorted({*range(0, width, s), width - 1})  # substrings that cover the window

    def chosen(h: Column) -> Column:
        def pick(m: Column, i: Column) -> Column:
            edge = (m == F.get(h, i)) | (m == F.get(h, i + (width - 1)))
            return F.when(edge, F.struct(i.alias("position"), F.xxhash64(*[F.get(h, i + j) if j else F.get(h, i) for j in inner]).alias("hash")))

        return F.array_compact(F.transform(sliding_min(h, width), pick))

    def short(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<struct<position:int,hash:bigint>>")).otherwise(F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(w).alias("hash"))))

    return let(words(text), lambda w: F.when(F.size(w) < k, short(w)).otherwise(let(substring_hashes(w, s), chosen)))


def marks(text: Column, k: int = K, s: int = S) -> Column:
    """struct<anchors, hashes>: all anchors in text order, and their distinct hashes."""
    return let(anchors(text, k, s), lambda a: F.struct(a.alias("anchors"), F.array_distinct(F.transform(a, lambda x: x["hash"])).alias("hashes")))


def fingerprint(found: Column) -> Column:
    """Hash and position of every anchor, as hexadecimal digits."""
    digits = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return F.array_join(F.transform(found, lambda a: F.concat(digits(a["hash"], 16), digits(a["position"], 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct hashes in common, 2 |A and B| / (|A| + |B|)."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def aligned(a: Column, b: Column) -> Column:
    """Share of anchors that match at the commonest distance of positions, each hash once: 2 m / (|A| + |B|)."""

    def side(found: Column, k: int, sign: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), F.lit(k).alias("side"), (sign * x["position"]).alias("place")))

    def distances(both: Column) -> Column:
        # sorted by hash, side and place, which is negative in a: the first of a hash in a and its first in b are neighbours
        def apart(y: Column, i: Column) -> Column:
            x = F.get(both, i)
            return F.when((x["hash"] == y["hash"]) & (x["side"] < y["side"]), -x["place"] - y["place"])

        return F.array_sort(F.array_compact(F.transform(F.slice(both, 2, F.size(both)), apart)))

    def longest(d: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        return F.aggregate(d, start, step, lambda acc: acc["best"])

    n = F.size(a["hashes"]) + F.size(b["hashes"])
    return F.when(n == 0, 1.0).otherwise(2 * longest(let(F.sort_array(F.concat(side(a["anchors"], 0, -1), side(b["anchors"], 1, 1))), distances)) / n)


def fingerprints(docs: DataFrame, **how) -> DataFrame:
    """doc_id, anchors and fingerprint of each text."""
    text = text_of(docs)
    found = docs.select("doc_id", anchors(text, **how).alias("anchors"))
    return found.select("doc_id", "anchors", fingerprint(F.col("anchors")).alias("fingerprint"))


def with_next(docs: DataFrame, value) -> DataFrame:
    """doc_id, text, value(text) as own, next_text, next_own: also those of the next document by id, where the last
    document's next is the first.

    Texts are dealt out once, by id bucket; each bucket's first document is also sent to the bucket before it, which
    holds about one text in BUCKET_IDS a second time.
    """
    # rows without an id go by hash, in up to 4096 buckets before all others
    bucket = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.floor(F.col("doc_id") / BUCKET_IDS), F.shiftright("tie", 52)).cast("long").alias("n"))
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")).withColumn("bucket", bucket)
    # the buckets in order, each with the one before it
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    n_parts = max(1, rows.rdd.getNumPartitions() // 4)
    ordered = cut(firsts.repartitionByRange(n_parts, "bucket").sortWithinPartitions("bucket").withColumn("at", F.monotonically_increasing_id()))
    counts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a row per partition
    total = sum(n for _, n in counts)
    start, starts = 0, {}
    for part, n in sorted(counts):
        starts[part], start = start, start + n
    if not total:
        return rows.select("doc_id", "text", value(F.col("text")).alias("own"), F.col("text").alias("next_text"), value(F.col("text")).alias("next_own")).limit(0)
    offset = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{p}":{o}' for p, o in starts.items()) + "}"), "map<string,bigint>"), F.shiftright("at", 33).cast("string"))
    ranked = cut(ordered.select("bucket", "first", (offset + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank")))
    before = ranked.select(F.col("bucket").alias("to"), ((F.col("rank") + 1) % total).alias("next_rank"))
    ghosts = ranked.join(before, F.col("rank") == F.col("next_rank")).select("to", F.col("first.doc_id").alias("g_id"), F.col("first.tie").alias("g_tie"), "bucket")
    ghosts = cut(ghosts)
    if total <= BROADCAST_ROWS:
        ghosts = F.broadcast(ghosts)
    sent = rows.drop("bucket").join(ghosts, F.expr("doc_id <=> g_id AND tie = g_tie")).select(F.col("to").alias("bucket"), "doc_id", "text", "tie", F.lit(1).alias("ghost"))
    both = rows.select("bucket", "doc_id", "text", "tie", F.lit(0).alias("ghost")).unionByName(sent)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tie")
    # the second window keeps the first one's partitions and order; between them each text's value is computed once
    seen = both.withColumn("next_text", F.lead("text").over(order)).withColumn("own", value(F.col("text")))
    return seen.withColumn("next_own", F.lead("own").over(order)).where("ghost = 0").select("doc_id", "text", "own", "next_text", "next_own")


def edited(text: Column, after: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def compared(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, aligned_edited and
    aligned_next."""
    rows = with_next(docs, lambda text: marks(text, **how)).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", marks(F.col("edited"), **how).alias("other"), "next_own")
    own, other, after = F.col("own.hashes"), F.col("other.hashes"), F.col("next_own.hashes")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own.anchors")).alias("fingerprint"), fingerprint(F.col("other.anchors")).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"), aligned(F.col("own"), F.col("other")).alias("aligned_edited"), aligned(F.col("own"), F.col("next_own")).alias("aligned_next"))
