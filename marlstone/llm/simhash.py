"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into BLOCKS blocks. Two fingerprints that differ in at most DISTANCE bits agree on at
least BLOCKS - DISTANCE blocks, so they share the key made of some choice of that many blocks. Distinct fingerprints
are joined on those keys, each pair is verified by its Hamming distance, and the components of the links are found.

The pipeline's stage (`keep_one_similar`) removes texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or
more. At 0.8 two 64-bit fingerprints differ in some 10 bits, which no choice of blocks finds at a bearable number of keys,
so there the blocks' pairs are joined by others, of texts that share one of BANDS keys of ROWS minimum hashes each. Every
pair, of either kind, is verified on the whole sets. Texts first meet the least text of each key they have; then, where a
key has texts of several classes, those outside its largest class meet all others of the key that are not in their own. So
any two texts that share a key are of one class or were compared. In keys of at most SMALL texts these meetings are rows of
pairs; a sketch of one byte a minimum hash lets a pair through if at least LIKE bytes agree, which a pair at 0.8 fails in
less than one of a million cases. Larger keys are cut into blocks of BLOCK hashes, and every two blocks that have to meet
are one group of rows: its whole sets are compared inside the task, which gives a forest of links between classes and no
row for a pair. Rows grow with a key's texts times its blocks; what a task holds does not grow.

With 6 blocks and distance 3 a key holds 32 or so bits: chance pairs stay rare where single 16-bit blocks would pair
a large part of the table with itself. Copies collapse to one fingerprint first, whatever their number.

Defined cases: null text is empty; texts without words have fingerprint zero, linked like any other; a null doc_id is
never a component's id unless all ids of the component are null; extra columns of the input are not looked at. For
similarity, a text with fewer words than a shingle has one shingle, all its words; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marlstone.llm.components import components
from marlstone.session import Rounds, cut

SHINGLE, SEED, BLOCKS, DISTANCE = 3, 42, 6, 3
#: Words of a shingle and least Jaccard similarity of near copies; keys of a text, and minimum hashes in each: a pair at
#: 0.8 shares no key in (1 - 0.8^6)^24 = 0.07 % of cases.
NEAR_SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 6
#: Equal bytes of two sketches that a pair needs to be verified.
LIKE = 88
#: Texts of a key that meet as rows of pairs; hashes of a block of a larger key, where each text counts as EACH more, so that
#: short ones are bounded too; columns that are multiplied at a time.
SMALL, BLOCK, EACH, COLUMNS = 16, 1 << 16, 64, 4096
#: Shingles whose bits are summed at a time.
STEP = 65_536


def hash_parts(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in order, at most STEP at a time."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and the white space 9 to 13 and 32
    ws = (text or "").encode("utf-8").lower().split()
    n = max(1, len(ws) - shingle + 1) if ws else 0
    for at in range(0, n, STEP):
        part = ws[at : at + STEP + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle))) if len(ws) > shingle else [part]
        yield np.fromiter((xxh64_intdigest(b" ".join(p), seed) for p in parts), np.uint64, min(STEP, n - at))


def majority(parts: Iterator[np.ndarray]) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(hash_parts(text, shingle, seed))


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The kept columns packed in `row`, and fingerprint as a signed long."""
    source = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["row", "fingerprint"])

    schema = source.select("row", F.lit(0).cast("long").alias("fingerprint")).schema
    return source.mapInArrow(run, schema)


def links(fps: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """(a, b): the pairs of distinct fingerprints (column fp) within the distance, each once or more."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    choices = [signed(sum(c)) for c in combinations(masks, blocks - distance)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in choices])).alias("choice", "key"))
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, ["choice", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def classes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """(row, fingerprint, component_id): component_id is the smallest doc_id that links can reach."""
    if "doc_id" not in keep:
        raise ValueError("doc_id names the components and has to be kept")
    marked = cut(with_fingerprints(docs, keep))
    firsts = cut(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.col("row.doc_id").cast("long")).alias("first")))
    found = components(links(firsts.select("fp"), blocks, distance))
    members = firsts.join(found, firsts["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    # the least id is summed up before rows move, so that a component with a large part of all fingerprints fills no task
    least = members.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = members.join(least, "component").select("fp", "component_id")
    return marked.join(ids, marked["fingerprint"] == ids["fp"], "left").select("row", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    return classes(docs, **how).select("row.doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int = NEAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hash_parts(text, shingle, seed)]))


@cache
def mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return tuple(rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def minimum_hashes(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each of n mixed orders; those of no hashes are all alike."""
    factors, shifts = mixers(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP // 16):
        mixed = hashes[at : at + STEP // 16, None] * factors + shifts
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band, from `rows` minimum hashes."""
    return np.array([xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def similar_classes(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, fingerprint, component_id) of docs (doc_id, text, tie): fingerprint is the hash of a text's shingle set,
    component_id the smallest doc_id reachable over pairs with at least the similarity. Texts move only for the
    candidates of such pairs."""
    source = docs.select(F.struct("doc_id", "tie").alias("row"), docs["text"].cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, simhash, keys, sketch, size = [], [], [], [], []
            for t in batch.column(1):
                parts = list(hash_parts(t.as_py(), shingle, SEED))
                hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
                whole.append(xxh64_intdigest(hashes.tobytes(), SEED))
                simhash.append(majority(parts))
                least = minimum_hashes(hashes)
                keys.append(band_keys(least))
                sketch.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                size.append(len(hashes))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(whole), signed(simhash), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(size, pa.int64())], names=["row", "fingerprint", "simhash", "keys", "sketch", "size"])

    schema = source.select("row", F.lit(0).cast("long").alias("fingerprint"), F.lit(0).cast("long").alias("simhash"), F.array(F.lit(0).cast("long")).alias("keys"), F.lit(b"").alias("sketch"), F.lit(0).cast("long").alias("size")).schema
    marked = cut(source.mapInArrow(mark, schema))
    sets = cut(marked.groupBy(F.col("fingerprint").alias("s")).agg(F.min("row").alias("lead"), F.min(F.col("row.doc_id").cast("long")).alias("first"), F.min("simhash").alias("fp"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"), F.min("size").alias("size")))
    tables = Rounds(docs.sparkSession, "similar")
    keyed = sets.select("s", (F.col("size") + EACH).alias("size"), F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low < high")
    keyed = tables.keep(keyed.join(shared, ["band", "key"]))
    tried = tables.keep(_first_pairs(sets, keyed))
    # whole sets are made once, for all that may be compared with another
    ends = [keyed.select("s"), tried.select(F.col("a").alias("s")), tried.select(F.col("b").alias("s"))]
    paired = tables.keep(ends[0].unionAll(ends[1]).unionAll(ends[2]).distinct())
    whole_sets = tables.keep(_hash_sets(docs, sets.join(paired, "s"), shingle))
    sketches = tables.keep(sets.select("s", "sketch").join(paired, "s"))
    verify = lambda pairs: tables.keep(_verified(whole_sets, tables.keep(_alike(sketches, pairs)), similarity))
    of = components(verify(tried)).withColumnRenamed("node", "s")
    named = tables.keep(keyed.select("band", "key", "s", "size").join(of, "s", "left").select("band", "key", "s", "size", F.coalesce("component", "s").alias("c")))
    # sums by class and then by key, so that no key's texts are gathered
    by_class = named.groupBy("band", "key", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    by_key = by_class.groupBy("band", "key").agg(F.count("*").alias("several"), F.sum("n").alias("n"), F.sum("size").alias("all"), F.max(F.struct("n", "c", "size")).alias("at")).where("several > 1")
    inside = tables.keep(named.join(by_key.select("band", "key", "n", "all", F.col("at.c").alias("largest"), F.col("at.size").alias("own")), ["band", "key"]))
    few = inside.where(F.col("n") <= SMALL)
    left, right = few.where("c <> largest").select("band", "key", "s", "c"), few.select("band", "key", F.col("s").alias("t"), F.col("c").alias("d"))
    pairs = left.join(right, ["band", "key"]).where("c <> d").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    pairs = tables.keep(pairs.join(tried, ["a", "b"], "left_anti"))
    of = _merged(paired, of, verify(pairs).unionByName(tables.keep(_met_in_blocks(whole_sets, inside.where(F.col("n") > SMALL), similarity))), tables)
    members = sets.join(of, "s", "left").select("s", "first", F.coalesce("component", "s").alias("component"))
    least = members.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = members.join(least, "component").select("s", "component_id")
    return marked.join(ids, marked["fingerprint"] == ids["s"], "left").select("row", "fingerprint", "component_id")


def _first_pairs(sets: DataFrame, keyed: DataFrame) -> DataFrame:
    """(a, b): sets that share a band's key with its least one, or whose fingerprints are DISTANCE bits apart or less. Ends of
    keys and equal fingerprints are found by partial sums, so no group is gathered."""
    stars = keyed.select("s", F.col("low").alias("t"))
    by_fp = cut(sets.groupBy("fp").agg(F.min("s").alias("t")))
    same = sets.join(by_fp, "fp").select("s", "t")
    of = lambda c: by_fp.select(F.col("fp").alias(c), F.col("t").alias(f"{c}_t"))
    blocks = links(by_fp.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_t").alias("s"), F.col("b_t").alias("t"))
    return stars.unionByName(same).unionByName(blocks).where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in LIKE bytes or more."""
    of = lambda c: sets.select(F.col("s").alias(c), F.col("sketch").alias(f"{c}_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= LIKE, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def _met_in_blocks(whole: DataFrame, inside: DataFrame, similarity: float) -> DataFrame:
    """(a, b): classes that pairs with the similarity link within a key, as a forest of each group; of inside (band, key, s, c,
    largest, and the hashes of `all` and of the largest class's `own`). Texts outside the largest class are in the first
    blocks of their key, and these meet one another and all the rest."""
    blocks = lambda hashes: F.ceil(hashes / BLOCK).cast("int")
    one = F.col("all") <= BLOCK
    first = F.when(one, 1).otherwise(F.greatest(blocks(F.col("all") - F.col("own")), F.lit(1)))
    last = F.when(one, 0).otherwise(F.greatest(blocks(F.col("own")), F.lit(1)))
    nth = lambda n: F.pmod(F.xxhash64("s"), n).cast("int")
    own = F.when((F.col("c") == F.col("largest")) & (F.col("last") > 0), F.col("first") + nth(F.greatest("last", F.lit(1)))).otherwise(nth(F.col("first")))
    at = inside.withColumns({"first": first, "last": last}).withColumn("block", own)
    # an outer block meets all, a block of the largest class the outer ones only
    others = F.sequence(F.lit(0), F.when(F.col("block") < F.col("first"), F.col("first") + F.col("last") - 1).otherwise(F.col("first") - 1))
    cells = at.select("band", "key", "s", "c", "block", F.explode(others).alias("other"))
    cells = cells.select("band", "key", "s", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def meet(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("hashes")]
        names, of = np.unique(rows.column("c").to_numpy(), return_inverse=True)
        block, i, j = rows.column("block").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        x, y = (np.flatnonzero(block == k) for k in (i, j))
        xs = [sets[k] for k in x]
        p, q = np.nonzero(_near(xs, xs if i == j else [sets[k] for k in y], similarity))
        linked = np.zeros((len(names), len(names)), bool)
        linked[of[x[p]], of[y[q]]] = True
        a, b = _forest(linked | linked.T)
        return pa.table({"a": pa.array(names[a], pa.int64()), "b": pa.array(names[b], pa.int64())})

    return cells.join(whole, "s").select("band", "key", "c", "block", "i", "j", "hashes").groupBy("band", "key", "i", "j").applyInArrow(meet, "a long, b long")


def _near(xs: list[np.ndarray], ys: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each set of xs (down) and each of ys (across) have the similarity; a set and itself need not."""
    flat = lambda sets: (np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(h) for h in sets], np.int64))
    (hx, nx), (hy, ny) = flat(xs), flat(ys)
    values, times = np.unique(hx, return_counts=True)
    common = values[times > 1] if xs is ys else np.intersect1d(values, hy)
    both = np.zeros((len(xs), len(ys)))
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        both += _marks(hx, nx, part) @ _marks(hy, ny, part).T
    return both >= similarity * (nx[:, None] + ny - both) - 1e-9


def _marks(hashes: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A row for each set, a column for each value: 1 where the set has it."""
    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    there = values[at] == hashes
    marks = np.zeros((len(sizes), len(values)), np.float32)
    marks[np.repeat(np.arange(len(sizes)), sizes)[there], at[there]] = 1
    return marks


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) from the first member of each component to each of its others, of a symmetric matrix."""
    free, a, b = np.ones(len(linked), bool), [], []
    for k in range(len(linked)):
        if free[k]:
            free[k], now = False, np.array([k])
            while len(now):
                now = np.flatnonzero(linked[now].any(0) & free)
                free[now] = False
                a.append(np.full(len(now), k)), b.append(now)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))


def _merged(sets: DataFrame, of: DataFrame, near: DataFrame, tables: Rounds) -> DataFrame:
    """(s, component) after more links: components of components."""
    known = tables.keep(sets.select("s").join(of, "s", "left").select("s", F.coalesce("component", "s").alias("component")))
    at = lambda c: known.select(F.col("s").alias(c), F.col("component").alias(f"{c}_at"))
    joined = components(near.join(at("a"), "a").join(at("b"), "b").select(F.col("a_at").alias("a"), F.col("b_at").alias("b")))
    return known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("s", F.coalesce("new", "component").alias("component"))


def _hash_sets(docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """(s, hashes): the whole sets of these, from the texts of their leads; texts move here and nowhere else."""
    named = lambda c: [F.coalesce(c("doc_id").cast("long"), F.lit(0)).alias("k"), c("doc_id").isNull().alias("none"), c("tie").alias("tie")]
    leads = sets.select("s", *named(lambda c: F.col(f"lead.{c}")))
    texts = docs.select(*named(lambda c: docs[c]), docs["text"].cast("string").alias("text")).join(leads, ["k", "none", "tie"]).select("s", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())], names=["s", "hashes"])

    return texts.mapInArrow(hashes, "s long, hashes binary").dropDuplicates(["s"])


def _verified(whole: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the Jaccard similarity."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: whole.select(F.col("s").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_hashes", "b_hashes").mapInArrow(near, "a long, b long")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The input's columns, one document of each class of linked fingerprints: that with the smallest doc_id."""
    tie = F.xxhash64(docs["text"])
    return _lead_rows(docs, classes(docs.select("doc_id", "text", tie.alias("tie")), keep=("doc_id", "tie"), **how))


def keep_one_similar(docs: DataFrame, **how) -> DataFrame:
    """The input's columns, one document of each class of near copies: that with the smallest doc_id."""
    tie = F.xxhash64(docs["text"])
    return _lead_rows(docs, similar_classes(docs.select("doc_id", "text", tie.alias("tie")), **how))


def _lead_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose id names their component.

    Only ids and fingerprints moved to find the classes; the texts then meet the kept ids in one shuffle. Of rows that
    repeat the smallest id one stays; a class whose ids are all null keeps one row for each of its fingerprints.
    """
    tie = F.xxhash64(docs["text"])
    lead = found.where(F.expr("row.doc_id <=> component_id")).select(F.coalesce(F.col("row.doc_id").cast("long"), F.col("fingerprint")).alias("k"), F.col("row.doc_id").isNull().alias("none"), F.col("row.tie").alias("tie"))
    lead = lead.groupBy("k", "none").agg(F.min("tie").alias("tie"))
    # a null id is replaced by the text's hash on both sides, so that plain keys join and then deal out the window
    lead = lead.select(F.when(F.col("none"), F.lit(0)).otherwise(F.col("k")).cast("long").alias("k"), "none", "tie")
    whole = docs.select(F.struct("*").alias("whole"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("k"), docs["doc_id"].isNull().alias("none"), tie.alias("tie"))
    same = Window.partitionBy("k", "none", "tie").orderBy("k")
    return whole.join(lead, ["k", "none", "tie"]).withColumn("nth", F.row_number().over(same)).where("nth = 1").select("whole.*")
