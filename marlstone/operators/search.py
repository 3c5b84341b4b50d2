"""Search lanes over source files: literal occurrences with exact locators, paths, words with BM25, vectors, ranking.

Files are DataFrames (doc_id, repo_id, file_path, text); hits carry character and byte offsets and line numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Needles that go to the workers in one block.
BLOCK = 20_000
HITS = "doc_id long, file_path string, item_id long, ordinal long, char_offset long, byte_offset long, line long"


def located(text: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(character, byte, line) of each hit (character offset first), in ascending order; the text is read once."""
    at = bytes_before = 0
    line = 1
    for start, _ in hits:
        between = text[at:start]
        bytes_before += len(between.encode())
        line += between.count("\n")
        at = start
        yield start, bytes_before, line


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay: the few whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def whole(text: str, start: int, end: int) -> bool:
    """Whether neither neighbour is a letter, a digit or _."""
    part = lambda c: c.isalnum() or c == "_"
    return not (start and part(text[start - 1])) and not (end < len(text) and part(text[end]))


def _found(files: DataFrame, needles: dict[str, list[int]], case_sensitive: bool = True, whole_word: bool = False) -> DataFrame:
    """HITS rows of one block of needles; the automaton reads each text once, however many needles there are."""
    by_form: dict[str, list[int]] = {}
    for needle, items in needles.items():
        by_form.setdefault(needle if case_sensitive else folded(needle), []).extend(items)
    needles = by_form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for needle in needles:
            machine.add_word(needle, needle)
        machine.make_automaton()
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                free, hits, counts = {}, [], {}
                for end, needle in machine.iter(text if case_sensitive else folded(text)):
                    start = end + 1 - len(needle)
                    if start >= free.get(needle, 0):  # occurrences of one needle do not overlap, as a left-to-right search has them
                        free[needle] = end + 1
                        if not whole_word or whole(text, start, end + 1):
                            hits.append((start, needle))
                if not hits:
                    continue
                hits.sort()
                rows = []
                for (start, needle), place in zip(hits, located(text, hits)):
                    ordinal = counts[needle] = counts.get(needle, -1) + 1
                    rows += [(item, ordinal, *place) for item in needles[needle]]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64()), pa.array([batch.column(1)[i].as_py()] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "file_path", "item_id", "ordinal", "char_offset", "byte_offset", "line"])

    return files.select(F.col("doc_id").cast("long"), "file_path", "text").where("text is not null").mapInArrow(run, HITS)


def verified(pairs: DataFrame, case_sensitive: bool = True, whole_word: bool = False) -> DataFrame:
    """Hits of pairs (doc_id, file_path, text, item_id, needle), as `needles_found` gives them: every pair is looked at on the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, path, text, item, needle in zip(*(c.to_pylist() for c in batch.columns)):
                hay, form = (text, needle) if case_sensitive else (folded(text), folded(needle))
                at, hits = hay.find(form), []
                while at >= 0:
                    if not whole_word or whole(text, at, at + len(form)):
                        hits.append((at, len(form)))
                    at = hay.find(form, at + len(form))
                rows += [(doc, path, item, k, *place) for k, place in enumerate(located(text, hits))]
            if rows:
                ints = [pa.int64(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ints)], names=["doc_id", "file_path", "item_id", "ordinal", "char_offset", "byte_offset", "line"])

    wanted = pairs.where(F.col("text").isNotNull() & (F.length("needle") > 0)).select(F.col("doc_id").cast("long"), "file_path", "text", F.col("item_id").cast("long"), "needle")
    return wanted.mapInArrow(run, HITS).select("item_id", "doc_id", "file_path", "ordinal", "char_offset", "byte_offset", "line")


def occurrences(files: DataFrame, needle: str, case_sensitive: bool = True, whole_word: bool = False) -> DataFrame:
    """(doc_id, file_path, ordinal, char_offset, byte_offset, line): every non-overlapping occurrence, left to right.
    Map-only: texts that hold the needle are read once where they are. Without case, characters are compared in lower
    case; whole words have neither letter, digit nor _ beside them."""
    if not needle:
        raise ValueError("the needle is empty")
    near = files.where(F.contains("text", F.lit(needle))) if case_sensitive else files
    return _found(near, {needle: [0]}, case_sensitive, whole_word).drop("item_id")


def needles_found(files: DataFrame, needles: DataFrame, case_sensitive: bool = True, whole_word: bool = False) -> DataFrame:
    """(item_id, doc_id, file_path, ordinal, char_offset, byte_offset, line) of every occurrence of each needle (item_id,
    needle) in each file; occurrences of one needle do not overlap. The needles are the stated query set: they go to the
    workers in blocks of BLOCK, the files stay in place. Needles that are null or empty have no occurrence."""
    wanted = sorted((r[0], r[1]) for r in needles.where(F.length("needle") > 0).select("item_id", "needle").collect())
    out = None
    for at in range(0, max(len(wanted), 1), BLOCK):
        block: dict[str, list[int]] = {}
        for item, needle in wanted[at : at + BLOCK]:
            block.setdefault(needle, []).append(item)
        part = _found(files if block else files.limit(0), block or {"-": []}, case_sensitive, whole_word)
        out = part if out is None else out.unionByName(part)
    return out.select("item_id", "doc_id", "file_path", "ordinal", "char_offset", "byte_offset", "line")


def path_hits(files: DataFrame, wanted: str) -> DataFrame:
    """(doc_id, file_path, rank): 0 the path itself, 1 a path that ends with /wanted, 2 one that starts with wanted, 3 one that holds it."""
    if wanted.startswith("/") or ".." in wanted.split("/"):
        raise ValueError("paths are relative and stay inside the repository")
    p, w = F.lower("file_path"), wanted.lower()
    rank = F.when(p == w, 0).when(F.endswith(p, F.lit("/" + w)), 1).when(F.startswith(p, F.lit(w)), 2).otherwise(3)
    return files.where(F.contains(p, F.lit(w))).select("doc_id", "file_path", rank.cast("long").alias("rank"))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(files: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score): files that hold all query terms, scored by BM25; corpus statistics in one pass."""
    ts = files.select("doc_id", terms(F.col("text")).alias("ts"))

    def frequency(term: str) -> Column:
        return F.size(F.filter("ts", lambda t: t == term))

    counted = ts.select("doc_id", F.size("ts").alias("len"), *[frequency(q).alias(f"tf{i}") for i, q in enumerate(query)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(query))])
    score = F.lit(0.0)
    every = F.lit(True)
    for i in range(len(query)):
        tf = F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
        every = every & (tf > 0)
    # one row of statistics meets the rows that matched
    return counted.where(every).join(F.broadcast(stats)).select("doc_id", F.round(score, 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector in doubles, of length 1; a zero vector stays zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    return F.element_at(F.transform(F.array(d), lambda x: F.transform(x, lambda y: y / F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)))), 1)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(dot(unit(a), unit(b)), F.lit(0.0))


def _by_length(vectors: list) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Places and unit vectors by number of components; null vectors, ones with null components and zero vectors are left out."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v) and not any(x is None for x in v):
            places.setdefault(len(v), []).append(i)
    at, units = {}, {}
    for n, rows in places.items():
        m = np.array([vectors[i] for i in rows], np.float64)
        norm = np.sqrt((m * m).sum(axis=1))
        at[n], units[n] = np.array(rows)[norm != 0], m[norm != 0] / norm[norm != 0, None]
    return at, units


def _best(asked: list[tuple], k: int, some: int = 500):
    """Per task, the k best rows (query_id, vec_id, cosine) of every query; queries are multiplied with a batch some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(np.array([r[0] for r in part], np.int64), _by_length([r[1] for r in part])) for part in (asked[i : i + some] for i in range(0, len(asked), some))]
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in blocks]  # place of the query, vector, cosine
        least = [np.full(len(ids), -np.inf) for ids, _ in blocks]
        for batch in batches:
            vecs = batch.column(0).to_numpy(zero_copy_only=False)
            at, units = _by_length(batch.column(1).to_pylist())
            for b, (ids, (q_at, q_units)) in enumerate(blocks):
                cosine = np.zeros((len(ids), len(vecs)))
                for n in q_at.keys() & at.keys():
                    cosine[np.ix_(q_at[n], at[n])] = q_units[n] @ units[n].T
                # compared as they are ranked: rounded, not a number before all numbers
                key = np.where(np.isnan(cosine), np.inf, np.round(cosine, 6))
                key[ids[:, None] == vecs[None, :]] = -np.inf
                if len(vecs) > k:
                    least[b] = np.maximum(least[b], np.partition(key, -k, axis=1)[:, -k])
                q, v = np.nonzero((key >= least[b][:, None]) & (key > -np.inf))
                q, vec, found = (np.concatenate(x) for x in zip(held[b], (q, vecs[v], cosine[q, v])))
                rank = np.where(np.isnan(found), np.inf, np.round(found, 6))
                order = np.lexsort((vec, -rank, q))
                q, vec, found, rank = q[order], vec[order], found[order], rank[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                least[b][q[nth == k - 1]] = rank[nth == k - 1]
                held[b] = q[nth < k], vec[nth < k], found[nth < k]
        for (ids, _), (q, vec, found) in zip(blocks, held):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(vec, pa.int64()), pa.array(found, pa.float64())], names=["query_id", "vec_id", "cosine"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 10_000) -> DataFrame:
    """(query_id, vec_id, cosine, rank) of the k nearest vectors to each query vector; ties by id. The query set is counted and
    goes to the executors in blocks of about `block` vectors; each task multiplies them with its batches of vectors and keeps its k
    best of every query before any row moves. Null, zero and unequally long vectors have cosine 0; rows without id are left out."""
    units = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long"), F.col("query").cast("array<double>"))
    parts = max(1, -(-asked.count() // block))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    out = None
    for part in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        scored = units.mapInArrow(_best([tuple(r) for r in some.collect()], k), "query_id long, vec_id long, cosine double").withColumn("cosine", F.round("cosine", 6))
        best = scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def dedupe_hits(hits: DataFrame, key: list[str]) -> DataFrame:
    """One hit per key: the best score, all reasons (sorted), the number of hits."""
    return hits.groupBy(*key).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"), F.count("*").alias("hits"))


def boosted(hits: DataFrame, feedback: DataFrame) -> DataFrame:
    """score + 0.02 for each useful and - 0.05 for each dead end verdict on the hit; other verdicts count nothing."""
    votes = feedback.groupBy("doc_id").agg(F.sum(F.when(F.col("verdict") == "useful", 0.02).when(F.col("verdict") == "dead_end", -0.05).otherwise(0.0)).alias("boost"))
    return hits.join(votes, "doc_id", "left").select("doc_id", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))


def within_budget(hits: DataFrame, budget: int, group: list[str], order: list) -> DataFrame:
    """Adds given_bytes: full snippets while the running sum of bytes is inside the budget, then the rest, then null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("snippet_bytes").over(w)
    before = run - F.col("snippet_bytes")
    return hits.withColumn("given_bytes", F.when(run <= budget, F.col("snippet_bytes")).when(before < budget, budget - before))


def spelling(words: DataFrame, wanted: str, k: int = 5) -> DataFrame:
    """(title, distance): the k nearest titles that hold the word or lie within max(2, len/3) edits of it."""
    distance = F.levenshtein(F.lower("title"), F.lit(wanted.lower()))
    return words.select("title", distance.cast("long").alias("distance")).where(F.contains(F.lower("title"), F.lit(wanted.lower())) | (F.col("distance") <= max(2, len(wanted) // 3))).orderBy("distance", "title").limit(k)
