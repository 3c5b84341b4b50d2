"""Vector codes (product quantisation) whose codebooks are learned by Elkan's form of Lloyd's rounds.

Vectors are cut into equal parts; each part position has a codebook of its own. For every part of every vector an upper
bound of the distance to its entry and a lower bound for each entry are kept from round to round, as single floats rounded
outward, in a table of the shared folder. When entries move, bounds are shifted by the movement. An entry is passed over
only if the upper bound is strictly below its lower bound, or strictly below half its distance from the entry that is
assigned (the triangle inequality); all others are compared by exact integer distances, ties to the lower index. So results
equal those of full comparison.

Defined cases: rows with a null vector, or with null, NaN or infinite components, are dropped; so are empty vectors, those
whose length is no multiple of the number of parts, and those of another length than the first kept row's. Rows go by
vec_id, nulls last, then by their components. With fewer rows than entries codebooks are as short. Repeated rows count each. Null
labels are one label. An empty table gives an empty result. Integers beyond 2^27 are an error. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import new_folder, removed, small, written
from marlstone.llm.vectors import integers, lists, matrix, means, squared, usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


class Bounds(NamedTuple):
    """Of one part of n vectors: assigned entries (n), upper bounds (n) and lower bounds (n, entries)."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def shifted(b: Bounds, moved: np.ndarray) -> Bounds:
    """Bounds that hold after each entry moved so far."""
    return Bounds(b.entry, above(b.upper + moved[b.entry]), below(b.lower - moved))


def nearest(x: np.ndarray, book: np.ndarray, b: Bounds) -> tuple[Bounds, int]:
    """Nearest entries with bounds, and the number of distances that were worked out."""
    half = below(np.sqrt(np.stack([squared(book, c) for c in book])) / 2)

    def open_pairs(entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        pairs = (lower <= upper[:, None]) & (half[entry] <= upper[:, None])
        pairs[np.arange(len(entry)), entry] = False
        return pairs

    entry, upper, lower = b.entry.copy(), b.upper.copy(), b.lower.copy()
    rows = np.flatnonzero(open_pairs(entry, upper, lower).any(axis=1))
    own = entry[rows]
    exact = squared(x[rows], book[own])
    i, j = np.nonzero(open_pairs(own, above(np.sqrt(exact)), lower[rows]))
    found = squared(x[rows[i]], book[j])
    distance = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    distance[np.arange(len(rows)), own] = exact
    distance[i, j] = found
    lower[rows, own] = below(np.sqrt(exact))
    lower[rows[i], j] = below(np.sqrt(found))
    entry[rows] = distance.argmin(axis=1)
    upper[rows] = above(np.sqrt(distance.min(axis=1)))
    return Bounds(entry, upper, lower), len(rows) + len(i)


def _assigned(state: DataFrame, books: list[np.ndarray], moved: list[np.ndarray]) -> DataFrame:
    """state (row, ints, code, upper, lower) with entries and bounds for these codebooks."""
    parts, width = len(books), sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, code = matrix(batch.column("ints"), width), matrix(batch.column("code"), parts)
            floats = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.float32).reshape(n, parts, -1)
            upper, lower = floats("upper"), floats("lower")
            out = [nearest(part, book, shifted(Bounds(code[:, p], upper[:, p, 0], lower[:, p]), moved[p]))[0] for p, (part, book) in enumerate(zip(np.split(x, parts, axis=1), books))]
            binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("ints"), lists(np.stack([b.entry for b in out], axis=1)), binary(np.stack([b.upper for b in out], axis=1)), binary(np.stack([b.lower for b in out], axis=1))],
                names=["row", "ints", "code", "upper", "lower"],
            )

    return state.mapInArrow(run, state.schema)


def encode(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(row, code, error) of every kept vector, and the codebooks (by part and entry): row holds the kept columns, code the
    entries in the order of the parts, error the squared distance from what the code stands for."""
    spark = vectors.sparkSession
    folder = new_folder(spark, "vector-codes")
    length = F.size(vectors["embedding"])
    fits = usable(vectors["embedding"]) & (length > 0) & (length % parts == 0)
    good = vectors.where(fits).select(F.struct(*[vectors[c] for c in keep]).alias("row"), vectors["vec_id"].alias("id"), length.alias("length"), integers(vectors["embedding"], scale).alias("ints"))
    order = [F.col("id").asc_nulls_last(), "ints"]
    first = good.orderBy(*order).select("length").limit(1).collect()
    if not first:
        return good.select("row", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False)), []
    width = first[0].length
    kept = good.where(F.col("length") == width)
    starts = [r.ints for r in kept.orderBy(*order).limit(entries).collect()]
    cut = width // parts
    books = [[s[p * cut : (p + 1) * cut] for s in starts] for p in range(parts)]
    arrays = lambda b: [np.array(x, np.int64) for x in b]
    none = Bounds(np.zeros(parts), np.full(parts, np.inf, np.float32), np.zeros((parts, len(starts)), np.float32))
    state = kept.select("row", "ints", F.array_repeat(F.lit(0), parts).alias("code"), F.lit(bytearray(none.upper.tobytes())).alias("upper"), F.lit(bytearray(none.lower.tobytes())).alias("lower"))
    moved = [np.zeros(len(starts))] * parts
    for k in range(rounds + 1):
        state = written(_assigned(state, arrays(books), moved), f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
        new = means(state, parts, books) if k < rounds else books
        moved = [np.sqrt(squared(a, b)) for a, b in zip(arrays(new), arrays(books))]
        if new == books:
            break  # nothing moves any more: further rounds would change nothing
        books = new
    final = arrays(books)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, code = matrix(batch.column("ints"), width), matrix(batch.column("code"), parts)
            error = sum(squared(part, final[p][code[:, p]]) for p, part in enumerate(np.split(x, parts, axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("code"), pa.array(error, pa.int64())], names=["row", "code", "error"])

    out = state.select("row", "ints", "code")
    return out.mapInArrow(errors, out.select("row", "code", F.lit(0).cast("long").alias("error")).schema), books


def codes(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    coded, books = encode(vectors, keep=("vec_id", "label"), **how)
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    hexes = F.array_join(F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    rows = coded.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), hexes.alias("code"), "error")
    # partial sums before they move; a label that holds a large part of all rows meets one row
    sums = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), new_folder(vectors.sparkSession, "label-errors"))
    return rows.join(small(sums, sums.count()), rows["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by full comparison, every round spelled out."""
    ctes = [
        f"""good AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0 AND len(embedding) % {parts} = 0)""",
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, * FROM good WHERE len(v) = (SELECT len(v) FROM good ORDER BY vec_id NULLS LAST, v LIMIT 1))",
        f"long AS MATERIALIZED (SELECT rid, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS d, v[i] AS x FROM (SELECT rid, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM kept))",
        f"book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, d, x AS c FROM long WHERE rid <= {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(f"near{k} AS MATERIALIZED (SELECT rid, p, min(struct_pack(s := s, e := e)) AS m FROM (SELECT rid, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS s FROM long JOIN book{k} USING (p, d) GROUP BY rid, p, e) GROUP BY rid, p)")
        if k < rounds:
            ctes.append(f"mean{k} AS MATERIALIZED (SELECT p, n.m.e AS e, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM long JOIN near{k} n USING (rid, p) GROUP BY ALL)")
            ctes.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, d, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{k} LEFT JOIN mean{k} USING (p, e, d))")
    last = rounds
    ctes.append(f"coded AS (SELECT rid, string_agg(lpad(printf('%x', m.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.s) AS BIGINT) AS error FROM near{last} GROUP BY rid)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM book{last})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), digest"
