"""Clusters of vectors by sort-means.

In every round the distances between centroids are worked out once and, for each centroid, the others are put in the order of
their distance from it. A vector starts from the centroid it had, goes through the others in that order, and stops at the
first whose distance from it is strictly beyond twice the vector's own distance: by the triangle inequality nothing from there on is as near.
Distances are exact integers, so the test (squared: beyond four times) has no rounding and ties are always compared.

What is kept from round to round is the vector and its cluster, in a table of the shared folder; centroids are a constant of
the plan and only their sums reach the driver.

Defined cases: vectors that are null, have null, NaN or infinite components, or another number of components than `width` are
dropped. Start rows are those with the smallest hash, then the smallest components; null ids have no hash and come last. With
fewer rows than centroids there are as many centroids as rows. Repeated rows count each; centroids may be equal (the
smaller number wins). An empty table gives an empty result. Integers beyond 2^27 are an error. Columns other than vec_id
and embedding are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import new_folder, removed, written
from marlstone.llm.vectors import integers, lists, matrix, means, squared, usable

SCALE, WIDTH, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, "2:"


def by_distance(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others, nearest first, and their squared distances (ties by number)."""
    apart = np.stack([squared(centroids, c) for c in centroids])
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(x: np.ndarray, was: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each row, and how many distances were worked out."""
    best = squared(x, centroids[was])
    own, cluster, count = best.copy(), was.copy(), len(x)
    rows = np.arange(len(x))
    for step in range(order.shape[1]):
        rows = rows[apart[was[rows], step] <= 4 * own[rows]]
        if not len(rows):
            break
        other = order[was[rows], step]
        d = squared(x[rows], centroids[other])
        count += len(rows)
        closer = (d < best[rows]) | ((d == best[rows]) & (other < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = d[closer], other[closer]
    return cluster, best, count


def _assigned(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """state (row, ints, code, distance) assigned to these centroids; code is an array with the one cluster."""
    at = np.array(centroids, np.int64)
    order, apart = by_distance(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(matrix(batch.column("ints"), at.shape[1]), matrix(batch.column("code"), 1)[:, 0], at, order, apart)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ints"), lists(cluster[:, None]), pa.array(distance, pa.int64())], names=["row", "ints", "code", "distance"])

    return state.mapInArrow(run, state.schema)


def cluster(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), scale: int = SCALE, width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(row, cluster, distance) of every kept vector, and the centroids; row holds the kept columns."""
    spark = vectors.sparkSession
    folder = new_folder(spark, "clusters")
    fits = usable(vectors["embedding"]) & (F.size(vectors["embedding"]) == width)
    digest = F.sha2(F.concat(F.lit(seed), vectors["vec_id"].cast("string")).cast("binary"), 256)
    kept = vectors.where(fits).select(F.struct(*[vectors[c] for c in keep]).alias("row"), digest.alias("digest"), integers(vectors["embedding"], scale).alias("ints"))
    at = [r.ints for r in kept.orderBy(F.col("digest").asc_nulls_last(), "ints").limit(centroids).select("ints").collect()]
    state = kept.select("row", "ints", F.array(F.lit(0)).alias("code"), F.lit(0).cast("long").alias("distance"))
    if not at:
        return state.select("row", F.lit(0).alias("cluster"), "distance").where(F.lit(False)), []
    for k in range(rounds + 1):
        state = written(_assigned(state, at), f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
        new = means(state, 1, [at])[0] if k < rounds else at
        if new == at:
            break  # nothing moves any more: further rounds would change nothing
        at = new
    return state.select("row", F.col("code")[0].alias("cluster"), "distance"), at


def clusters(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    found, at = cluster(vectors, **how)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    table = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(at)]
    of = vectors.sparkSession.createDataFrame(table, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), found["cluster"] == of["of"]).select(F.col("row.vec_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(scale: int = SCALE, width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same by full comparison, every round spelled out."""
    ctes = [
        f"""good AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) = {width})""",
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) AS rid, * FROM good)",
        "long AS MATERIALIZED (SELECT rid, i AS d, v[i] AS x FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS i FROM kept))",
        f"at0 AS MATERIALIZED (SELECT rid - 1 AS e, d, x AS c FROM long WHERE rid <= {centroids})",
    ]
    for k in range(rounds + 1):
        ctes.append(f"near{k} AS MATERIALIZED (SELECT rid, min(struct_pack(s := s, e := e)) AS m FROM (SELECT rid, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS s FROM long JOIN at{k} USING (d) GROUP BY rid, e) GROUP BY rid)")
        if k < rounds:
            ctes.append(f"mean{k} AS MATERIALIZED (SELECT n.m.e AS e, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM long JOIN near{k} n USING (rid) GROUP BY ALL)")
            ctes.append(f"at{k + 1} AS MATERIALIZED (SELECT e, d, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM at{k} LEFT JOIN mean{k} USING (e, d))")
    ctes.append(f"digest AS (SELECT e, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM at{rounds} GROUP BY e)")
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, CAST(m.e AS INTEGER) AS cluster, m.s AS distance, CAST(sum(m.s) OVER (PARTITION BY m.e) AS BIGINT) AS cluster_inertia, CAST(sum(m.s) OVER () AS BIGINT) AS inertia, centroid_sha256"
        f" FROM kept JOIN near{rounds} n USING (rid) JOIN digest ON digest.e = n.m.e"
    )
