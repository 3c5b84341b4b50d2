"""Integer vectors and exact Lloyd steps, shared by vector codes and centroid clusters.

Vectors of floats become integers once; every distance and mean after that is exact, so results do not hang on the order
in which partitions are added up. Only sums, one row for each centroid and task, leave the workers in a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are an error: squared distances of whole vectors of up to 64 components fit a long below it.
MOST = 1 << 27


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, taken as a double."""

    def one(x: Column) -> Column:
        v = F.floor(x.cast("double") * scale)
        # what is not finite is dropped before or after, and no error
        return F.when(F.abs(v) <= MOST, v).when(F.abs(x) < float("inf"), F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}"))).cast("int")

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of an Arrow column as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.astype(np.int32).ravel()))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def means(assigned: DataFrame, groups: int, old: list[list[list[int]]]) -> list[list[list[int]]]:
    """New centroids by group: floor(sum / count) of each component over the rows assigned; unused ones stay as they were.

    assigned: ints (array) and code (array with a centroid's number for each of the equal consecutive parts); old: centroids
    of each part. At most a row for each centroid of each task is shuffled, and one for each centroid comes to the driver.
    """
    counts, width = [len(c) for c in old], len(old[0][0]) * groups

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(k, np.int64) for k in counts]
        total = [np.zeros((k, width // groups), np.int64) for k in counts]
        for batch in batches:
            x, code = matrix(batch.column(0), width), matrix(batch.column(1), groups)
            for p, part in enumerate(np.split(x, groups, axis=1)):
                order = np.argsort(code[:, p], kind="stable")
                entries, starts = np.unique(code[order, p], return_index=True)
                if len(entries):
                    total[p][entries] += np.add.reduceat(part[order], starts, axis=0)
                    n[p] += np.bincount(code[:, p], minlength=counts[p])
        rows = [(p, e) for p in range(groups) for e in range(counts[p]) if n[p][e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()), pa.array([n[p][e] for p, e in rows], pa.int64()), pa.array([total[p][e].tolist() for p, e in rows], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    partial = assigned.select("ints", "code").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    added = [F.sum(F.col("total")[i].cast("decimal(20,0)")) for i in range(width // groups)]
    new = [list(map(list, part)) for part in old]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*added).alias("total")).collect():
        new[r.part][r.entry] = [int(t) // r.n for t in r.total]
    return new
