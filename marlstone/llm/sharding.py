"""Shards by sampled splitters: nearly equal bytes, copies side by side.

Records are put in the order of a key: the hash of the text, then that of the id, then a number of the row, so that equal
texts stand together, no two keys are equal, and any group of copies, however large, can be cut. A key sample in which a
record is drawn in proportion to its size gives quantiles as splitters, some RANGES_A_SHARD ranges for each shard. Ranges
are then measured over all records, and each that is overfull (beyond twice its due, its largest record not counted, or
more than twice RANGE_ROWS records) draws a sample of its own and is cut again, until none is. A shard is a run of whole ranges, so it
misses its due by a range at most, or by one record larger than that.

What reaches the driver is a sample of OVERSAMPLE keys a range and a count and a sum for each range; their number is
shards * RANGES_A_SHARD or one for RANGE_ROWS records, whichever is more. Records find their range in a tree of splitters
that is a constant of the plan, and move once, by range, to be numbered there.

Defined cases: null text has 16 bytes and the checksum of the empty text, and stands with empty texts; null ids count as
one id; repeated rows are numbered one by one; with fewer ranges than shards some shards are empty; an empty table gives
an empty result. Columns of the input other than doc_id and text are not looked at (`shard_documents` keeps them all).
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import let, literals, new_folder, small, text_of, written

SHARDS = 40
#: Bytes that a record counts besides its text.
OVERHEAD = 16
RANGES_A_SHARD, RANGE_ROWS, OVERSAMPLE = 64, 1_000_000, 8
#: Children of a node in the tree of splitters.
FANOUT = 16


class Layout(NamedTuple):
    """cuts: first keys of all ranges but the first; shard and first slot of each range."""

    cuts: list[str]
    shard: list[int]
    slot: list[int]


def record_size(text: Column) -> Column:
    return (F.octet_length(text) + OVERHEAD).cast("long")


def record_key(text: Column, doc_id: Column) -> Column:
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(digits(F.xxhash64(text)), digits(F.xxhash64(doc_id)), digits(F.monotonically_increasing_id()))


def range_of(key: Column, cuts: list[str]) -> Column:
    """Number of cuts at or below the key, found from node to node of a tree."""
    depth = max(1, math.ceil(math.log(len(cuts) + 1, FANOUT)))
    at = F.lit(0)

    def child(ends: Column):
        return lambda node: node * FANOUT + F.size(F.filter(F.slice(ends, node * FANOUT + 1, FANOUT), lambda end: end <= key))

    for stride in (FANOUT**d for d in range(depth - 1, -1, -1)):
        at = let(at, child(literals(cuts[stride - 1 :: stride], "string")))  # the last cut of each child
    return at


def _quantiles(drawn: list, due: float) -> list[str]:
    """Keys at which a new range starts; drawn: (key, weight) in key order."""
    cuts, have = [], 0.0
    for i, (key, weight) in enumerate(drawn):
        if i and have + weight / 2 > due:
            cuts.append(key)
            have = 0.0
        have += weight
    return cuts


def _drawn(rows: DataFrame, per_byte: Column, seed: int) -> DataFrame:
    """A sample with a chance of per_byte for each byte, alike in every run over the same rows."""
    u = F.xxhash64("key", F.lit(seed)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    return rows.where(u < F.col("size") * per_byte).withColumn("weight", F.greatest(F.col("size").cast("double"), 1 / per_byte))


def layout(staged: DataFrame, shards: int = SHARDS, ranges_a_shard: int = RANGES_A_SHARD, range_rows: int = RANGE_ROWS) -> Layout:
    """The layout of records (key, size) over so many shards."""
    spark = staged.sparkSession
    rows, total = staged.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return Layout([], [0], [0])
    pieces = max(shards * ranges_a_shard, math.ceil(rows / range_rows))
    due = total / pieces
    cuts = _quantiles(sorted(map(tuple, _drawn(staged, F.lit(OVERSAMPLE / due), 0).select("key", "weight").collect())), due)
    for seed in range(1, 1_000):
        ranged = staged.withColumn("range", range_of(F.col("key"), cuts))
        found = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("most")).collect()
        over = [(r["range"], float(r.bytes), float(min(due, range_rows * r.bytes / r.n))) for r in found if r.bytes - r.most > 2 * due or r.n > 2 * range_rows]
        if not over:
            break
        dues = spark.createDataFrame([(i, d) for i, _, d in over], "over int, due double")
        more = ranged.join(small(dues, len(over)), F.col("range") == F.col("over"))
        per: dict[int, list] = {i: [] for i, _, _ in over}
        for i, key, weight in sorted(map(tuple, _drawn(more, OVERSAMPLE / F.col("due"), seed).select("over", "key", "weight").collect())):
            per[i].append((key, weight))
        cuts = sorted({*cuts, *(c for i, _, d in over for c in _quantiles(per[i], d))})
    # whole ranges go to the shard in which their middle lies
    sizes = {r["range"]: (r.n, r.bytes) for r in found}
    shard, slot, before, filled = [], [], 0, {}
    for i in range(len(cuts) + 1):
        n, size = sizes.get(i, (0, 0))
        s = min(shards - 1, int((before + size / 2) * shards / total))
        shard.append(s)
        slot.append(filled.get(s, 0))
        filled[s] = filled.get(s, 0) + n
        before += size
    return Layout(cuts, shard, slot)


def place(staged: DataFrame, plan: Layout) -> DataFrame:
    """staged with range, shard and slot (0, 1, ... in each shard)."""
    of = lambda values, kind: F.get(literals(values, kind), F.col("range"))
    ranged = staged.withColumn("range", range_of(F.col("key"), plan.cuts))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return ranged.withColumn("shard", of(plan.shard, "int")).withColumn("slot", (of(plan.slot, "bigint") + nth - 1).cast("long"))


def assign(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; texts are read once and don't move."""
    text = text_of(docs)
    narrow = docs.select("doc_id", record_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), record_key(text, docs["doc_id"]).alias("key"))
    staged = written(narrow, new_folder(docs.sparkSession, "sharding"))
    placed = place(staged, layout(staged, shards, **how))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """The whole rows: row (a struct of the input's columns), shard and slot. Rows are written once before they move."""
    text = text_of(docs)
    whole = docs.select(F.struct("*").alias("row"), record_size(text).alias("size"), record_key(text, docs["doc_id"]).alias("key"))
    staged = written(whole, new_folder(docs.sparkSession, "sharding"))
    return place(staged, layout(staged.select("key", "size"), shards, **how)).select("row", "shard", "slot")


def write_shards(docs: DataFrame, at: str, shards: int = SHARDS, **how) -> None:
    """Parquet folders at/shard=N, rows of a range in slot order in one file; a column slot goes with the rows."""
    shard_documents(docs, shards, **how).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(at)
