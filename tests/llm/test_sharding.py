"""Shards against counts of all records, and the splitter tree against bisection."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from marlstone.llm import sharding
from marlstone.llm.sharding import assign, layout, place, range_of


def held(rows, texts, shards):
    """Checks sizes, checksums, gapless slots; bytes of each shard."""
    slots, sizes = defaultdict(list), Counter()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_tree_is_bisection(spark):
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 255, 256, 300, 4100):
        cuts = sorted({f"{rng.randrange(1 << 30):08X}" for _ in range(n)})
        keys = [f"{rng.randrange(1 << 30):08X}" for _ in range(200)] + cuts[:50] + ["", "Z"]
        got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", range_of(F.col("key"), cuts).alias("r")).collect()
        assert all(r.r == bisect.bisect_right(cuts, r.key) for r in got)


def test_sizes_are_near_and_copies_together(table):
    rng = random.Random(5)
    texts = [(i, f"t{i} " + "x" * rng.randrange(400)) for i in range(4000)] + [(10_000 + i, "hot " * 60) for i in range(2000)] + [(7, "same row " * 20)] * 800
    docs = table([(d, t, "en", "s", 0) for d, t in texts]).repartition(7)
    rows = assign(docs, 10).collect()
    sizes = held(rows, texts, 10)
    mean = sum(sizes.values()) / 10
    assert len(sizes) == 10 and all(abs(s - mean) <= 0.04 * mean for s in sizes.values())
    crc = zlib.crc32(("hot " * 60).encode())
    at = sorted((r.shard, r.slot) for r in rows if r.text_crc32 == crc)
    # a run without gaps over shards that follow one another
    last = Counter(r.shard for r in rows)
    assert all(b == (a[0], a[1] + 1) or (b[0] == a[0] + 1 and b[1] == 0 and a[1] == last[a[0]] - 1) for a, b in zip(at, at[1:]))
    assert [r[1:] for r in sorted(map(tuple, rows))] == [r[1:] for r in sorted(map(tuple, assign(docs, 10).collect()))]


def test_overfull_ranges_are_cut(table):
    docs = table([(i, "a" if i % 3 else "y" * 3000, "en", "s", 0) for i in range(3000)])
    staged = sharding.written(docs.select(sharding.record_size(docs["text"]).alias("size"), sharding.record_key(docs["text"], docs["doc_id"]).alias("key")), sharding.new_folder(docs.sparkSession, "t"))
    plan = layout(staged, 4, ranges_a_shard=4, range_rows=20)
    assert plan.cuts == sorted(set(plan.cuts)) and len(plan.cuts) + 1 == len(plan.shard) == len(plan.slot)
    assert max(r["count"] for r in place(staged, plan).groupBy("range").count().collect()) <= 40
    sizes = [r.b for r in place(staged, plan).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) - min(sizes) <= 0.1 * sum(sizes)


def test_one_long_text_and_few_rows(table):
    texts = [(0, "z" * 500_000)] + [(i, "w" * 50) for i in range(1, 300)]
    sizes = held(assign(table([(d, t, "en", "s", 0) for d, t in texts]), 5).collect(), texts, 5)
    assert sum(sizes.values()) == 500_016 + 299 * 66
    assert max(sizes.values()) <= sum(sizes.values()) / 5 + 500_016


def test_odd_rows(odd, clashing, empty, sf, spark):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    held(assign(odd).collect(), texts, 40)
    held(assign(clashing).collect(), texts, 40)
    assert assign(empty).count() == 0
    out = assign(odd)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]


def test_written_shards(clashing, tmp_path):
    at = f"file://{tmp_path}/shards"
    sharding.write_shards(clashing, at, 3)
    back = clashing.sparkSession.read.parquet(at)
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, clashing.collect()))
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in assign(clashing, 3).collect()}
