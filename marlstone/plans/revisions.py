"""Snapshot, overlay and artifact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import revisions as R
from marlstone.plans.base import query, table
from marlstone.plans.windows import CHAIN_SQL, chain

# two versions of the parts table: the base lacks keys divisible by 7, the target lacks those divisible by 11 and has other prices
VERSIONS_SQL = "base AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 7 <> 0), target AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0)"
DIFF_SQL = "changes AS (SELECT coalesce(b.k, t.k) AS k, CASE WHEN b.k IS NULL THEN 'add' WHEN t.k IS NULL THEN 'delete' WHEN b.v <> t.v THEN 'modify' END AS op FROM base b FULL JOIN target t ON b.k = t.k WHERE b.k IS NULL OR t.k IS NULL OR b.v <> t.v)"


def versions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return p.where("k % 7 <> 0"), p.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))


@query(f"WITH {VERSIONS_SQL}, {DIFF_SQL} SELECT k, op FROM changes")
def rev_overlay_diff(spark, sf_dir):
    return R.diff(*versions(spark, sf_dir), "k", "v")


@query(f"WITH {VERSIONS_SQL}, {DIFF_SQL} SELECT op, count(*)::BIGINT AS n FROM changes GROUP BY op")
def sink_artifact_delta(spark, sf_dir):
    return R.diff(*versions(spark, sf_dir), "k", "v").groupBy("op").agg(F.count("*").alias("n"))


@query(f"WITH {VERSIONS_SQL} SELECT k, v FROM target")
def apply_artifact_delta(spark, sf_dir):
    """The base with the delta applied is the target."""
    base, target = versions(spark, sf_dir)
    return R.apply_diff(base, R.diff(base, target, "k", "v"), target, "k")


@query(f"WITH {VERSIONS_SQL} SELECT k FROM base WHERE k NOT IN (SELECT k FROM target)")
def artifact_tombstones(spark, sf_dir):
    base, target = versions(spark, sf_dir)
    return base.select("k").join(target, "k", "left_anti")


@query(f"WITH {VERSIONS_SQL} SELECT (SELECT count(*) FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM target))::BIGINT AS only_base, (SELECT count(*) FROM (SELECT * FROM target EXCEPT ALL SELECT * FROM base))::BIGINT AS only_target")
def rev_assert_manifest(spark, sf_dir):
    """Rows on one side only; both zero means equal manifests."""
    base, target = versions(spark, sf_dir)
    a, b = base.exceptAll(target).agg(F.count("*").alias("only_base")), target.exceptAll(base).agg(F.count("*").alias("only_target"))
    return a.join(b)


@query(f"WITH {CHAIN_SQL}, d AS (SELECT *, max(snapshot) OVER () - snapshot AS depth FROM chain) SELECT path, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY depth, o_orderkey) AS r FROM d) WHERE r = 1 AND op <> 'delete'")
def rev_manifest(spark, sf_dir):
    """The manifest of the newest snapshot from its chain."""
    c = chain(spark, sf_dir)
    newest = c.agg(F.max("snapshot")).first()[0]
    depth = c.withColumn("depth", F.struct((F.lit(newest) - F.col("snapshot")).alias("d"), "o_orderkey"))
    return R.manifest(depth, "path").select("path", "o_orderkey")


@query("SELECT o_custkey, count(*)::BIGINT AS snapshots, max(o_orderkey) AS head, sum((o_orderstatus = 'O')::INT)::BIGINT AS stale FROM orders GROUP BY o_custkey")
def rev_trust(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("snapshots"), F.max("o_orderkey").alias("head"), F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("stale"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS age FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'keep' WHEN r <= 2 THEN 'hot' WHEN age <= 30 THEN 'cool' ELSE 'collect' END AS plan FROM r""")
def retention_plan(spark, sf_dir):
    """Protected snapshots stay, the newest are hot, recent ones cool, the rest can go."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    newest = o.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    age = F.date_diff(F.lit(newest), F.to_date("o_orderdate"))
    return o.withColumn("r", r).select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "keep").when(F.col("r") <= 2, "hot").when(age <= 30, "cool").otherwise("collect").alias("plan"))


@query("SELECT content_hash, min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM (SELECT sha256(text) AS content_hash, doc_id FROM documents) GROUP BY content_hash")
def sink_blob(spark, sf_dir):
    """One blob per content hash, with its copies."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("SELECT c_custkey, CASE n WHEN 1 THEN 'link' ELSE 'drop' END AS outcome FROM (SELECT c_custkey, count(DISTINCT s_suppkey) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_custkey) UNION ALL SELECT c_custkey, 'keep' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def sink_pending_edges(spark, sf_dir):
    """One candidate links, several drop, none keeps the pending edge."""
    n = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count_distinct("s_suppkey").alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "keep").when(F.col("n") == 1, "link").otherwise("drop").alias("outcome"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'stale' WHEN a.k IS NULL THEN 'new' ELSE 'fresh' END AS status FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k")
def sink_symbol_version(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"), F.lit(True).alias(n)).distinct() for s, n in (("F", "a"), ("P", "b")))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("b").isNull(), "stale").when(F.col("a").isNull(), "new").otherwise("fresh").alias("status"))


@query("SELECT doc_id, source || ':' || lang AS key FROM documents WHERE source || ':' || lang > 'src10:en' AND source || ':' || lang <= 'src15:fr'")
def backfill_resume(spark, sf_dir):
    """The batch after a checkpoint key, up to the next."""
    key = F.concat_ws(":", "source", "lang")
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).where((F.col("key") > "src10:en") & (F.col("key") <= "src15:fr"))
