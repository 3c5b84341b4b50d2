"""The code-knowledge model as views over the driver's tables, in DataFrames and in SQL.

Documents stand for source files (repository = source, path = lang/source/id.txt); customers, orders, parts, suppliers,
nations and regions for graph nodes; their keys for typed edges. Real corpora come through `sources.files`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo_id, file_path, lang, text of every source file."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("repo_id"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), "lang", F.coalesce("text", F.lit("")).alias("text"))


FILES_SQL = "files AS (SELECT doc_id, source AS repo_id, lang || '/' || source || '/' || doc_id || '.txt' AS file_path, lang, coalesce(text, '') AS text FROM documents)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, node_type, title, repo_id (null for shared nodes)."""

    def part(name: str, kind: str, key: str, title, repo) -> DataFrame:
        return read(spark, sf_dir, name).select(node_id(kind, key).alias("node_id"), F.lit(kind).alias("node_type"), title.alias("title"), repo.alias("repo_id"))

    none = F.lit(None).cast("string")
    nation = lambda c: F.concat(F.lit("repo"), F.col(c).cast("string"))
    parts = [
        part("region", "region", "r_regionkey", F.col("r_name"), none),
        part("nation", "nation", "n_nationkey", F.col("n_name"), nation("n_regionkey")),
        part("customer", "customer", "c_custkey", F.col("c_name"), nation("c_nationkey")),
        part("supplier", "supplier", "s_suppkey", F.col("s_name"), nation("s_nationkey")),
        part("part", "part", "p_partkey", F.col("p_name"), none),
        part("orders", "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node_id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS title, NULL::VARCHAR AS repo_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'repo' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'repo' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'repo' || s_nationkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'order ' || o_orderkey, NULL FROM orders)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, edge_type, method, confidence: nations and their members define, customers call orders, orders
    reference parts, suppliers handle parts."""

    def edge(df: DataFrame, a: tuple, b: tuple, kind: str, method) -> DataFrame:
        return df.select(node_id(*a).alias("src"), node_id(*b).alias("dst"), F.lit(kind).alias("edge_type"), method.alias("method"))

    sure = F.lit("EXTRACTED")
    line = read(spark, sf_dir, "lineitem")
    rows = line.count()
    by_order, by_supplier = (spread(line.select(*c), rows, *c[:2]) for c in (("l_orderkey", "l_partkey", "l_returnflag"), ("l_suppkey", "l_partkey")))
    flag = F.when(F.col("flag") == "A", "INFERRED").when(F.col("flag") == "N", "EXTRACTED").otherwise("ASSERTED")
    parts = [
        edge(read(spark, sf_dir, "nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "defines", sure),
        edge(read(spark, sf_dir, "customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "defines", sure),
        edge(read(spark, sf_dir, "supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "defines", sure),
        edge(read(spark, sf_dir, "orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "calls", F.when(F.col("o_orderstatus") == "P", "INFERRED").otherwise("EXTRACTED")),
        edge(by_order.groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("flag")), ("order", "l_orderkey"), ("part", "l_partkey"), "references", flag),
        edge(by_supplier.distinct(), ("supplier", "l_suppkey"), ("part", "l_partkey"), "handles", sure),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("confidence", F.when(F.col("method") == "INFERRED", 0.5).otherwise(1.0))


EDGES_SQL = """edges AS (SELECT *, CASE WHEN method = 'INFERRED' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'defines' AS edge_type, 'EXTRACTED' AS method FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'defines', 'EXTRACTED' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'defines', 'EXTRACTED' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'calls', CASE WHEN o_orderstatus = 'P' THEN 'INFERRED' ELSE 'EXTRACTED' END FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'references', CASE max(l_returnflag) WHEN 'A' THEN 'INFERRED' WHEN 'N' THEN 'EXTRACTED' ELSE 'ASSERTED' END FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'handles', 'EXTRACTED' FROM lineitem))"""
