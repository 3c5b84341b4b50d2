"""Record-store, evidence and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.plans.base import query, table


@query("SELECT user_id, count(*)::BIGINT AS items, sum((value < 20)::INT)::BIGINT AS expired FROM events GROUP BY user_id")
def memory_remember(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("items"), F.sum((F.col("value") < 20).cast("long")).alias("expired"))


@query("SELECT lower(trim(p_type)) AS alias, count(DISTINCT p_brand)::BIGINT AS owners FROM part GROUP BY lower(trim(p_type)) HAVING count(DISTINCT p_brand) > 1")
def ontology_upsert(spark, sf_dir):
    """Aliases that more than one term claims."""
    return table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_type")).alias("alias")).agg(F.count_distinct("p_brand").alias("owners")).where("owners > 1")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unindexed' ELSE 'missing_file' END AS problem FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def evidence_doctor(spark, sf_dir):
    """Files and index compared both ways."""
    d, i = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(i, "doc_id", "left_anti").withColumn("problem", F.lit("unindexed")).unionAll(i.join(d, "doc_id", "left_anti").withColumn("problem", F.lit("missing_file")))


@query("SELECT sha256(event_type || '|' || props) AS row_hash, min(event_id) AS event_id, count(*)::BIGINT AS rows FROM events GROUP BY event_type, props")
def log_correlate(spark, sf_dir):
    """Rows alike in content, once each."""
    return table(spark, sf_dir, "events").groupBy(F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("row_hash")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("rows"))


@query("SELECT user_id, CASE WHEN sum((event_type = 'error')::INT) > 0 THEN 'failed' WHEN sum((event_type = 'purchase')::INT) > 0 THEN 'done' ELSE 'pending' END AS status FROM events GROUP BY user_id")
def log_status(spark, sf_dir):
    n = lambda k: F.sum((F.col("event_type") == k).cast("long"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(n("error") > 0, "failed").when(n("purchase") > 0, "done").otherwise("pending").alias("status"))


@query("SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for'))))[1:24] AS terms FROM conversations")
def log_terms(spark, sf_dir):
    """Distinct telling words of each turn, the first 24 in order."""
    ws = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "for"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(F.array_sort(F.array_distinct(ws)), 1, 24).alias("terms"))


@query("SELECT p_brand, count(*)::BIGINT AS producers, CASE WHEN sum((p_size > 49)::INT) > 0 THEN 'partial' WHEN count(*) > 100 THEN 'bounded' ELSE 'exhaustive' END AS coverage FROM part GROUP BY p_brand")
def api_coverage(spark, sf_dir):
    cover = F.when(F.sum((F.col("p_size") > 49).cast("long")) > 0, "partial").when(F.count("*") > 100, "bounded").otherwise("exhaustive")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("producers"), cover.alias("coverage"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def api_evidence_check(spark, sf_dir):
    """References that no evidence answers."""
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, v.kind, v.size::BIGINT AS size FROM (SELECT p_partkey, unnest([{'kind': 'below', 'size': p_size - 1}, {'kind': 'valid', 'size': p_size}, {'kind': 'above', 'size': p_size + 1}]) AS v FROM part)")
def api_request_classes(spark, sf_dir):
    """Valid and invalid classes around each limit."""
    s = F.col("p_size").cast("long")
    classes = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("size")) for k, v in (("below", s - 1), ("valid", s), ("above", s + 1))])
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(classes).alias("v")).select("p_partkey", "v.kind", "v.size")


@query("SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS identity FROM orders GROUP BY o_custkey")
def api_identity(spark, sf_dir):
    """Order-free identity of a set of revisions."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ","), 256).alias("identity"))


@query("SELECT p_type AS target, CASE count(*) WHEN 1 THEN 'verified' ELSE 'candidate' END AS status, count(*)::BIGINT AS n FROM part GROUP BY p_type")
def graph_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("target")).agg(F.when(F.count("*") == 1, "verified").otherwise("candidate").alias("status"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE event_type = 'view') WHERE r = 1")
def samples_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("value", (-F.col("event_id")).alias("i"))).alias("m")).select("user_id", "m.event_id", "m.value")
