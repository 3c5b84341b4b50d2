"""Aggregation, sorting and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.plans.base import query, table


@query("SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 12")
def agg_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(12)


COVER_SQL = "cover AS (SELECT doc_id, source, CASE WHEN length(text) < 20 THEN 'excluded' WHEN length(text) > 20000 THEN 'failed' WHEN doc_id % 17 = 0 THEN 'stale' ELSE 'admitted' END AS status FROM documents)"


def cover(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.when(n < 20, "excluded").when(n > 20000, "failed").when(F.col("doc_id") % 17 == 0, "stale").otherwise("admitted").alias("status"))


@query(f"WITH {COVER_SQL} SELECT count(*)::BIGINT AS discovered, sum((status = 'admitted')::INT)::BIGINT AS admitted, sum((status <> 'admitted')::INT)::BIGINT AS excluded, sum((status = 'failed')::INT)::BIGINT AS failed, sum((status = 'stale')::INT)::BIGINT AS stale FROM cover")
def agg_coverage(spark, sf_dir):
    """Excluded is everything that is not admitted; failed and stale are shown beside it."""
    n = lambda c: F.sum(c.cast("long"))
    s = F.col("status")
    return cover(spark, sf_dir).agg(F.count("*").alias("discovered"), n(s == "admitted").alias("admitted"), n(s != "admitted").alias("excluded"), n(s == "failed").alias("failed"), n(s == "stale").alias("stale"))


@query(f"WITH {COVER_SQL} SELECT source, status AS reason, count(*)::BIGINT AS n FROM cover GROUP BY source, status")
def agg_coverage_reason(spark, sf_dir):
    return cover(spark, sf_dir).groupBy("source", F.col("status").alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {COVER_SQL} SELECT source, sum((status = 'admitted')::INT)::BIGINT AS admitted, sum((status = 'excluded')::INT)::BIGINT AS excluded, sum((status = 'failed')::INT)::BIGINT AS failed, sum((status = 'stale')::INT)::BIGINT AS stale FROM cover GROUP BY source")
def agg_status_panel(spark, sf_dir):
    out = cover(spark, sf_dir).groupBy("source").pivot("status", ["admitted", "excluded", "failed", "stale"]).count()
    return out.na.fill(0)


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, sum((o_orderstatus = 'O')::INT)::BIGINT AS stale, sum((o_orderstatus = 'O')::INT) = 0 AS trusted FROM orders GROUP BY o_orderpriority")
def agg_index_status(spark, sf_dir):
    stale = F.sum((F.col("o_orderstatus") == "O").cast("long"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), stale.alias("stale"), (stale == 0).alias("trusted"))


@query("SELECT source, greatest(0, 100 - 100.0 * sum((length(text) > 3000)::INT) / count(*))::DOUBLE AS reuse FROM documents GROUP BY source")
def agg_trust_reuse(spark, sf_dir):
    changed = F.sum((F.length("text") > 3000).cast("long"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.greatest(F.lit(0.0), 100 - 100.0 * changed / F.count("*")).alias("reuse"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 5")
def agg_count_distinct_having(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n = 5").select("l_orderkey")


@query("SELECT o_custkey, o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority HAVING count(*) >= 2")
def agg_group_concat(spark, sf_dir):
    """Groups of two or more, with their members listed in order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    g = o.groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"), F.count("*").alias("n"))
    return g.where("n >= 2").select("o_custkey", "o_orderpriority", "orders", "n")


@query("SELECT l_orderkey, sha256(string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_partkey || ':' || l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def agg_edge_fingerprint(spark, sf_dir):
    """Order-free hash of each file's edge set."""
    edge = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(edge)), ","), 256).alias("fingerprint"))


@query("SELECT p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS r FROM part) WHERE r <= 3")
def agg_package_rows(spark, sf_dir):
    """The three newest versions of each package."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc("p_partkey"))
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_brand", "p_name", "p_partkey")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def agg_percentile(spark, sf_dir):
    """Nearest-rank percentiles."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("SELECT DISTINCT event_type, json_extract_string(props, '$.k') AS k FROM events")
def distinct_tags(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 200")
def limit_offset(spark, sf_dir):
    """A page by a boolean first, nulls last and a total order."""
    return table(spark, sf_dir, "orders").orderBy(F.desc(F.col("o_orderstatus") == "F"), F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(200).limit(100).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 7) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def page_keyset(spark, sf_dir):
    """The page after (150000, 7)."""
    after = (F.col("o_totalprice") < 150000) | ((F.col("o_totalprice") == 150000) & (F.col("o_orderkey") > 7))
    return table(spark, sf_dir, "orders").where(after).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT p_partkey, p_size FROM part ORDER BY CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 ELSE 3 END, p_size DESC, p_partkey LIMIT 40")
def sort_case(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.when(F.col("p_brand") == "Brand#11", 1).when(F.col("p_brand") == "Brand#22", 2).otherwise(3), F.desc("p_size"), "p_partkey").limit(40).select("p_partkey", "p_size")


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k, 'part' AS side FROM lineitem UNION ALL SELECT l_suppkey, 'supplier' FROM lineitem")
def set_union_all(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("k"), F.lit("part").alias("side")).unionAll(li.select("l_suppkey", F.lit("supplier")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT k, lane FROM (SELECT k, lane, row_number() OVER (PARTITION BY k ORDER BY lane) AS r FROM (SELECT o_custkey AS k, 1 AS lane FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, 2 FROM customer)) WHERE r = 1")
def set_concat_dedupe(spark, sf_dir):
    """Lanes after one another, the first wins."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit(1).alias("lane"))
    return a.unionAll(table(spark, sf_dir, "customer").select("c_custkey", F.lit(2))).groupBy("k").agg(F.min("lane").alias("lane"))
