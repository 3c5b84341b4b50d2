"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.jsonpath import json_path
from marlstone.plans.base import query, table


@query("SELECT c_custkey, lower(c_name) AS low, starts_with(c_name, 'Customer') AS starts, replace(c_name, '#', '-') AS dashed, substr(c_name, 3, 5) AS mid, string_split(c_name, '#')[1] AS first FROM customer")
def fn_string(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(n).alias("low"), F.startswith(n, F.lit("Customer")).alias("starts"), F.replace(n, F.lit("#"), F.lit("-")).alias("dashed"), F.substring(n, 3, 5).alias("mid"), F.element_at(F.split(n, "#"), 1).alias("first"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance FROM part")
def fn_edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%an%' AND lower(p_brand) = lower('BRAND#11')")
def fn_like_nocase(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type").ilike("%an%") & (F.lower("p_brand") == "brand#11")).select("p_partkey")


@query("SELECT c_custkey, substr(sha256(c_name), 1, 12) AS short_id, to_base64(encode(c_name)) AS b64, strlen(c_name)::BIGINT AS bytes FROM customer")
def fn_hash_encoding(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha2(n, 256), 1, 12).alias("short_id"), F.base64(n.cast("binary")).alias("b64"), F.octet_length(n).cast("long").alias("bytes"))


@query("SELECT event_id, round(sqrt(value), 6) AS root, least(greatest(value / 100, 0), 1)::DOUBLE AS clamped FROM events")
def fn_math(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sqrt(v), 6).alias("root"), F.least(F.greatest(v / 100, F.lit(0.0)), F.lit(1.0)).alias("clamped"))


@query("SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms, year(ts)::BIGINT AS y, hour(ts + INTERVAL 8 HOUR)::BIGINT AS local_hour FROM events")
def fn_date(spark, sf_dir):
    t = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(t.cast("timestamp")).alias("ms"), F.year(t).cast("long").alias("y"), F.hour(t + F.expr("interval 8 hours")).cast("long").alias("local_hour"))


@query("SELECT o_orderkey, regexp_extract('1.2.3-' || strftime(o_orderdate, '%Y%m%d%H%M%S'), '[0-9]{14}') AS stamp FROM orders")
def fn_version_stamp(spark, sf_dir):
    v = F.concat(F.lit("1.2.3-"), F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(v, "[0-9]{14}", 0).alias("stamp"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NULL AS missing FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("missing"))


BODY = """concat('{"a": [{"k": ', event_id % 7, '}, {"k": ', user_id, CASE WHEN event_id % 3 = 0 THEN '}' ELSE '}, {"z": null}' END, '], "p": ', props, '}')"""


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS last, CASE WHEN event_id % 3 > 0 THEN 'Key "k" not found' END AS last_error, '[' || event_id % 7 || ',' || user_id || ']' AS every, json_extract_string(props, '$.k') AS inner_k, 'Index 4 out of bounds' AS far_error FROM events""")
def fn_jsonpath(spark, sf_dir):
    """Paths from the end of a list, over all of it, into an object, and beyond it."""
    body = table(spark, sf_dir, "events").select("event_id", F.expr(BODY).alias("body"))
    of = lambda path: json_path(F.col("body"), path)
    found = body.select("event_id", of("$.a[-1].k").alias("one"), of("$.a[*].k").alias("all"), of("$['p'].k").alias("p"), of("$.a[4]").alias("far"))
    return found.select("event_id", F.col("one.value").alias("last"), F.col("one.error").alias("last_error"), F.col("all.value").alias("every"), F.col("p.value").alias("inner_k"), F.col("far.error").alias("far_error"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey))[1] AS first, len(list(DISTINCT l_suppkey))::BIGINT AS n FROM lineitem GROUP BY l_orderkey")
def fn_array(spark, sf_dir):
    a = F.array_sort(F.collect_set("l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(a.alias("a")).select("l_orderkey", F.element_at("a", 1).alias("first"), F.size("a").cast("long").alias("n"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS level FROM customer")
def fn_conditional(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("segment"), F.when(b < 0, "debt").when(b < 1000, "low").otherwise("high").alias("level"))


@query("""SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS canonical FROM customer""")
def fn_canonical_json(spark, sf_dir):
    """JSON with sorted keys."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("canonical"))


@query("SELECT s_suppkey FROM supplier WHERE regexp_matches(s_name, '^S.*p.*[0-9]{3}$')")
def fn_subsequence(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.col("s_name").rlike("^S.*p.*[0-9]{3}$")).select("s_suppkey")
