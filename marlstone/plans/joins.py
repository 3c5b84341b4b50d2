"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import revisions as R
from marlstone.operators import trigrams as T
from marlstone.plans.base import query, table
from marlstone.sources.views import FILES_SQL, files
from marlstone.session import new_folder


@query(f"WITH {FILES_SQL} SELECT f.doc_id, f.file_path, sha256(f.text) AS content_hash, coalesce(CASE WHEN quality = 0 THEN 'generated' END, 'source') AS classification FROM files f LEFT JOIN labels l ON f.doc_id = l.doc_id")
def join_snapshot_source(spark, sf_dir):
    """Manifest, blob and coverage; a file without coverage counts as source."""
    cover = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "generated").alias("c"))
    return files(spark, sf_dir).select("doc_id", "file_path", F.sha2("text", 256).alias("content_hash")).join(cover, "doc_id", "left").select("doc_id", "file_path", "content_hash", F.coalesce("c", F.lit("source")).alias("classification"))


@query("SELECT l_orderkey, l_linenumber, p_name, o_orderstatus FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def join_symbol_file(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "o_orderstatus")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON c_custkey = o_custkey")
def join_latest_version(spark, sf_dir):
    """Each customer's newest order, finished ones first."""
    new = R.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, sf_dir, "customer").select("c_custkey").join(new, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT DISTINCT c.c_nationkey AS consumer, s.s_nationkey AS provider FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey WHERE c.c_nationkey <> s.s_nationkey")
def join_depends_on_repos(spark, sf_dir):
    c = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("consumer"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("provider"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return line.join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("consumer <> provider").select("consumer", "provider").distinct()


@query("""
SELECT event_id, o_orderkey AS span_id FROM (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r
FROM (SELECT event_id, user_id, ((epoch_us(ts) // 1000) % 2400)::BIGINT AS day FROM events) e LEFT JOIN (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS o_orderdate FROM orders) o ON o_custkey = user_id AND o_orderdate <= day) WHERE r = 1""")
def join_asof_deployment(spark, sf_dir):
    """Each event with the deployment of its user that was in force on its day."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (F.unix_millis(F.col("ts").cast("timestamp")) % 2400).cast("long").alias("day"))
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("span_id"), F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("since"))
    return R.as_of(e, s, "k", "day", "since").select("event_id", "span_id")


@query("""
WITH p AS (SELECT l_orderkey AS bucket, l_orderkey * 10 + l_linenumber AS point_id, l_quantity::BIGINT AS line FROM lineitem),
s AS (SELECT l_orderkey AS bucket, l_linenumber AS span_id, least(l_quantity, l_linenumber * 7)::BIGINT AS start_line, greatest(l_quantity, l_linenumber * 7)::BIGINT AS end_line FROM lineitem)
SELECT point_id, span_id FROM (SELECT point_id, span_id, row_number() OVER (PARTITION BY point_id ORDER BY end_line - start_line, span_id) AS r FROM p JOIN s USING (bucket) WHERE line BETWEEN start_line AND end_line) WHERE r = 1""")
def join_enclosing_symbol(spark, sf_dir):
    """The innermost span around each line of a file."""
    li = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("long"), (F.col("l_linenumber") * 7).cast("long")
    p = li.select(F.col("l_orderkey").alias("bucket"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), q.alias("line"))
    s = li.select(F.col("l_orderkey").alias("bucket"), F.col("l_linenumber").alias("span_id"), F.least(q, n).alias("start_line"), F.greatest(q, n).alias("end_line"))
    return R.innermost(p, s, "bucket")


@query("SELECT doc_id, len(string_split(substr(text, 1, (length(text) // 2)::BIGINT), chr(10)))::BIGINT AS line FROM documents")
def join_line_locator(spark, sf_dir):
    """The line of each text's middle character."""
    head = F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def anti_dead_code(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("""SELECT 'customer without order' AS check_name, count(*)::BIGINT AS orphans FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'part without line', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def anti_orphans(spark, sf_dir):
    def left(name, a, key, b, other):
        d = table(spark, sf_dir, a).select(F.col(key).alias("k")).join(table(spark, sf_dir, b).select(F.col(other).alias("k")), "k", "left_anti")
        return d.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("check_name"), "orphans")

    out = left("customer without order", "customer", "c_custkey", "orders", "o_custkey")
    for args in (("part without line", "part", "p_partkey", "lineitem", "l_partkey"), ("label without document", "labels", "doc_id", "documents", "doc_id"), ("line without order", "lineitem", "l_orderkey", "orders", "o_orderkey")):
        out = out.unionAll(left(*args))
    return out


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_backfill(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'lic') AND contains(lower(text), 'ice') AND contains(lower(text), 'cen') AND contains(lower(text), 'ens') AND contains(lower(text), 'nse')")
def semi_trigram(spark, sf_dir):
    """Texts that hold every trigram of a needle, from stored postings."""
    d = table(spark, sf_dir, "documents")
    index = T.build(d, new_folder(spark, "trigrams"))
    all_of = T.candidates(index, T.plan(index, spark.createDataFrame([(0, "license")], "item_id long, needle string"), rarest=None))
    return d.select("doc_id").join(all_of, "doc_id", "left_semi")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_file_symbol(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum((l_linestatus = 'O')::INT) = 0")
def outer_stale_targets(spark, sf_dir):
    """Targets without any fresh version."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum((F.col("l_linestatus") == "O").cast("long")).alias("fresh")).where("fresh = 0").select("l_partkey")


@query("SELECT n_nationkey, c_custkey FROM nation JOIN customer ON ends_with(c_name, lpad(n_nationkey::VARCHAR, 2, '0'))")
def theta_alias_resolution(spark, sf_dir):
    """Names by suffix: the nations are the query set, against all customers."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("suffix"))
    return table(spark, sf_dir, "customer").join(F.broadcast(n), F.endswith("c_name", F.col("suffix"))).select("n_nationkey", "c_custkey")


@query(r"""
WITH lines AS (SELECT c.conv_id, c.turn, c.text FROM conversations c), t AS (SELECT DISTINCT lower(n_name) AS title FROM nation WHERE length(n_name) >= 4)
SELECT conv_id, title, min(turn)::BIGINT AS first_turn FROM lines JOIN t ON contains(lower(text), title) AND regexp_matches(' ' || lower(text) || ' ', '[^\p{L}\p{N}]' || title || '[^\p{L}\p{N}]') GROUP BY conv_id, title""")
def theta_unlinked_mentions(spark, sf_dir):
    """First turn of each conversation that mentions a nation as a whole word."""
    t = table(spark, sf_dir, "nation").where(F.length("n_name") >= 4).select(F.lower("n_name").alias("title")).distinct()
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("low"))
    hits = lines.join(F.broadcast(t), F.contains("low", F.col("title"))).where(F.expr(r"regexp_like(concat(' ', low, ' '), concat('[^\\p{L}\\p{N}]', title, '[^\\p{L}\\p{N}]'))"))
    return hits.groupBy("conv_id", "title").agg(F.min("turn").cast("long").alias("first_turn"))


@query("SELECT DISTINCT p_partkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (1, 2, 3)")
def left_repo_scope_via_edges(spark, sf_dir):
    """Shared nodes stay if any linked node's repository is in scope."""
    s = table(spark, sf_dir, "supplier").where(F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(table(spark, sf_dir, "lineitem").join(s, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) WHERE r = 1")
def exists_revision_visible(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    seen = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    return seen.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type")
