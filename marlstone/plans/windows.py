"""Window queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import revisions as R
from marlstone.plans.base import query, table


@query("SELECT text_hash, doc_id FROM (SELECT sha256(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def win_latest_per_key(spark, sf_dir):
    """The newest document of each text: an aggregate, so that a hot text does not reach one task whole."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.max("doc_id").alias("doc_id"))


CHAIN_SQL = "chain AS (SELECT o_custkey AS path, CASE o_orderstatus WHEN 'F' THEN 'modify' WHEN 'O' THEN 'add' ELSE 'delete' END AS op, year(o_orderdate) AS snapshot, o_orderkey FROM orders)"


def chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "modify").when(F.col("o_orderstatus") == "O", "add").otherwise("delete")
    return o.select(F.col("o_custkey").alias("path"), op.alias("op"), F.year("o_orderdate").alias("snapshot"), "o_orderkey")


@query(f"WITH {CHAIN_SQL} SELECT path, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY snapshot DESC, o_orderkey DESC) AS r FROM chain) WHERE r = 1 AND op <> 'delete'")
def win_snapshot_shadow(spark, sf_dir):
    """The nearest overlay of each path wins; deletes hide it."""
    return R.latest(chain(spark, sf_dir), ["path"], [F.desc("snapshot"), F.desc("o_orderkey")]).where("op <> 'delete'").select("path", "o_orderkey")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), e AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_number FROM l)
SELECT doc_id, line_number::BIGINT AS line_number, (sum(length(line) + 1) OVER w - length(line) - 1)::BIGINT AS start_char, (sum(strlen(line) + 1) OVER w - strlen(line) - 1)::BIGINT AS start_byte FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY line_number ROWS UNBOUNDED PRECEDING)""")
def win_line_offsets(spark, sf_dir):
    """Start of each line in characters and bytes."""
    e = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.char_length("line").alias("c"), F.octet_length("line").alias("b"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_number"), (F.sum(F.col("c") + 1).over(w) - F.col("c") - 1).cast("long").alias("start_char"), (F.sum(F.col("b") + 1).over(w) - F.col("b") - 1).cast("long").alias("start_byte"))


@query("""SELECT conv_id, turn, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = a.role) AS section_end FROM conversations a""")
def win_section_end(spark, sf_dir):
    """A turn's section ends before the next turn of its role."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("section_end"))


@query("SELECT o_orderkey, (r <= 20) AS hot FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P')")
def win_hot_rank(spark, sf_dir):
    """The newest 20 of each priority: every task keeps its own best before any row moves, and the few that are left mark
    the rest, so no task sorts a whole priority."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    top = o.select("o_orderpriority", "o_orderdate", "o_orderkey").withColumn("r", F.row_number().over(w)).where("r <= 20").select("o_orderkey", F.lit(True).alias("top"))
    return o.select("o_orderkey").join(top, "o_orderkey", "left").select("o_orderkey", F.coalesce("top", F.lit(False)).alias("hot"))


@query("SELECT user_id, event_id, (lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)) AS previous FROM events")
def win_audit_chain(spark, sf_dir):
    """Each user's chain of events."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("previous"))


@query("SELECT c.conv_id, c.turn, (c.turn - lag(c.turn) OVER (PARTITION BY c.conv_id ORDER BY c.turn) = 1) AS dense FROM conversations c")
def win_ledger_gap(spark, sf_dir):
    """Dense sequence check; null for a ledger's first entry."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")) == 1).alias("dense"))


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY r, l_suppkey, l_linenumber))::BIGINT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS r FROM lineitem)")
def win_round_robin(spark, sf_dir):
    """Children interleaved across parents."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber")))
    return li.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("r", "l_suppkey", "l_linenumber")).cast("long").alias("turn"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS last_five FROM events")
def win_running_sum(spark, sf_dir):
    """Sum of each user's last five values (not in the reference)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("last_five"))
