"""Queries of data flow: every order is a source file with a statement for each of its line numbers, cast from the tables alike in
both engines; the SQL knows each statement's kind and never looks at its text."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import dataflow as D
from marlstone.plans.base import query, table

#: Statement n of a file takes v(n-1); its form goes by the part.
FORMS = ["'const v' || n || ' = read(v' || (n - 1) || ');'", "'const { f: v' || n || ' } = v' || (n - 1) || ';'", "'if (v' || (n - 1) || ') stop();'", "'return v' || (n - 1) || ';'", "'send(v' || (n - 1) || ');'", "'const v' || n || ' = v' || (n - 1) || ' + 1;'"]
HOPS = 4

STATEMENTS = "l AS MATERIALIZED (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, max(l_linestatus) AS shipped, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber),\ns AS MATERIALIZED (SELECT l_orderkey AS f, l_linenumber AS n, part % 6 AS form, k FROM l)"
TRACES = f"""{STATEMENTS},
t AS (SELECT f, v, 0::BIGINT AS k, [v] AS held, []::STRUCT(f BIGINT, line BIGINT, kind VARCHAR, candidate BOOLEAN)[] AS steps, []::VARCHAR[] AS gaps FROM (SELECT DISTINCT f FROM s), (SELECT unnest(range(0, 7))::INTEGER AS v) UNION ALL
  SELECT t.f, v, s.k, CASE WHEN list_contains(held, n - 1) AND form IN (0, 1, 5) THEN list_append(held, n) ELSE held END,
    CASE WHEN NOT list_contains(held, n - 1) THEN steps WHEN form = 0 THEN steps || [(t.f, s.k, 'assign', false), (t.f, s.k, 'argument', true)] ELSE list_append(steps, (t.f, s.k, ['', 'field', 'guard', 'return', 'argument', 'assign'][form + 1], form = 4)) END,
    CASE WHEN list_contains(held, n - 1) AND form IN (0, 4) THEN list_append(gaps, t.f || ':' || s.k) ELSE gaps END
  FROM t JOIN s ON s.f = t.f AND s.k = t.k + 1),
traces AS MATERIALIZED (SELECT f, v, arg_max(steps, k) AS steps, arg_max(gaps, k) AS gaps FROM t GROUP BY f, v),
asked AS (SELECT f, min(n) - 1 AS v FROM s GROUP BY f)"""
SHOWN = "array_to_string(list_transform(steps, lambda x: x.kind), ',') AS kinds, len(list_distinct(gaps))::INTEGER AS gaps, steps[1].line::INTEGER AS source_line, CASE steps[-1].kind WHEN 'assign' THEN 'variable' WHEN 'guard' THEN 'variable' WHEN 'argument' THEN 'call' ELSE steps[-1].kind END AS sink_kind, steps[-1].line::INTEGER AS sink_line"


def _files(spark, sf_dir):
    """One row per order: file_path, text, and the number of its first statement."""
    form = "CASE min(l_partkey) % 6 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(FORMS)) + " END"
    lines = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_linenumber")).groupBy("l_orderkey", "n").agg(F.expr(form).alias("line"))
    # a line number occurs once, so a group has as many rows as there are line numbers
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(F.col("l_orderkey").cast("string").alias("file_path")).agg(text.alias("text"), F.min("n").alias("first"))


def _asked(files):
    return files.select(F.col("file_path").cast("long").alias("request_id"), "file_path", F.concat(F.lit("v"), F.col("first") - 1).alias("variable"))


def _shown(flows):
    return flows.select("request_id", "found", F.array_join(F.transform("steps", lambda s: s["kind"]), ",").alias("kinds"), F.size("gaps").alias("gaps"), "source_line", "sink_kind", "sink_line")


@query(f"WITH RECURSIVE {TRACES} SELECT f AS request_id, len(steps) > 0 AS found, {SHOWN} FROM traces JOIN asked USING (f, v)")
def graph_data_flow(spark, sf_dir):
    """Steps of the value that each file starts from."""
    files = _files(spark, sf_dir)
    return _shown(D.data_flows(files, _asked(files)))


@query(f"""
WITH RECURSIVE {TRACES},
e AS MATERIALIZED (SELECT l_orderkey AS f, k - 1 AS turn, part AS target, shipped = 'F' AS verified FROM l),
ways AS MATERIALIZED (SELECT e.f, turn, target, verified, t.steps AS more FROM e LEFT JOIN traces t ON t.f = e.target AND t.v = 0),
r AS (SELECT f AS request_id, f AS here, 0 AS hop, [f][1:0] AS been, steps, gaps, len(steps) > 0 AS going FROM traces JOIN asked USING (f, v) UNION ALL
  SELECT request_id, CASE WHEN verified AND len(more) > 0 THEN target ELSE here END, hop + 1, list_append(been, here),
    CASE WHEN verified AND len(more) > 0 THEN list_filter(steps, lambda x: NOT (x.f = here AND x.line = 1 AND x.candidate)) || [(here, 1::BIGINT, 'call', false)] || more ELSE steps END,
    CASE WHEN NOT verified THEN list_append(gaps, 'unverified ' || here) WHEN len(coalesce(more, [])) = 0 THEN list_append(gaps, 'unavailable ' || target) ELSE gaps END, verified AND len(coalesce(more, [])) > 0
  FROM r JOIN ways w ON w.f = here AND turn = len(list_filter(been, lambda b: b = here)) WHERE going AND hop < {HOPS}),
done AS (SELECT request_id, arg_max(steps, hop) AS steps, arg_max(gaps, hop) AS gaps FROM r GROUP BY request_id)
SELECT request_id, len(steps) > 0 AS found, {SHOWN} FROM done""")
def graph_data_flow_calls(spark, sf_dir):
    """The same, followed over verified calls into other files."""
    files = _files(spark, sf_dir)
    # each statement may call the file of its part; those of shipped lines are verified (the greatest status is F; as truths, which need no sort)
    edges = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("target"), (F.bool_and(F.col("l_linestatus") <= "F") & F.bool_or(F.col("l_linestatus") == "F")).alias("shipped"))
    edges = edges.select(F.col("l_linenumber").alias("seq"), F.col("l_orderkey").cast("string").alias("from_file"), F.lit(1).alias("from_line"), F.col("target").cast("string").alias("to_file"), F.lit("v0").alias("to_variable"), F.when(F.col("shipped"), "verified").otherwise("candidate").alias("status"))
    return _shown(D.flows_over_calls(files, _asked(files), edges, hops=HOPS))
