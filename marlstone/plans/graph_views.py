"""More graph queries: views of repositories, injected targets, paths carried along, suggestions, timelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import deployment
from marlstone.operators import graph as G
from marlstone.plans.base import query, table
from marlstone.plans.graph import start
from marlstone.sources.views import EDGES_SQL, NODES_SQL, edges, nodes


@query(f"WITH {EDGES_SQL} SELECT DISTINCT o.src AS node_id FROM edges r JOIN edges o ON r.src = o.dst AND o.edge_type = 'calls' WHERE r.dst = 'part:7' AND r.edge_type = 'references'")
def graph_who_injects(spark, sf_dir):
    """Inbound references, each named by what encloses it."""
    e = edges(spark, sf_dir)
    refs = e.where("dst = 'part:7' and edge_type = 'references'").select(F.col("src").alias("inner_id"))
    return e.where("edge_type = 'calls'").join(refs, F.col("dst") == F.col("inner_id")).select(F.col("src").alias("node_id")).distinct()


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, d AS (SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges) GROUP BY n),
t AS (SELECT node_id FROM (SELECT d.node_id FROM d JOIN nodes ON d.node_id = nodes.node_id WHERE repo_id = 'repo1' ORDER BY degree DESC, d.node_id LIMIT 40))
SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT node_id FROM t) AND dst IN (SELECT node_id FROM t)""")
def graph_repo_view(spark, sf_dir):
    """The best linked nodes of a repository and the edges among them."""
    e = edges(spark, sf_dir)
    degree = e.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    top = degree.join(nodes(spark, sf_dir).where("repo_id = 'repo1'").select("node_id"), "node_id").orderBy(F.desc("degree"), "node_id").limit(40)
    return G.induced(e, top, None, ["calls", "references", "defines"])


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, d AS (SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges) GROUP BY n)
SELECT title, count(*)::BIGINT AS n_nodes, sum(degree)::BIGINT AS degree FROM d JOIN nodes ON d.node_id = nodes.node_id GROUP BY title HAVING count(*) > 1 AND sum(degree) >= 3 ORDER BY degree DESC, title LIMIT 50""")
def graph_suppressed_hubs(spark, sf_dir):
    """Names that several nodes share and many edges touch."""
    degree = edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    shared = degree.join(nodes(spark, sf_dir), "node_id").groupBy("title").agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("degree"))
    return shared.where("n_nodes > 1 and degree >= 3").orderBy(F.desc("degree"), "title").limit(50)


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'customer:7' AS node_id, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node_id WHERE r.depth < 2)
SELECT DISTINCT e.src AS node_id FROM edges e WHERE edge_type = 'handles' AND e.dst IN (SELECT node_id FROM r)""")
def graph_flow_enrich(spark, sf_dir):
    """Who handles any step of a flow."""
    e = edges(spark, sf_dir)
    steps = G.reach(e, start(spark, "customer:7"), 2).select(F.col("node_id").alias("dst"))
    return e.where("edge_type = 'handles'").join(steps, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()


@query(f"""WITH {EDGES_SQL}, {NODES_SQL} SELECT 'language' AS section, lang AS name, count(*)::BIGINT AS n FROM documents GROUP BY lang UNION ALL
SELECT 'node', node_type, count(*) FROM nodes GROUP BY node_type UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type""")
def graph_architecture(spark, sf_dir):
    """Counts of languages, nodes and edges in one table."""
    part = lambda df, section, column: df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    return part(table(spark, sf_dir, "documents"), "language", "lang").unionAll(part(nodes(spark, sf_dir), "node", "node_type")).unionAll(part(edges(spark, sf_dir), "edge", "edge_type"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS date FROM orders), t AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS tags FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(tags, '') AS tags, row_number() OVER (PARTITION BY o_custkey ORDER BY date DESC NULLS LAST, o_orderkey)::BIGINT AS place FROM c LEFT JOIN t ON o_orderkey = l_orderkey""")
def graph_commit_timeline(spark, sf_dir):
    """Newest first, undated last, with tags."""
    tags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("tags"))
    dated = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("date").desc_nulls_last(), "o_orderkey"))
    return dated.join(tags, "o_orderkey", "left").select("o_orderkey", F.coalesce("tags", F.lit("")).alias("tags"), place.cast("long").alias("place"))


@query("""WITH s AS (SELECT s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 7)
SELECT 0::BIGINT AS step, 'supplier:7' AS node_id UNION ALL SELECT 1, 'nation:' || s_nationkey FROM s UNION ALL SELECT 2, 'region:' || n_regionkey FROM s""")
def graph_pkg_path(spark, sf_dir):
    """Shortest directed path from a supplier to its region."""
    goal = table(spark, sf_dir, "supplier").where("s_suppkey = 7").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return G.shortest_path(edges(spark, sf_dir), "supplier:7", f"region:{goal}")


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT n.node_id, title, (SELECT count(*) FROM edges WHERE dst = n.node_id)::BIGINT AS n_in, (SELECT count(*) FROM edges WHERE src = n.node_id)::BIGINT AS n_out FROM nodes n WHERE node_type IN ('region', 'nation')")
def graph_node_detail(spark, sf_dir):
    """Nodes with their edges in and out."""
    e = edges(spark, sf_dir)
    end = lambda c, name: e.groupBy(F.col(c).alias("node_id")).agg(F.count("*").alias(name))
    n = nodes(spark, sf_dir).where(F.col("node_type").isin("region", "nation"))
    return n.join(end("dst", "n_in"), "node_id", "left").join(end("src", "n_out"), "node_id", "left").select("node_id", "title", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def graph_dangling_links(spark, sf_dir):
    """Links whose target is not there."""
    return table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_anti").select("event_id", "user_id")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'rejected' ELSE 'suggested' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'ASSERTED' ELSE 'INFERRED' END AS method, (CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END)::DOUBLE AS confidence FROM orders WHERE o_orderstatus = 'P'""")
def graph_suggestions(spark, sf_dir):
    """Inferred edges after their decisions: accepted, rejected or still pending."""
    p = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    decided = p.where("o_orderkey % 3 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "accept").otherwise("reject").alias("decision"))
    d = F.col("decision")
    status = F.when(d == "accept", "active").when(d == "reject", "rejected").otherwise("suggested")
    return p.join(decided, "o_orderkey", "left").select("o_orderkey", status.alias("status"), F.when(d == "accept", "ASSERTED").otherwise("INFERRED").alias("method"), F.when(d == "accept", 1.0).when(d == "reject", 0.0).otherwise(0.5).alias("confidence"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'region:0' AS node_id, 0 AS depth UNION SELECT 'part:3', 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node_id WHERE r.depth < 4)
SELECT DISTINCT node_id FROM r""")
def graph_invalidation_closure(spark, sf_dir):
    """Whatever leads to a changed node."""
    return G.reach(edges(spark, sf_dir), start(spark, "region:0", "part:3"), 4, inbound=True).select("node_id")


@query("""
SELECT doc_id, name, CASE WHEN name = 'n77' THEN 'verified' ELSE 'candidate' END AS evidence FROM (
  SELECT p_partkey AS doc_id, unnest(['n' || p_partkey % 100, 'n' || p_size, '${N' || p_size || '}']) AS name, unnest(['v', 'v', 'c']) AS status FROM part)
WHERE status = 'c' OR contains(lower(name), 'n77') OR contains('n77', lower(name))""")
def graph_blast_iac(spark, sf_dir):
    """What a change of the object n77 touches in cluster files, one for each part."""
    text = "concat('metadata:\n  name: n', p_partkey % 100, '\nspec:\n  - configMap: n', p_size, '\n  - name: ${N', p_size, '}')"
    files = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "'k8s/app.yaml' AS file_path", f"{text} AS text")
    return deployment.blast_radius(deployment.facts(files), "N77").select("doc_id", "name", "evidence")


@query(f"WITH {EDGES_SQL} SELECT b.src || '>' || a.src || '>' || a.dst AS path FROM edges a JOIN edges b ON b.dst = a.src WHERE a.edge_type = 'defines' AND b.edge_type = 'defines' AND starts_with(a.dst, 'region:')")
def graph_dsl(spark, sf_dir):
    """Two inbound steps from every region, the path carried along."""
    d = edges(spark, sf_dir).where("edge_type = 'defines'").select("src", "dst")
    one = d.where(F.startswith("dst", F.lit("region:"))).select(F.col("src").alias("mid"), F.concat_ws(">", "src", "dst").alias("tail"))
    return d.join(one, F.col("dst") == F.col("mid")).select(F.concat_ws(">", "src", "tail").alias("path"))


@query("SELECT p_name AS method, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS package, CASE WHEN count(DISTINCT p_brand) = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM part GROUP BY p_name")
def call_target(spark, sf_dir):
    """A method is called in the one package that has it."""
    one = F.col("n") == 1
    g = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("method")).agg(F.count_distinct("p_brand").alias("n"), F.min("p_brand").alias("b"))
    return g.select("method", F.when(one, F.col("b")).alias("package"), F.when(one, "unique").otherwise("ambiguous").alias("status"))
