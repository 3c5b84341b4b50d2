"""Queries of schemas and canvases: parts are fields of messages that form a tree, orders are canvases of two nodes and an edge."""

from __future__ import annotations

from marlstone.operators import schemas as S
from marlstone.plans.base import query, table
from marlstone.sources import vaults as V

#: Ten parts are the fields of a message; the first two name the message's children in the tree, the third the message itself.
FIELDS = [
    "concat('M', p_partkey DIV 10) AS message", "concat('f', p_partkey) AS field",
    "CASE p_partkey % 10 WHEN 0 THEN concat('M', p_partkey DIV 10 * 2 + 1) WHEN 1 THEN concat('M', p_partkey DIV 10 * 2 + 2) WHEN 2 THEN concat('M', p_partkey DIV 10) ELSE 't' END AS type",
    "CASE WHEN p_partkey % 10 < 3 THEN 'message' WHEN p_partkey % 10 = 3 THEN 'map' WHEN p_partkey % 10 = 4 THEN 'enum' ELSE 'scalar' END AS kind",
    "CASE WHEN p_size % 7 > 0 THEN 'implicit' END AS presence", "CASE WHEN p_size % 3 > 0 THEN array('A', 'B') END AS enum_values", "CASE WHEN p_partkey % 10 = 3 AND p_size % 2 = 0 THEN 'string' END AS map_value",
]


@query("""
WITH RECURSIVE f AS (SELECT p_partkey // 10 AS m, 'f' || p_partkey AS field, p_partkey % 10 AS k, p_size FROM part),
tops AS (SELECT n_name AS method, unnest(['request', 'response']) AS side, unnest([n_nationkey, n_nationkey + 1000000]) AS m FROM nation),
w AS (SELECT method, side, side AS pt, m::BIGINT AS m FROM tops UNION ALL SELECT method, side, pt || '.' || field, f.m * 2 + 1 + k FROM w JOIN f ON f.m = w.m WHERE k < 2),
x AS (SELECT method, pt || '.' || field AS path, k, p_size FROM w JOIN f ON f.m = w.m)
SELECT method, 'request_schema_empty' AS code, 'request' AS path FROM tops WHERE side = 'request' AND m NOT IN (SELECT m FROM f)
UNION ALL SELECT method, 'response_schema_empty', 'response' FROM tops WHERE side = 'response' AND m NOT IN (SELECT m FROM f)
UNION ALL SELECT method, 'presence_unknown', path FROM x WHERE p_size % 7 = 0
UNION ALL SELECT method, 'map_value_type_missing', path FROM x WHERE k = 3 AND p_size % 2 = 1
UNION ALL SELECT method, 'enum_values_missing', path FROM x WHERE k = 4 AND p_size % 3 = 0""")
def schema_gaps(spark, sf_dir):
    methods = table(spark, sf_dir, "nation").selectExpr("n_name AS method", "concat('M', n_nationkey) AS request", "concat('M', n_nationkey + 1000000) AS response")
    return S.schema_gaps(methods, table(spark, sf_dir, "part").selectExpr(*FIELDS))


CANVAS = """CASE WHEN o_orderkey % 9 = 0 THEN '{' ELSE concat('{"nodes": [{"id": "a", "type": "file", "file": "c', o_custkey, '.md"}, {"text": "', o_orderpriority, '"}], "edges": [{"fromNode": "a", "toNode": "node-', 1 + o_orderkey % 3, '", "label": "', o_orderstatus, '"}]}') END"""


@query("""
SELECT o_orderkey || '.canvas' AS file_path, CASE WHEN o_orderkey % 9 = 0 THEN 'CANVAS_INVALID_JSON' WHEN o_orderkey % 3 <> 1 THEN 'CANVAS_EDGE_NODE_NOT_FOUND:0' END AS error,
  CASE WHEN o_orderkey % 9 > 0 AND o_orderkey % 3 = 1 THEN concat_ws(chr(10), '---', 'id: canvas:' || o_orderkey || '.canvas', 'title: ' || o_orderkey, 'type: canvas', '---', '', '[[c' || o_custkey || '.md]]', o_orderpriority, o_orderstatus) || chr(10) END AS markdown FROM orders""")
def scan_canvas(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("concat(o_orderkey, '.canvas') AS file_path", f"{CANVAS} AS text")
    return V.canvases(files).select("file_path", "error", "markdown")
