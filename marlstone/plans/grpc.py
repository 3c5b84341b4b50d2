"""The query of remote clients: customers and suppliers are source files of four conventions; the SQL knows what each holds."""

from __future__ import annotations

from marlstone.operators import grpc
from marlstone.plans.base import query, table
from marlstone.session import dealt

#: Repositories are nations. Suppliers hold the forwarders and getters, customers the calls.
CALLER = """CASE c_custkey % 5
  WHEN 0 THEN concat('class C { init() { this.svc = this.client.getService<S', c_nationkey, '>(''S', c_nationkey, '''); }\n run() { this.svc.m', c_custkey % 60, '(1); // this.svc.no()\n other.m1(); } }')
  WHEN 1 THEN concat('const reg = { [KEY]: { host: "h", serviceName: "S', c_nationkey, '" } };\nmodule.exports = {\n  go: async function (d) { const { c } = createGrpcClientFromRegistry(KEY, "go");\n return grpcClientCall(c, "M', c_custkey % 60, '", d); } };')
  WHEN 2 THEN concat('requestApi({ functionName: "f', c_custkey % 40, '", data: {} });')
  WHEN 3 THEN concat('api.get', c_custkey % 30, '().m', c_custkey % 70, '(req);')
  ELSE concat('const c = api.get', c_custkey % 30, '();\nfunction f(', CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'd' END, ') { return c.m', c_custkey % 70, '(req); }') END"""
HOLDER = """CASE s_suppkey % 3
  WHEN 0 THEN concat('class N { static f', s_suppkey % 40, ' = (r) => this._net.f', s_suppkey % 40, '(r); }')
  WHEN 1 THEN concat('class G { constructor() { this.c = createClient(B.S, t); }\n get', s_suppkey % 30, '() { return this.c; } }')
  ELSE concat('class W { static f', s_suppkey % 40, ' = (r) => this._net.g(r); }') END"""


@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS repo, s_suppkey % 3 AS form FROM supplier),
ends AS (SELECT 'n' || s_suppkey AS node_id, 'S' || s_nationkey AS service, 'm' || s_suppkey % 60 AS method FROM supplier),
calls AS (
  SELECT c_custkey AS k, 2 AS line, 'proxy' AS convention, 'S' || c_nationkey AS service, 'm' || c_custkey % 60 AS method FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 3, 'registry', 'S' || c_nationkey, 'M' || c_custkey % 60 FROM customer WHERE c_custkey % 5 = 1
  UNION ALL SELECT c_custkey, 1, 'dispatcher', NULL, 'f' || c_custkey % 40 FROM customer WHERE c_custkey % 5 = 2 AND EXISTS (SELECT 1 FROM s WHERE form = 0 AND repo = c_nationkey AND k % 40 = c_custkey % 40)
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN 1 ELSE 2 END, 'getter', NULL, 'm' || c_custkey % 70 FROM customer WHERE (c_custkey % 5 = 3 OR c_custkey % 5 = 4 AND c_custkey % 2 = 1) AND EXISTS (SELECT 1 FROM s WHERE form = 1 AND repo = c_nationkey AND k % 30 = c_custkey % 30)),
f AS (SELECT *, (SELECT min(node_id) FROM ends e WHERE e.service = calls.service AND e.method = lower(calls.method)) AS by_key, (SELECT count(DISTINCT e.service) FROM ends e WHERE e.method = lower(calls.method)) AS n, (SELECT min(node_id) FROM ends e WHERE e.method = lower(calls.method)) AS by_method FROM calls)
SELECT k::VARCHAR AS file_path, line, convention, service, method, CASE WHEN service IS NOT NULL THEN CASE WHEN by_key IS NULL THEN 'not_found' ELSE 'unique' END WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'not_grpc' END AS kind, CASE WHEN service IS NOT NULL THEN by_key WHEN n = 1 THEN by_method END AS node_id FROM f""")
def ext_grpc_client(spark, sf_dir):
    """Calls of all four conventions with the endpoints that they reach."""
    # rows are dealt out before they become texts, so that texts do not move and all tasks read some
    callers = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").selectExpr("CAST(c_nationkey AS STRING) AS repo_id", "CAST(c_custkey AS STRING) AS file_path", f"{CALLER} AS text")
    holders = dealt(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").selectExpr("CAST(s_nationkey AS STRING) AS repo_id", "concat('s', s_suppkey) AS file_path", f"{HOLDER} AS text")
    ends = table(spark, sf_dir, "supplier").selectExpr("concat('n', s_suppkey) AS node_id", "concat('grpc::S', s_nationkey, '.m', s_suppkey % 60) AS identity_key")
    return grpc.invokes(callers.unionByName(holders), ends).select("file_path", "line", "convention", "service", "method", "kind", "node_id")
