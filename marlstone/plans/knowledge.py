"""Queries of the knowledge operators: the driver's tables are cast into the model by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import deployment as D
from marlstone.operators import knowledge as K
from marlstone.operators import symbols as Y
from marlstone.plans.base import query, table


class View:
    """Columns over one table, as a DataFrame and as SQL."""

    def __init__(self, source: str, *columns: str, where: str = "true"):
        self.source, self.columns, self.where = source, columns, where

    def df(self, spark, sf_dir):
        return table(spark, sf_dir, self.source).where(self.where).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.columns)} FROM {self.source} WHERE {self.where})"


TRUST = View("lineitem", "l_orderkey", "l_linenumber", "CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'INFERRED' ELSE 'EXTRACTED' END AS method", """CASE l_linenumber WHEN 1 THEN '{"proof": "heuristic"}' WHEN 2 THEN '{"frameworkConvention": true}' WHEN 3 THEN '{"runtimeObservation": "trace"}' WHEN 4 THEN '{"proof": "lsp_resolution"}' WHEN 5 THEN '{"typeResolved": false}' END AS provenance""")


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, method, json_extract_string(provenance, '$.proof') AS proof, json_extract_string(provenance, '$.frameworkConvention') = 'true' AS convention, json_extract_string(provenance, '$.runtimeObservation') IS NOT NULL AS seen FROM {TRUST.sql})
SELECT l_orderkey, l_linenumber, CASE WHEN method = 'INFERRED' OR proof = 'heuristic' OR convention THEN 'candidate' ELSE 'verified' END AS status,
  CASE WHEN convention THEN 'framework_convention' WHEN method = 'INFERRED' OR proof = 'heuristic' THEN 'heuristic' WHEN proof IS NOT NULL THEN proof WHEN seen THEN 'runtime_observation' ELSE 'ast_exact' END AS proof FROM p""")
def filter_edge_trust(spark, sf_dir):
    return K.edge_trust(TRUST.df(spark, sf_dir)).select("l_orderkey", "l_linenumber", "status", "proof")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE contains(lower(text), 'under the')),
a AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: contains(lower(x), 'under the')), true)::BIGINT AS n FROM l)
SELECT doc_id, n AS start_line, n AS end_line, coalesce(list_sum(list_transform(lines[1:n - 1], lambda x: strlen(x) + 1)), 0)::BIGINT AS start_byte FROM a""")
def filter_markdown(spark, sf_dir):
    """The first line of each document that holds a phrase, with its place in bytes."""
    return K.markdown_places(table(spark, sf_dir, "documents"), "line", "under the")


BASES = View(
    "orders", "o_orderkey", "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'p' || o_orderkey END AS prior_snapshot_id", "CASE WHEN o_orderstatus = 'F' THEN 'c' || o_orderkey END AS prior_commit", "CASE WHEN o_custkey % 10 = 0 THEN 'main' ELSE 'feature' END AS target_branch", "'main' AS canonical_branch",
    "CASE WHEN o_orderkey % 5 = 1 THEN 'm' || o_custkey END AS merge_base_snapshot_id", "CASE WHEN o_orderkey % 2 = 1 THEN 'k' || o_custkey END AS merge_base_commit", "CASE WHEN o_orderkey % 7 < 3 THEN 's' || o_custkey END AS canonical_snapshot_id", "'h' || o_custkey AS canonical_commit", "CASE o_orderstatus WHEN 'O' THEN 'complete' WHEN 'F' THEN 'shallow' END AS history",
)


@query(f"""
SELECT o_orderkey, CASE WHEN prior_snapshot_id IS NOT NULL THEN 'prior_branch_snapshot' WHEN target_branch = canonical_branch THEN 'canonical_master' WHEN merge_base_snapshot_id IS NOT NULL OR (merge_base_commit IS NOT NULL AND history = 'complete') THEN 'git_merge_base' WHEN canonical_snapshot_id IS NOT NULL OR coalesce(history, '') <> 'complete' THEN 'degraded_history' ELSE 'no_base' END AS reason,
  CASE WHEN prior_snapshot_id IS NOT NULL THEN prior_snapshot_id WHEN target_branch = canonical_branch THEN NULL WHEN merge_base_snapshot_id IS NOT NULL THEN merge_base_snapshot_id WHEN merge_base_commit IS NOT NULL AND history = 'complete' THEN NULL ELSE canonical_snapshot_id END AS base_snapshot_id,
  CASE WHEN prior_snapshot_id IS NOT NULL THEN prior_commit WHEN target_branch = canonical_branch THEN NULL WHEN merge_base_snapshot_id IS NOT NULL OR (merge_base_commit IS NOT NULL AND history = 'complete') THEN merge_base_commit WHEN canonical_snapshot_id IS NOT NULL THEN canonical_commit END AS base_commit
FROM {BASES.sql}""")
def rev_base(spark, sf_dir):
    return K.branch_bases(BASES.df(spark, sf_dir)).select("o_orderkey", "reason", "base_snapshot_id", "base_commit")


FRESH = View("orders", "o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS last_indexed_at", "CASE WHEN o_orderkey % 4 > 0 THEN 'c' || o_custkey % 3 END AS last_indexed_commit", "'c' || o_orderkey % 3 AS head_commit")


@query(f"SELECT o_orderkey, last_indexed_at IS NULL OR coalesce(head_commit <> last_indexed_commit, false) AS stale, CASE WHEN last_indexed_at IS NULL THEN 'never_indexed' WHEN head_commit <> last_indexed_commit THEN 'advanced' ELSE 'fresh' END AS reason FROM {FRESH.sql}")
def rev_freshness(spark, sf_dir):
    return K.freshness(FRESH.df(spark, sf_dir)).select("o_orderkey", "stale", "reason")


REQUESTS = View("events", "event_id AS request_id", "user_id AS repo_id", "event_type AS target_id", "ts AS observed_at", "CASE WHEN event_type = 'purchase' THEN 'log' || event_id END AS log_commit", "CASE WHEN event_type = 'signup' THEN 'stage' END AS environment_branch")
DEPLOYED = View("orders", "CASE WHEN o_orderkey % 2 = 0 THEN 'view' ELSE 'click' END AS target_id", "o_custkey AS repo_id", "'d' || o_orderkey AS commit", "o_orderdate AS deployed_from", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS deployed_to")
SNAPSHOTS = View("orders", "o_custkey AS repo_id", "CASE WHEN o_orderkey % 5 > 0 THEN 's' || o_orderkey END AS commit", "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'cold' ELSE 'failed' END AS state", "o_orderdate AS published_at", where="o_custkey % 2 = 0")
BRANCHES = View("customer", "c_custkey AS repo_id", "CASE WHEN c_custkey % 3 = 0 THEN 'stage' ELSE 'main' END AS name", "c_custkey % 3 = 1 AS live")


@query(f"""
WITH r AS {REQUESTS.sql}, d AS (SELECT request_id, arg_max(commit, (deployed_from, commit)) AS ran FROM r JOIN {DEPLOYED.sql} USING (target_id, repo_id) WHERE deployed_from <= observed_at AND (deployed_to IS NULL OR deployed_to > observed_at) GROUP BY request_id),
n AS (SELECT repo_id, arg_max(commit, (published_at, commit)) AS newest FROM {SNAPSHOTS.sql} WHERE commit IS NOT NULL AND state IN ('ready', 'cold') GROUP BY repo_id), b AS {BRANCHES.sql}
SELECT r.request_id, CASE WHEN log_commit IS NOT NULL THEN 'log_commit' WHEN ran IS NOT NULL THEN 'deployment_record' WHEN newest IS NOT NULL THEN 'indexed_commit' WHEN EXISTS (SELECT 1 FROM b WHERE b.repo_id = r.repo_id AND b.name = r.environment_branch) THEN 'environment_branch' WHEN EXISTS (SELECT 1 FROM b WHERE b.repo_id = r.repo_id AND live) THEN 'live_fallback' ELSE 'unresolved' END AS source,
  coalesce(log_commit, ran, newest) AS commit FROM r LEFT JOIN d ON r.request_id = d.request_id LEFT JOIN n ON r.repo_id = n.repo_id""")
def rev_code_version(spark, sf_dir):
    return K.code_versions(*(v.df(spark, sf_dir) for v in (REQUESTS, DEPLOYED, SNAPSHOTS, BRANCHES)))


WRITES = View("orders", "o_orderkey AS seq", "o_orderstatus AS node_type", "'n' || o_custkey AS identity_key", "o_orderpriority AS title", "CASE WHEN o_orderkey % 3 = 0 THEN 'm' || o_orderkey END AS meta", "CASE WHEN o_orderkey % 4 = 0 THEN 'r' || o_orderkey % 11 END AS repo_id")


@query(f"SELECT node_type, identity_key, arg_max(title, seq) AS title, arg_max(meta, seq) FILTER (WHERE meta IS NOT NULL) AS meta, arg_min(repo_id, seq) FILTER (WHERE repo_id IS NOT NULL) AS repo_id FROM {WRITES.sql} GROUP BY node_type, identity_key")
def sink_node_upsert(spark, sf_dir):
    return K.upsert_nodes(WRITES.df(spark, sf_dir))


INCOMING = View("customer", "c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'git' || c_custkey % 400 END AS remote", "'Name ' || c_custkey % 700 AS name")
EXISTING = View("supplier", "s_suppkey * 9 AS id", "CASE WHEN s_suppkey % 2 = 0 THEN 'git' || s_suppkey END AS remote", "'NAME ' || s_suppkey * 3 AS name")


@query(f"""
WITH i AS {INCOMING.sql}, e AS {EXISTING.sql}, f AS (SELECT i.id, (SELECT max(e.id) FROM e WHERE e.id = i.id) AS a, (SELECT max(e.id) FROM e WHERE e.remote = i.remote) AS b, (SELECT max(e.id) FROM e WHERE lower(e.name) = lower(i.name)) AS c FROM i)
SELECT id AS incoming_id, coalesce(a, b, c) AS existing_id, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'remote' WHEN c IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by FROM f""")
def artifact_conflicts(spark, sf_dir):
    return K.repo_conflicts(INCOMING.df(spark, sf_dir), EXISTING.df(spark, sf_dir))


ENDPOINTS = View("supplier", "'n' || s_suppkey AS node_id", "'grpc::S' || s_nationkey || '.m' || s_suppkey % 60 AS identity_key")
CALLS = View("customer", "CASE c_custkey % 4 WHEN 0 THEN '/pkg.v1.S' || c_nationkey || '/M' || c_custkey % 60 WHEN 1 THEN 'S' || c_nationkey || '.M' || c_custkey % 60 WHEN 2 THEN 'M' || c_custkey % 70 ELSE 'grpc::S' || c_nationkey || '.m' || c_custkey % 60 END AS input", "c_nationkey AS nation", "c_custkey AS k")


@query(f"""
WITH e AS {ENDPOINTS.sql}, c AS (SELECT DISTINCT input, CASE WHEN k % 4 <> 2 THEN 'grpc::S' || nation || '.m' || k % 60 END AS key, CASE WHEN k % 4 = 2 THEN 'm' || k % 70 END AS method FROM {CALLS.sql}),
f AS (SELECT *, (SELECT min(node_id) FROM e WHERE identity_key = key) AS by_key, (SELECT count(DISTINCT identity_key) FROM e WHERE split_part(identity_key, '.', 2) = method) AS n, (SELECT min(node_id) FROM e WHERE split_part(identity_key, '.', 2) = method) AS by_method FROM c)
SELECT input, CASE WHEN key IS NOT NULL THEN CASE WHEN by_key IS NULL THEN 'not_found' ELSE 'unique' END WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'not_grpc' END AS kind, CASE WHEN key IS NOT NULL THEN by_key WHEN n = 1 THEN by_method END AS node_id, CASE WHEN key IS NOT NULL THEN (by_key IS NOT NULL)::BIGINT ELSE n END AS candidates FROM f""")
def graph_resolve_grpc(spark, sf_dir):
    return K.resolve_grpc(CALLS.df(spark, sf_dir).select("input").distinct(), ENDPOINTS.df(spark, sf_dir))


MEMORY = View("events", "event_id AS id", "CASE event_type WHEN 'error' THEN 'forgotten' ELSE 'active' END AS status", "CASE WHEN event_id % 3 = 0 THEN value END AS expires_at", "floor(value) AS confidence", "ts AS updated_at", "CASE WHEN event_id % 2 = 0 THEN 'w' || user_id % 3 END AS workspace_id", "'r' || user_id % 5 AS repo_id")


@query(f"SELECT id FROM {MEMORY.sql} WHERE status = 'active' AND (expires_at IS NULL OR expires_at > 20) AND (workspace_id IS NULL OR workspace_id = 'w1') AND repo_id = 'r2'")
def memory_recall(spark, sf_dir):
    return K.recall(MEMORY.df(spark, sf_dir), 20.0, workspace="w1", repo="r2").select("id")


NOTES = View("orders", "o_orderkey", "CASE o_orderkey % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'verified' WHEN 3 THEN 'resolved' WHEN 4 THEN 'archived' END AS status", "CASE o_custkey % 5 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'verified' WHEN 2 THEN 'resolved' WHEN 3 THEN 'archived' ELSE 'draft' END AS wanted", "CASE WHEN o_custkey % 7 = 0 THEN 'draft' END AS expected")
FINDINGS = View("orders", "o_orderkey", "CASE o_orderkey % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'reproduced' WHEN 2 THEN 'validated' WHEN 3 THEN 'contradicted' WHEN 4 THEN 'resolved' END AS status", "CASE o_custkey % 5 WHEN 0 THEN 'reproduced' WHEN 1 THEN 'validated' WHEN 2 THEN 'contradicted' WHEN 3 THEN 'resolved' ELSE 'draft' END AS wanted", "CASE WHEN o_custkey % 7 = 0 THEN 'draft' END AS expected")


def moves_sql(view: View, moves) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, bs in moves.items() for b in bs)
    outcome = f"CASE WHEN expected <> status THEN 'conflict' WHEN (status, wanted) IN ({pairs}) THEN 'moved' ELSE 'invalid' END"
    return f"SELECT o_orderkey, outcome, CASE WHEN outcome = 'moved' THEN wanted ELSE status END AS status FROM (SELECT *, {outcome} AS outcome FROM {view.sql})"


@query(moves_sql(NOTES, K.EVIDENCE_MOVES))
def evidence_lifecycle(spark, sf_dir):
    return K.moved(NOTES.df(spark, sf_dir), K.EVIDENCE_MOVES).select("o_orderkey", "outcome", "status")


@query(moves_sql(FINDINGS, K.FINDING_MOVES))
def finding_fsm(spark, sf_dir):
    return K.moved(FINDINGS.df(spark, sf_dir), K.FINDING_MOVES).select("o_orderkey", "outcome", "status")


CARDS = View("orders", "o_orderkey AS id", "o_custkey AS subject", "CASE o_orderkey % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'move' ELSE 'drop' END AS decision", "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'reviewed' ELSE 'draft' END AS status", "o_orderkey AS seq")


@query(f"""WITH c AS {CARDS.sql} SELECT id, CASE WHEN status <> 'draft' AND EXISTS (SELECT 1 FROM c d WHERE d.subject = c.subject AND d.decision <> c.decision AND d.status <> 'draft' AND d.seq > c.seq) THEN 'disputed' ELSE status END AS status FROM c""")
def why_conflict(spark, sf_dir):
    return K.disputed(CARDS.df(spark, sf_dir)).select("id", "status")


CITES = View("orders", "o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'verified' ELSE 'active' END AS status", """'["h' || o_custkey || '", "h' || o_orderkey % 50 || 'x"]' AS sources""")
CHANGED = View("customer", "'h' || c_custkey AS key", where="c_custkey % 3 = 0")


def cited_sql(before: str) -> str:
    return f"WITH g AS {CHANGED.sql}, c AS {CITES.sql}, k AS (SELECT DISTINCT id FROM (SELECT id, unnest(regexp_extract_all(sources, 'h[0-9]+')) AS key FROM c WHERE status = '{before}') JOIN (SELECT DISTINCT key FROM g) USING (key)) SELECT c.id, CASE WHEN k.id IS NULL THEN status ELSE 'stale' END AS status FROM c LEFT JOIN k ON c.id = k.id"


@query(cited_sql("verified"))
def why_stale(spark, sf_dir):
    return K.citing(CITES.df(spark, sf_dir), "sources", CHANGED.df(spark, sf_dir), "verified", "h[0-9]+").select("id", "status")


@query(cited_sql("active"))
def memory_stale_by_revision(spark, sf_dir):
    return K.citing(CITES.df(spark, sf_dir), "sources", CHANGED.df(spark, sf_dir), "active", "h[0-9]+").select("id", "status")


#: A chain whose rows are hashed on their own here, with a break at every 97th row and a forged one at every 89th.
LOG = View("events", "event_id AS seq", "event_type AS actor", "CASE WHEN event_id % 89 = 0 THEN 'forged' ELSE props END AS result", "props AS true_result")
HASH_SQL = "sha256(coalesce(length(actor) || ':' || actor, '-') || '|' || coalesce(length({0}) || ':' || {0}, '-') || '|' || coalesce(length(previous_hash) || ':' || previous_hash, '-'))"


@query(f"""
WITH l AS (SELECT *, CASE WHEN seq % 97 = 0 THEN 'broken' WHEN seq > (SELECT min(event_id) FROM events) THEN sha256((seq - 1)::VARCHAR) END AS previous_hash, sha256(seq::VARCHAR) AS linked FROM {LOG.sql}),
h AS (SELECT *, CASE WHEN seq % 2 = 0 THEN {HASH_SQL.format("true_result")} ELSE linked END AS event_hash, {HASH_SQL.format("result")} AS real FROM l),
p AS (SELECT h.seq, CASE WHEN h.previous_hash IS DISTINCT FROM b.event_hash THEN 'unlinked' WHEN h.event_hash <> h.real THEN 'forged' END AS problem FROM h LEFT JOIN h b ON h.seq = b.seq + 1)
SELECT seq, problem FROM p WHERE problem IS NOT NULL""")
def stream_audit_chain(spark, sf_dir):
    """Broken links and forged rows of a log."""
    log = LOG.df(spark, sf_dir)
    first = log.agg(F.min("seq")).first()[0]
    number = lambda c: F.sha2(c.cast("string"), 256)
    log = log.withColumn("previous_hash", F.when(F.col("seq") % 97 == 0, "broken").when(F.col("seq") > first, number(F.col("seq") - 1)))
    honest = K.event_hash(["actor", "true_result"])
    return K.audit_breaks(log.withColumn("event_hash", F.when(F.col("seq") % 2 == 0, honest).otherwise(number(F.col("seq")))), ["actor", "result"])


KNOWN = View("customer", "c_custkey AS topic", "'h' || c_custkey % 4 AS evidence_hash", "c_custkey % 7 AS n", where="c_custkey % 3 > 0")
SEEN = View("orders", "o_custkey AS topic", "'o' || o_orderkey % 20 AS observation_id", where="o_orderstatus = 'F'")
PACKETS = View("orders", "o_custkey AS topic", "'h' || o_custkey % 5 AS evidence_hash", "'o' || o_orderkey % 30 AS observation_id", where="o_orderstatus = 'O'")
MERGED_SQL = f"""WITH s AS (SELECT topic, max(evidence_hash) AS new_hash, count(*) AS more FROM {PACKETS.sql} GROUP BY topic),
d AS (SELECT s.topic, CASE WHEN n IS NULL THEN 'created' WHEN new_hash = evidence_hash THEN 'duplicate_observed' ELSE 'updated' END AS status, new_hash AS evidence_hash, (coalesce(n, 0) + more)::BIGINT AS n FROM s LEFT JOIN {KNOWN.sql} k ON s.topic = k.topic)"""


@query(f"{MERGED_SQL} SELECT topic, status, evidence_hash, n FROM d")
def evidence_upsert(spark, sf_dir):
    return K.merge_evidence(*(v.df(spark, sf_dir) for v in (KNOWN, SEEN, PACKETS)))[0]


@query(f"{MERGED_SQL} SELECT DISTINCT p.topic, observation_id FROM {PACKETS.sql} p JOIN d ON p.topic = d.topic AND d.status <> 'duplicate_observed' WHERE NOT EXISTS (SELECT 1 FROM {SEEN.sql} o WHERE o.topic = p.topic AND o.observation_id = p.observation_id)")
def evidence_merge(spark, sf_dir):
    """Observations that the documents did not have."""
    return K.merge_evidence(*(v.df(spark, sf_dir) for v in (KNOWN, SEEN, PACKETS)))[1]


CHAIN = View("region", "'s' || r_regionkey AS snapshot_id", "CASE WHEN r_regionkey > 0 THEN 's' || (r_regionkey - 1) END AS base_snapshot_id")
REFS = View("orders", "'s' || o_orderkey % 5 AS snapshot_id", "'f' || o_custkey AS file_path", "o_orderkey AS resolution_set_id", where="o_orderstatus = 'F'")
GONE = View("customer", "'s' || c_custkey % 5 AS snapshot_id", "'f' || c_custkey AS file_path", where="c_custkey % 2 = 0")
LINKS = View("lineitem", "CASE WHEN l_linenumber < 7 THEN l_orderkey END AS resolution_set_id", "l_partkey AS dst", "l_linenumber AS n")


@query(f"""
WITH own AS (SELECT file_path, resolution_set_id, 3 - substr(snapshot_id, 2)::INT AS depth FROM {REFS.sql} WHERE substr(snapshot_id, 2)::INT <= 3), gone AS (SELECT file_path, 3 - substr(snapshot_id, 2)::INT AS depth FROM {GONE.sql} WHERE substr(snapshot_id, 2)::INT <= 3),
near AS (SELECT file_path, min(depth) AS depth FROM (SELECT file_path, depth FROM own UNION ALL SELECT file_path, depth FROM gone) GROUP BY file_path),
shown AS (SELECT DISTINCT resolution_set_id FROM own JOIN near USING (file_path, depth))
SELECT resolution_set_id, dst, n FROM {LINKS.sql} WHERE resolution_set_id IS NULL OR resolution_set_id IN (SELECT resolution_set_id FROM shown)""")
def rev_view_edges(spark, sf_dir):
    """Edges that the snapshot s3 shows along its chain, and the global ones."""
    return K.visible_edges(*(v.df(spark, sf_dir) for v in (CHAIN, REFS, GONE, LINKS)), "s3")


SCOPES = View("events", "event_id AS request_id", "user_id AS repo_id", "CASE WHEN event_type = 'view' THEN 'main' WHEN event_type = 'error' THEN 'gone' END AS branch", "CASE WHEN event_id % 3 = 0 THEN 'stage' WHEN event_id % 3 = 1 THEN 'new' END AS checked_out")


@query(f"""
WITH r AS {SCOPES.sql}, b AS {BRANCHES.sql}, f AS (SELECT r.*, EXISTS (SELECT 1 FROM b WHERE b.repo_id = r.repo_id AND b.name = r.branch) AS asked, EXISTS (SELECT 1 FROM b WHERE b.repo_id = r.repo_id AND b.name = r.checked_out) AS indexed, (SELECT min(name) FROM b WHERE b.repo_id = r.repo_id AND live) AS live_branch FROM r),
g AS (SELECT *, CASE WHEN branch IS NOT NULL THEN CASE WHEN asked THEN 'explicit' ELSE 'unresolved' END WHEN indexed THEN 'checkout' WHEN live_branch IS NOT NULL THEN 'fallback' ELSE 'unresolved' END AS resolved_by FROM f)
SELECT request_id, CASE resolved_by WHEN 'explicit' THEN branch WHEN 'checkout' THEN checked_out WHEN 'fallback' THEN live_branch END AS branch, resolved_by,
  CASE WHEN resolved_by = 'explicit' AND branch <> checked_out THEN 'SCOPE_DIFFERS_FROM_CHECKOUT' WHEN resolved_by = 'fallback' AND checked_out IS NOT NULL THEN 'BRANCH_NOT_INDEXED_FALLBACK' WHEN resolved_by = 'fallback' THEN 'FALLBACK_LIVE_BRANCH' WHEN resolved_by = 'unresolved' THEN 'SCOPE_UNRESOLVED' END AS warning FROM g""")
def rev_scope_chokepoint(spark, sf_dir):
    return K.scopes(SCOPES.df(spark, sf_dir), BRANCHES.df(spark, sf_dir))


VERSIONS = View("orders", "'n' || o_custkey AS node_id", "'b' || o_orderkey % 3 AS branch_id", where="o_orderstatus = 'F'")
BRANCH_EDGES = View("orders", "'n' || o_custkey AS src", "'n' || o_orderkey % 900 AS dst", "CASE WHEN o_orderkey % 4 > 0 THEN 'b' || o_orderkey % 3 END AS branch_id", where="o_orderstatus = 'P'")
OWNED = View("customer", "'n' || c_custkey AS node_id", "'r' || c_nationkey AS repo_id")


@query(f"""
WITH v AS {VERSIONS.sql}, e AS {BRANCH_EDGES.sql}, left_e AS (SELECT * FROM e WHERE branch_id IS DISTINCT FROM 'b1'),
held AS (SELECT node_id FROM v WHERE branch_id <> 'b1' UNION SELECT src FROM left_e UNION SELECT dst FROM left_e)
SELECT node_id, repo_id FROM {OWNED.sql} WHERE node_id NOT IN (SELECT node_id FROM v WHERE branch_id = 'b1') OR node_id IN (SELECT node_id FROM held)""")
def branch_remove(spark, sf_dir):
    """Nodes that stay when a branch goes."""
    return K.remove_branch("b1", *(v.df(spark, sf_dir) for v in (VERSIONS, BRANCH_EDGES, OWNED)))[2]


NOTE_FILES = View("customer", "'n' || c_custkey AS node_id", "'p' || c_custkey AS path")
ON_DISK = View("orders", "'p' || o_custkey AS path", where="o_orderstatus = 'F'")


@query(f"""SELECT src, dst FROM (SELECT src, dst FROM {BRANCH_EDGES.sql}) WHERE src NOT IN (SELECT node_id FROM {NOTE_FILES.sql} WHERE path NOT IN (SELECT path FROM {ON_DISK.sql}))""")
def note_prune(spark, sf_dir):
    """Links that stay when notes that are not on disk go."""
    return K.prune_notes(NOTE_FILES.df(spark, sf_dir), BRANCH_EDGES.df(spark, sf_dir).select("src", "dst"), ON_DISK.df(spark, sf_dir))[1]


IMPORTS = View("lineitem", "l_orderkey AS doc_id", "'src/d' || l_suppkey % 7 || '/m' || l_orderkey || '.ts' AS file_path", "CASE l_linenumber WHEN 1 THEN './p' || l_partkey WHEN 2 THEN '../d' || l_suppkey % 5 || '/p' || l_partkey || '.js' WHEN 3 THEN './../../lib/p' || l_partkey WHEN 4 THEN '../../../p' ELSE 'pkg' || l_linenumber END AS spec")
SOURCES = View("part", "CASE p_partkey % 4 WHEN 0 THEN 'src/d' || p_partkey % 7 || '/p' || p_partkey || '.ts' WHEN 1 THEN 'src/d' || p_partkey % 5 || '/p' || p_partkey || '.tsx' WHEN 2 THEN 'lib/p' || p_partkey || '/index.js' ELSE 'src/d' || p_partkey % 5 || '/p' || p_partkey || '.js' END AS file_path")


@query(f"""
WITH i AS (SELECT DISTINCT doc_id, file_path, spec FROM {IMPORTS.sql}), f AS {SOURCES.sql},
b AS (SELECT doc_id, spec, CASE WHEN starts_with(spec, './p') THEN regexp_replace(file_path, '[^/]+$', '') || substr(spec, 3) WHEN starts_with(spec, '../d') THEN 'src/' || substr(spec, 4) WHEN starts_with(spec, './../../lib') THEN substr(spec, 9) END AS base FROM i),
t AS (SELECT doc_id, spec, unnest(CASE WHEN ends_with(base, '.js') THEN [regexp_replace(base, '.js$', '.ts'), regexp_replace(base, '.js$', '.tsx'), regexp_replace(base, '.js$', '.d.ts'), base, base || '.ts', base || '.tsx'] ELSE [base, base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '/index.ts', base || '/index.tsx', base || '/index.js'] END) AS path,
  unnest(range(8)) AS nth FROM b WHERE base IS NOT NULL),
m AS (SELECT doc_id, spec, arg_min(path, nth) AS target FROM t WHERE path IN (SELECT file_path FROM f) GROUP BY doc_id, spec)
SELECT DISTINCT i.doc_id, i.spec, target FROM i LEFT JOIN m ON i.doc_id = m.doc_id AND i.spec = m.spec""")
def ext_resolve_import(spark, sf_dir):
    return K.resolve_imports(IMPORTS.df(spark, sf_dir).distinct(), SOURCES.df(spark, sf_dir))


DEPLOY = View("part", "p_partkey AS doc_id", "CASE p_partkey % 3 WHEN 0 THEN 'svc/Dockerfile' WHEN 1 THEN 'infra/main.tf' ELSE 'k8s/app.yaml' END AS file_path", """CASE p_partkey % 3 WHEN 0 THEN concat('FROM img', p_size, ' AS stage', p_size, chr(10), 'EXPOSE ', p_size) WHEN 1 THEN concat('resource "t', p_size, '"  "r', p_partkey, '" {', chr(10), '}') ELSE concat('kind: Service', chr(10), '  name: n', p_partkey, chr(10), '  token: ', p_name) END AS text""")


@query("""
SELECT p_partkey AS doc_id, 1::BIGINT AS start_line, 'docker_stage' AS kind, 'stage' || p_size AS name, 'runs' AS relation, 'verified' AS status FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 2, 'port', p_size::VARCHAR, 'exposes', 'verified' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 1, 'terraform_resource', 't' || p_size || '.r' || p_partkey, NULL, 'verified' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, 1, 'service', 'Service', NULL, 'verified' FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT p_partkey, 2, 'config', 'n' || p_partkey, 'references', 'verified' FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT p_partkey, 3, 'secret_ref', 'token', 'references', 'verified' FROM part WHERE p_partkey % 3 = 2""")
def ext_iac(spark, sf_dir):
    return D.facts(DEPLOY.df(spark, sf_dir))


CODE = View("part", "p_partkey AS doc_id", "concat('src/p', p_partkey, '.ts') AS file_path", "concat('export class P', p_partkey, ' {', chr(10), '  size(a: number) {', chr(10), '    return ', p_size, ';', chr(10), '  }', chr(10), '  size(b: string) {', chr(10), '  }', chr(10), '}', chr(10), 'function free', p_partkey, '() { return 1; }') AS text")


@query("""
WITH d AS (
  SELECT p_partkey AS doc_id, 'P' || p_partkey AS qualified_name, 'class' AS kind, 'export class P' || p_partkey || ' {' AS signature, 1::BIGINT AS start_line, 7::BIGINT AS end_line, 'export class \\0 {' || chr(10) || '  size(a: number) {' || chr(10) || '    return ' || p_size || ';' || chr(10) || '  }' || chr(10) || '  size(b: string) {' || chr(10) || '  }' || chr(10) || '}' AS body FROM part
  UNION ALL SELECT p_partkey, 'P' || p_partkey || '.size(a:number)', 'method', 'size(a: number) {', 2, 4, '  \\0(a: number) {' || chr(10) || '    return ' || p_size || ';' || chr(10) || '  }' FROM part
  UNION ALL SELECT p_partkey, 'P' || p_partkey || '.size(b:string)', 'method', 'size(b: string) {', 5, 6, '  \\0(b: string) {' || chr(10) || '  }' FROM part
  UNION ALL SELECT p_partkey, 'free' || p_partkey, 'function', 'function free' || p_partkey || '() { return 1; }', 8, 8, 'function \\0() { return 1; }' FROM part)
SELECT doc_id, qualified_name, kind, signature, start_line, end_line, sha256(body) AS body_hash FROM d""".replace("\\\\0", "\\0"))
def ext_symbols(spark, sf_dir):
    return Y.symbols(CODE.df(spark, sf_dir))
