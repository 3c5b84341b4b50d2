"""Rules of the knowledge model on small fixtures."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import knowledge as K
from marlstone.operators.graph import shortest_path
from marlstone.operators.symbols import definitions, symbols


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_edge_trust(spark):
    edges = spark.createDataFrame(
        [(1, "EXTRACTED", None), (2, "INFERRED", "{}"), (3, "EXTRACTED", '{"proof": "heuristic"}'), (4, "EXTRACTED", '{"frameworkConvention": true}'), (5, "ASSERTED", '{"runtimeObservation": "trace"}'), (6, None, "no json"), (7, "EXTRACTED", '{"proof": "lsp_resolution"}'), (8, "EXTRACTED", '{"typeResolved": false}')],
        "id int, method string, provenance string",
    )
    assert rows(K.edge_trust(edges), "id", "status", "proof") == [
        (1, "verified", "ast_exact"), (2, "candidate", "heuristic"), (3, "candidate", "heuristic"), (4, "candidate", "framework_convention"),
        (5, "verified", "runtime_observation"), (6, "verified", "ast_exact"), (7, "verified", "lsp_resolution"), (8, "verified", "ast_exact"),
    ]


NOTE = "# One\nálpha #tag\n## Deep\n- [ ] open it\n- [x] done it\ntext ^block1\n# Two\nbeta"


@pytest.mark.parametrize("field, value, want", [
    ("line", "BETA", (8, 8)), ("tag", "#tag", (2, 2)), ("section", "one", (1, 6)), ("section", "deep", (3, 6)), ("section", "two", (7, 8)),
    ("task", "open", (4, 4)), ("task", "done", (5, 5)), ("block", "block1", (6, 6)), ("line", "nowhere", None), ("section", "nowhere", None),
])
def test_markdown_places(spark, field, value, want):
    notes = spark.createDataFrame([(1, NOTE), (2, ""), (3, None)], "doc_id long, text string")
    before = len("".join(x + "\n" for x in NOTE.split("\n")[: want[0] - 1]).encode()) if want else 0
    got = rows(K.markdown_places(notes, field, value), "doc_id", "start_line", "end_line", "start_byte")
    assert got == ([(1, *want, before)] if want else [])


def test_branch_bases(spark):
    b = spark.createDataFrame(
        [(1, "s1", "c1", "f", "main", "m", "mc", "k", "kc", "complete"), (2, None, None, "main", "main", "m", "mc", "k", "kc", "complete"), (3, None, None, "f", "main", "m", "mc", "k", "kc", "shallow"), (4, None, None, "f", "main", None, "mc", "k", "kc", "complete"), (5, None, None, "f", "main", None, "mc", "k", "kc", "shallow"), (6, None, None, "f", "main", None, None, None, None, "complete"), (7, None, None, "f", None, None, None, None, None, None)],
        "id int, prior_snapshot_id string, prior_commit string, target_branch string, canonical_branch string, merge_base_snapshot_id string, merge_base_commit string, canonical_snapshot_id string, canonical_commit string, history string",
    )
    assert rows(K.branch_bases(b), "id", "reason", "base_snapshot_id", "base_commit", "degraded", "materialize") == [
        (1, "prior_branch_snapshot", "s1", "c1", False, False), (2, "canonical_master", None, None, False, False), (3, "git_merge_base", "m", "mc", False, False), (4, "git_merge_base", None, "mc", False, True),
        (5, "degraded_history", "k", "kc", True, False), (6, "no_base", None, None, False, False), (7, "degraded_history", None, None, True, False),
    ]


def test_freshness(spark):
    b = spark.createDataFrame([(1, None, None, "h"), (2, "t", "a", "b"), (3, "t", "a", "a"), (4, "t", "a", None)], "id int, last_indexed_at string, last_indexed_commit string, head_commit string")
    assert rows(K.freshness(b), "id", "stale", "reason") == [(1, True, "never_indexed"), (2, True, "advanced"), (3, False, "fresh"), (4, False, "fresh")]


def test_code_versions(spark):
    req = spark.createDataFrame([(1, "r", "t", 5, "log", None), (2, "r", "t", 5, None, None), (3, "r", "t", 50, None, None), (4, "q", None, 5, None, "stage"), (5, "q", None, 5, None, "x"), (6, "z", None, 5, None, None)], "request_id int, repo_id string, target_id string, observed_at int, log_commit string, environment_branch string")
    dep = spark.createDataFrame([("t", "r", "d1", 1, 10), ("t", "r", "d2", 4, 20)], "target_id string, repo_id string, commit string, deployed_from int, deployed_to int")
    snap = spark.createDataFrame([("r", "n1", "ready", 1), ("r", "n2", "cold", 2), ("r", "n3", "failed", 3)], "repo_id string, commit string, state string, published_at int")
    br = spark.createDataFrame([("q", "stage", False), ("q", "main", True)], "repo_id string, name string, live boolean")
    assert rows(K.code_versions(req, dep, snap, br), "request_id", "source", "commit") == [(1, "log_commit", "log"), (2, "deployment_record", "d2"), (3, "indexed_commit", "n2"), (4, "environment_branch", None), (5, "live_fallback", None), (6, "unresolved", None)]


def test_upsert_nodes(spark):
    w = spark.createDataFrame([(1, "f", "k", "a", None, None), (2, "f", "k", "b", "m", "r1"), (3, "f", "k", "c", None, "r2"), (1, "g", "k", "x", None, None)], "seq int, node_type string, identity_key string, title string, meta string, repo_id string")
    assert rows(K.upsert_nodes(w), "node_type", "title", "meta", "repo_id") == [("f", "c", "m", "r1"), ("g", "x", None, None)]


def test_repo_conflicts(spark):
    new = spark.createDataFrame([("1", "x", "A"), ("9", "u", "A"), ("8", None, "beta"), ("7", None, "other")], "id string, remote string, name string")
    old = spark.createDataFrame([("1", "y", "Q"), ("2", "u", "Z"), ("3", None, "Beta")], "id string, remote string, name string")
    assert rows(K.repo_conflicts(new, old), "incoming_id", "existing_id", "matched_by") == [("1", "1", "id"), ("7", None, "new"), ("8", "3", "name"), ("9", "2", "remote")]


def test_resolve_grpc(spark):
    ends = spark.createDataFrame([("n1", "grpc::User.get"), ("n2", "grpc::Admin.get"), ("n3", "grpc::User.put"), ("n4", "http::x.get")], "node_id string, identity_key string")
    asked = ["grpc::User.get", "/pkg.sub.User/Get", "User.Put", "get", "put", "nope", "/only", "User.none", "grpc::No.x"]
    got = dict((r[0], r[1:]) for r in rows(K.resolve_grpc(spark.createDataFrame([(a,) for a in asked], "input string"), ends), "input", "kind", "node_id", "candidates"))
    assert got == {"grpc::User.get": ("unique", "n1", 1), "/pkg.sub.User/Get": ("unique", "n1", 1), "User.Put": ("unique", "n3", 1), "get": ("ambiguous", None, 2), "put": ("unique", "n3", 1), "nope": ("not_grpc", None, 0), "/only": ("not_grpc", None, 0), "User.none": ("not_found", None, 0), "grpc::No.x": ("not_found", None, 0)}


def test_records(spark):
    m = spark.createDataFrame([(1, "active", None, 0.5, 1, None, "r"), (2, "active", 5, 0.9, 1, None, "r"), (3, "active", 50, 0.9, 1, "w", None), (4, "forgotten", None, 1.0, 1, None, "r"), (5, "active", 50, 0.9, 2, "v", "r")], "id int, status string, expires_at int, confidence double, updated_at int, workspace_id string, repo_id string")
    assert [r.id for r in K.recall(m, 10).collect()] == [5, 3, 1] and [r.id for r in K.recall(m, 10, repo="r").collect()] == [5, 1] and [r.id for r in K.recall(m, 10, workspace="w").collect()] == [3, 1]
    items = spark.createDataFrame([(1, "draft", "reviewed", None), (2, "draft", "verified", None), (3, "draft", "reviewed", "verified"), (4, "archived", "draft", None), (5, None, "draft", None)], "id int, status string, wanted string, expected string")
    assert rows(K.moved(items, K.EVIDENCE_MOVES), "id", "status", "outcome") == [(1, "reviewed", "moved"), (2, "draft", "invalid"), (3, "draft", "conflict"), (4, "archived", "invalid"), (5, None, "invalid")]
    cards = spark.createDataFrame([(1, "s", "a", "verified", 1), (2, "s", "b", "draft", 2), (3, "s", "b", "reviewed", 3), (4, "s", "b", "verified", 4), (5, "t", "a", "verified", 1), (6, "s", "c", "draft", 9)], "id int, subject string, decision string, status string, seq int")
    assert [r[0] for r in rows(K.disputed(cards).where("status = 'disputed'"), "id")] == [1]
    h = ["%064x" % i for i in range(3)]
    cites = spark.createDataFrame([(1, "verified", f'["{h[0]}", "{h[1]}"]'), (2, "draft", h[0]), (3, "verified", h[2])], "id int, status string, evidence string")
    assert rows(K.citing(cites, "evidence", spark.createDataFrame([(h[1],), (h[0],)], "key string"), "verified", "[0-9a-f]{64}"), "id", "status") == [(1, "stale"), (2, "draft"), (3, "verified")]


def test_audit_chain(spark):
    log, before = [], None
    for seq in range(1, 9):
        row = spark.createDataFrame([(f"a{seq}", None, before)], "actor string, result string, previous_hash string").select(K.event_hash(["actor", "result"]).alias("h")).first()["h"]
        log.append((seq, f"a{seq}", None, before, row))
        before = row
    schema = "seq int, actor string, result string, previous_hash string, event_hash string"
    assert K.audit_breaks(spark.createDataFrame(log, schema), ["actor", "result"]).count() == 0
    log[2] = (3, "other", *log[2][2:])
    log[5] = (*log[5][:3], "x" * 64, log[5][4])
    assert rows(K.audit_breaks(spark.createDataFrame(log, schema), ["actor", "result"]), "seq", "problem") == [(3, "forged"), (6, "unlinked")]


def test_merge_evidence(spark):
    docs = spark.createDataFrame([("a", "h1", 2), ("b", "h2", 1)], "topic string, evidence_hash string, n long")
    seen = spark.createDataFrame([("a", "o1"), ("a", "o2"), ("b", "o1")], "topic string, observation_id string")
    sent = spark.createDataFrame([("a", "h1", "o3"), ("b", "h9", "o1"), ("b", "h9", "o2"), ("c", "h3", "o1")], "topic string, evidence_hash string, observation_id string")
    out, fresh = K.merge_evidence(docs, seen, sent)
    assert rows(out, "topic", "status", "n") == [("a", "duplicate_observed", 3), ("b", "updated", 3), ("c", "created", 1)]
    assert rows(fresh, "topic", "observation_id") == [("b", "o2"), ("c", "o1")]


def test_visible_edges(spark):
    snaps = spark.createDataFrame([("s2", "s1"), ("s1", "s0"), ("s0", None)], "snapshot_id string, base_snapshot_id string")
    refs = spark.createDataFrame([("s0", "a", "r0a"), ("s0", "b", "r0b"), ("s0", "c", "r0c"), ("s1", "a", "r1a"), ("x", "a", "rx")], "snapshot_id string, file_path string, resolution_set_id string")
    over = spark.createDataFrame([("s1", "a"), ("s2", "b")], "snapshot_id string, file_path string")
    edges = spark.createDataFrame([(s, f"e{i}") for i, s in enumerate(["r0a", "r0b", "r0c", "r1a", "rx", None])], "resolution_set_id string, edge string")
    assert [r[0] for r in rows(K.visible_edges(snaps, refs, over, edges, "s2"), "edge")] == ["e2", "e3", "e5"]
    assert [r[0] for r in rows(K.visible_edges(snaps, refs, over, edges, "s0"), "edge")] == ["e0", "e1", "e2", "e5"]


def test_scopes(spark):
    req = spark.createDataFrame([(1, "r", "dev", "main"), (2, "r", "gone", "main"), (3, "r", None, "dev"), (4, "r", None, "new"), (5, "r", None, None), (6, "z", None, "x"), (7, "r", "dev", "dev")], "request_id int, repo_id string, branch string, checked_out string")
    br = spark.createDataFrame([("r", "main", True), ("r", "dev", False)], "repo_id string, name string, live boolean")
    assert rows(K.scopes(req, br), "request_id", "branch", "resolved_by", "warning") == [
        (1, "dev", "explicit", "SCOPE_DIFFERS_FROM_CHECKOUT"), (2, None, "unresolved", "SCOPE_UNRESOLVED"), (3, "dev", "checkout", None), (4, "main", "fallback", "BRANCH_NOT_INDEXED_FALLBACK"),
        (5, "main", "fallback", "FALLBACK_LIVE_BRANCH"), (6, None, "unresolved", "SCOPE_UNRESOLVED"), (7, "dev", "explicit", None),
    ]


def test_removals(spark):
    versions = spark.createDataFrame([("a", "b1"), ("a", "b2"), ("b", "b1"), ("c", "b1")], "node_id string, branch_id string")
    edges = spark.createDataFrame([("a", "b", "b1"), ("c", "x", None)], "src string, dst string, branch_id string")
    nodes = spark.createDataFrame([(n, "r") for n in "abcx"], "node_id string, repo_id string")
    v, e, n = K.remove_branch("b1", versions, edges, nodes)
    assert rows(v, "node_id") == [("a",)] and rows(e, "src") == [("c",)] and rows(n, "node_id") == [("a",), ("c",), ("x",)]
    notes = spark.createDataFrame([("n1", "p1"), ("n2", "p2")], "node_id string, path string")
    links = spark.createDataFrame([("n2", "n1"), ("n1", "n2")], "src string, dst string")
    kept, left = K.prune_notes(notes, links, spark.createDataFrame([("p1",)], "path string"))
    assert rows(kept, "node_id") == [("n1",)] and rows(left, "src", "dst") == [("n1", "n2")]


def test_resolve_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.ts", "src/c.js", "src/c.ts", "lib/d.d.ts", "e.mts")], "file_path string")
    specs = [("./a", "src/a.ts"), ("../src/a", "src/a.ts"), ("./b", "src/b/index.ts"), ("./c.js", "src/c.ts"), ("./c", "src/c.ts"), ("../lib/d", "lib/d.d.ts"), ("../e.mjs", "e.mts"), ("react", None), ("../../out", None), ("./none", None)]
    imports = spark.createDataFrame([(1, "src/main.ts", s) for s, _ in specs], "doc_id long, file_path string, spec string")
    assert rows(K.resolve_imports(imports, files), "spec", "target") == sorted(specs, key=repr)


def test_symbols(spark):
    ts = "export class Ctrl {\n  get(a: number) {\n    return get(a);\n  }\n  get(b: string) {\n    return 1;\n  }\n}\nfunction helper(x) {\n  if (x) {\n    return 1;\n  }\n}\n"
    py = "class A:\n    def f(self):\n        return 1\n\ndef f():\n    return 2\n"
    got = {r.qualified_name: r for r in symbols(spark.createDataFrame([(1, "a.ts", ts), (2, "b.py", py), (3, "c.ts", None)], "doc_id long, file_path string, text string")).collect()}
    assert {n: (r.kind, r.start_line, r.end_line) for n, r in got.items()} == {"Ctrl": ("class", 1, 8), "Ctrl.get(a:number)": ("method", 2, 4), "Ctrl.get(b:string)": ("method", 5, 7), "helper": ("function", 9, 13), "A": ("class", 1, 3), "A.f": ("def", 2, 3), "f": ("def", 5, 6)}
    assert got["helper"].signature == "function helper(x) {"
    renamed = definitions("a.ts", ts.replace("helper", "other"))
    assert got["helper"].body_hash == next(d[5] for d in renamed if d[0] == "other")


def test_files_without_definitions():
    assert definitions("a.ts", "") == definitions("a.ts", "just words; and (braces) {") == []


def test_no_group_is_gathered():
    import inspect

    assert "collect_list" not in inspect.getsource(K) and F is not None


def test_snapshot_chain_tells_of_cycles_and_depth(spark):
    snaps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "snapshot_id string, base_snapshot_id string")
    assert rows(K.snapshot_chain(snaps, "a"), "snapshot_id", "depth") == [("a", 0), ("b", 1), ("c", 2)] == rows(K.snapshot_chain(snaps, "a", 3), "snapshot_id", "depth")
    with pytest.raises(ValueError, match="come back"):
        K.snapshot_chain(snaps, "x")
    with pytest.raises(ValueError, match="more than"):
        K.snapshot_chain(snaps, "a", 2)


def test_long_path(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(15)] + [("n00", "n00"), ("n03", None)], "src string, dst string")
    assert [r.node_id for r in shortest_path(edges, "n00", "n15").orderBy("step").collect()] == [f"n{i:02}" for i in range(16)]
    assert shortest_path(edges, "n05", "n00").count() == 0
