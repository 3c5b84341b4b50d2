"""Flows of variables on small files."""

import pytest

from marlstone.operators import dataflow as D

FILES = [
    ("a.ts", "const cpf = request.cpf;\nconst result = lookup(cpf);\nreturn result;\n"),
    ("b.ts", "const input = request.cpf;\nreturn input;\n"),
    ("path.ts", "const cpf = request.cpf;\nconst normalized = normalize(cpf);\nif (!normalized) throw new Error('invalid');\nreturn normalized;\n"),
    ("fields.ts", "const { id: key, other } = input;\n// key in a comment\nconst { id: key } = input;\nsave({ name: key });\nthrow fail(name);\nlog(other);\n"),
    ("take.ts", "function run(first, cpf) {\n  audit.write(cpf);\n  audit.write(cpfs, first);\n}\n"),
    ("loop.ts", "const x = source;\nsend(x);\n"),
    ("empty.ts", ""),
    ("null.ts", None),
]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "file_path string, text string")


def traced(df):
    return {r.request_id: r for r in df.collect()}


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id string, file_path string, variable string")


def test_flow_in_one_file(spark, files):
    got = traced(D.data_flows(files, ask(spark, ("p", "path.ts", "cpf"), ("f", "fields.ts", "input"), ("t", "take.ts", "cpf"), ("e", "empty.ts", "x"), ("n", "null.ts", "x"), ("g", "gone.ts", "x"), ("v", "a.ts", None), ("w", "a.ts", "absent"))))
    p = got["p"]
    assert [s.kind for s in p.steps] == ["assign", "assign", "argument", "guard", "return"]
    assert [s.line for s in p.steps] == [1, 2, 2, 3, 4] and [s.status for s in p.steps].count("candidate") == 1 == len([s for s in p.steps[2:3] if s.status == "candidate"])
    assert (p.source_kind, p.source_line, p.sink_kind, p.sink_file, p.sink_line) == ("variable", 1, "return", "path.ts", 4)
    assert p.gaps == ["opaque call boundary at path.ts:2 (normalize)"] and not p.truncated and p.found
    f = got["f"]
    assert [(s.kind, s.line, s.name) for s in f.steps] == [("assign", 1, "input"), ("field", 3, "key"), ("field", 4, "name"), ("call", 5, "input")]
    assert [(s.kind, s.line, s.expression) for s in got["t"].steps] == [("assign", 1, "first, cpf"), ("argument", 1, "function run(first, cpf) {"), ("argument", 2, "audit.write(cpf);")]
    assert len(got["t"].gaps) == 2 and got["t"].sink_kind == "call"
    assert not any(got[k].found or got[k].steps or got[k].gaps for k in "engvw")


def test_steps_are_bounded(spark, files):
    r = traced(D.data_flows(files, ask(spark, ("p", "path.ts", "cpf")), most=3))["p"]
    assert len(r.steps) == 3 and r.truncated and r.sink_kind == "call"


EDGE = "seq int, from_file string, from_line int, to_file string, to_variable string, status string"


def test_verified_calls_are_followed(spark, files):
    edges = spark.createDataFrame([(2, "a.ts", 2, "path.ts", "cpf", "verified"), (1, "a.ts", 2, "b.ts", "input", "verified")], EDGE)
    r = traced(D.flows_over_calls(files, ask(spark, ("a", "a.ts", "cpf")), edges))["a"]
    assert [(s.kind, s.file_path, s.line) for s in r.steps] == [("assign", "a.ts", 1), ("assign", "a.ts", 2), ("return", "a.ts", 3), ("call", "a.ts", 2), ("assign", "b.ts", 1), ("return", "b.ts", 2)]
    assert (r.sink_file, r.sink_kind) == ("b.ts", "return") and r.steps[3].expression == "verified call -> b.ts:input"


@pytest.mark.parametrize("edge, gap", [
    ((1, "a.ts", 2, "b.ts", "input", "candidate"), "unverified inter-procedural edge at a.ts:2"),
    ((1, "a.ts", 2, "gone.ts", "input", "verified"), "verified target source unavailable at gone.ts"),
    ((1, "a.ts", 2, "b.ts", "absent", "verified"), "verified target source unavailable at b.ts"),
])
def test_other_edges_are_gaps(spark, files, edge, gap):
    r = traced(D.flows_over_calls(files, ask(spark, ("a", "a.ts", "cpf"), ("z", "gone.ts", "x")), spark.createDataFrame([edge], EDGE)))
    assert gap in r["a"].gaps and not any(s.file_path != "a.ts" for s in r["a"].steps) and not r["z"].found


def test_cycles_end(spark, files):
    edges = spark.createDataFrame([(1, "loop.ts", 2, "loop.ts", "x", "verified"), (2, "loop.ts", 2, "loop.ts", "x", "verified")], EDGE)
    r = traced(D.flows_over_calls(files, ask(spark, ("l", "loop.ts", "x")), edges))["l"]
    assert [s.kind for s in r.steps] == ["assign", "call", "assign", "call", "assign", "argument"] and not r.truncated
    r = traced(D.flows_over_calls(files, ask(spark, ("l", "loop.ts", "x")), edges, hops=1))["l"]
    assert r.truncated and [s.kind for s in r.steps].count("call") == 1


def test_requests_move_without_steps_and_ended_ones_stay(spark, files, monkeypatch):
    """Tables of the rounds hold no steps but for the one of traces, and only requests that still go on."""
    kept = []
    monkeypatch.setattr(D.Rounds, "keep", lambda self, df, keep=D.Rounds.keep: (kept.append((df.columns, (out := keep(self, df)).count())), out)[1])
    edges = spark.createDataFrame([(1, "a.ts", 2, "b.ts", "input", "verified"), (1, "b.ts", 2, "path.ts", "cpf", "verified"), (1, "path.ts", 1, "a.ts", "cpf", "candidate"), (1, "loop.ts", 2, "a.ts", "cpf", "candidate")], EDGE)
    asked = [("a", "a.ts", "cpf")] + [(f"l{i}", "loop.ts", "x") for i in range(20)]
    r = traced(D.flows_over_calls(files, ask(spark, *asked), edges))
    assert [s.file_path for s in r["a"].steps if s.kind == "call" and s.expression.startswith("verified")] == ["a.ts", "b.ts"]
    assert all("unverified inter-procedural edge at loop.ts:2" in r[f"l{i}"].gaps and r[f"l{i}"].found for i in range(20))
    assert len([c for c, _ in kept if {"steps", "more"} & {*c}]) == 1
    assert [n for c, n in kept if "been" in c] == [21, 21, 1, 1]
    got = traced(D.flows_over_calls(files, ask(spark, ("a", "a.ts", "cpf"), ("z", "gone.ts", "x")), edges, hops=0))
    assert got["a"].truncated and [s.line for s in got["a"].steps] == [1, 2, 2, 3] and not got["z"].truncated and not got["z"].found


def test_mentions(spark, files):
    got = sorted((r.request_id, r.line, r.kind, r.expression) for r in D.mentions(files, ask(spark, ("a", "a.ts", "cpf"), ("r", "a.ts", "result"), ("k", "take.ts", "run"), ("d", "a.ts", "$x"))).collect())
    assert got == [("a", 1, "definition", "request.cpf;"), ("a", 2, "use", "const result = lookup(cpf);"), ("k", 1, "call", "function run(first, cpf) {"), ("r", 2, "definition", "lookup(cpf);"), ("r", 3, "return", "return result;")]
