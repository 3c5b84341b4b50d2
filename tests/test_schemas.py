"""Gaps of schemas, folders of Markdown, canvases."""

import json

from marlstone.operators import schemas as S
from marlstone.sources import vaults as V

FIELDS = "message string, field string, type string, kind string, presence string, enum_values array<string>, map_value string"


def test_schema_walk(spark):
    fields = spark.createDataFrame([
        ("Req", "id", "string", "scalar", "implicit", None, None), ("Req", "user", "User", "message", "explicit", None, None), ("Req", "user", "User", "message", "explicit", None, None),
        ("User", "mode", "ModeEnum", "enum", "implicit", [], None), ("User", "friend", "User", "message", None, None, None), ("User", "by_name", "map", "map", "implicit", None, "Item"), ("User", "bare", "map", "map", "implicit", None, None),
        ("Item", "owner", "Req", "message", "explicit", None, None), ("Item", "kind", "E", "enum", "implicit", ["A"], None), ("Res", None, "x", "scalar", None, None, None), ("Res2", "gone", "Nowhere", "message", "explicit", None, None),
    ], FIELDS)
    methods = spark.createDataFrame([("m", "Req", "Res"), ("n", None, "Res2"), ("o", "Item", "Unknown")], "method string, request string, response string")
    walked = {(r.method, r.path): (r.depth, r.cycle) for r in S.schema_fields(methods, fields).collect()}
    assert walked["m", "request.user.by_name.owner"] == (3, True) and walked["m", "request.user.friend"] == (2, True) and walked["n", "response.gone"] == (1, False)
    assert walked["o", "request.owner.user.by_name"] == (3, True) and len(walked) == 8 + 1 + 8
    gaps = sorted(map(tuple, S.schema_gaps(methods, fields).collect()))
    assert [g for g in gaps if g[0] == "m"] == [("m", "enum_values_missing", "request.user.mode"), ("m", "map_value_type_missing", "request.user.bare"), ("m", "presence_unknown", "request.user.friend"), ("m", "response_schema_empty", "response")]
    assert [g for g in gaps if g[0] == "n"] == [("n", "request_schema_empty", "request")]
    assert ("o", "response_schema_empty", "response") in gaps
    assert S.schema_gaps(methods.limit(0), fields).count() == 0


def test_markdown_dir(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "deep" / "er").mkdir(parents=True)
    for name, text in [("a.md", "# A"), ("deep/b.MARKDOWN", "b"), ("deep/er/c.canvas", "{}"), ("deep/d.txt", "no"), ("md", "no"), ("e.mdx", "no")]:
        (root / name).write_text(text)
    files = V.read_markdown_dir(spark, str(root))
    assert sorted((r.file_path, r.text, r.byte_size) for r in files.collect()) == [("a.md", "# A", 3), ("deep/b.MARKDOWN", "b", 1), ("deep/er/c.canvas", "{}", 2)]
    n, mark = V.fingerprint(files).first()
    assert n == 3 and mark == V.fingerprint(files.repartition(3)).first()[1]
    (root / "a.md").rename(root / "a2.md")
    other = V.fingerprint(V.read_markdown_dir(spark, f"file://{root}")).first()[1]
    assert other != mark and V.fingerprint(files.limit(0)).first()[0] == 0


def test_canvases(spark):
    good = {"nodes": [{"id": "n", "type": "file", "file": "a.md"}, {"text": "hello", "x": 3}, {"id": "u", "type": "link", "url": "http://e"}, {"id": "g", "type": "group"}], "edges": [{"fromNode": "n", "toNode": "node-2", "label": "leads to"}, {"fromNode": "u", "toNode": "n", "label": ""}]}
    cases = [("v/Map.canvas", json.dumps(good)), ("bad", "{"), ("null", None), ("list", "[]"), ("part", '{"nodes": []}'), ("node", '{"nodes": [{}, 3], "edges": []}'), ("edge", '{"nodes": [{"id": "a"}], "edges": [{"fromNode": "a", "toNode": "a"}, 1]}'), ("lost", '{"nodes": [{"id": "a"}], "edges": [{"fromNode": "a", "toNode": "b"}, 1]}'), ("none", '{"nodes": [], "edges": []}')]
    got = {r.file_path: r for r in V.canvases(spark.createDataFrame(cases, "file_path string, text string")).collect()}
    assert {k: r.error for k, r in got.items()} == {"v/Map.canvas": None, "bad": "CANVAS_INVALID_JSON", "null": "CANVAS_INVALID_JSON", "list": "CANVAS_INVALID_DOCUMENT", "part": "CANVAS_INVALID_DOCUMENT", "node": "CANVAS_INVALID_NODE:1", "edge": "CANVAS_INVALID_EDGE:1", "lost": "CANVAS_EDGE_NODE_NOT_FOUND:0", "none": None}
    r = got["v/Map.canvas"]
    assert r.markdown == "---\nid: canvas:Map.canvas\ntitle: Map\ntype: canvas\n---\n\n[[a.md]]\nhello\nhttp://e\nleads to\n"
    assert [(n.id, n.type, n.x, n.width) for n in r.nodes][:2] == [("n", "file", 0.0, 200.0), ("node-2", "text", 3.0, 200.0)] and [e.id for e in r.edges] == ["edge-1", "edge-2"] and got["bad"].nodes is None
